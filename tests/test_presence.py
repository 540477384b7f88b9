"""Labels of missing elements, from all atoms of a structure."""

from porelake.plans import bindings as B
from porelake.plans.queries import QUERIES


def test_presence_counts_all_atoms(spark, monkeypatch):
    kinds = {"both": "HHHHZC", "carbon": "HHHHHC", "metal": "HHHHZH", "none": "HHHHHH"}
    atoms = spark.createDataFrame([(k, i, "Zn" if x == "Z" else x) for k, v in kinds.items() for i, x in enumerate(v)], "structure_id string, atom_idx int, element string")
    monkeypatch.setattr(B, "atoms", lambda spark, d: atoms)
    got = {r.structure_id: r.label for r in QUERIES["presence_labels"](spark, "").collect()}
    assert got == {"both": "has metal and carbon", "carbon": "missing metal", "metal": "missing carbon", "none": "missing metal and carbon"}
