"""Oxidation states: valence-bond sums, domains, and the greedy spread of charge."""

import numpy as np
import pytest

from porelake.operators import oxidation as O

ZN = O.ElementStates(chances=[0.0, 0.01, 0.99, 0, 0, 0, 0, 0, 0, 0, 0], energies=[9.39, 17.96, 39.72], known=[0, 1, 2])
FE = O.ElementStates(chances=[0.0, 0.02, 0.5, 0.45, 0.03, 0, 0, 0, 0, 0, 0], energies=[7.9, 16.2, 30.65, 54.8], known=[0, 1, 2, 3, 4, 6])
TABLE = {"Zn": ZN, "Fe": FE}


def molecule(symbols, bonds, places=None):
    return O.Molecule(symbols, np.zeros((len(symbols), 3)) if places is None else np.array(places, float), {k: v if isinstance(v, tuple) else (v, False, False) for k, v in bonds.items()})


def test_water_is_neutral_and_hydroxide_gives_one():
    water = molecule(["Zn", "O", "H", "H"], {(0, 1): "Single", (1, 2): "Single", (1, 3): "Single"})
    assert water.contributions() == [0, 0, 0, 0]
    hydroxide = molecule(["Zn", "O", "H"], {(0, 1): "Single", (1, 2): "Single"})
    assert hydroxide.contributions() == [0, 1, 0]


def test_carboxylate_shares_its_charge():
    # two Zn, each on one oxygen of a delocalised carboxylate on a methyl group
    m = molecule(["Zn", "O", "C", "O", "Zn", "C", "H", "H", "H"], {(0, 1): "Single", (1, 2): O.DELOCALISED, (2, 3): O.DELOCALISED, (3, 4): "Single", (2, 5): "Single", (5, 6): "Single", (5, 7): "Single", (5, 8): "Single"})
    assert m.sums()[1] == pytest.approx(1.5) and m.sums()[2] == pytest.approx(4.0)
    assert sum(m.contributions()) == pytest.approx(1.0)
    got = m.metal_states(TABLE)
    assert [x["inner"] for x in got] == [pytest.approx(0.5)] * 2 and got[0]["network"] == got[1]["network"]
    assert sum(x["network_state"] for x in got) == pytest.approx(1.0)


@pytest.mark.parametrize("charge", [-5, -2.5, -1, 0, 0.5, 1, 3, 4.25])
def test_charge_is_conserved(charge):
    for merge in (False, True):
        out = O.spread_charge([2.0, 2.0, 3.0], [[0, 1], [2]], [ZN, FE], charge, merge)
        assert sum(out) == pytest.approx(7 + charge)


def test_probable_states_go_first():
    # Fe 2 -> 3 is probable, Zn 2 -> 3 is not
    assert O.spread_charge([2.0, 2.0], [[0], [1]], [ZN, FE], 1, False) == [2.0, 3.0]
    assert O.distribute_outer([("Zn", 2.0), ("Zn", 2.0)], -1, TABLE) == [1.5, 1.5]
    assert O.distribute_outer([("Zn", 2.0)], 0, TABLE) == [2.0]


def test_flags():
    assert O.flags("Zn", 2.0, TABLE)["low_prob_1"] == "GOOD"
    odd = O.flags("Zn", 4.0, TABLE)
    assert odd["unknown"] == "BAD" and odd["low_prob_1"] == "LIKELY_BAD" and odd["low_prob_3"] == "BAD" and odd["noint_flag"] == "GOOD"
    assert O.flags("Zn", 0.0, TABLE)["zero_valence"] == "BAD"
    assert O.flags("Zn", 13.0, TABLE)["impossible"] == "BAD"
    # a negative state counts from the end of the list
    assert O.python_index([1, 2, 3], -1) == 3 and O.python_index([1], 4) is None
    assert O.ElementStates(chances=[0.0] * 11).likeliest == 10


def test_tables_are_read(spark, tmp_path):
    (tmp_path / "known.csv").write_text("﻿H,-1,1,,\nHe,,,,\n")
    (tmp_path / "chances.csv").write_text("Li,0,0.99,0.01\n")
    (tmp_path / "energies.csv").write_text("Ion Charge,El. Name,Ionization Energy (a) (eV)\n0,H,13.6\n0,Li,5.4\n1,Li,\n2,Li,122.4\n")
    table = O.element_states(O.read_known_states(spark, str(tmp_path / "known.csv")), O.read_state_probabilities(spark, str(tmp_path / "chances.csv")), O.read_ionization_energies(spark, str(tmp_path / "energies.csv")))
    assert table["H"].known == [-1, 1] and table["He"].known == [] and table["Li"].energies == [5.4, 122.4] and table["Li"].likeliest == 1


def test_grouped_states(spark):
    atoms = spark.createDataFrame([(7, 0, "Zn", 0.0, 0.0, 0.0), (7, 1, "O", 2.0, 0.0, 0.0), (7, 2, "H", 2.5, 0.8, 0.0)], "structure_id long, atom_idx int, element string, x double, y double, z double")
    bonds = spark.createDataFrame([(7, 0, 1, "Single", False, False), (7, 1, 2, "Single", False, False)], "structure_id long, i int, j int, bond_type string, is_conjugated boolean, is_cyclic boolean")
    row = O.metal_states(atoms, bonds, TABLE).collect()
    assert len(row) == 1 and row[0].inner == 1.0 and row[0].state == pytest.approx(1.0)


def test_three_bonded_and_two_bonded_carbon():
    arms = {(0, 1): "Single", (0, 2): "Single", (0, 3): "Single"}
    flat = [(0, 0, 0), (1, 0, 0), (-0.5, 3**0.5 / 2, 0), (-0.5, -(3**0.5) / 2, 0)]
    assert molecule(["C", "H", "H", "H"], arms, flat).contributions()[0] == -1.0  # a carbocation
    corners = [(0, 0, 0), (1, 1, 1), (1, -1, -1), (-1, 1, -1)]
    assert molecule(["C", "H", "H", "H"], arms, corners).contributions()[0] == 1.0  # a carbanion
    two = {(0, 1): "Single", (0, 2): "Single"}
    assert molecule(["C", "H", "H"], two).contributions()[0] == 2.0  # a triplet carbene
    assert molecule(["C", "N", "H"], two).contributions()[0] == 0.0  # a singlet one, beside nitrogen


def test_states_of_many_structures(spark):
    """Structures go to Python many at once, atom_idx may have gaps, and equal molecules of other ids and places keep their own rows."""
    hydroxide = [("Zn", "O", "H"), [(0, 1, "Single"), (1, 2, "Single")]]
    formate = [("Zn", "O", "C", "O", "Zn", "H"), [(0, 1, "Single"), (2, 1, O.DELOCALISED), (2, 3, O.DELOCALISED), (3, 4, "Single"), (2, 5, "Single")]]
    ions = [("Zn", "O", "Fe"), []]
    given = {n: (hydroxide, formate, ions)[n % 3] for n in range(300)}
    atoms, bonds, wanted = [], [], []
    for n, (symbols, edges) in given.items():
        step = 1 + n % 2 * 4
        atoms += [(n, k * step, s, float(n // 3 % 2), 0.0, 0.0) for k, s in enumerate(symbols)]
        bonds += [(n, i * step, j * step, kind, False, None) for i, j, kind in edges]
        states = molecule(list(symbols), {(min(i, j), max(i, j)): kind for i, j, kind in edges}).metal_states(TABLE)
        wanted += [(n, x["atom_idx"] * step, x["metal"], x["inner"], x["network"], x["state"], x["zero_valence"]) for x in states]
    atoms = spark.createDataFrame(atoms + [(None, 3, "Zn", 0.0, 0.0, 0.0), (400, 1, "O", 0.0, 0.0, 0.0)], "structure_id long, atom_idx int, element string, x double, y double, z double")
    bonds = spark.createDataFrame(bonds, "structure_id long, i int, j int, bond_type string, is_conjugated boolean, is_cyclic boolean")
    out = O.metal_states(atoms, bonds, TABLE)
    assert "CoGroups" not in out._jdf.queryExecution().toString()
    got = out.select("structure_id", "atom_idx", "metal", "inner", "network", "state", "zero_valence").collect()
    assert sorted(tuple(r) for r in got if r.structure_id is not None) == sorted(wanted)
    assert [r.atom_idx for r in got if r.structure_id is None] == [3]


def test_domains_meet_over_shared_atoms():
    # zincs on both ends of a conjugated chain, and one on a water apart from it
    single, double = ("Single", True, False), ("Double", True, False)
    m = molecule(["Zn", "O", "C", "C", "C", "O", "Zn", "Zn", "O"], {(0, 1): "Single", (1, 2): single, (2, 3): double, (3, 4): single, (4, 5): double, (5, 6): "Single", (7, 8): "Single"})
    domains = m.domains(m.contributions())
    assert domains[1] == domains[5] == {1, 2, 3, 4, 5} and domains[8] == {8}
