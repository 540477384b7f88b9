"""Clusters of bonded atoms: components, formulas, and which of them cleaning keeps as framework, ion or solvent.

Clusters are found in one grouped pass for each structure; ranking and the two decision rules are also there as window
expressions over a cluster table, for data whose clusters are known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from porelake.functions import elements as E
from porelake.functions.scalars import formula_of, tokens_of
from porelake.operators import crystal
from porelake.operators.neighbours import arrays

SKIN, SKIN_STEP, ION_CHARGE = 0.25, 0.05, 0.1


def label_components(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, cluster_id): cluster_id is the smallest index of the component; atoms without bonds are their own."""

    def run(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        up = {int(i): int(i) for i in nodes["atom_idx"]}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i, j in zip(edges["i"].tolist(), edges["j"].tolist()):
            a, b = sorted((root(i), root(j)))
            up[b] = a
        ids = sorted(up)
        return pd.DataFrame({"structure_id": nodes["structure_id"].iloc[0] if len(nodes) else 0, "atom_idx": ids, "cluster_id": [root(i) for i in ids]})

    grouped = bonds.select("structure_id", "i", "j").groupBy("structure_id").cogroup(atoms.select("structure_id", "atom_idx").groupBy("structure_id"))
    return grouped.applyInPandas(run, "structure_id long, atom_idx int, cluster_id int")


def cluster_table(labelled: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, cluster_id, size, formula, charge): clusters with their formulas and summed charges; null charges count as none."""
    rows = labelled.join(atoms.select("structure_id", "atom_idx", "element", *(["charge"] if "charge" in atoms.columns else [F.lit(None).cast("double").alias("charge")])), ["structure_id", "atom_idx"])
    per_element = rows.groupBy("structure_id", "cluster_id", "element").agg(F.count(F.lit(1)).alias("n"), F.sum("charge").alias("charge"))
    part = F.concat("element", F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(""))
    return per_element.groupBy("structure_id", "cluster_id").agg(
        F.sum("n").alias("size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", part.alias("p")))), lambda x: x["p"]), "").alias("formula"),
        F.coalesce(F.sum("charge"), F.lit(0.0)).alias("charge"),
    )


def ranked(clusters: DataFrame, ties: str = "last") -> DataFrame:
    """rank by size, largest first; equal sizes in reverse order of id (`last`, the list-based rule) or in its order (`first`, the charge rule)."""
    order = F.col("cluster_id").desc() if ties == "last" else F.col("cluster_id").asc()
    return clusters.withColumn("rank", F.row_number().over(Window.partitionBy("structure_id").orderBy(F.col("size").desc(), order)))


def decide_by_list(clusters: DataFrame, ions: frozenset[str] = E.IONS) -> DataFrame:
    """decision: ion if the formula is listed; else framework if larger than half the largest that isn't an ion; else solvent."""
    ion = F.col("formula").isin(sorted(ions))
    largest = F.max(F.when(~F.col("is_ion"), F.col("size"))).over(Window.partitionBy("structure_id"))
    out = clusters.withColumn("is_ion", ion).withColumn("largest", largest)
    return out.withColumn("decision", F.when(F.col("is_ion"), "ion").when((F.col("size") == F.col("largest")) | (F.col("size") > 0.5 * F.col("largest")), "framework").otherwise("solvent")).drop("is_ion", "largest")


def decide_by_charge(clusters: DataFrame, threshold: float = ION_CHARGE) -> DataFrame:
    """decision: framework if first by rank or larger than half of it; else ion if the charge exceeds the threshold; else solvent."""
    largest = F.max("size").over(Window.partitionBy("structure_id"))
    rows = ranked(clusters, "first").withColumn("largest", largest)
    keep = (F.col("rank") == 1) | (F.col("size") > 0.5 * F.col("largest"))
    return rows.withColumn("decision", F.when(keep, "framework").when(F.abs("charge") > threshold, "ion").otherwise("solvent")).drop("rank", "largest")


def _bonded(cell: np.ndarray, frac: np.ndarray, symbols: list[str], skin: float) -> list[list[int]]:
    return crystal.near_lists(cell, frac, np.array([E.cleaning_radii()[s] for s in symbols]), 2 * skin)


def _among(near: list[list[int]], kept: list[int]) -> list[list[int]]:
    """The bonds between kept atoms, by their places in that list."""
    place = {i: k for k, i in enumerate(kept)}
    return [sorted(place[j] for j in near[i] if j in place) for i in kept]


def _by_size(parts: list[list[int]], reverse_ties: bool) -> list[list[int]]:
    if reverse_ties:
        return sorted(parts, key=len)[::-1]
    return sorted(parts, key=len, reverse=True)


def _split(parts: list[list[int]], symbols: list[str], ions: frozenset[str]) -> tuple[list[list[int]], list[list[int]], list[str]]:
    """By descending size: framework, ions, distinct solvent formulas in order."""
    main, found_ions, solvents = [], [], []
    for part in _by_size(parts, True):
        formula = formula_of(symbols[i] for i in part)
        if formula in ions:
            found_ions.append(part)
        elif not main or len(part) > 0.5 * len(main[0]):
            main.append(part)
        elif formula not in solvents:
            solvents.append(formula)
    return main, found_ions, solvents


def free_pass(near: list[list[int]], symbols: list[str], ions: frozenset[str]) -> tuple[list[int], bool, list[str]]:
    """Atoms kept when free solvent goes (framework, then ions), whether there are ions, and the solvents."""
    main, found, solvents = _split(crystal.components(near), symbols, ions)
    return [i for part in main + found for i in part], bool(found), solvents


def all_pass(near: list[list[int]], symbols: list[str], ions: frozenset[str]) -> tuple[list[int], bool, list[str]]:
    """As free_pass, and then coordinated solvent goes too: metal-oxygen bonds are cut where that frees something."""
    parts = crystal.components(near)
    main, found, solvents = _split(parts, symbols, ions)
    kept_parts = [p for p in _by_size(parts, True) if p in main or p in found]
    kept = [i for part in kept_parts for i in part]
    own_symbols = [symbols[i] for i in kept]
    own = _among(near, kept)
    metals = {i: own[i] for i, s in enumerate(own_symbols) if E.is_cleaning_metal(s)}
    cut = crystal.cut_metal_oxygen([set(x) for x in own], own_symbols, metals)
    main, found2, more = _split(crystal.components(cut), own_symbols, ions)
    order = [p for p in _by_size(main + found2, False)]
    return [kept[i] for part in order for i in part], bool(found or found2), [*solvents, *(x for x in more if x not in solvents)]


def charge_pass(near: list[list[int]], symbols: list[str], charges: list[float | None]) -> tuple[list[int], list[str], list[str], list[float]]:
    """Atoms kept (framework, ions), solvents, ion formulas and their charges, by the charge rule."""
    main, ions, solvents, formulas, sums = [], [], [], [], []
    for part in _by_size(crystal.components(near), False):
        formula, charge = formula_of(symbols[i] for i in part), sum(c for i in part if (c := charges[i]) is not None)
        if not main or len(part) > 0.5 * len(main[0]):
            main.append(part)
        elif abs(charge) > ION_CHARGE:
            ions.append(part), formulas.append(formula), sums.append(charge)
        else:
            solvents.append(formula)
    return [i for part in main + ions for i in part], solvents, formulas, sums


_CLEANED = "structure_id long, kind string, skin double, suffix string, kept array<int>, solvents string, ions string, ion_charges array<double>, error string"


def clean(atoms: DataFrame, skin: float = SKIN, ions: frozenset[str] = E.IONS, by_charge: bool = False) -> DataFrame:
    """Two rows for each structure, FSR (free solvent removed) and ASR (all removed): the skin used, name suffix, atoms kept in output order, solvents, ions.

    While a solvent's formula holds a metal, the pass is repeated with a larger skin: 0.05 more for each such formula, or
    for each pass by the charge rule, whose two kinds differ in their suffix only. Once the skin bonds every atom with every
    other, more of it changes nothing: if a metal is left in a solvent's formula then, that is the row's error. Lists are
    comma-joined, `none` if empty. A kind that fails (so, or by an unknown element) has its error and no atoms; others go on.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sid, out = rows["structure_id"].iloc[0], []
        for kind in ("FSR", "ASR"):
            try:
                cell, frac, symbols = arrays(rows)
                charges = [None if c is None or c != c else float(c) for c in rows.sort_values("atom_idx")["charge"]] if "charge" in rows else [None] * len(symbols)
                now = skin
                while True:
                    near = _bonded(cell, frac, symbols, now)
                    if by_charge:
                        kept, solvents, names, sums = charge_pass(near, symbols, charges)
                        suffix = f"_{kind}{'_ION' if names else ''}"
                    else:
                        kept, has_ions, solvents = (free_pass if kind == "FSR" else all_pass)(near, symbols, ions)
                        names, sums, suffix = [], [], f"{'_ION' if has_ions else ''}_{kind}"
                    metallic = sum(any(E.is_cleaning_metal(t) for t in tokens_of(f)) for f in solvents)
                    if not metallic:
                        break
                    if all(len(x) == len(symbols) - 1 for x in near):
                        raise ValueError(f"a metal is left in {','.join(solvents)}")
                    now = round(now + SKIN_STEP * (1 if by_charge else metallic), 10)
                out.append((sid, kind, now, suffix, kept, ",".join(solvents) or "none", ",".join(names) or "none", sums, None))
            except Exception as e:  # noqa: BLE001  one bad structure must not end the job
                out.append((sid, kind, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["structure_id", "kind", "skin", "suffix", "kept", "solvents", "ions", "ion_charges", "error"])

    return atoms.groupBy("structure_id").applyInPandas(run, _CLEANED)


def fragments_by_formula(clusters: DataFrame) -> DataFrame:
    """Of each structure the first fragment of each formula, by descending size."""
    order = Window.partitionBy("structure_id", "formula").orderBy(F.col("size").desc(), "cluster_id")
    return clusters.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def unwrap_fragments(atoms: DataFrame, factor: float = 1.4, margin: float = 2.0) -> DataFrame:
    """(structure_id, atom_idx, x, y, z, box): a fragment in one piece, walked from its first atom over bonds, centred in a cube.

    Bonds reach as far as the sum of radii times factor. Atoms that can't be reached stay where they are.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cell, frac, symbols = arrays(rows)
        radii = np.array([E.cleaning_radii()[s] for s in symbols]) * factor
        place = frac @ cell
        seen, todo = {0}, [0]
        while todo:
            i = todo.pop()
            vectors, dist = (x[0] for x in crystal.image_vectors(cell, frac[[i]], frac))
            for j in np.flatnonzero(dist < radii[i] + radii).tolist():
                if j not in seen:
                    seen.add(j)
                    place[j] = place[i] + vectors[j]
                    todo.append(j)
        box = float((place.max(axis=0) - place.min(axis=0)).max()) + margin
        place = place - place.mean(axis=0) + box / 2
        return pd.DataFrame({"structure_id": rows["structure_id"].iloc[0], "atom_idx": range(len(symbols)), "x": place[:, 0], "y": place[:, 1], "z": place[:, 2], "box": box})

    return atoms.groupBy("structure_id").applyInPandas(run, "structure_id long, atom_idx int, x double, y double, z double, box double")


def register_nodes(nodes: DataFrame, registry: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """nodes (structure_id, node_id, formula, distances array<double>) -> (structure_id, node_id, name): `<formula>_Type-<k>`.

    A node is that of the registry (formula, type_k, distances) with the same formula whose sorted pair distances are
    within the tolerance, the first by type; others get the next type in order of structure and node. One formula is one
    group, since its numbering is serial.
    """

    def run(found: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        types = [(int(k), np.sort(np.asarray(d, float))) for k, d in zip(known.get("type_k", []), known.get("distances", []))]
        types.sort(key=lambda x: x[0])
        out = []
        for row in found.sort_values(["structure_id", "node_id"]).itertuples():
            own = np.sort(np.asarray(row.distances, float))
            for k, other in types:
                if len(own) == len(other) and (not len(own) or np.abs(own - other).max() <= tolerance):
                    break
            else:
                k = max([0, *(t[0] for t in types)]) + 1
                types.append((k, own))
            out.append((row.structure_id, row.node_id, f"{row.formula}_Type-{k}"))
        return pd.DataFrame(out, columns=["structure_id", "node_id", "name"])

    return nodes.groupBy("formula").cogroup(registry.groupBy("formula")).applyInPandas(run, "structure_id long, node_id long, name string")
