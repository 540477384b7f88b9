"""Neighbour search under periodic boundaries as joins, and bonds by grouped numpy.

Small structures: an equi-join on the structure with the distance as residual, images unrolled in JVM expressions. Large
ones: a cell-list key (bins at least as wide as the cutoff, each atom sent to its neighbouring bins), so the work grows with
the number of atoms.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from porelake.functions import elements as E
from porelake.functions.scalars import bond_limit, wrapped
from porelake.operators import crystal


def with_lattice(atoms: DataFrame, structures: DataFrame) -> DataFrame:
    return atoms.join(structures.select("structure_id", "lattice"), "structure_id")


_CELL = [f"l{i}{k}" for i in range(3) for k in range(3)]


def lattice_columns() -> list[Column]:
    """The lattice's entries as scalar columns, so that the images below are plain arithmetic."""
    return [F.col("lattice")[i][k].alias(f"l{i}{k}") for i in range(3) for k in range(3)]


def with_min_image(joined: DataFrame, images: int = 1) -> DataFrame:
    """Adds dist from (x1, y1, z1), (x2, y2, z2) and the lattice's columns: differences rounded to the nearest image, then the least over 27 images.

    images=0 takes the rounded difference alone, which is exact in orthogonal cells.
    """
    rows = joined.withColumns({f"d{k}": wrapped(F.col(f"{k}2") - F.col(f"{k}1")) for k in "xyz"})
    rows = rows.withColumns({f"v{k}": F.col("dx") * F.col(f"l0{k}") + F.col("dy") * F.col(f"l1{k}") + F.col("dz") * F.col(f"l2{k}") for k in range(3)})

    def squared(v, shift: list[Column] | None = None) -> Column:
        parts = [v[f"v{k}"] if shift is None else v[f"v{k}"] + shift[0] * v[f"l0{k}"] + shift[1] * v[f"l1{k}"] + shift[2] * v[f"l2{k}"] for k in range(3)]
        return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]

    if not images:
        return rows.withColumn("dist", F.sqrt(squared({f"v{k}": F.col(f"v{k}") for k in range(3)})))
    # one lambda over the images: 27 copies of the formula, pushed into a join's condition, would be too much code for one method
    shifts = F.array(*(F.array(*(F.lit(float(n)) for n in s)) for s in itertools.product((-1, 0, 1), repeat=3)))
    given = F.array(F.struct(*(f"v{k}" for k in range(3)), *_CELL))
    least = F.transform(given, lambda v: F.array_min(F.transform(shifts, lambda s: squared(v, [s[0], s[1], s[2]]))))
    return rows.withColumn("dist", F.sqrt(least[0]))


def pairs(atoms: DataFrame, images: int = 1, both: bool = False) -> DataFrame:
    """atoms (structure_id, atom_idx, element, fx, fy, fz, lattice) -> (structure_id, i, j, element_i, element_j, dist), i < j or both ways."""
    a = atoms.select("structure_id", F.col("atom_idx").alias("i"), F.col("element").alias("element_i"), F.col("fx").alias("x1"), F.col("fy").alias("y1"), F.col("fz").alias("z1"), *lattice_columns())
    b = atoms.select("structure_id", F.col("atom_idx").alias("j"), F.col("element").alias("element_j"), F.col("fx").alias("x2"), F.col("fy").alias("y2"), F.col("fz").alias("z2"))
    order = F.col("i") != F.col("j") if both else F.col("i") < F.col("j")
    return with_min_image(a.join(b, "structure_id").where(order), images).select("structure_id", "i", "j", "element_i", "element_j", "dist")


def _radii(elements: DataFrame, radius: str, side: str) -> DataFrame:
    return F.broadcast(elements.select(F.col("symbol").alias(f"element_{side}"), F.col(radius).alias(f"r_{side}")))


def cutoff_bonds(found: DataFrame, elements: DataFrame, skin: float = 0.25, radius: str = "r_csd") -> DataFrame:
    """Pairs closer than the sum of radii and twice the skin."""
    joined = found.join(_radii(elements, radius, "i"), "element_i").join(_radii(elements, radius, "j"), "element_j")
    return joined.where(F.col("dist") < F.col("r_i") + F.col("r_j") + 2 * skin).drop("r_i", "r_j")


def site_bonds(found: DataFrame, elements: DataFrame) -> DataFrame:
    """Pairs that bond by site radii and tolerance."""
    joined = found.join(_radii(elements, "r_site", "i"), "element_i").join(_radii(elements, "r_site", "j"), "element_j")
    return joined.where(F.col("dist") < bond_limit(F.col("r_i"), F.col("r_j"))).drop("r_i", "r_j")


def coordination_numbers(found: DataFrame, elements: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, cn): bonded neighbours of each atom that has any; found lists pairs both ways."""
    return site_bonds(found, elements).groupBy("structure_id", F.col("i").alias("atom_idx")).agg(F.count(F.lit(1)).alias("cn"))


def metal_neighbours(bonds: DataFrame, elements: DataFrame) -> DataFrame:
    """Bonds (both ways) whose first atom is a metal of the cleaning kind."""
    metals = F.broadcast(elements.where("is_metal_curation").select(F.col("symbol").alias("element_i")))
    return bonds.join(metals, "element_i", "left_semi")


def cell_list_pairs(atoms: DataFrame, cutoff: float) -> DataFrame:
    """pairs() closer than cutoff by a cell-list join, i < j; exact for cells at least three bins wide on an axis and others.

    Bins per axis: the cell's height over the cutoff, rounded down, at least one. The right side's atoms go to the distinct
    ones of their 27 wrapped neighbour bins, so fewer than three bins on an axis give no repeats.
    """
    atoms = atoms.select("structure_id", "atom_idx", "element", "fx", "fy", "fz", *lattice_columns())
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    row = lambda i: [F.col(f"l{i}{k}") for k in range(3)]
    faces = [cross(row(1), row(2)), cross(row(2), row(0)), cross(row(0), row(1))]
    volume = F.abs(sum((row(0)[k] * faces[0][k] for k in range(1, 3)), row(0)[0] * faces[0][0]))
    bins = [F.greatest(F.lit(1), F.floor(volume / F.sqrt(f[0] * f[0] + f[1] * f[1] + f[2] * f[2]) / cutoff)).cast("int") for f in faces]
    place = lambda f, n: F.least(F.floor((f - F.floor(f)) * n).cast("int"), n - 1)
    binned = atoms.select("*", *(b.alias(f"n{k}") for k, b in zip("xyz", bins))).select("*", *(place(F.col(f"f{k}"), F.col(f"n{k}")).alias(f"b{k}") for k in "xyz"))
    left = binned.select("structure_id", "bx", "by", "bz", F.col("atom_idx").alias("i"), F.col("element").alias("element_i"), F.col("fx").alias("x1"), F.col("fy").alias("y1"), F.col("fz").alias("z1"), *_CELL)
    near = lambda k: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col(f"b{k}") + d, F.col(f"n{k}"))))
    spread = binned.select("structure_id", F.col("atom_idx").alias("j"), F.col("element").alias("element_j"), F.col("fx").alias("x2"), F.col("fy").alias("y2"), F.col("fz").alias("z2"), F.explode(near("x")).alias("bx"), "by", "bz", "ny", "nz")
    spread = spread.withColumn("by", F.explode(near("y"))).withColumn("bz", F.explode(near("z"))).drop("ny", "nz")
    joined = left.join(spread, ["structure_id", "bx", "by", "bz"]).where("i < j")
    return with_min_image(joined).select("structure_id", "i", "j", "element_i", "element_j", "dist").where(F.col("dist") < cutoff)


def bond_order_check(found: DataFrame, atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """(structure_id, problems): overlaps, isolated atoms, carbons of a bond order sum under 3.3 or from 5.5 on, or `good`.

    found lists pairs both ways. A carbon is tested if all its neighbours have coefficients; without neighbours its sum is
    zero. Any element without a typed radius makes the whole structure `unknown`.
    """
    dim = elements.select("symbol", "r_typed", "bo_a", "bo_c")
    side = lambda s: F.broadcast(dim.select(F.col("symbol").alias(f"element_{s}"), F.col("r_typed").alias(f"r_{s}"), *([F.col("bo_a"), F.col("bo_c")] if s == "j" else [])))
    known = found.join(side("i"), "element_i").join(side("j"), "element_j")
    reach = F.col("r_i") + F.col("r_j")
    order = F.pow(F.lit(10.0), F.col("bo_a") * F.col("dist") + F.col("bo_c"))
    order = F.when(F.col("element_j") == "H", F.least(order, F.lit(1.25))).otherwise(order)
    near = F.col("dist") <= reach
    per_atom = known.groupBy("structure_id", F.col("i").alias("atom_idx")).agg(
        F.bool_or(F.col("dist") < 0.5 * reach).alias("overlap"),
        F.count_if(near).alias("n"),
        F.count_if(near & F.col("bo_a").isNull()).alias("untested"),
        F.sum(F.when(near, order)).alias("order"),
    )
    typed = F.broadcast(dim.select(F.col("symbol").alias("element"), F.col("r_typed")))
    rows = atoms.select("structure_id", "atom_idx", "element").join(typed, "element", "left").join(per_atom, ["structure_id", "atom_idx"], "left")
    total = F.coalesce("order", F.lit(0.0))
    tested = (F.col("element") == "C") & (F.coalesce("untested", F.lit(0)) == 0)
    label = F.array_compact(
        F.array(
            F.when(F.coalesce("overlap", F.lit(False)), "overlapping"),
            F.when(tested & (total < 3.3), "under_carbon").when(tested & (total >= 5.5), "over_carbon"),
            F.when(F.coalesce("n", F.lit(0)) == 0, "isolated"),
        )
    )
    by = rows.groupBy("structure_id").agg(F.bool_or(F.col("r_typed").isNull()).alias("unknown"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(label)))), ",").alias("found"))
    return by.select("structure_id", F.when(F.col("unknown"), "unknown").when(F.col("found") == "", "good").otherwise(F.col("found")).alias("problems"))


# Properties of the external checker that are bad if true, and bad if false.
BAD_IF_TRUE = ("has_atomic_overlaps", "has_overcoordinated_c", "has_overcoordinated_n", "has_overcoordinated_h", "has_suspicious_terminal_oxo", "has_undercoordinated_c", "has_undercoordinated_n", "has_lone_molecule", "has_high_charges")
BAD_IF_FALSE = ("has_metal", "has_carbon", "is_porous")


def checker_labels(checks: Column) -> Column:
    """A map of the external checker's booleans -> the names of the bad ones, sorted and comma-joined, or `good`; null is `unknown`. Missing ones are fine."""
    bad = [F.when(F.coalesce(checks[k], F.lit(False)), k) for k in BAD_IF_TRUE] + [F.when(~F.coalesce(checks[k], F.lit(True)), k) for k in BAD_IF_FALSE]
    found = F.array_join(F.array_sort(F.array_compact(F.array(*bad))), ",")
    return F.when(checks.isNull(), "unknown").when(found == "", "good").otherwise(found)


def arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A structure's lattice, fractional coordinates and symbols, in order of atom_idx."""
    rows = rows.sort_values("atom_idx")
    cell = np.array([list(map(float, r)) for r in rows["lattice"].iloc[0]])
    return cell, rows[["fx", "fy", "fz"]].to_numpy(float), rows["element"].tolist()


def primitive_cells(atoms: DataFrame) -> DataFrame:
    """Each structure's atoms in a cell without inner translations (translations only, no standard setting): atom_idx is that of the kept atom."""
    schema = "structure_id long, atom_idx int, element string, fx double, fy double, fz double, lattice array<array<double>>"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cell, frac, symbols = arrays(rows)
        small, inside, kept = crystal.primitive(cell, frac, symbols)
        return pd.DataFrame([(rows["structure_id"].iloc[0], k, symbols[k], *map(float, f), small.tolist()) for k, f in zip(kept, inside)], columns=["structure_id", "atom_idx", "element", "fx", "fy", "fz", "lattice"])

    return atoms.groupBy("structure_id").applyInPandas(run, schema)


def coordination_sequences(atoms: DataFrame, shells: int = crystal.SHELLS) -> DataFrame:
    """(structure_id, atom_idx, element, shells): sizes of the shells around every atom, comma-joined."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cell, frac, symbols = arrays(rows)
        spheres = crystal.spheres(cell, frac, symbols)
        sizes = [",".join(map(str, crystal.coordination_sequence(i, spheres, frac, shells))) for i in range(len(symbols))]
        return pd.DataFrame({"structure_id": rows["structure_id"].iloc[0], "atom_idx": range(len(symbols)), "element": symbols, "shells": sizes})

    return atoms.groupBy("structure_id").applyInPandas(run, "structure_id long, atom_idx int, element string, shells string")


def analyse_metals(atoms: DataFrame) -> DataFrame:
    """Metal sites of each structure: openness, type, ligands, t-factor, and whether a site is the first of its kind.

    A kind is the element and its six shells, apart for open and closed sites.
    """
    schema = "structure_id long, atom_idx int, metal string, type string, is_open boolean, is_unique boolean, problematic boolean, number_of_linkers int, t_factor double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cell, frac, symbols = arrays(rows)
        metals = [i for i, s in enumerate(symbols) if E.is_site_metal(s)]
        spheres = crystal.spheres(cell, frac, symbols)
        out, kinds = [], set()
        for i in metals:
            site = crystal.metal_site(cell, frac, symbols, i, spheres[i])
            kind = (site["is_open"], symbols[i], tuple(crystal.coordination_sequence(i, spheres, frac)))
            out.append(site | {"structure_id": rows["structure_id"].iloc[0], "is_unique": kind not in kinds})
            kinds.add(kind)
        return pd.DataFrame(out, columns=["structure_id", "atom_idx", "metal", "type", "is_open", "is_unique", "problematic", "number_of_linkers", "t_factor"])

    return atoms.groupBy("structure_id").applyInPandas(run, schema)
