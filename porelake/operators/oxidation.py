"""Oxidation states: valence-bond sums, contributions of ligands, domains, networks, and the greedy spread of charge.

Bond types, rings and conjugation come with the input (mol_bonds); the element data that are more than a small table
(known states, state probabilities, ionisation energies) are input tables too, read by read_known_states() and its like.
"""

from __future__ import annotations

import itertools
import marshal
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from porelake.functions import elements as E
from porelake.operators import crystal

#: Order of a bond in the valence-bond sum; delocalised and aromatic ones come from the delocalised system.
ORDERS = {"Single": 1.0, "Double": 2.0, "Triple": 3.0, "Quadruple": 4.0}
DELOCALISED = "Delocalised"
#: Rows that an input table of element states may have.
MOST_ELEMENTS = 200
#: Bytes of molecules that a task remembers the states of.
MEMORY_BYTES = 16 << 20
#: Least chance (per cent) of a probable next state; stand-in energies for states that are negative and beyond the known.
PROBABLE, FREE, FORBIDDEN = 1.0, 0.0, 9999.0
HETERO_CENTRES = frozenset(("C", "Si", "Ge", "Pb"))


def read_known_states(spark: SparkSession, path: str) -> DataFrame:
    """CSV without header: element and its known states, blanks between -> (element, states array<int>)."""
    lines = spark.read.text(path).select(F.split(F.regexp_replace("value", "^﻿", ""), ",").alias("v"))
    return lines.select(F.trim(F.col("v")[0]).alias("element"), F.expr("transform(filter(slice(v, 2, size(v)), x -> trim(x) != ''), x -> cast(trim(x) as int))").alias("states")).where("element != ''")


def read_state_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """CSV without header: element and the chance of states 0, 1, ... -> (element, chances array<double>)."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("v"))
    return lines.select(F.trim(F.col("v")[0]).alias("element"), F.expr("transform(slice(v, 2, size(v)), x -> cast(trim(x) as double))").alias("chances")).where("element != ''")


def read_ionization_energies(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: charge, element, energy -> (element, energies array<double>): those given, by charge; blanks move later ones down."""
    rows = spark.read.csv(path, schema="charge int, element string, energy double", header=True)
    found = rows.where("energy is not null").groupBy("element").agg(F.array_sort(F.collect_list(F.struct("charge", "energy"))).alias("e"))
    return found.select("element", F.transform("e", lambda x: x["energy"]).alias("energies"))


def highest_known(states: Column) -> Column:
    return F.array_max(states)


def most_probable_state(chances: Column) -> Column:
    """The index of the largest chance, the last among equals; with nothing but zeros the last index."""
    return (F.size(chances) - F.array_position(F.reverse(chances), F.array_max(chances))).cast("int")


def expected_contribution(vbs: Column, valence: Column) -> Column:
    """Contribution of an atom that isn't a metal, before special cases: by its valence-bond sum and valence electrons."""
    free = 4 - F.abs(4 - valence)
    over = vbs - free
    step = F.when(over <= 2, 2).when(over <= 4, 4).when(over <= 6, 6).otherwise(8)
    return F.when(vbs <= free, free - vbs).when(vbs < valence, vbs + (valence - free - step) - valence).otherwise(vbs - valence)


def formal_charge(vbs: Column, valence: Column) -> Column:
    """The octet rule's charge, valence expanded by two at a time."""
    return -expected_contribution(vbs, valence)


def valence_bond_sums(bonds: DataFrame, metals: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, vbs) over mol_bonds both ways; bonds with metals count nothing, delocalised ones by their system.

    bonds: (structure_id, i, j, bond_type, delocalised_order); metals: (structure_id, atom_idx).
    """
    m = metals.select("structure_id", F.col("atom_idx").alias("j"), F.lit(True).alias("_m"))
    order = F.when(F.col("_m"), 0.0).when(F.col("bond_type").isin(DELOCALISED, "Aromatic"), F.coalesce("delocalised_order", F.lit(0.0)))
    for kind, value in ORDERS.items():
        order = order.when(F.col("bond_type") == kind, value)
    return bonds.join(m, ["structure_id", "j"], "left").groupBy("structure_id", F.col("i").alias("atom_idx")).agg(F.sum(order.otherwise(0.0)).alias("vbs"))


def metal_contacts(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, cn, bridging): neighbours that aren't metals, and that are."""
    kinds = atoms.select("structure_id", F.col("atom_idx").alias("j"), "is_metal")
    return bonds.join(kinds, ["structure_id", "j"]).groupBy("structure_id", F.col("i").alias("atom_idx")).agg(F.count_if(~F.col("is_metal")).alias("cn"), F.count_if("is_metal").alias("bridging"))


def ligand_pairs(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, metal_idx, ligand_idx): bonded pairs of a metal and another atom."""
    kinds = atoms.select("structure_id", "atom_idx", "is_metal")
    i = kinds.select("structure_id", F.col("atom_idx").alias("i"), F.col("is_metal").alias("mi"))
    j = kinds.select("structure_id", F.col("atom_idx").alias("j"), F.col("is_metal").alias("mj"))
    return bonds.join(i, ["structure_id", "i"]).join(j, ["structure_id", "j"]).where("mi and not mj").select("structure_id", F.col("i").alias("metal_idx"), F.col("j").alias("ligand_idx"))


def unique_sites(atoms: DataFrame, asymmetric: DataFrame, degrees: DataFrame) -> DataFrame:
    """Atoms on the asymmetric unit's coordinates, one for each place and label: the one with most neighbours, then the first."""
    place = ["structure_id", "fx", "fy", "fz"]
    rows = atoms.join(asymmetric.select(*place).distinct(), place, "left_semi").join(degrees.select("structure_id", "atom_idx", "degree"), ["structure_id", "atom_idx"], "left")
    order = Window.partitionBy(*place, "label").orderBy(F.coalesce("degree", F.lit(0)).desc(), "atom_idx")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def spread_to_duplicates(values: DataFrame, atoms: DataFrame) -> DataFrame:
    """values (structure_id, label, value) to every atom of the label."""
    return atoms.join(values, ["structure_id", "label"], "left")


def domain_contributions(domains: DataFrame) -> DataFrame:
    """domains (structure_id, site_idx, member_idx, contribution, is_binding) -> (structure_id, site_idx, contribution): a domain's sum over its binding sites."""
    return domains.groupBy("structure_id", "site_idx").agg((F.sum("contribution") / F.count_if("is_binding")).alias("contribution"))


def outer_sphere_charge(atoms: DataFrame, domains: DataFrame) -> DataFrame:
    """(structure_id, charge): contributions of atoms that are in no domain and no metals."""
    inside = domains.select("structure_id", F.col("member_idx").alias("atom_idx")).distinct()
    return atoms.where("not is_metal").join(inside, ["structure_id", "atom_idx"], "left_anti").groupBy("structure_id").agg(F.sum("contribution").alias("charge"))


def python_index(values: list[float], at: int) -> float | None:
    """values[at] with negative places from the end; None out of range."""
    return values[at] if -len(values) <= at < len(values) else None


@dataclass
class ElementStates:
    """What is known of a metal's states: chances by state, ionisation energies by charge, highest and known states."""

    chances: list[float] = field(default_factory=list)
    energies: list[float] = field(default_factory=list)
    known: list[int] = field(default_factory=list)

    @property
    def highest(self) -> int:
        return max(self.known, default=0)

    @property
    def likeliest(self) -> int:
        best = max(self.chances, default=0.0)
        return max((i for i, p in enumerate(self.chances) if p >= best), default=0)

    def probable(self, state: float, step: int) -> bool:
        return 100 * (python_index(self.chances, math.floor(state) + step) or 0.0) >= PROBABLE

    def energy_up(self, state: float) -> float:
        """What the next oxidation costs."""
        if state < 0:
            return FREE
        if state >= self.highest:
            return FORBIDDEN
        return python_index(self.energies, math.floor(state)) or FREE

    def energy_down(self, state: float) -> float:
        """What the last oxidation cost: of a fractional state the one it is in the middle of."""
        if state <= 0:
            return FREE
        if state > self.highest:
            return FORBIDDEN
        rest = state % 1
        whole = min(rest, 1 - rest) <= 1e-4
        return python_index(self.energies, math.floor(state) - (1 if whole else 0)) or FREE


def spread_charge(states: list[float], groups: list[list[int]], elements: list[ElementStates], charge: float, merge_ties: bool) -> list[float]:
    """Adds or removes charge one level at a time until none is left.

    groups are the sets of atoms that move together, in order, with the element of each. Groups whose next state is
    probable come first; among them adding takes the least next energy and removing the largest last one, the first among
    equals, or all of them with merge_ties. A rest smaller than the atoms is split evenly.
    """
    now = list(states)
    while abs(charge) > 1e-12:
        up = charge > 0
        step = 1 if up else -1
        probable = [g for g in range(len(groups)) if elements[g].probable(now[groups[g][0]], step)]
        found = probable or list(range(len(groups)))
        if not found:
            break
        cost = {g: (elements[g].energy_up if up else elements[g].energy_down)(now[groups[g][0]]) for g in found}
        best = (min if up else max)(cost.values())
        chosen = [g for g in found if cost[g] == best]
        moved = [a for g in (chosen if merge_ties else chosen[:1]) for a in groups[g]]
        if abs(charge) >= len(moved):
            for a in moved:
                now[a] += step
            charge -= step * len(moved)
        else:
            for a in moved:
                now[a] += charge / len(moved)
            charge = 0
    return now


def distribute_networks(metals: list[tuple[str, float, int]], table: dict[str, ElementStates]) -> list[float]:
    """metals (element, inner state, network) -> states: each network starts at its likeliest states and takes up what the inner states leave."""
    out = [0.0] * len(metals)
    networks: dict[int, list[int]] = defaultdict(list)
    for k, (_, _, network) in enumerate(metals):
        networks[network].append(k)
    for members in networks.values():
        start = {k: float(table[metals[k][0]].likeliest) for k in members}
        kinds: dict[str, list[int]] = defaultdict(list)
        for n, k in enumerate(members):
            kinds[metals[k][0]].append(n)
        rest = sum(metals[k][1] for k in members) - sum(start.values())
        spread = spread_charge([start[k] for k in members], list(kinds.values()), [table[e] for e in kinds], rest, False)
        for k, state in zip(members, spread):
            out[k] = state
    return out


def distribute_globally(metals: list[tuple[str, float]], table: dict[str, ElementStates]) -> list[float]:
    """The same with all metals of a structure as one network."""
    return distribute_networks([(e, s, 0) for e, s in metals], table)


def distribute_outer(metals: list[tuple[str, float]], charge: float, table: dict[str, ElementStates]) -> list[float]:
    """(element, state) -> states after an outer-sphere charge is spread over single atoms, equal energies together."""
    return spread_charge([s for _, s in metals], [[k] for k in range(len(metals))], [table[e] for e, _ in metals], charge, True) if charge else [s for _, s in metals]


def flags(element: str, state: float, table: dict[str, ElementStates]) -> dict[str, str]:
    """Verdicts on a metal's state. Negative whole states count from the end of the list of chances."""
    known = table[element]
    out = dict.fromkeys(("impossible", "unknown", "zero_valence", "noint_flag", "low_prob_1", "low_prob_2", "low_prob_3", "low_prob_multi"), "GOOD")
    if state > E.valence_electrons(element):
        out["impossible"] = "BAD"
    if state == 0:
        out["zero_valence"] = "BAD"
    if not any(abs(state - k) <= max(0.5, 1e-9 * max(abs(state), abs(k))) for k in known.known):
        out["unknown"] = "BAD"
    if state % 1 <= 1e-4:
        chance = python_index(known.chances, round(state)) or 0.0
        for name, limit, verdict in (("low_prob_1", 0.01, "LIKELY_BAD"), ("low_prob_2", 0.001, "BAD"), ("low_prob_3", 0.0001, "BAD")):
            if chance < limit:
                out[name] = verdict
    return out


@dataclass
class Molecule:
    """One structure's bond graph: symbols, cartesian coordinates, bonds as (i, j) -> (type, conjugated, cyclic)."""

    symbols: list[str]
    places: np.ndarray
    bonds: dict[tuple[int, int], tuple[str, bool, bool]]
    ring_sums: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.near: list[list[int]] = [[] for _ in self.symbols]
        for i, j in sorted(self.bonds):
            self.near[i].append(j)
            self.near[j].append(i)
        self.metal = [E.is_site_metal(s) for s in self.symbols]

    def kind(self, i: int, j: int) -> str:
        return self.bonds[(i, j) if (i, j) in self.bonds else (j, i)][0]

    def kinds(self, i: int) -> set[str]:
        return {self.kind(i, j) for j in self.near[i]}

    def delocalised_orders(self) -> dict[int, float]:
        """Of each atom in a delocalised system: (T + 1) / T at an end with T ends, (c + 1) / c at a node of c neighbours."""
        out: dict[int, float] = {}
        linked = [[j for j in self.near[i] if self.kind(i, j) == DELOCALISED] for i in range(len(self.symbols))]
        for part in crystal.components(linked):
            if len(part) < 2:
                continue
            inside, ends = set(part), sum(len(linked[i]) == 1 for i in part)
            for i in part:
                n = sum(j in inside for j in self.near[i])
                out[i] = (ends + 1) / ends if n == 1 and ends else (n + 1) / n if n else 0.0
        return out

    def sums(self) -> list[float]:
        """Valence-bond sums; metals have none, and bonds with them count nothing."""
        deloc, out = self.delocalised_orders(), []
        for i in range(len(self.symbols)):
            if self.metal[i]:
                out.append(0.0)
            elif i in self.ring_sums:
                out.append(self.ring_sums[i])
            else:
                kinds = [self.kind(i, j) for j in self.near[i] if not self.metal[j]]
                out.append(sum(deloc.get(i, 0.0) if k in (DELOCALISED, "Aromatic") else ORDERS.get(k, 0.0) for k in kinds))
        return out

    def mean_angle(self, i: int) -> float:
        arms = [self.places[j] - self.places[i] for j in self.near[i] if not self.metal[j]][:3]
        return sum(crystal.true_angle(a, b) for a, b in itertools.combinations(arms, 2)) / 3

    def geometry(self, i: int) -> str | None:
        """Which of a tetrahedron and a plane of three the mean of the three angles is nearer to."""
        angle = self.mean_angle(i)
        tetrahedral, trigonal = abs(angle - 109.5), abs(angle - 120)
        return "tetrahedral" if tetrahedral < trigonal else "trigonal" if trigonal < tetrahedral else None

    def singlet_carbene(self, i: int) -> bool:
        """Next to a hetero atom, or in a ring that has one."""
        if any(self.symbols[j] not in ("C", "H") for j in self.near[i] if not self.metal[j]):
            return True
        return any(c for j in self.near[i] for c in [self.bonds[(i, j) if (i, j) in self.bonds else (j, i)][2]] if c) and self._ring_hetero(i)

    def _ring_hetero(self, i: int) -> bool:
        for a, b in itertools.combinations([j for j in self.near[i] if not self.metal[j]], 2):
            todo, before = [a], {a: None, i: None}
            while todo:
                at = todo.pop(0)
                if at == b:
                    while at is not None:
                        if self.symbols[at] != "C":
                            return True
                        at = before[at]
                    break
                for n in self.near[at]:
                    if n not in before and not self.metal[n]:
                        before[n] = at
                        todo.append(n)
        return False

    def contributions(self) -> list[float]:
        """Contribution of each atom to the metals' states."""
        out = []
        for i, (symbol, vbs) in enumerate(zip(self.symbols, self.sums())):
            if self.metal[i]:
                out.append(0.0)
                continue
            valence = E.valence_electrons("H" if symbol == "D" else symbol)
            free = 4 - abs(4 - valence)
            cn = sum(not self.metal[j] for j in self.near[i])
            if vbs <= free:
                value = free - vbs
            elif vbs < valence:
                over = vbs - free
                value = vbs + (valence - free - (2 if over <= 2 else 4 if over <= 4 else 6 if over <= 6 else 8)) - valence
            else:
                value = vbs - valence
            if symbol in HETERO_CENTRES:
                if vbs == 3 and cn == 3 and i not in self.ring_sums:
                    value = {"trigonal": -1.0, "tetrahedral": 1.0}.get(self.geometry(i), value)
                if vbs == 2 and cn == 2:
                    value = 0.0 if self.singlet_carbene(i) else 2.0
            if symbol == "N" and vbs == 5 and cn == 3 and sum(self.symbols[j] == "O" for j in self.near[i]) == 2 and self.geometry(i) == "trigonal":
                value = 0.0
            out.append(float(value))
        return out

    def domains(self, contributions: list[float]) -> dict[int, set[int]]:
        """The binding domain of each atom next to a metal: what aromatic bonds reach, or else what conjugation and the like reach; overlapping ones are joined."""
        out: dict[int, set[int]] = {}
        for site in range(len(self.symbols)):
            if self.metal[site] or not any(self.metal[j] for j in self.near[site]):
                continue
            aromatic = "Aromatic" in self.kinds(site)
            steps = self._near_steps(site)
            part, todo = {site}, [site]
            while todo:
                at = todo.pop(0)
                for j in self.near[at]:
                    if j in part or self.metal[j]:
                        continue
                    kinds = self.kinds(j)
                    if aromatic:
                        reach = "Aromatic" in kinds
                    else:
                        kind, conjugated, _ = self.bonds[(at, j) if (at, j) in self.bonds else (j, at)]
                        reach = "Aromatic" not in kinds and (
                            j in steps or kind == DELOCALISED or conjugated or (kind == "Single" and contributions[j] != 0) or not kinds & {"Single", "Aromatic", DELOCALISED}
                        )
                    if reach:
                        part.add(j)
                        todo.append(j)
            out[site] = part
        sites = list(out)
        holders: dict[int, list[int]] = defaultdict(list)
        for n, site in enumerate(sites):
            for atom in out[site]:
                holders[atom].append(n)
        linked: list[set[int]] = [set() for _ in sites]
        for of in holders.values():
            for a, b in zip(of, of[1:]):
                linked[a].add(b)
                linked[b].add(a)
        for group in crystal.components(linked):
            if len(group) == 1:
                continue
            union = set().union(*(out[sites[k]] for k in group))
            for k in group:
                out[sites[k]] = union
        return out

    def _near_steps(self, start: int) -> set[int]:
        """What is at most two bonds from start, over metals too."""
        return {start, *self.near[start], *(j for i in self.near[start] for j in self.near[i])}

    def hapto(self, ligand: int, metal: int) -> bool:
        """Whether some neighbour of the ligand that isn't a metal binds the same metal."""
        return any(not self.metal[j] and metal in self.near[j] for j in self.near[ligand])

    def networks(self, domains: dict[int, set[int]], binding: dict[int, float]) -> list[list[int]]:
        """Metals joined by metal-metal bonds or by a charged domain."""
        metals = [i for i, m in enumerate(self.metal) if m]
        at = {m: n for n, m in enumerate(metals)}
        linked: list[set[int]] = [set() for _ in metals]
        for m in metals:
            for j in self.near[m]:
                if self.metal[j]:
                    linked[at[m]].add(at[j])
                elif j in domains and binding[j] != 0:
                    for d in domains[j]:
                        if d in domains:
                            for other in self.near[d]:
                                if self.metal[other] and other != m:
                                    linked[at[m]].add(at[other])
                                    linked[at[other]].add(at[m])
        return [[metals[n] for n in part] for part in crystal.components(linked)]

    def metal_states(self, table: dict[str, ElementStates]) -> list[dict]:
        """Every metal's inner, network and final state, effective coordination number, and flags."""
        metals = [i for i, m in enumerate(self.metal) if m]
        own = self.contributions()
        domains = self.domains(own)
        binding = {s: sum(own[k] for k in part) / sum(k in domains for k in part) for s, part in domains.items()}
        inner, cn = {}, {}
        for m in metals:
            ligands = [j for j in self.near[m] if not self.metal[j]]
            cn[m] = sum(0.5 if self.hapto(j, m) else 1.0 for j in ligands) + 0.5 * sum(self.metal[j] for j in self.near[m])
            inner[m] = 0.0
            for j in ligands:
                share = binding[j] / sum(self.metal[k] for k in self.near[j])
                inner[m] += share
                cn[m] += (share >= 2) + (share >= 3)
        networks = self.networks(domains, binding)
        number = {m: n for n, part in enumerate(networks) for m in part}
        spread = distribute_networks([(self.symbols[m], inner[m], number[m]) for m in metals], table)
        inside = set().union(*domains.values()) if domains else set()
        outer = sum(own[i] for i in range(len(self.symbols)) if not self.metal[i] and i not in inside)
        final = distribute_outer([(self.symbols[m], s) for m, s in zip(metals, spread)], outer, table)
        return [{"atom_idx": m, "metal": self.symbols[m], "inner": inner[m], "cn": cn[m], "network": number[m], "network_state": s, "state": f, **flags(self.symbols[m], f, table)} for m, s, f in zip(metals, spread, final)]


_STATES = "structure_id long, atom_idx int, metal string, inner double, cn double, network int, network_state double, state double, impossible string, unknown string, zero_valence string, noint_flag string, low_prob_1 string, low_prob_2 string, low_prob_3 string, low_prob_multi string"


def _slices(lists: pa.ListArray) -> tuple[list[int], list[pa.Array]]:
    """Where each row's list begins and ends, and the fields of all lists' structs one after the other."""
    cuts = lists.offsets.to_numpy()
    return (cuts - cuts[0]).tolist(), lists.flatten().flatten()


def metal_states(atoms: DataFrame, bonds: DataFrame, states: dict[str, ElementStates]) -> DataFrame:
    """Oxidation states and flags of every metal. atoms (structure_id, atom_idx, element, x, y, z); bonds (structure_id, i, j, bond_type, is_conjugated, is_cyclic).

    i and j are atom_idx, which may have gaps. The work of one structure is sequential, so a structure is one row of lists,
    and many structures go to Python at once; a task works out equal molecules once. Structures without metals give no
    rows. states is a table of about a hundred elements and goes to each task.
    """
    columns = [c.split() for c in _STATES.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(name, arrow[kind]) for name, kind in columns])
    names = [name for name, _ in columns[1:]]

    def found(idx: list[int], symbols: list[str], places: np.ndarray, edges: list[tuple]) -> list[tuple]:
        at = {x: k for k, x in enumerate(idx)}
        linked = {tuple(sorted((at[i], at[j]))): (kind, bool(conjugated), bool(cyclic)) for i, j, kind, conjugated, cyclic in edges}
        made = Molecule(symbols, places, linked).metal_states(states)
        return [tuple(x[name] for name in names) for x in ({**x, "atom_idx": idx[x["atom_idx"]]} for x in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[tuple]] = {}
        held = 0
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            cuts, fields = _slices(batch.column(1))
            idx, symbols = fields[0].to_pylist(), fields[1].to_pylist()
            places = np.column_stack([f.to_numpy(zero_copy_only=False).astype(float) for f in fields[2:]])
            ends, of_bonds = _slices(batch.column(2))
            edges = list(zip(*(f.to_pylist() for f in of_bonds)))
            for n, structure in enumerate(ids):
                a, b = cuts[n], cuts[n + 1]
                molecule = idx[a:b], symbols[a:b], places[a:b], edges[ends[n] : ends[n + 1]]
                # version 2 has no references, so equal molecules are equal bytes
                key = marshal.dumps((*molecule[:2], molecule[2].tobytes(), molecule[3]), 2)
                if (rows := known.get(key)) is None:
                    rows = found(*molecule)
                    if held > MEMORY_BYTES:
                        known.clear()
                        held = 0
                    known[key] = rows
                    held += len(key) + 500 * (len(rows) + 1)
                out.extend((structure, *r) for r in rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

    atom = F.struct(F.col("atom_idx").cast("int"), F.col("element").cast("string"), *(F.col(c).cast("double") for c in "xyz"))
    bond = F.struct(F.col("i").cast("int"), F.col("j").cast("int"), F.col("bond_type").cast("string"), "is_conjugated", "is_cyclic")
    parts = atoms.select(F.col("structure_id").cast("long"), atom.alias("atom")).unionByName(bonds.select(F.col("structure_id").cast("long"), bond.alias("bond")), allowMissingColumns=True)
    # a number of partitions is given, as few bytes would be coalesced into one task though each structure costs much
    n = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = parts.repartition(n, "structure_id").groupBy("structure_id").agg(F.sort_array(F.collect_list("atom")).alias("atoms"), F.sort_array(F.collect_list("bond")).alias("bonds"))
    return lists.where(F.size("atoms") > 0).mapInArrow(run, _STATES)


def element_states(known: DataFrame, chances: DataFrame, energies: DataFrame) -> dict[str, ElementStates]:
    """The three input tables as one dict; each has a row for each element. Tables of over MOST_ELEMENTS rows are an error."""
    joined = known.join(chances, "element", "full_outer").join(energies, "element", "full_outer")
    if (n := joined.count()) > MOST_ELEMENTS:
        raise ValueError(f"{n} rows of element states, more than there are elements ({MOST_ELEMENTS})")
    rows = joined.collect()
    return {r.element: ElementStates(list(r.chances or []), list(r.energies or []), list(r.states or [])) for r in rows}
