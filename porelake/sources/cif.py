"""Crystal files as tables: a permissive parser of CIF and AIF text, symmetry expansion, and readers over folders.

Files come in through Spark's binaryFile source, so any store that Spark reads will do, and names with brackets are no
trouble as folders are listed, not globbed by file name. A file that can't be read gives a row with an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from porelake.operators import crystal

_TOKEN = re.compile(r"""'(?:[^'\n]|'(?!\s|$))*'(?=\s|$)|"(?:[^"\n]|"(?!\s|$))*"(?=\s|$)|\#[^\n]*|[^\s]+""")
_NUMBER = re.compile(r"^([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?:\(\d+\))?$")
_TERM = re.compile(r"([+-]?)(?:(\d+)/(\d+)|(\d*\.\d+|\d+\.?)|([xyz]))")

OPERATION_TAGS = ("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz")
#: Sites closer than this (Å) after expansion are the same site.
SAME_SITE = 0.01


@dataclass
class Block:
    """A data block: scalar tags and loops, each loop a list of its tags with one list of values for each row."""

    name: str
    tags: dict[str, str] = field(default_factory=dict)
    loops: list[tuple[list[str], list[list[str]]]] = field(default_factory=list)

    def column(self, tag: str) -> list[str] | None:
        for tags, rows in self.loops:
            if tag in tags:
                at = tags.index(tag)
                return [r[at] for r in rows]
        return [self.tags[tag]] if tag in self.tags else None


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """Words of a CIF text and whether each was quoted; comments are left out, `;` blocks are one word."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    i = 0
    while i < len(lines):
        if lines[i].startswith(";"):
            part = [lines[i][1:]]
            i += 1
            while i < len(lines) and not lines[i].startswith(";"):
                part.append(lines[i])
                i += 1
            yield "\n".join(part), True
            i += 1
            continue
        for m in _TOKEN.finditer(lines[i]):
            word = m[0]
            if word[0] == "#":
                break
            if len(word) > 1 and word[0] in "'\"" and word[-1] == word[0]:
                yield word[1:-1], True
            else:
                yield word, False
        i += 1


def parse(text: str) -> list[Block]:
    """The blocks of a CIF or AIF text; data before any block heading belong to a nameless block."""
    blocks: list[Block] = []
    block, tag, loop, row = Block(""), None, None, []

    def close_loop() -> None:
        nonlocal loop, row
        if loop is not None and loop[0]:
            block.loops.append((loop[0], loop[1]))
        loop, row = None, []

    for word, quoted in tokens(text):
        low = word.lower()
        if not quoted and low.startswith("data_"):
            close_loop()
            block, tag = Block(word[5:]), None
            blocks.append(block)
        elif not quoted and low == "loop_":
            close_loop()
            loop, tag = ([], []), None
        elif not quoted and word.startswith("_"):
            if loop is not None and not loop[1] and not row:
                loop[0].append(low)
            else:
                close_loop()
                tag = low
        elif loop is not None:
            row.append(word)
            if len(row) == len(loop[0]):
                loop[1].append(row)
                row = []
        elif tag is not None:
            block.tags[tag] = word
            tag = None
        if not blocks and (block.tags or block.loops):
            blocks.append(block)
    close_loop()
    return blocks if blocks else ([block] if block.tags or block.loops else [])


def number(word: str | None) -> float | None:
    """A number with its uncertainty in brackets left out; none for `.`, `?` and other text."""
    m = _NUMBER.match(word.strip()) if word else None
    return float(m[1]) if m else None


def parse_operation(text: str) -> tuple[np.ndarray, np.ndarray]:
    """`x,y,z` affine expression -> (3x3, shift)."""
    w, t = np.zeros((3, 3)), np.zeros(3)
    for k, part in enumerate(text.lower().replace(" ", "").split(",")):
        at = 0
        while at < len(part):
            m = _TERM.match(part, at)
            if not m or m.end() == at:
                raise ValueError(f"operation {text!r}")
            sign = -1.0 if m[1] == "-" else 1.0
            if m[5]:
                w[k]["xyz".index(m[5])] += sign
            else:
                t[k] += sign * (float(m[2]) / float(m[3]) if m[2] else float(m[4]))
            at = m.end()
    return w, t


def element_of(word: str) -> str:
    """The symbol that a type or label begins with, as in Zn2+ or C12."""
    m = re.match(r"[A-Za-z]{1,2}", word)
    if not m:
        raise ValueError(f"no element in {word!r}")
    from porelake.functions.elements import atomic_numbers

    two = m[0].capitalize()
    return two if two in atomic_numbers() else two[0]


def structure(block: Block, expand: bool = True) -> dict:
    """Cell, sites and operations of a block; with expand the sites that the operations make, each once."""
    size = [number(block.tags.get(f"_cell_length_{k}")) for k in "abc"] + [number(block.tags.get(f"_cell_angle_{k}")) for k in ("alpha", "beta", "gamma")]
    if None in size:
        raise ValueError("no unit cell")
    cell = crystal.lattice(*size)
    col = lambda k: block.column(f"_atom_site_{k}")
    xyz = [col(f"fract_{k}") for k in "xyz"]
    if None in xyz:
        raise ValueError("no fractional coordinates")
    n = len(xyz[0])
    labels = col("label") or [None] * n
    kinds = col("type_symbol") or labels
    charges, occupancies = col("charge") or [None] * n, col("occupancy") or [None] * n
    sites = []
    for i in range(n):
        f = [number(xyz[k][i]) for k in range(3)]
        if None not in f:
            sites.append([labels[i], element_of(kinds[i]), np.array(f), number(occupancies[i]), number(charges[i])])
    ops = next((c for t in OPERATION_TAGS if (c := block.column(t))), ["x,y,z"])
    if expand and len(ops) > 1:
        sites = expanded(cell, sites, ops)
    return {"name": block.name, "size": size, "cell": cell, "sites": sites, "operations": ops, "volume": abs(float(np.linalg.det(cell))), "sg_hm": block.tags.get("_symmetry_space_group_name_h-m") or block.tags.get("_space_group_name_h-m_alt"), "sg_number": number(block.tags.get("_symmetry_int_tables_number") or block.tags.get("_space_group_it_number"))}


def expanded(cell: np.ndarray, sites: list[list], ops: list[str]) -> list[list]:
    """Every site under every operation, brought into the cell, sites that coincide once."""
    parsed, out = [parse_operation(o) for o in ops], []
    for label, element, f, occupancy, charge in sites:
        found: list[np.ndarray] = []
        for w, t in parsed:
            g = (w @ f + t) % 1.0
            g[np.abs(g - 1.0) < 1e-6] = 0.0
            if not found or crystal.image_vectors(cell, g[None, :], np.array(found))[1].min() > SAME_SITE:
                found.append(g)
        out += [[label, element, g, occupancy, charge] for g in found]
    return out


def repair(text: str) -> str:
    """If the second line isn't a block heading, one is put before it."""
    lines = text.split("\n")
    if len(lines) > 1 and not lines[1].startswith("data_"):
        lines.insert(1, "data_struc")
    return "\n".join(lines)


STRUCTURES = "path string, checksum string, name string, block_idx int, block string, a double, b double, c double, alpha double, beta double, gamma double, lattice array<array<double>>, volume double, sg_hm string, sg_number int, n_atoms int, n_blocks int, error string, atoms array<struct<label:string,element:string,fx:double,fy:double,fz:double,occupancy:double,charge:double>>"


def read_structures(spark: SparkSession, folder: str, names: list[str] | None = None, expand: bool = True, suffix: str = ".cif") -> DataFrame:
    """A row for each block with coordinates of each file of a folder, its atoms as an array in file order.

    names keeps only those file names. A file that can't be read gives one row with its error and no atoms.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")
    if names is not None:
        wanted = spark.createDataFrame([(n,) for n in names], "file string")
        files = files.withColumn("file", F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))).join(wanted, "file", "left_semi").drop("file")
    return parse_files(files, expand)


def parse_files(files: DataFrame, expand: bool = True) -> DataFrame:
    """files (path string, content binary or string) -> STRUCTURES."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        from urllib.parse import unquote

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                data = content.encode() if isinstance(content, str) else bytes(content or b"")
                name = unquote(path.rsplit("/", 1)[-1]).replace(".cif", "")
                head = [path, hashlib.sha256(data).hexdigest(), name]
                none = [None] * 11
                try:
                    text = data.decode("utf-8", "replace")
                    found = [b for b in parse(text) if b.column("_atom_site_fract_x")]
                    if not found:
                        raise ValueError("no block with coordinates")
                    for k, block in enumerate(found):
                        s = structure(block, expand)
                        sites = [{"label": x[0], "element": x[1], "fx": float(x[2][0]), "fy": float(x[2][1]), "fz": float(x[2][2]), "occupancy": x[3], "charge": x[4]} for x in s["sites"]]
                        rows.append([*head, k, s["name"], *s["size"], s["cell"].tolist(), s["volume"], s["sg_hm"], None if s["sg_number"] is None else int(s["sg_number"]), len(sites), len(found), None, sites])
                except Exception as e:  # noqa: BLE001  a bad file is a row with an error
                    rows.append([*head, 0, None, *none[:6], None, None, None, None, 0, 0, f"{type(e).__name__}: {e}", []])
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in re.split(r", (?=[a-z_]+ )", STRUCTURES)])

    return files.select("path", "content").mapInPandas(run, STRUCTURES)


def atoms_of(structures: DataFrame) -> DataFrame:
    """Atoms as rows, with atom_idx in file order, for structures that were read; a file under two paths is two structures."""
    rows = structures.where("error is null").select(F.xxhash64("path", "checksum", "block_idx").alias("structure_id"), "name", "block_idx", "lattice", F.posexplode("atoms").alias("atom_idx", "atom"))
    return rows.select("structure_id", "name", "block_idx", "atom_idx", "atom.*", "lattice")


def precheck(structures: DataFrame) -> DataFrame:
    """(name, n_structures, labels): by file, its blocks' presence labels under <name>_<i>, or <name> if it is alone."""
    from porelake.functions.elements import CLEANING_NON_METALS
    from porelake.functions.scalars import presence_label

    metal = F.exists("atoms", lambda a: ~a["element"].isin(sorted(CLEANING_NON_METALS)))
    carbon = F.exists("atoms", lambda a: a["element"] == "C")
    key = F.when(F.col("n_blocks") > 1, F.concat("name", F.lit("_"), (F.col("block_idx") + 1).cast("string"))).otherwise(F.col("name"))
    rows = structures.where("error is null").select("path", "name", "n_blocks", F.struct("block_idx", key.alias("key"), presence_label(metal, carbon).alias("label")).alias("x"))
    by = rows.groupBy("path", "name", "n_blocks").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return by.select("name", F.col("n_blocks").alias("n_structures"), F.map_from_arrays(F.transform("x", lambda v: v["key"]), F.transform("x", lambda v: v["label"])).alias("labels"))


def relabelled(atoms: DataFrame, formula_tokens: DataFrame | None = None) -> DataFrame:
    """label becomes <element><n> by running count; with formula_tokens (structure_id, token) atoms beyond a label named there go."""
    from pyspark.sql import Window

    rows = atoms.withColumn("_n", F.row_number().over(Window.partitionBy("structure_id", "element").orderBy("atom_idx"))).withColumn("label", F.concat("element", F.col("_n").cast("string")))
    if formula_tokens is not None:
        last = formula_tokens.select("structure_id", F.regexp_extract("token", r"^([A-Z][a-z]?)(\d+)$", 1).alias("element"), F.regexp_extract("token", r"^([A-Z][a-z]?)(\d+)$", 2).cast("int").alias("_last"))
        rows = rows.join(last, ["structure_id", "element"], "left").where("_last is null or _n <= _last").drop("_last")
    return rows.drop("_n")


def read_isotherms(files: DataFrame) -> DataFrame:
    """files (path, content) of AIF text with exactly one block -> (path, loading_unit, pressure, uptake arrays of text, doubles beside, error)."""
    schema = "path string, loading_unit string, pressure array<string>, uptake array<string>, pressure_value array<double>, uptake_value array<double>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
                blocks = parse(text)
                if len(blocks) != 1:
                    rows.append([path, None, None, None, None, None, f"{len(blocks)} blocks"])
                    continue
                p, u = blocks[0].column("_adsorp_pressure") or [], blocks[0].column("_adsorp_amount") or []
                rows.append([path, blocks[0].tags.get("_units_loading"), p, u, [number(x) for x in p], [number(x) for x in u], None])
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInPandas(run, schema)


def write_text(name: str, cell_size: list[float], sites: list[tuple[str, str, float, float, float]]) -> str:
    """A P1 CIF text of (label, element, x, y, z) sites in the order given."""
    a, b, c, al, be, ga = cell_size
    head = [f"data_{name}", "_symmetry_space_group_name_H-M   'P 1'", "_symmetry_Int_Tables_number   1"]
    head += [f"_cell_length_{k}   {v:.6f}" for k, v in zip("abc", (a, b, c))] + [f"_cell_angle_{k}   {v:.6f}" for k, v in zip(("alpha", "beta", "gamma"), (al, be, ga))]
    head += ["loop_", " _symmetry_equiv_pos_as_xyz", "  'x, y, z'", "loop_", " _atom_site_type_symbol", " _atom_site_label", " _atom_site_fract_x", " _atom_site_fract_y", " _atom_site_fract_z", " _atom_site_occupancy"]
    return "\n".join([*head, *(f"  {e}  {label or e}  {x:.8f}  {y:.8f}  {z:.8f}  1.0" for label, e, x, y, z in sites)]) + "\n"
