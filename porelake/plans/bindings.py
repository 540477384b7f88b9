"""The driver's tables seen as the data model: sites, collections, atoms, predictions, metadata; in Spark and, as text, in DuckDB.

One text serves both engines; the few functions that have two names stand in it as @NAME.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from porelake.functions import elements as E

_SPARK = {"SHA": "sha2({0}, 256)", "LIST": "array({0})", "AT": "element_at({0})", "SEQ": "explode(sequence({0}))", "RINT": "rint({0})", "EMB": "CAST(embedding[{0}] AS DOUBLE)"}
_DUCK = {"SHA": "sha256({0})", "LIST": "list_value({0})", "AT": "list_extract({0})", "SEQ": "unnest(generate_series({0}))", "RINT": "round_even({0}, 0)", "EMB": "CAST(embedding[({0}) + 1] AS DOUBLE)"}

SITES = """SELECT l_orderkey AS name, l_linenumber AS site_idx, l_returnflag || l_linestatus AS metal, l_suppkey % 3 <> 0 AS is_unique, l_discount >= 0.05 AS is_open, l_tax >= 0.07 AS problematic,
    l_linenumber AS number_of_linkers, CASE WHEN l_linenumber BETWEEN 4 AND 6 THEN (CAST(round(l_extendedprice * 100) AS BIGINT) % 997) / CAST(997 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS t_factor FROM lineitem"""

COLLECTION = """SELECT p_partkey AS name, @SHA(p_name || '-' || CAST(p_size AS STRING)) AS checksum, '/data/' || p_brand || '/' || CAST(p_partkey AS STRING) || '.cif' AS path,
    CASE WHEN p_partkey % 17 = 0 THEN CAST(0 AS DOUBLE) WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS density, CAST(p_size AS DOUBLE) AS uc_volume,
    CASE WHEN p_partkey % 7 = 0 THEN @LIST('Zn', 'Cu') WHEN p_partkey % 5 = 0 THEN @LIST('Fe') ELSE @LIST('Zn') END AS metal_species,
    @LIST('C', 'H', 'O') AS non_metal_species, p_partkey % 11 <> 0 AS cif_okay, p_size % 2 = 0 AS has_oms, p_size * 3 AS n_atoms FROM part"""

RESULTS = """SELECT p_partkey AS name, @SHA(p_name || '-' || CAST(CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS STRING)) AS checksum, p_partkey % 10 = 0 AS running FROM part WHERE p_partkey % 2 = 0"""

ATOMS = """SELECT structure_id, atom_idx, @AT(@LIST('C', 'H', 'O', 'N', 'Zn'), CAST((atom_idx + label) % 5 + 1 AS INT)) AS element, x + 0.5e0 - floor(x + 0.5e0) AS fx, y + 0.5e0 - floor(y + 0.5e0) AS fy, z + 0.5e0 - floor(z + 0.5e0) AS fz,
    CAST(8 + label AS DOUBLE) AS a, q * (atom_idx % 3 - 1) AS charge FROM
    (SELECT structure_id, atom_idx, label, @EMB(3 * atom_idx) AS x, @EMB(3 * atom_idx + 1) AS y, @EMB(3 * atom_idx + 2) AS z, @EMB(63) AS q FROM (SELECT vec_id AS structure_id, label, embedding, @SEQ(0, 20) AS atom_idx FROM embeddings) e) v"""

PREDICTED_SITES = """SELECT l_orderkey AS structure_id, l_linenumber AS site_idx, l_quantity AS f1, l_discount AS f2, l_tax AS f3, 1 + l_quantity AS mass FROM lineitem"""

METADATA = """SELECT o_orderkey AS doi_key, CASE o_orderkey % 9 WHEN 0 THEN '10.1021' WHEN 1 THEN '10.1039' WHEN 2 THEN '10.1002' WHEN 3 THEN '10.1038' WHEN 4 THEN '10.1126' WHEN 5 THEN '10.1016' WHEN 6 THEN 'unknown' WHEN 7 THEN '10.9999' ELSE NULL END || '/x' || CAST(o_orderkey AS STRING) AS doi,
    '{"message": {' || CASE o_orderkey % 4 WHEN 0 THEN '"published-online": {"date-parts": [[' || CAST(year(o_orderdate) AS STRING) || ',' || CAST(month(o_orderdate) AS STRING) || ',' || CAST(day(o_orderdate) AS STRING) || ']]}'
        WHEN 1 THEN '"published-print": {"date-parts": [[' || CAST(year(o_orderdate) AS STRING) || ',' || CAST(month(o_orderdate) AS STRING) || ']]}'
        WHEN 2 THEN '"license": [{"start": {"date-parts": [[' || CAST(year(o_orderdate) AS STRING) || ']]}}]' ELSE '' END || '}}' AS metadata FROM orders"""


def render(text: str, names: dict[str, str]) -> str:
    """Replaces @NAME(...) from the inside out."""
    pattern = re.compile(r"@([A-Z]+)\(([^@()]*(?:\([^@()]*(?:\([^@()]*\)[^@()]*)*\)[^@()]*)*)\)")
    while m := pattern.search(text):
        text = text[: m.start()] + names[m[1]].format(m[2]) + text[m.end() :]
    return text


def duck(text: str) -> str:
    return render(text, _DUCK).replace(" AS STRING)", " AS VARCHAR)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A binding's text over the tables that it names."""
    names = [n for n in ("lineitem", "orders", "part", "embeddings", "events", "documents", "labels", "customer", "supplier", "pages") if re.search(rf"\bFROM {n}\b", text)]
    sql = render(text, _SPARK).replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", sql)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The atoms binding with its cubic lattices as arrays."""
    rows = bound(spark, sf_dir, ATOMS)
    zero = "CAST(0 AS DOUBLE)"
    return rows.selectExpr("*", f"array(array(a, {zero}, {zero}), array({zero}, a, {zero}), array({zero}, {zero}, a)) AS lattice")


def element_values() -> str:
    """The element dimension as DuckDB VALUES, for the elements that the atoms binding has."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    rows = [r for r in E.element_rows() if r[1] in ("C", "H", "O", "N", "Zn")]
    names = [c.split()[0] for c in E.SCHEMA.split(", ")]
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS e({', '.join(names)}))"
