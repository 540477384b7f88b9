"""Queries over the driver's tables: each operator bound to data, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from porelake.functions import elements as E
from porelake.functions import scalars as S
from porelake.operators import clusters as CL
from porelake.operators import collection as C
from porelake.operators import features as FE
from porelake.operators import inference as I
from porelake.operators import neighbours as N
from porelake.operators import oxidation as O
from porelake.plans import bindings as B
from porelake.sources import cif as CIF
from porelake.sources import files as FI

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SITES, COLLECTION, RESULTS, ATOMS, PREDICTED, METADATA = (B.duck(t) for t in (B.SITES, B.COLLECTION, B.RESULTS, B.ATOMS, B.PREDICTED_SITES, B.METADATA))
ELEMENTS = B.element_values()
WITH = f"sites AS ({SITES}), coll AS ({COLLECTION}), res AS ({RESULTS}), atoms AS ({ATOMS}), elements AS {ELEMENTS}"
_DELTA = "(b.f{0} - a.f{0}) - round_even(b.f{0} - a.f{0}, 0)"
_LENGTH = "sqrt(" + " + ".join(f"(({_DELTA.format(k)}) * a.a) * (({_DELTA.format(k)}) * a.a)" for k in "xyz") + ")"
PAIRS = f"pairs AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, a.element AS element_i, b.element AS element_j, {_LENGTH} AS dist FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_idx <> b.atom_idx)"
SITE_BONDS = "site_bonds AS (SELECT p.* FROM pairs p JOIN elements x ON x.symbol = p.element_i JOIN elements y ON y.symbol = p.element_j WHERE dist < x.r_site + y.r_site + CASE WHEN x.r_site > 1.95 OR y.r_site > 1.95 THEN 0.2 ELSE 0.5 END)"
CUT_BONDS = "cut_bonds AS (SELECT p.* FROM pairs p JOIN elements x ON x.symbol = p.element_i JOIN elements y ON y.symbol = p.element_j WHERE dist < x.r_csd + y.r_csd + 0.5)"
REACH = "reach AS (SELECT structure_id, atom_idx AS i, atom_idx AS j FROM atoms UNION SELECT r.structure_id, r.i, b.j FROM reach r JOIN cut_bonds b ON b.structure_id = r.structure_id AND b.i = r.j)"
CLUSTERS = """labelled AS (SELECT structure_id, i AS atom_idx, min(j) AS cluster_id FROM reach GROUP BY 1, 2),
    parts AS (SELECT l.structure_id, l.cluster_id, a.element, count(*) AS n, sum(a.charge) AS q FROM labelled l JOIN atoms a ON a.structure_id = l.structure_id AND a.atom_idx = l.atom_idx GROUP BY 1, 2, 3),
    clusters AS (SELECT structure_id, cluster_id, CAST(sum(n) AS BIGINT) AS size, string_agg(element || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY element) AS formula, sum(q) AS charge FROM parts GROUP BY 1, 2)"""


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def sites(spark: SparkSession, d: str) -> DataFrame:
    return B.bound(spark, d, B.SITES)


def collection(spark: SparkSession, d: str) -> DataFrame:
    return B.bound(spark, d, B.COLLECTION)


def results(spark: SparkSession, d: str) -> DataFrame:
    return B.bound(spark, d, B.RESULTS)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return N.pairs(B.atoms(spark, d), images=0, both=True)


def cut_bonds(spark: SparkSession, d: str) -> DataFrame:
    return N.cutoff_bonds(pairs(spark, d), E.elements(spark))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    atoms = B.atoms(spark, d)
    return CL.cluster_table(CL.label_components(cut_bonds(spark, d), atoms), atoms)


# --- aggregations over sites (A1-A5, A8-A10) ---


@query(f"""WITH {WITH} SELECT metal, structures, structures_with_oms, metal_sites, oms, printf('%.2f %%', 100.0 * structures_with_oms / structures) AS structures_pct, printf('%.2f %%', 100.0 * oms / metal_sites) AS oms_pct
FROM (SELECT metal, count(DISTINCT name) AS structures, count(DISTINCT CASE WHEN is_open THEN name END) AS structures_with_oms, count(is_open) AS metal_sites, CAST(sum(CAST(is_open AS BIGINT)) AS BIGINT) AS oms FROM sites WHERE is_unique GROUP BY metal)""")
def site_summary(spark, d):
    """A1, A2, N24, P9, W10."""
    return C.site_summary(sites(spark, d))


@query(f"WITH {WITH} SELECT count(DISTINCT name) AS structures, count(DISTINCT CASE WHEN is_open THEN name END) AS structures_with_oms, count(*) FILTER (is_unique) AS unique_sites, count(*) FILTER (is_unique AND is_open) AS unique_oms FROM sites")
def site_totals(spark, d):
    """A3."""
    return C.site_totals(sites(spark, d))


@query(f"""WITH {WITH} SELECT name, string_agg(DISTINCT metal, ',' ORDER BY metal) AS metals, CASE WHEN bool_or(is_open) THEN 'Yes' ELSE 'No' END AS has_oms,
coalesce(string_agg(DISTINCT metal, ',' ORDER BY metal) FILTER (is_open AND is_unique), 'N/A') AS oms FROM sites GROUP BY name""")
def structure_metals(spark, d):
    """A4, A6."""
    return C.structure_metals(sites(spark, d))


@query(f"WITH {WITH} SELECT CAST(name AS VARCHAR) || '_' || CAST(row_number() OVER (PARTITION BY name ORDER BY site_idx, metal, t_factor, is_open) - 1 AS VARCHAR) AS site_key, name, metal, is_open, t_factor FROM sites")
def site_table(spark, d):
    """Summaries with nested sites, flattened again."""
    nested = sites(spark, d).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("site_idx", "metal", "t_factor", "is_open", F.lit(0.0).alias("min_dihedral")))).alias("metal_sites"))
    return C.flattened_sites(nested).select("site_key", "name", "metal", "is_open", "t_factor")


@query(f"""WITH {WITH}, v AS (SELECT name, CAST(count(*) + 10 AS DOUBLE) AS uc_volume FROM sites GROUP BY name), s AS (SELECT name, count(*) FILTER (is_unique) AS u, count(*) FILTER (is_unique AND is_open) AS o, bool_or(is_open) AS has_oms, bool_or(problematic) AS problematic FROM sites GROUP BY name)
SELECT s.name, u / uc_volume AS oms_density, o / uc_volume AS open_site_density, has_oms, problematic FROM s JOIN v ON s.name = v.name""")
def oms_density(spark, d):
    """A8, T2."""
    rows = sites(spark, d)
    return C.structure_oms(rows, rows.groupBy("name").agg((F.count(F.lit(1)) + 10).cast("double").alias("uc_volume")))


@query(f"""WITH {WITH}, h AS (SELECT number_of_linkers, is_open, CAST(least(49, floor(t_factor * 50)) AS INTEGER) AS bin, count(*) AS n FROM sites WHERE is_unique AND number_of_linkers IN (4, 5, 6) AND t_factor BETWEEN 0 AND 1 GROUP BY 1, 2, 3),
g AS (SELECT k AS number_of_linkers, o AS is_open, CAST(b AS INTEGER) AS bin FROM unnest([4, 5, 6]) AS a(k), unnest([true, false]) AS c(o), range(50) AS r(b))
SELECT g.number_of_linkers, g.is_open, g.bin, coalesce(h.n, 0) AS n, (g.bin + 0.5::DOUBLE) / 50 AS centre, CASE WHEN sum(coalesce(h.n, 0)) OVER w > 0 THEN coalesce(h.n, 0) * 50 / CAST(sum(coalesce(h.n, 0)) OVER w AS DOUBLE) ELSE 0.0::DOUBLE END AS density
FROM g LEFT JOIN h ON g.number_of_linkers = h.number_of_linkers AND g.is_open = h.is_open AND g.bin = h.bin WINDOW w AS (PARTITION BY g.number_of_linkers, g.is_open)""")
def t_factor_histograms(spark, d):
    """A9, A10, K8."""
    return C.t_factor_histograms(sites(spark, d))


@query(f"WITH {WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY name, is_open, metal ORDER BY site_idx, t_factor) AS n FROM sites) SELECT name, site_idx, metal, is_open, t_factor FROM r WHERE n = 1")
def first_of_kind_sites(spark, d):
    """W6."""
    order = Window.partitionBy("name", "is_open", "metal").orderBy("site_idx", "t_factor")
    return sites(spark, d).withColumn("n", F.row_number().over(order)).where("n = 1").select("name", "site_idx", "metal", "is_open", "t_factor")


# --- collections (F1-F12, W3, S3, K5, K6, E1, E2) ---


@query(f"WITH {WITH} SELECT name, density, uc_volume FROM coll WHERE density BETWEEN 900 AND 950 AND density <> 0 AND uc_volume BETWEEN 5 AND 40 AND list_contains(metal_species, 'Zn') AND cif_okay")
def filter_reference(spark, d):
    """Conjunction of range, contains-all and equals."""
    return C.filter_collection(collection(spark, d), {"density": (950, 900), "uc_volume": (5, 40), "metal_species": ["Zn"], "cif_okay": True}).select("name", "density", "uc_volume")


@query(f"WITH {WITH} SELECT name FROM coll WHERE false")
def filter_false_matches_nothing(spark, d):
    """In reference mode filtering for false matches nothing."""
    return C.filter_collection(collection(spark, d), {"has_oms": False}).select("name")


@query(f"WITH {WITH} SELECT name FROM coll WHERE density BETWEEN 0 AND 905 AND NOT has_oms")
def filter_sql_mode(spark, d):
    """F1 with plain SQL semantics for zero and false."""
    return C.filter_collection(collection(spark, d), {"density": (0, 905), "has_oms": False}, mode="sql").select("name")


@query(f"WITH {WITH} SELECT name FROM coll WHERE name IN (3, 5, 8, 13, 21) AND list_contains(metal_species, 'Zn') AND list_contains(metal_species, 'Cu') OR name IN (7, 14)")
def filter_names(spark, d):
    """members of a list, and all of several species."""
    rows = collection(spark, d)
    named = rows.withColumn("mof_name", F.col("name").cast("string"))
    both = C.filter_collection(named, {"mof_name": ["3", "5", "8", "13", "21"], "metal_species": ["Zn", "Cu"]})
    return both.unionByName(C.filter_collection(named, {"mof_name": ["7", "14"]})).select("name")


@query(f"""WITH {WITH}, s AS (SELECT name, bool_or(is_open) AS open FROM sites GROUP BY name) SELECT c.name FROM coll c JOIN s ON s.name = c.name WHERE c.uc_volume BETWEEN 10 AND 20 AND s.open""")
def staged_filter(spark, d):
    """cheap filters first, site analysis only for what is left."""
    rows = collection(spark, d).drop("has_oms").withColumn("checksum", F.col("name").cast("string"))
    analysed = sites(spark, d).groupBy(F.col("name").cast("string").alias("checksum")).agg(F.bool_or("is_open").alias("has_oms"))
    return C.filter_collection(rows, {"uc_volume": (10, 20), "has_oms": True}, analyse=lambda _: analysed).select("name")


@query(f"""WITH {WITH} SELECT name, CASE WHEN name % 3 = 0 THEN 0 WHEN density IS NOT NULL OR NOT cif_okay THEN 1 ELSE 2 END AS level, name % 3 = 0 OR density IS NOT NULL OR NOT cif_okay OR name % 2 = 0 AS valid FROM coll""")
def validation_levels(spark, d):
    """Cached, then from the file, then from the analysis."""
    rows = collection(spark, d).withColumn("checksum", F.col("name").cast("string"))
    cached = rows.select("checksum", F.when(F.col("name") % 3 == 0, F.lit(1.0)).alias("density"))
    analysed = rows.where("name % 2 = 0").select("checksum", F.lit(2.0).alias("density"))
    out = C.validation_level(cached, rows.select("checksum", "density", "cif_okay"), analysed, ["density"])
    return out.select(F.col("checksum").cast("long").alias("name"), "level", "valid")


@query(f"WITH {WITH} SELECT name, n_atoms FROM coll ORDER BY n_atoms * n_atoms, name LIMIT 25")
def cheapest_structures(spark, d):
    """F9, W1."""
    return C.cheapest(collection(spark, d), 25).select("name", "n_atoms")


@query(f"WITH {WITH} SELECT least(50, count(*)) AS n FROM coll")
def sampled(spark, d):
    """F8: an exact size; which rows is a matter of the seed."""
    return C.sample(collection(spark, d), 50).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY metal_species[1] ORDER BY name) AS s, row_number() OVER (PARTITION BY n_atoms ORDER BY name) AS a FROM coll)
SELECT name FROM r WHERE s <= 2 OR a <= 1 ORDER BY CASE WHEN s <= 2 THEN 0 ELSE 1 END, name LIMIT 20""")
def selected_structures(spark, d):
    """The first two of each type, then the first of each atom type."""
    rows = collection(spark, d).withColumn("structure_type", F.col("metal_species")[0]).withColumn("atom_types", F.col("n_atoms"))
    return C.first_per_type(rows, 20).select("name")


@query(f"WITH {WITH} SELECT name FROM coll WHERE name NOT IN (SELECT name FROM res WHERE NOT running)")
def unfinished_structures(spark, d):
    """Skip what has a finished result."""
    return C.skip_existing(collection(spark, d), results(spark, d), ["name"]).select("name")


@query(f"""WITH {WITH}, o AS (SELECT name, CAST(n_atoms AS BIGINT) * n_atoms AS cost, sum(CAST(n_atoms AS BIGINT) * n_atoms) OVER (ORDER BY CAST(n_atoms AS BIGINT) * n_atoms, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(CAST(n_atoms AS BIGINT) * n_atoms) OVER () AS total FROM coll)
SELECT name, cost, CAST(floor(CAST(coalesce(before, 0) AS DOUBLE) / (CAST(total AS DOUBLE) / 7)) AS INTEGER) AS batch FROM o""")
def balanced_batches(spark, d):
    """W3, E1."""
    return C.batches(collection(spark, d), 7).select("name", "cost", "batch")


@query(f"WITH {WITH} SELECT checksum, string_agg(DISTINCT CAST(name AS VARCHAR), ',' ORDER BY CAST(name AS VARCHAR)) AS names FROM coll GROUP BY checksum HAVING count(DISTINCT name) > 1")
def checksum_conflicts(spark, d):
    """S1-S3, P2."""
    return C.checksum_conflicts(collection(spark, d).withColumn("name", F.col("name").cast("string")))


@query(f"WITH {WITH} SELECT c.name, c.checksum, r.checksum AS stored FROM coll c JOIN res r ON c.name = r.name WHERE c.checksum <> r.checksum")
def stale_results(spark, d):
    """E2."""
    return C.stale_results(collection(spark, d), results(spark, d))


@query(f"WITH {WITH} SELECT count(*) AS members, count(*) FILTER (NOT cif_okay) AS unreadable, CAST(0 AS BIGINT) AS without_metal, count(*) FILTER (checksum NOT IN (SELECT checksum FROM res)) AS unfinished FROM coll")
def collection_report(spark, d):
    """F12, E4."""
    return C.check_report(collection(spark, d), results(spark, d))


@query(f"""WITH {WITH}, f AS (SELECT name, uc_volume * 2 AS uc_volume FROM coll WHERE name % 2 = 0), s AS (SELECT name, density, uc_volume FROM coll WHERE name % 3 = 0)
SELECT coalesce(f.name, s.name) AS name, s.density, coalesce(f.uc_volume, s.uc_volume) AS uc_volume FROM s FULL JOIN f ON s.name = f.name""")
def upserted_properties(spark, d):
    """K5."""
    rows = collection(spark, d)
    return C.upsert_properties(rows.where("name % 3 = 0").select("name", "density", "uc_volume"), rows.where("name % 2 = 0").select("name", (F.col("uc_volume") * 2).alias("uc_volume")), "name")


@query(f"WITH {WITH} SELECT regexp_replace(path, '^.*/', '/copy/') AS path, checksum FROM coll WHERE has_oms")
def copied_subset(spark, d):
    """K6."""
    return FI.copy_subset(collection(spark, d).where("has_oms").select("path", "checksum"), "/copy")


# --- scalars (P1-P5, P8-P16, P19-P23, N25, K2, S14) ---


@query("SELECT doc_id, sha256(coalesce(text, '')) AS checksum, replace(regexp_replace('/a/' || CAST(doc_id AS VARCHAR) || '.cif.x.cif', '^.*/', ''), '.cif', '') AS name, CAST(doc_id AS VARCHAR) || '.cif.x' AS stem FROM documents")
def names_and_checksums(spark, d):
    """P1, P2."""
    path = F.concat(F.lit("/a/"), F.col("doc_id").cast("string"), F.lit(".cif.x.cif"))
    return B.table(spark, d, "documents").select("doc_id", S.checksum(F.coalesce("text", F.lit(""))).alias("checksum"), S.structure_name(path).alias("name"), S.file_stem(path).alias("stem"))


@query(f"""WITH m AS ({METADATA}) SELECT doi_key, CASE WHEN doi IS NULL OR split_part(doi, '/', 1) = 'unknown' THEN 'unknown' ELSE coalesce(map {{'10.1021': 'ACS', '10.1039': 'RSC', '10.1002': 'WILEY', '10.1038': 'Nature', '10.1126': 'Science', '10.1016': 'SciDirect', '10.1007': 'Springer', '10.3390': 'MDPI'}}[split_part(doi, '/', 1)], 'other') END AS publisher,
CASE doi_key % 4 WHEN 3 THEN 'unknown' ELSE (SELECT CASE o.o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END FROM orders o WHERE o.o_orderkey = doi_key) END AS published FROM m""")
def publications(spark, d):
    """P3, P4."""
    return B.bound(spark, d, B.METADATA).select("doi_key", S.publisher(F.col("doi")).alias("publisher"), S.publication_date(F.col("metadata")).alias("published"))


_FORMULAS = "['Zn4C12O13', 'H2O', 'C6H12N2', 'CO2', 'Cu2C8']"


@query(f"""WITH f AS (SELECT p_partkey, list_extract({_FORMULAS}, CAST(p_partkey % 5 + 1 AS INT)) AS formula FROM part), e AS (SELECT p_partkey, formula, regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 1) AS tokens FROM f)
SELECT p_partkey, array_to_string(tokens, ',') AS tokens, array_to_string(list_sort(list_distinct(tokens)), '') AS built, array_to_string(list_transform(list_sort(list_distinct(tokens)), lambda x: x || '1'), '') AS counted FROM e""")
def formulas(spark, d):
    """P5-P7."""
    given = F.element_at(F.array(*map(F.lit, eval(_FORMULAS))), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = B.table(spark, d, "part").select("p_partkey", S.formula_tokens(given).alias("t"))
    return rows.select("p_partkey", F.array_join("t", ",").alias("tokens"), S.formula_column(F.col("t")).alias("built"), S.formula_column(F.col("t"), True).alias("counted"))


@query("SELECT p_partkey, '[' || p_brand || '].[' || p_type || '].' || p_name || ' MOFid-v2.pcu.cat' || CAST(p_size % 3 AS VARCHAR) || ';' || CAST(p_partkey AS VARCHAR) AS identifier FROM part")
def identifiers(spark, d):
    """P8."""
    return B.table(spark, d, "part").select("p_partkey", S.structure_identifier(F.array("p_brand", "p_type"), F.array("p_name"), F.lit("pcu"), F.col("p_size") % 3, F.col("p_partkey").cast("string")).alias("identifier"))


_V = "CAST(embedding[{}] AS DOUBLE)"
_DOT = " + ".join(f"{_V.format(i)} * {_V.format(i + 3)}" for i in (1, 2, 3))
_NORM = "sqrt({})"


@query(
    "SELECT vec_id, CASE WHEN {dot} = 0 THEN 0 ELSE round(degrees(acos(greatest(-1, least(1, ({dot}) / {n1} / {n2})))), 6) END AS angle, round((n1 * p[7] + n2 * p[8] + n3 * p[9] - o) / sqrt(n1 * n1 + n2 * n2 + n3 * n3), 6) AS distance FROM "
    "(SELECT *, p[1] * n1 + p[2] * n2 + p[3] * n3 AS o FROM (SELECT *, (p[2] - p[5]) * (p[9] - p[6] + 1) - (p[3] - p[6]) * (p[8] - p[5] + 1) AS n1, (p[3] - p[6]) * (p[7] - p[4] + 1) - (p[1] - p[4]) * (p[9] - p[6] + 1) AS n2, "
    "(p[1] - p[4]) * (p[8] - p[5] + 1) - (p[2] - p[5]) * (p[7] - p[4] + 1) AS n3 FROM (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p FROM embeddings)))".format(
        dot=_DOT, n1=_NORM.format(" + ".join(f"{_V.format(i)} * {_V.format(i)}" for i in (1, 2, 3))), n2=_NORM.format(" + ".join(f"{_V.format(i)} * {_V.format(i)}" for i in (4, 5, 6)))
    )
)
def angles_and_planes(spark, d):
    """The angle of two vectors, and a point's height over the plane through three."""
    v = [F.col("embedding")[i].cast("double") for i in range(9)]
    plane = S.plane_through((v[0], v[1], v[2]), (v[3], v[4], v[5]), tuple(x + 1 for x in v[6:9]))
    rows = B.table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(S.vector_angle(*v[:6]), 6).alias("angle"), F.round(S.plane_distance((v[6], v[7], v[8]), plane), 6).alias("distance"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((360 - (l_quantity + 2 * l_quantity)) / 141.0, 6) AS t4, round((2 * l_quantity - l_quantity) / 60.0, 6) AS t5, round(l_quantity / 180.0, 6) AS t6 FROM lineitem")
def t_factors(spark, d):
    """P14."""
    q = F.col("l_quantity")
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.t4(q, 2 * q), 6).alias("t4"), F.round(S.t5(q, 2 * q), 6).alias("t5"), F.round(S.t6(q), 6).alias("t6"))


@query(f"""WITH {WITH}, c AS (SELECT p_partkey, p_size / 25.0::DOUBLE + 0.5 AS dist, list_extract(['C', 'H', 'O', 'N'], CAST(p_partkey % 4 + 1 AS INT)) AS element FROM part)
SELECT p_partkey, round(CASE WHEN element = 'H' THEN least(1.25, pow(10, bo_a * dist + bo_c)) ELSE pow(10, bo_a * dist + bo_c) END, 6) AS bond_order FROM c JOIN elements ON symbol = element""")
def bond_orders(spark, d):
    """P15."""
    rows = B.table(spark, d, "part").select("p_partkey", (F.col("p_size") / 25.0 + 0.5).alias("dist"), F.element_at(F.array(*map(F.lit, "CHON")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("element"))
    joined = rows.join(F.broadcast(E.elements(spark).select("symbol", "bo_a", "bo_c")), F.col("element") == F.col("symbol"))
    return joined.select("p_partkey", F.round(S.bond_order(F.col("element"), F.col("dist"), F.col("bo_a"), F.col("bo_c")), 6).alias("bond_order"))


_K = f"({S.PLANCK_CM / S.BOLTZMANN!r}::DOUBLE)"


@query(f"""SELECT event_type, round(sum(CASE WHEN value > 0 THEN {S.AVOGADRO * S.BOLTZMANN!r}::DOUBLE * ({_K} * value / 300) * ({_K} * value / 300) * exp({_K} * value / 300) / ((exp({_K} * value / 300) - 1) * (exp({_K} * value / 300) - 1)) * (event_id % 7) ELSE 0 END), 4) AS cv_300 FROM events WHERE value > 0 GROUP BY event_type""")
def heat_capacities(spark, d):
    """The harmonic kernel summed over a spectrum."""
    rows = B.table(spark, d, "events").select("event_type", F.col("value").alias("frequency"), (F.col("event_id") % 7).alias("dos"))
    return I.heat_capacity_sum(rows, [300.0], ["event_type"]).select("event_type", F.round("cv_300", 4).alias("cv_300"))


@query("SELECT p_partkey, round_even(p_retailprice / 7, 4) AS four, round_even(p_retailprice / 7, 1) AS one, CASE WHEN p_size > 25 THEN 1 WHEN p_size < 25 THEN -1 ELSE 0 END AS compared FROM part")
def rounded(spark, d):
    """Half to even."""
    x = F.col("p_retailprice") / 7
    return B.table(spark, d, "part").select("p_partkey", F.bround(x, 4).alias("four"), F.bround(x, 1).alias("one"), S.three_way(F.col("p_size"), F.lit(25)).alias("compared"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'")
def record_lookup(spark, d):
    """A field of a JSON record, by data set."""
    rows = B.table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("event_id"), F.parse_json("props").alias("record"))
    return rows.where("dataset = 'click'").select("event_id", F.expr("variant_get(record, '$.k', 'bigint')").alias("k"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size END, CASE WHEN p_partkey % 3 = 0 THEN p_size * 10 END, CASE WHEN p_partkey % 5 = 0 THEN p_size * 100 END, -1) AS value FROM part""")
def feature_fallback(spark, d):
    """A feature from the first table that has it."""
    named = lambda c, k: F.when(c, F.create_map(F.lit("f"), F.col("p_size") * k)).otherwise(F.expr("map()").cast("map<string,int>"))
    p = F.col("p_partkey")
    rows = B.table(spark, d, "part").select("p_partkey", named(p % 2 == 0, 1).alias("a"), named(p % 3 == 0, 10).alias("b"), named(p % 5 == 0, 100).alias("c"))
    return rows.select("p_partkey", F.coalesce(S.first_known(F.lit("f"), F.col("a"), F.col("b"), F.col("c")), F.lit(-1)).alias("value"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({z}, '{s}', {E.valence_electrons(s)}, {str(E.is_cleaning_metal(s)).lower()}, {str(E.is_site_metal(s)).lower()}, {str(56 < z < 72).lower()}, {str(88 < z < 97).lower()})" for z, s in enumerate(E.SYMBOLS, 1)) + ") AS t(z, symbol, valence, is_metal_curation, is_metal_site, is_lanthanide, is_actinide)")
def element_table(spark, d):
    """S19, P17, P19, E5."""
    return E.elements(spark).select("z", "symbol", "valence", "is_metal_curation", "is_metal_site", "is_lanthanide", "is_actinide")


# --- neighbours and clusters (N1-N8, A7, A12-A14, C8, W1, W2, P6, P18, P20) ---


@query(f"WITH {WITH}, {PAIRS} SELECT structure_id, i, j, round(dist, 6) AS dist FROM pairs WHERE i < j AND dist < 3")
def distances(spark, d):
    """Minimum-image distances."""
    return pairs(spark, d).where("i < j and dist < 3").select("structure_id", "i", "j", F.round("dist", 6).alias("dist"))


@query(f"WITH {WITH}, {PAIRS} SELECT structure_id, i, j, round(dist, 6) AS dist FROM pairs WHERE i < j AND dist < 2.5")
def distances_by_cells(spark, d):
    """The cell-list join."""
    return N.cell_list_pairs(B.atoms(spark, d), 2.5).select("structure_id", "i", "j", F.round("dist", 6).alias("dist"))


@query(f"WITH {WITH}, {PAIRS}, {CUT_BONDS} SELECT structure_id, i, j, element_i, element_j FROM cut_bonds WHERE i < j")
def cutoff_bonds(spark, d):
    """N2-N4."""
    return cut_bonds(spark, d).where("i < j").select("structure_id", "i", "j", "element_i", "element_j")


@query(f"WITH {WITH}, {PAIRS}, {SITE_BONDS} SELECT structure_id, i AS atom_idx, count(*) AS cn FROM site_bonds GROUP BY 1, 2")
def coordination(spark, d):
    """N5, N16, P18."""
    return N.coordination_numbers(pairs(spark, d), E.elements(spark))


@query(f"WITH {WITH}, {PAIRS}, {CUT_BONDS} SELECT structure_id, i AS metal_idx, count(*) AS neighbours FROM cut_bonds WHERE element_i = 'Zn' GROUP BY 1, 2")
def metal_contacts(spark, d):
    """N8, F13, F14."""
    found = N.metal_neighbours(cut_bonds(spark, d), E.elements(spark))
    return found.groupBy("structure_id", F.col("i").alias("metal_idx")).agg(F.count(F.lit(1)).alias("neighbours"))


@query(f"WITH RECURSIVE {WITH}, {PAIRS}, {CUT_BONDS}, {REACH}, {CLUSTERS} SELECT structure_id, atom_idx, cluster_id FROM labelled")
def components(spark, d):
    """N6, D6."""
    return CL.label_components(cut_bonds(spark, d), B.atoms(spark, d))


@query(f"WITH RECURSIVE {WITH}, {PAIRS}, {CUT_BONDS}, {REACH}, {CLUSTERS} SELECT structure_id, cluster_id, size, formula, round(charge, 6) AS charge FROM clusters")
def cluster_formulas(spark, d):
    """P6, A12."""
    return clusters(spark, d).withColumn("charge", F.round("charge", 6))


@query(f"""WITH RECURSIVE {WITH}, {PAIRS}, {CUT_BONDS}, {REACH}, {CLUSTERS}, t AS (SELECT *, formula IN ({', '.join(f"'{x}'" for x in sorted(E.IONS))}) AS ion FROM clusters), m AS (SELECT *, max(CASE WHEN NOT ion THEN size END) OVER (PARTITION BY structure_id) AS top, row_number() OVER (PARTITION BY structure_id ORDER BY size DESC, cluster_id DESC) AS rank FROM t)
SELECT structure_id, cluster_id, rank, CASE WHEN ion THEN 'ion' WHEN size = top OR size > 0.5 * top THEN 'framework' ELSE 'solvent' END AS decision FROM m""")
def decisions_by_list(spark, d):
    """The list-based rule."""
    return CL.ranked(CL.decide_by_list(clusters(spark, d))).select("structure_id", "cluster_id", "rank", "decision")


@query(f"""WITH RECURSIVE {WITH}, {PAIRS}, {CUT_BONDS}, {REACH}, {CLUSTERS}, m AS (SELECT *, max(size) OVER (PARTITION BY structure_id) AS top, row_number() OVER (PARTITION BY structure_id ORDER BY size DESC, cluster_id) AS rank FROM clusters)
SELECT structure_id, cluster_id, CASE WHEN rank = 1 OR size > 0.5 * top THEN 'framework' WHEN abs(charge) > 0.1 THEN 'ion' ELSE 'solvent' END AS decision FROM m""")
def decisions_by_charge(spark, d):
    """The charge-based rule."""
    return CL.decide_by_charge(clusters(spark, d)).select("structure_id", "cluster_id", "decision")


@query(f"""WITH RECURSIVE {WITH}, {PAIRS}, {CUT_BONDS}, {REACH}, {CLUSTERS}, m AS (SELECT *, row_number() OVER (PARTITION BY structure_id, formula ORDER BY size DESC, cluster_id) AS n FROM clusters) SELECT structure_id, formula, cluster_id FROM m WHERE n = 1""")
def first_fragments(spark, d):
    """The first fragment of each formula."""
    return CL.fragments_by_formula(clusters(spark, d)).select("structure_id", "formula", "cluster_id")


@query(f"""WITH {WITH} SELECT structure_id, count(*) AS n_atoms, round(sum(mass), 6) AS mass, max(a) * max(a) * max(a) AS volume, round(sum(mass) * 1.66053906660 / (max(a) * max(a) * max(a)), 6) AS density FROM atoms JOIN elements ON symbol = element GROUP BY structure_id""")
def mass_volume_density(spark, d):
    """A7."""
    rows = B.atoms(spark, d)
    volumes = rows.groupBy("structure_id").agg((F.max("a") * F.max("a") * F.max("a")).alias("volume"))
    return C.mass_volume_density(rows, volumes, E.elements(spark)).select("structure_id", "n_atoms", F.round("mass", 6).alias("mass"), "volume", F.round("density", 6).alias("density"))


@query(f"WITH {WITH}, s AS (SELECT structure_id, bool_or(element = 'Zn') AS m, bool_or(element = 'C') AS c FROM atoms GROUP BY 1) SELECT structure_id, CASE WHEN m AND c THEN 'has metal and carbon' WHEN m THEN 'missing carbon' WHEN c THEN 'missing metal' ELSE 'missing metal and carbon' END AS label FROM s")
def presence_labels(spark, d):
    """P20, C1."""
    return C.presence(B.atoms(spark, d), E.elements(spark))


@query(f"""WITH {WITH}, {PAIRS}, k AS (SELECT p.*, x.r_typed + y.r_typed AS reach, CASE WHEN element_j = 'H' THEN least(1.25, pow(10, y.bo_a * dist + y.bo_c)) ELSE pow(10, y.bo_a * dist + y.bo_c) END AS bo, y.bo_a IS NULL AS odd FROM pairs p JOIN elements x ON x.symbol = element_i JOIN elements y ON y.symbol = element_j),
s AS (SELECT structure_id, i, bool_or(dist < 0.5 * reach) AS overlap, count(*) FILTER (dist <= reach) AS n, count(*) FILTER (dist <= reach AND odd) AS odd, coalesce(sum(bo) FILTER (dist <= reach), 0) AS bo FROM k GROUP BY 1, 2),
l AS (SELECT s.structure_id, unnest([CASE WHEN overlap THEN 'overlapping' END, CASE WHEN element = 'C' AND odd = 0 AND bo < 3.3 THEN 'under_carbon' WHEN element = 'C' AND odd = 0 AND bo >= 5.5 THEN 'over_carbon' END, CASE WHEN n = 0 THEN 'isolated' END]) AS label FROM s JOIN atoms a ON a.structure_id = s.structure_id AND a.atom_idx = s.i)
SELECT structure_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), 'good') AS problems FROM l GROUP BY structure_id""")
def bond_order_check(spark, d):
    """C7, C8, A13, A14, N1."""
    return N.bond_order_check(pairs(spark, d), B.atoms(spark, d), E.elements(spark))


# --- predictions and metrics (A15-A19, N23, S16, H4, H5) ---

_MODELS = {"a": (1.0, {"f1": 0.5, "f2": 2.0}), "b": (0.5, {"f1": 0.25, "f3": -1.0}), "c": (2.0, {"f2": 1.0, "f3": 3.0})}


@query(f"""WITH s AS ({PREDICTED}), p AS (SELECT structure_id, mass, unnest(['a', 'b', 'c']) AS model, unnest([1.0 + 0.5 * f1 + 2.0 * f2, 0.5 + 0.25 * f1 - 1.0 * f3, 2.0 + 1.0 * f2 + 3.0 * f3]) AS v FROM s),
m AS (SELECT structure_id, model, sum(v) / count(*) AS molar, sum(v) / sum(mass) AS grav FROM p GROUP BY 1, 2) SELECT structure_id, round(avg(grav), 8) AS gravimetric_mean, round(stddev_pop(grav), 8) AS gravimetric_std, round(avg(molar), 8) AS molar_mean, round(stddev_pop(molar), 8) AS molar_std FROM m GROUP BY 1""")
def ensemble_prediction(spark, d):
    """A15, H5, T13, T20."""
    out = I.ensemble(I.linear_predictions(B.bound(spark, d, B.PREDICTED_SITES), _MODELS, ["structure_id", "mass"]), ["structure_id"])
    return out.select("structure_id", *(F.round(c, 8).alias(c) for c in out.columns[1:]))


@query(f"""WITH s AS ({PREDICTED}), p AS (SELECT structure_id, mass, t, unnest(['a', 'b', 'c']) AS model, unnest([1.0 + 0.5 * f1 + 2.0 * f2, 0.5 + 0.25 * f1 - 1.0 * f3, 2.0 + 1.0 * f2 + 3.0 * f3]) * t / 300.0 AS v FROM s, unnest([300, 350]) AS x(t)),
m AS (SELECT structure_id, t, model, sum(v) / count(*) AS molar FROM p GROUP BY 1, 2, 3), e AS (SELECT structure_id, t, avg(molar) AS v FROM m GROUP BY 1, 2) SELECT structure_id, round(max(v) FILTER (t = 300), 8) AS molar_300, round(max(v) FILTER (t = 350), 8) AS molar_350 FROM e GROUP BY 1""")
def prediction_by_temperature(spark, d):
    """A16, N23."""
    p = I.linear_predictions(B.bound(spark, d, B.PREDICTED_SITES), _MODELS, ["structure_id", "mass"])
    p = p.withColumn("temperature", F.explode(F.array(F.lit(300.0), F.lit(350.0)))).withColumn("prediction", F.col("prediction") * F.col("temperature") / 300.0)
    out = I.by_temperature(p, [300.0, 350.0])
    return out.select("structure_id", F.round("`300.0_molar_mean`", 8).alias("molar_300"), F.round("`350.0_molar_mean`", 8).alias("molar_350"))


@query("""WITH c AS (SELECT l.quality AS t, CASE WHEN d.n_chars > 1000 THEN 1.2 ELSE 0.3 END AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id), s AS (SELECT sum(round_even(greatest(0, least(1, t * p)), 0)) AS hit, sum(round_even(greatest(0, least(1, p)), 0)) AS said, sum(t) AS there FROM c)
SELECT round(hit / (said + 1e-7), 6) AS "precision", round(hit / (there + 1e-7), 6) AS recall, round(2 * (hit / (said + 1e-7)) * (hit / (there + 1e-7)) / (hit / (said + 1e-7) + hit / (there + 1e-7) + 1e-7), 6) AS f1 FROM s""")
def classification_metrics(spark, d):
    """A19."""
    rows = B.table(spark, d, "labels").join(B.table(spark, d, "documents"), "doc_id").select("quality", F.when(F.col("n_chars") > 1000, 1.2).otherwise(0.3).alias("p"))
    out = I.classification_metrics(rows, "quality", "p")
    return out.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {WITH}, {PAIRS}, f AS (SELECT structure_id, i, count(*) AS n, sum(exp(-0.05 * (dist / 5) * (dist / 5)) * 0.5 * (cos(pi() * dist / 5) + 1)) AS g0, sum(exp(-4.0 * (dist / 5) * (dist / 5)) * 0.5 * (cos(pi() * dist / 5) + 1)) AS g1 FROM pairs WHERE dist < 5 GROUP BY 1, 2) SELECT structure_id, i AS atom_idx, round(g0, 5) AS g2_0, round(g1, 5) AS g2_1 FROM f""")
def radial_features(spark, d):
    """H1: radial symmetry functions."""
    out = FE.radial_features(pairs(spark, d), FE.G2_ETAS[:2])
    return out.select("structure_id", "atom_idx", F.round("g2_0", 5).alias("g2_0"), F.round("g2_1", 5).alias("g2_1"))


@query(f"""WITH {WITH}, {PAIRS}, n AS (SELECT p.structure_id, p.i, x.mass AS v, y.mass AS w, 1 / (dist * dist) AS k FROM pairs p JOIN elements x ON x.symbol = element_i JOIN elements y ON y.symbol = element_j WHERE dist < 5 AND dist > 0.001)
SELECT structure_id, i AS site_idx, round(sum(k * abs(w - v)) / sum(k), 5) AS mean_abs, round(sum(k * (w - v)) / sum(k), 5) AS mean, round(max(w - v), 5) AS "max", round(min(w - v), 5) AS "min" FROM n GROUP BY 1, 2""")
def local_differences(spark, d):
    """H2: weighted differences to neighbours."""
    mass = F.broadcast(E.elements(spark).select("symbol", "mass"))
    near = pairs(spark, d).where("dist < 5 and dist > 0.001").join(mass.select(F.col("symbol").alias("element_i"), F.col("mass").alias("value")), "element_i").join(mass.select(F.col("symbol").alias("element_j"), F.col("mass").alias("neighbour_value")), "element_j")
    out = FE.local_difference(near.select("structure_id", F.col("i").alias("site_idx"), "value", "neighbour_value", (1 / (F.col("dist") * F.col("dist"))).alias("weight")))
    return out.select("structure_id", "site_idx", *(F.round(c, 5).alias(c) for c in ("mean_abs", "mean", "max", "min")))


# --- oxidation (P19, M1-M3, M8, A20-A24, N13-N15) ---


@query("""WITH c AS (SELECT p_partkey, CAST(p_size % 9 AS DOUBLE) AS vbs, CAST(p_partkey % 8 + 1 AS INT) AS valence FROM part), f AS (SELECT *, 4 - abs(4 - valence) AS free FROM c)
SELECT p_partkey, CASE WHEN vbs <= free THEN free - vbs WHEN vbs < valence THEN vbs + (valence - free - CASE WHEN vbs - free <= 2 THEN 2 WHEN vbs - free <= 4 THEN 4 WHEN vbs - free <= 6 THEN 6 ELSE 8 END) - valence ELSE vbs - valence END AS contribution FROM f""")
def valence_contributions(spark, d):
    """M2, M3."""
    rows = B.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 9).cast("double").alias("vbs"), (F.col("p_partkey") % 8 + 1).cast("int").alias("valence"))
    return rows.select("p_partkey", O.expected_contribution(F.col("vbs"), F.col("valence")).alias("contribution"))


@query("""SELECT p_brand, CAST(max(CASE WHEN c = top THEN k END) AS INTEGER) AS state FROM (SELECT *, max(c) OVER (PARTITION BY p_brand) AS top FROM (SELECT p_brand, p_size % 11 AS k, count(*) AS c FROM part GROUP BY 1, 2)) GROUP BY p_brand""")
def most_probable_states(spark, d):
    """Argmax, the last among equals."""
    counts = B.table(spark, d, "part").groupBy("p_brand", (F.col("p_size") % 11).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    rows = counts.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))
    chances = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0)))
    return rows.select("p_brand", O.most_probable_state(chances).alias("state"))


_BONDS = "SELECT l_orderkey AS structure_id, CAST(l_linenumber AS INT) AS i, CAST(l_linenumber % 7 + 1 AS INT) AS j, CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'Single' WHEN 1 THEN 'Double' WHEN 2 THEN 'Triple' ELSE 'Delocalised' END AS bond_type, CASE WHEN CAST(l_quantity AS INT) % 4 = 3 THEN CAST(1.5 AS DOUBLE) END AS delocalised_order FROM lineitem"
_NODES = "SELECT DISTINCT l_orderkey AS structure_id, CAST(l_linenumber AS INT) AS atom_idx, l_linenumber = 3 AS is_metal, CAST(l_linenumber AS DOUBLE) - 4 AS contribution FROM lineitem"


@query(f"""WITH b AS ({B.duck(_BONDS)}), n AS ({B.duck(_NODES)}) SELECT b.structure_id, b.i AS atom_idx, sum(CASE WHEN n.is_metal THEN 0.0::DOUBLE WHEN bond_type = 'Delocalised' THEN coalesce(delocalised_order, 0) WHEN bond_type = 'Single' THEN 1 WHEN bond_type = 'Double' THEN 2 ELSE 3 END) AS vbs FROM b LEFT JOIN n ON n.structure_id = b.structure_id AND n.atom_idx = b.j AND n.is_metal GROUP BY 1, 2""")
def valence_bond_sums(spark, d):
    """M1, A11."""
    nodes = B.bound(spark, d, _NODES)
    return O.valence_bond_sums(B.bound(spark, d, _BONDS), nodes.where("is_metal").select("structure_id", "atom_idx"))


@query(f"""WITH b AS ({B.duck(_BONDS)}), n AS ({B.duck(_NODES)}) SELECT b.structure_id, b.i AS atom_idx, count(*) FILTER (NOT n.is_metal) AS cn, count(*) FILTER (n.is_metal) AS bridging FROM b JOIN n ON n.structure_id = b.structure_id AND n.atom_idx = b.j GROUP BY 1, 2""")
def contact_counts(spark, d):
    """N16."""
    return O.metal_contacts(B.bound(spark, d, _BONDS), B.bound(spark, d, _NODES))


@query(f"""WITH b AS ({B.duck(_BONDS)}), n AS ({B.duck(_NODES)}) SELECT b.structure_id, b.i AS metal_idx, b.j AS ligand_idx FROM b JOIN n x ON x.structure_id = b.structure_id AND x.atom_idx = b.i JOIN n y ON y.structure_id = b.structure_id AND y.atom_idx = b.j WHERE x.is_metal AND NOT y.is_metal""")
def ligand_pairs(spark, d):
    """N14."""
    return O.ligand_pairs(B.bound(spark, d, _BONDS), B.bound(spark, d, _NODES))


@query(f"""WITH n AS ({B.duck(_NODES)}) SELECT structure_id, CAST(atom_idx % 2 AS INTEGER) AS site_idx, sum(contribution) / count(*) FILTER (atom_idx < 3) AS contribution FROM n WHERE NOT is_metal AND structure_id IN (SELECT structure_id FROM n WHERE atom_idx < 3 GROUP BY 1 HAVING count(*) = 2) GROUP BY 1, 2""")
def domain_contributions(spark, d):
    """A20."""
    nodes = B.bound(spark, d, _NODES)
    full = nodes.where("atom_idx < 3").groupBy("structure_id").count().where("count = 2").select("structure_id")
    domains = nodes.where("not is_metal").join(full, "structure_id", "left_semi").select("structure_id", (F.col("atom_idx") % 2).cast("int").alias("site_idx"), F.col("atom_idx").alias("member_idx"), "contribution", (F.col("atom_idx") < 3).alias("is_binding"))
    return O.domain_contributions(domains)


@query(f"""WITH n AS ({B.duck(_NODES)}) SELECT structure_id, sum(contribution) AS charge FROM n WHERE NOT is_metal AND atom_idx > 4 GROUP BY 1""")
def outer_sphere_charges(spark, d):
    """A21."""
    nodes = B.bound(spark, d, _NODES)
    domains = nodes.where("atom_idx <= 4").select("structure_id", F.col("atom_idx").alias("member_idx"))
    return O.outer_sphere_charge(nodes, domains)


@query("""SELECT l_orderkey AS structure_id, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_suppkey, l_partkey) AS n FROM lineitem""")
def relabelled_atoms(spark, d):
    """Labels by running count of the element."""
    order = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    return B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("structure_id"), "l_suppkey", "l_linenumber", F.row_number().over(order).alias("n"))


@query("""WITH f AS (SELECT event_type AS structure_id, CAST(event_id % 100 AS DOUBLE) AS f, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY 1, 2)
SELECT structure_id, k * 0.5::DOUBLE AS frequency, round(sum(w * exp(-((k * 0.5::DOUBLE - f) * (k * 0.5::DOUBLE - f)) / 0.5::DOUBLE) / (0.5::DOUBLE * sqrt(2 * pi()))), 6) AS dos FROM f, range(201) AS r(k) GROUP BY structure_id, k""")
def smeared_spectra(spark, d):
    """Gaussian smearing of frequencies over a fixed grid."""
    rows = B.table(spark, d, "events").groupBy(F.col("event_type").alias("structure_id"), (F.col("event_id") % 100).cast("double").alias("frequency")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return FE.gaussian_dos(rows).withColumn("dos", F.round("dos", 6))


_CV = f"{S.AVOGADRO * S.BOLTZMANN!r}::DOUBLE * ({_K} * f / {{t}}) * ({_K} * f / {{t}}) * exp({_K} * f / {{t}}) / ((exp({_K} * f / {{t}}) - 1) * (exp({_K} * f / {{t}}) - 1)) * w"


@query(f"""WITH e AS (SELECT event_type AS structure_id, CASE WHEN event_type = 'click' THEN event_id % 2 ELSE event_id % 3 END AS site, CAST(event_id % 50 + 1 AS DOUBLE) AS f, CAST(event_id % 5 AS DOUBLE) AS w FROM events)
SELECT structure_id, site, round(sum({_CV.format(t=300)}), 4) AS cv_300, round(sum({_CV.format(t=400)}), 4) AS cv_400 FROM e WHERE structure_id <> 'click' GROUP BY 1, 2""")
def site_heat_capacities(spark, d):
    """Labels by site, of structures with as many sites as spectra."""
    kind = F.col("event_type")
    rows = B.table(spark, d, "events").select(kind.alias("structure_id"), F.when(kind == "click", F.col("event_id") % 2).otherwise(F.col("event_id") % 3).alias("site"), (F.col("event_id") % 50 + 1).cast("double").alias("frequency"), (F.col("event_id") % 5).cast("double").alias("dos"))
    sites_of = rows.select("structure_id").distinct().withColumn("n_sites", F.lit(3))
    out = I.site_labels(rows, sites_of, [300.0, 400.0])
    return out.select("structure_id", "site", F.round("pCv_300_00", 4).alias("cv_300"), F.round("pCv_400_00", 4).alias("cv_400"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS s0, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 END) AS s1, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 END) AS t0, (p_size - 25.0::DOUBLE) / 5.0::DOUBLE AS scaled FROM part""")
def stability_vectors(spark, d):
    """H4: vectors from four feature tables, in both orders, and standardised."""
    p, none = F.col("p_partkey"), F.expr("map()").cast("map<string,double>")
    one = lambda c, n, v: F.when(c, F.create_map(F.lit(n), v)).otherwise(none)
    rows = B.table(spark, d, "part").select("p_partkey", one(p % 2 == 0, "d", F.col("p_retailprice")).alias("metal"), one(p % 3 == 0, "d", F.col("p_retailprice") * 2).alias("linker"), none.alias("group"), F.create_map(F.lit("g"), F.col("p_size").cast("double")).alias("geometry"))
    out = I.stability_vectors(rows, ["g"], ["d"])
    return out.select("p_partkey", F.col("solvent")[0].alias("s0"), F.col("solvent")[1].alias("s1"), F.col("thermal")[0].alias("t0"), I.standardised(F.col("solvent"), [25.0, 0.0], [5.0, 1.0])[0].alias("scaled"))


@query("""WITH a AS (SELECT l_orderkey AS structure_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS atom_idx, l_returnflag AS label, CAST(l_linenumber % 2 AS DOUBLE) AS fx, l_quantity > 25 AS inside, CAST(l_quantity AS INT) % 4 AS degree FROM lineitem),
k AS (SELECT a.*, row_number() OVER (PARTITION BY structure_id, fx, label ORDER BY degree DESC, atom_idx) AS n FROM a WHERE (structure_id, fx) IN (SELECT structure_id, fx FROM a WHERE inside)) SELECT structure_id, atom_idx, label FROM k WHERE n = 1""")
def unique_sites(spark, d):
    """Atoms on the asymmetric unit's places, the one with most neighbours for each."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("structure_id"), n.alias("atom_idx"), F.col("l_returnflag").alias("label"), (F.col("l_linenumber") % 2).cast("double").alias("fx"), F.lit(0.0).alias("fy"), F.lit(0.0).alias("fz"), (F.col("l_quantity") > 25).alias("inside"), (F.col("l_quantity").cast("int") % 4).alias("degree"))
    return O.unique_sites(rows.drop("degree"), rows.where("inside"), rows).select("structure_id", "atom_idx", "label")


@query("""WITH v AS (SELECT l_orderkey AS structure_id, l_returnflag AS label, max(l_tax) AS value FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2) SELECT l.l_orderkey AS structure_id, l.l_linenumber, l.l_returnflag AS label, v.value FROM lineitem l LEFT JOIN v ON v.structure_id = l.l_orderkey AND v.label = l.l_returnflag""")
def values_of_duplicates(spark, d):
    """A value of unique sites, spread to all atoms of the label."""
    rows = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("structure_id"), "l_linenumber", F.col("l_returnflag").alias("label"), "l_tax")
    values = rows.where("l_linenumber < 3").groupBy("structure_id", "label").agg(F.max("l_tax").alias("value"))
    return O.spread_to_duplicates(values, rows.drop("l_tax")).select("structure_id", "l_linenumber", "label", "value")


@query("SELECT event_id, regexp_extract(name, '^(.*)_[^_]*$', 1) AS structure FROM (SELECT event_id, event_type || '_' || CAST(user_id AS VARCHAR) || '_' || CAST(event_id % 9 AS VARCHAR) AS name FROM events)")
def structures_of_sites(spark, d):
    """The structure's name in a site's."""
    name = F.concat_ws("_", "event_type", F.col("user_id").cast("string"), (F.col("event_id") % 9).cast("string"))
    return B.table(spark, d, "events").select("event_id", FI.structure_of_site(name).alias("structure"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS lcd, CAST(p_size - 1 AS DOUBLE) AS pld, CAST(p_size % 4 AS INTEGER) AS dimension, p_retailprice AS asa FROM part")
def pore_reports(spark, d):
    """H9: numbers read from the external program's reports."""
    t = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    size = F.col("p_size")
    rows = B.table(spark, d, "part").select("p_partkey", t("x.res ", size, " ", size - 1, " 1\n").alias("pd"), t("y channels of dimensionality ", size % 4, "\n").alias("ch"), t("@ y ASA_A^2: ", F.col("p_retailprice"), " NASA_A^2: 1").alias("sa"))
    diameters = FI.pore_diameters(F.col("pd"))
    return rows.select("p_partkey", diameters[0], diameters[1], FI.channel_dimension(F.col("ch")).alias("dimension"), FI.report_value(F.col("sa"), "ASA_A^2").alias("asa"))


# --- structure files: texts made of the driver's tables are parsed again (S4, S5, S9, S15, S17) ---

_HEAD = ["_cell_angle_alpha 90", "_cell_angle_beta 90", "_cell_angle_gamma 90", "loop_", "_atom_site_label", "_atom_site_type_symbol", "_atom_site_fract_x", "_atom_site_fract_y", "_atom_site_fract_z"]


def crystal_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a CIF text for each two structures, a block for each."""
    site = F.format_string("%s%d %s %.12f %.12f %.12f", "element", "atom_idx", "element", "fx", "fy", "fz")
    by = B.atoms(spark, d).groupBy("structure_id", "a").agg(F.array_sort(F.collect_list(F.struct("atom_idx", site.alias("line")))).alias("sites"))
    sizes = [F.format_string(f"_cell_length_{k} %.6f", "a") for k in "abc"]
    block = F.concat_ws("\n", F.concat(F.lit("data_s"), F.col("structure_id").cast("string")), *sizes, *map(F.lit, _HEAD), F.transform("sites", lambda s: s["line"]))
    blocks = by.select(F.floor(F.col("structure_id") / 2).alias("file"), F.struct("structure_id", block.alias("text")).alias("block"))
    files = blocks.groupBy("file").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    return files.select(F.concat(F.lit("/cifs/f"), F.col("file").cast("string"), F.lit(".cif")).alias("path"), F.concat_ws("\n", F.transform("blocks", lambda b: b["text"])).alias("content"))


@query(f"""WITH {WITH} SELECT 'f' || CAST(structure_id // 2 AS VARCHAR) AS name, CAST(dense_rank() OVER (PARTITION BY structure_id // 2 ORDER BY structure_id) - 1 AS INTEGER) AS block_idx, CAST(atom_idx AS INTEGER) AS atom_idx, element || CAST(atom_idx AS VARCHAR) AS label, element, round(fx, 6) AS fx, round(fy, 6) AS fy, round(fz, 6) AS fz, a AS cell_length FROM atoms""")
def parsed_structures(spark, d):
    """Files of two blocks, read back atom by atom."""
    out = CIF.atoms_of(CIF.parse_files(crystal_files(spark, d)))
    return out.select("name", "block_idx", "atom_idx", "label", "element", *(F.round(f"f{k}", 6).alias(f"f{k}") for k in "xyz"), F.round(F.col("lattice")[0][0], 6).alias("cell_length"))


@query(f"""WITH {WITH}, k AS (SELECT structure_id, bool_or(element = 'Zn') AS m, bool_or(element = 'C') AS c FROM atoms GROUP BY 1), n AS (SELECT *, count(*) OVER (PARTITION BY structure_id // 2) AS n, row_number() OVER (PARTITION BY structure_id // 2 ORDER BY structure_id) AS i FROM k)
SELECT 'f' || CAST(structure_id // 2 AS VARCHAR) AS name, CAST(n AS INTEGER) AS n_structures, 'f' || CAST(structure_id // 2 AS VARCHAR) || CASE WHEN n > 1 THEN '_' || CAST(i AS VARCHAR) ELSE '' END AS block, CASE WHEN m AND c THEN 'has metal and carbon' WHEN m THEN 'missing carbon' WHEN c THEN 'missing metal' ELSE 'missing metal and carbon' END AS label FROM n""")
def prechecked_files(spark, d):
    """Presence labels of each block of each file."""
    out = CIF.precheck(CIF.parse_files(crystal_files(spark, d)))
    return out.select("name", "n_structures", F.explode("labels").alias("block", "label"))


@query("""SELECT 'i' || CAST(l_orderkey AS VARCHAR) AS path, 'mmol/g' AS loading_unit, CAST(count(*) AS BIGINT) AS n_points, CAST(sum(l_linenumber) AS DOUBLE) AS pressure, round(sum(l_quantity), 4) AS uptake FROM lineitem GROUP BY l_orderkey""")
def parsed_isotherms(spark, d):
    """AIF texts, a block and its loop of points each."""
    line = F.format_string("%d %.4f", "l_linenumber", "l_quantity")
    by = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("points"))
    head = ["data_iso", "_units_loading mmol/g", "loop_", "_adsorp_pressure", "_adsorp_amount"]
    files = by.select(F.concat(F.lit("i"), F.col("l_orderkey").cast("string")).alias("path"), F.concat_ws("\n", *map(F.lit, head), "points").alias("content"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    out = CIF.read_isotherms(files)
    return out.select("path", "loading_unit", F.size("pressure").cast("long").alias("n_points"), total("pressure_value").alias("pressure"), F.round(total("uptake_value"), 4).alias("uptake"))


_LINES = "SELECT l_orderkey AS path, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS line_no, CAST(l_quantity AS INT) AS q, CAST(l_linenumber AS INT) AS n FROM lineitem"


@query(f"""WITH l AS ({_LINES.replace("AS INT)", "AS INTEGER)")}) SELECT path, line_no, CASE WHEN q % 3 = 0 THEN 'H' ELSE 'C' END || CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) AS VARCHAR) AS label, CASE WHEN q % 3 = 0 THEN 'H' ELSE 'C.ar' END AS type, CAST(q AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y, CAST(q + n AS DOUBLE) AS z FROM l""")
def connection_points(spark, d):
    """MOL2 atom records, connection points as hydrogen."""
    q, n, free = F.col("q"), F.col("n"), F.col("q") % 3 == 0
    word = lambda c: c.cast("string")
    value = F.concat_ws(" ", word(F.col("line_no") + 1), F.when(free, "Du").otherwise("C"), word(q), word(n), word(q + n), F.when(free, "Du").otherwise("C.ar"), F.lit("1 RES1 0.0"), F.when(free, "*"))
    return FI.connection_points(B.bound(spark, d, _LINES).select("path", "line_no", value.alias("value")))


@query(f"""WITH l AS ({_LINES.replace("AS INT)", "AS INTEGER)")}), m AS (SELECT *, max(line_no) OVER (PARTITION BY path) AS last FROM l) SELECT path, line_no, CAST(q AS DOUBLE) AS frequency FROM m WHERE line_no >= 3 AND line_no < last""")
def vibrational_frequencies(spark, d):
    """S17."""
    value = F.concat_ws(" ", F.lit("mode"), F.col("line_no").cast("string"), F.col("q").cast("string"))
    return FI.vibrational_frequencies(B.bound(spark, d, _LINES).select("path", "line_no", value.alias("value")))


# --- the checker's labels, node names, and the whole oxidation check (C9, N21, M4-M9, C10, N17-N19, A22) ---


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE coalesce(nullif(concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'has_atomic_overlaps' END, CASE WHEN p_size % 3 = 0 THEN 'has_carbon' END, CASE WHEN p_size % 5 = 0 THEN 'is_porous' END), ''), 'good') END AS label FROM part""")
def external_checks(spark, d):
    """Names of the bad ones among the external checker's booleans."""
    size = F.col("p_size")
    given = F.create_map(F.lit("has_atomic_overlaps"), size % 2 == 0, F.lit("has_carbon"), size % 3 != 0, F.lit("is_porous"), size % 5 != 0)
    return B.table(spark, d, "part").select("p_partkey", N.checker_labels(F.when(F.col("p_partkey") % 7 != 0, given)).alias("label"))


@query("""WITH n AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS formula, CAST(p_size AS INTEGER) AS size FROM part), f AS (SELECT formula, size, min(id) AS first FROM n GROUP BY 1, 2),
t AS (SELECT formula, size, CASE WHEN size <= 5 THEN size ELSE 5 + row_number() OVER (PARTITION BY formula, size <= 5 ORDER BY first) END AS k FROM f)
SELECT id AS structure_id, CAST(0 AS BIGINT) AS node_id, n.formula || '_Type-' || CAST(k AS VARCHAR) AS name FROM n JOIN t ON t.formula = n.formula AND t.size = n.size""")
def registered_nodes(spark, d):
    """Nodes by formula and distances; five types of each formula are known."""
    part = B.table(spark, d, "part")
    nodes = part.select(F.col("p_partkey").cast("long").alias("structure_id"), F.lit(0).cast("long").alias("node_id"), F.col("p_brand").alias("formula"), F.array(F.col("p_size").cast("double"), F.lit(1.0)).alias("distances"))
    known = part.select(F.col("p_brand").alias("formula")).distinct().withColumn("type_k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return CL.register_nodes(nodes, known.withColumn("distances", F.array(F.lit(1.0), F.col("type_k").cast("double"))))


#: A zinc complex for each order, or two if its key is even; each line is a ligand: hydroxide, water, formate across both zincs, or (beside one zinc) a free oxide.
_LIGANDS = """SELECT sid, n, 10 * n AS o, CASE WHEN sid % 2 = 0 AND n % 2 = 1 THEN 1 ELSE 0 END AS m, CAST(sid % 2 = 0 AS INT) AS two, CASE WHEN kind = 3 AND sid % 2 = 0 THEN 1 ELSE kind END AS kind
    FROM (SELECT l_orderkey AS sid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS n, CAST(l_quantity AS INT) % 4 AS kind FROM lineitem) v"""
_ZINC = O.ElementStates(chances=[0.0, 0.01, 0.99, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], energies=[9.394, 17.964, 39.723], known=[0, 1, 2])


@query(f"""WITH l AS ({_LIGANDS}), m AS (SELECT sid, unnest(CASE WHEN sid % 2 = 0 THEN [0, 1] ELSE [0] END) AS atom FROM (SELECT DISTINCT sid FROM l)),
e AS (SELECT sid, m AS atom, kind = 0 AS charged, 1.0 AS share FROM l WHERE kind IN (0, 1) UNION ALL SELECT sid, unnest([0, two]), true, 0.5 FROM l WHERE kind = 2),
i AS (SELECT m.sid, m.atom, coalesce(sum(CASE WHEN charged THEN share END), 0) AS charge, count(e.sid) AS cn FROM m LEFT JOIN e ON e.sid = m.sid AND e.atom = m.atom GROUP BY 1, 2),
j AS (SELECT sid, bool_or(kind = 2) AS joined, 2 * count(*) FILTER (kind = 3) AS free FROM l GROUP BY 1),
s AS (SELECT i.*, joined, free, CASE WHEN joined THEN 0 ELSE atom END AS network, CASE WHEN joined THEN avg(charge) OVER (PARTITION BY i.sid) ELSE charge END AS spread FROM i JOIN j ON j.sid = i.sid),
f AS (SELECT *, spread + free AS state FROM s), g AS (SELECT *, state % 1 <= 0.0001 AND state NOT IN (1, 2) AS unlikely FROM f)
SELECT sid AS structure_id, CAST(atom AS INTEGER) AS atom_idx, 'Zn' AS metal, CAST(charge AS DOUBLE) AS "inner", CAST(cn AS DOUBLE) AS cn, CAST(network AS INTEGER) AS network, CAST(spread AS DOUBLE) AS network_state, CAST(state AS DOUBLE) AS state, CASE WHEN state > {E.valence_electrons("Zn")} THEN 'BAD' ELSE 'GOOD' END AS impossible, CASE WHEN state > 2.5 THEN 'BAD' ELSE 'GOOD' END AS "unknown", CASE WHEN state = 0 THEN 'BAD' ELSE 'GOOD' END AS zero_valence,
'GOOD' AS noint_flag, CASE WHEN unlikely THEN 'LIKELY_BAD' ELSE 'GOOD' END AS low_prob_1, CASE WHEN unlikely THEN 'BAD' ELSE 'GOOD' END AS low_prob_2, CASE WHEN unlikely THEN 'BAD' ELSE 'GOOD' END AS low_prob_3, 'GOOD' AS low_prob_multi FROM g""")
def oxidation_check(spark, d):
    """States and flags of zinc complexes; carbenes (M4) and mixed metals are in the tests."""
    ligands = B.bound(spark, d, _LIGANDS)
    atom = lambda c, element: f"struct(CAST({c} AS INT) AS atom_idx, '{element}' AS element)"
    bond = lambda i, j, kind="Single": f"struct(CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, '{kind}' AS bond_type)"
    oxygen, formate = atom("o", "O"), f"array({atom('o', 'O')}, {atom('o + 1', 'C')}, {atom('o + 2', 'O')}, {atom('o + 3', 'H')})"
    nodes = ligands.selectExpr("sid AS structure_id", f"inline(CASE kind WHEN 0 THEN array({oxygen}, {atom('o + 1', 'H')}) WHEN 1 THEN array({oxygen}, {atom('o + 1', 'H')}, {atom('o + 2', 'H')}) WHEN 2 THEN {formate} ELSE array({oxygen}) END)")
    metals = ligands.select("sid", "two").distinct().selectExpr("sid AS structure_id", "explode(sequence(0, two)) AS atom_idx", "'Zn' AS element")
    carboxylate = f"array({bond('0', 'o')}, {bond('two', 'o + 2')}, {bond('o', 'o + 1', O.DELOCALISED)}, {bond('o + 1', 'o + 2', O.DELOCALISED)}, {bond('o + 1', 'o + 3')})"
    edges = ligands.selectExpr("sid AS structure_id", f"inline(CASE kind WHEN 0 THEN array({bond('m', 'o')}, {bond('o', 'o + 1')}) WHEN 1 THEN array({bond('m', 'o')}, {bond('o', 'o + 1')}, {bond('o', 'o + 2')}) WHEN 2 THEN {carboxylate} END)")
    bonds = edges.withColumns({"is_conjugated": F.lit(False), "is_cyclic": F.lit(False)})
    zero = F.lit(0.0)
    return O.metal_states(nodes.unionByName(metals).withColumns({"x": zero, "y": zero, "z": zero}), bonds, {"Zn": _ZINC})


# --- grouped operators: rows are checked by the tests against brute force ---


@query()
def cleaned_structures(spark, d):
    """Both passes of the list-based cleaning."""
    return CL.clean(B.atoms(spark, d))


@query()
def cleaned_by_charge(spark, d):
    """C5, C6."""
    return CL.clean(B.atoms(spark, d), by_charge=True)


@query()
def metal_site_analysis(spark, d):
    """G1-G7, N11, N12, W5, W6."""
    return N.analyse_metals(B.atoms(spark, d))


def _shells(n: int) -> str:
    """CTEs s0, ... sn: the (atom, image) nodes of each shell around each atom, less those of the shell itself and the one before."""
    out = ["s0 AS (SELECT structure_id, atom_idx AS c, atom_idx AS i, 0 AS u, 0 AS v, 0 AS w FROM atoms)"]
    for k in range(n):
        gone = f"EXCEPT SELECT * FROM s{k}" + (f" EXCEPT SELECT * FROM s{k - 1}" if k else "")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT DISTINCT s.structure_id, c, j AS i, u - su AS u, v - sv AS v, w - sw AS w FROM s{k} s JOIN steps t ON t.structure_id = s.structure_id AND t.i = s.i {gone})")
    return ", ".join(out)


_STEP = ", ".join(f"CAST(round_even(a.f{k} - b.f{k}, 0) AS INTEGER) AS s{n}" for k, n in zip("xyz", "uvw"))
_SIZES = ", ',', ".join(f"(SELECT count(*) FROM s{k} s WHERE s.structure_id = a.structure_id AND s.c = a.atom_idx)" for k in range(1, 7))


@query(f"""WITH {WITH}, {PAIRS}, {SITE_BONDS}, steps AS MATERIALIZED (SELECT p.structure_id, p.i, p.j, {_STEP} FROM site_bonds p JOIN atoms a ON a.structure_id = p.structure_id AND a.atom_idx = p.i JOIN atoms b ON b.structure_id = p.structure_id AND b.atom_idx = p.j UNION ALL SELECT structure_id, atom_idx, atom_idx, 0, 0, 0 FROM atoms), {_shells(6)}
SELECT a.structure_id, CAST(a.atom_idx AS INTEGER) AS atom_idx, a.element, concat({_SIZES}) AS shells FROM atoms a""")
def coordination_sequences(spark, d):
    """N10."""
    return N.coordination_sequences(B.atoms(spark, d))


@query()
def site_features(spark, d):
    """H1, H2: all features of each site."""
    return FE.site_features(B.atoms(spark, d))


@query()
def autocorrelations(spark, d):
    """H3."""
    return FE.autocorrelations(B.atoms(spark, d))


@query()
def named_descriptors(spark, d):
    """H3: the 176 descriptors by name."""
    out = FE.named_descriptors(B.atoms(spark, d))
    return out.select("structure_id", *(F.to_json(c).alias(c) for c in ("metal", "linker", "functional")))


@query()
def primitive_cells(spark, d):
    """Cells without inner translations."""
    return N.primitive_cells(B.atoms(spark, d))


@query()
def framework_dimensions(spark, d):
    """H8."""
    return FE.dimensionality(B.atoms(spark, d))


@query()
def unwrapped_fragments(spark, d):
    """N22."""
    return CL.unwrap_fragments(B.atoms(spark, d))


@query()
def pore_estimates(spark, d):
    """H9: seeded estimates of surface, volume and largest sphere."""
    return FE.pore_geometry(B.atoms(spark, d))
