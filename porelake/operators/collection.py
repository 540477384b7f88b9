"""Collections of structures as tables: filters, staged validation, sampling, batches, checks, summaries, histograms.

`mode="reference"` replicates that zero, false, empty and null values never match a filter; `mode="sql"` treats only null so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from porelake.functions import scalars as S

BINS = 50


def range_filter(value: Column, bounds: Iterable, mode: str = "reference") -> Column:
    """Inclusive between the smaller and the larger bound."""
    found = value.between(min(bounds), max(bounds))
    return F.coalesce(found & (value != 0) if mode == "reference" else found, F.lit(False))


def contains_all(value: Column, wanted: Iterable[str], mode: str = "reference") -> Column:
    """Every wanted entry is in the array; an empty array never matches in reference mode."""
    found = F.size(F.array_except(F.array(*map(F.lit, wanted)), value)) == 0
    return F.coalesce(found & (F.size(value) > 0) if mode == "reference" else found, F.lit(False))


def equals(value: Column, wanted, mode: str = "reference") -> Column:
    """In reference mode filtering for false or zero matches nothing."""
    found = value == F.lit(wanted)
    truthy = value.cast("boolean") if not isinstance(wanted, str) else value != ""
    return F.coalesce(found & truthy if mode == "reference" else found, F.lit(False))


def in_list(value: Column, wanted: Iterable, mode: str = "reference") -> Column:
    found = value.isin(list(wanted))
    return F.coalesce(found & (value.cast("string") != "") if mode == "reference" else found, F.lit(False))


Filter = Callable[..., Column]
#: Filters by property; register_filter() adds to them.
FILTERS: dict[str, Filter] = {
    "density": range_filter,
    "oms_density": range_filter,
    "uc_volume": range_filter,
    "metal_species": contains_all,
    "non_metal_species": contains_all,
    "cif_okay": equals,
    "has_oms": equals,
    "mof_name": in_list,
}
#: Properties that only the analysis of metal sites can tell.
SITE_PROPERTIES = frozenset({"oms_density", "has_oms", "problematic"})


def register_filter(name: str, build: Filter) -> None:
    FILTERS[name] = build


def condition(using: dict, mode: str = "reference") -> Column:
    """The conjunction of named filters; an unknown name is an error."""
    unknown = [n for n in using if n not in FILTERS]
    if unknown:
        raise ValueError(f"no filter for {', '.join(unknown)}; there are {', '.join(FILTERS)}")
    return reduce(lambda a, b: a & b, (FILTERS[n](F.col(n), v, mode=mode) for n, v in using.items()), F.lit(True))


def filter_collection(collection: DataFrame, using: dict, analyse: Callable[[DataFrame], DataFrame] | None = None, mode: str = "reference") -> DataFrame:
    """Cheap filters first; only what they leave is joined with analyse()'s site properties, and only if some filter asks for one.

    Catalyst can't push a filter below a grouped Python function, so the order is decided here.
    """
    early = {n: v for n, v in using.items() if n not in SITE_PROPERTIES or n in collection.columns}
    late = {n: v for n, v in using.items() if n not in early}
    out = collection.where(condition(early, mode))
    if late:
        if analyse is None:
            raise ValueError(f"{', '.join(late)} need the site analysis")
        out = out.join(analyse(out), "checksum").where(condition(late, mode))
    return out


def validation_level(collection: DataFrame, cif: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """(checksum, level, valid): 0 if cached properties have all keys, 1 with those of the file, 2 with those of the analysis; unreadable files count as valid."""
    side = lambda df, p: df.select(F.col("checksum").alias(f"{p}checksum"), *((F.col(k) if k in df.columns else F.lit(None)).alias(f"{p}{k}") for k in keys))
    c, f, s = side(collection, "c_"), side(cif, "f_"), side(sites, "s_")
    okay = cif.select(F.col("checksum").alias("o_checksum"), F.col("cif_okay").alias("okay"))
    rows = c
    for other, p in ((f, "f_"), (s, "s_"), (okay, "o_")):
        rows = rows.join(other, F.col("c_checksum") == F.col(f"{p}checksum"), "left")
    has = lambda *ps: reduce(lambda a, b: a & b, (F.coalesce(*(F.col(f"{p}{k}") for p in ps)).isNotNull() for k in keys))
    unreadable = ~F.coalesce("okay", F.lit(True))
    level = F.when(has("c_"), 0).when(has("c_", "f_") | unreadable, 1).otherwise(2)
    return rows.select(F.col("c_checksum").alias("checksum"), level.alias("level"), (has("c_", "f_", "s_") | unreadable).alias("valid"))


def sample(collection: DataFrame, size: int = 50, seed: int = 0) -> DataFrame:
    """Exactly size rows, or all if there are fewer, without replacement."""
    return collection.orderBy(F.rand(seed)).limit(size)


def first_per_type(rows: DataFrame, n: int, type_col: str = "structure_type", atom_col: str = "atom_types", key: str = "name", seed: int = 0) -> DataFrame:
    """n rows: the first two by key of each structure type, then the first of each atom type, then others at random."""
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(key))
    ranked = rows.withColumn("_s", rank(type_col)).withColumn("_a", rank(atom_col)).withColumn("_r", F.rand(seed))
    tier = F.when(F.col("_s") <= 2, 0).when(F.col("_a") <= 1, 1).otherwise(2)
    return ranked.withColumn("_t", tier).orderBy("_t", F.when(F.col("_t") < 2, F.lit(0.0)).otherwise(F.col("_r")), key).limit(n).drop("_s", "_a", "_r", "_t")


def cheapest(collection: DataFrame, limit: int, key: str = "name") -> DataFrame:
    """The structures of the smallest number of atoms squared."""
    return collection.orderBy(F.col("n_atoms") * F.col("n_atoms"), key).limit(limit)


def skip_existing(collection: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """What has no finished result: rows of results with a running marker don't count."""
    done = results.where(~F.coalesce("running", F.lit(False))) if "running" in results.columns else results
    return collection.join(done.select(*keys).distinct(), keys, "left_anti")


def batches(collection: DataFrame, num_batches: int, key: str = "name", limit: int | None = None) -> DataFrame:
    """collection with batch: contiguous runs of about equal cost (atoms squared) in ascending order of cost.

    The total is taken before the limit. Costs are summed by value first, so the window runs over as many rows as there are
    distinct costs, and over the rows of one cost within it, not over all rows in one task.
    """
    cost = F.col("n_atoms").cast("long") * F.col("n_atoms").cast("long")
    rows = collection.withColumn("cost", cost)
    by_cost = rows.groupBy("cost").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("cost").rowsBetween(Window.unboundedPreceding, -1)
    all_costs = F.sum(F.col("cost") * F.col("n"))
    bases = by_cost.select("cost", F.coalesce(all_costs.over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"), all_costs.over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("cost").orderBy(key)) - 1
    out = rows.join(bases, "cost").withColumn("place", place)
    if limit is not None:
        out = out.where(F.col("base_n") + F.col("place") < limit)
    before_cost = F.col("base") + F.col("place") * F.col("cost")
    return out.withColumn("batch", F.floor(before_cost / (F.col("total") / num_batches)).cast("int")).drop("base", "base_n", "total", "place")


def checksum_conflicts(collection: DataFrame) -> DataFrame:
    """(checksum, names): contents that came under several names."""
    return collection.groupBy("checksum").agg(F.count_distinct("name").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names")).where("n > 1").drop("n")


def stale_results(collection: DataFrame, results: DataFrame) -> DataFrame:
    """(name, checksum, stored): names whose stored result was made from other contents."""
    r = results.select("name", F.col("checksum").alias("stored"))
    return collection.select("name", "checksum").join(r, "name").where("checksum != stored")


def check_report(collection: DataFrame, results: DataFrame) -> DataFrame:
    """One row: members, unreadable, without metal, unfinished."""
    done = results.select("checksum", F.lit(True).alias("done")).distinct()
    return collection.join(done, "checksum", "left").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(~F.col("cif_okay")).alias("unreadable"),
        F.count_if(F.col("cif_okay") & (F.size("metal_species") == 0)).alias("without_metal"),
        F.count_if(F.col("done").isNull()).alias("unfinished"),
    )


def upsert_properties(stored: DataFrame, fresh: DataFrame, key: str = "checksum") -> DataFrame:
    """Per key and column the fresh value, else the stored one."""
    s, f = stored.alias("s"), fresh.alias("f")
    joined = s.join(f, F.col(f"s.{key}") == F.col(f"f.{key}"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"f.{c}") if c in fresh.columns else F.lit(None), F.col(f"s.{c}") if c in stored.columns else F.lit(None))
    return joined.select(*(pick(c).alias(c) for c in dict.fromkeys([*stored.columns, *fresh.columns])))


def site_summary(sites: DataFrame, elements: DataFrame | None = None, max_atomic_number: int | None = None) -> DataFrame:
    """By metal over unique sites: structures, sites, those that are open, and their percentages; most structures first.

    Sites are summed by metal and structure first, so distinct structures are counted without expanding rows for each
    distinct count. A largest atomic number is applied after the aggregate and needs the element dimension.
    """
    by_structure = sites.where("is_unique").groupBy("metal", "name").agg(F.count("is_open").alias("n"), F.sum(F.col("is_open").cast("long")).alias("o"))
    out = by_structure.groupBy("metal").agg(F.count("name").alias("structures"), F.count(F.when(F.col("o") > 0, F.col("name"))).alias("structures_with_oms"), F.sum("n").alias("metal_sites"), F.sum("o").alias("oms"))
    out = out.withColumn("structures_pct", S.percentage(F.col("structures_with_oms"), F.col("structures"))).withColumn("oms_pct", S.percentage(F.col("oms"), F.col("metal_sites")))
    if max_atomic_number is not None:
        out = out.join(elements.where(F.col("z") <= max_atomic_number).select(F.col("symbol").alias("metal")), "metal", "left_semi")
    return out.orderBy(F.desc("structures"), "metal")


def site_totals(sites: DataFrame) -> DataFrame:
    """One row: structures, structures with any open site, unique sites, unique open sites."""
    by_structure = sites.groupBy("name").agg(F.bool_or("is_open").alias("open"), F.count_if("is_unique").alias("u"), F.count_if(F.col("is_unique") & F.col("is_open")).alias("o"))
    return by_structure.agg(
        F.count("name").alias("structures"),
        F.count(F.when(F.col("open"), F.col("name"))).alias("structures_with_oms"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("unique_sites"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("unique_oms"),
    )


def structure_metals(sites: DataFrame) -> DataFrame:
    """By structure: its metals, whether it has open sites, and the metals of its unique open sites or N/A."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = sites.groupBy("name").agg(
        joined(F.col("metal")).alias("metals"),
        F.when(F.bool_or("is_open"), "Yes").otherwise("No").alias("has_oms"),
        joined(F.when(F.col("is_open") & F.col("is_unique"), F.col("metal"))).alias("oms"),
    )
    return out.withColumn("oms", F.when(F.col("oms") == "", "N/A").otherwise(F.col("oms")))


def flattened_sites(summaries: DataFrame) -> DataFrame:
    """(name, metal_sites array<struct>) -> a row for each site with key <name>_<i>, without dihedrals."""
    rows = summaries.select("name", F.posexplode("metal_sites").alias("i", "site"))
    kept = [f.name for f in summaries.schema["metal_sites"].dataType.elementType.fields if "dihedral" not in f.name]
    return rows.select(F.concat_ws("_", "name", "i").alias("site_key"), "name", *(F.col(f"site.{k}").alias(k) for k in kept))


def structure_oms(sites: DataFrame, structures: DataFrame) -> DataFrame:
    """By structure: unique sites by volume (under its usual name), open sites by volume, has_oms, problematic."""
    by = sites.groupBy("name").agg(F.count_if("is_unique").alias("_u"), F.count_if(F.col("is_unique") & F.col("is_open")).alias("_o"), F.bool_or("is_open").alias("has_oms"), F.bool_or("problematic").alias("problematic"))
    return structures.join(by, "name").select("name", (F.col("_u") / F.col("uc_volume")).alias("oms_density"), (F.col("_o") / F.col("uc_volume")).alias("open_site_density"), "has_oms", "problematic")


def t_factor_histograms(sites: DataFrame, bins: int = BINS) -> DataFrame:
    """(number_of_linkers, is_open, bin, centre, n, density): unique sites of 4, 5 and 6 ligands, bins over [0, 1], the last one closed.

    Values out of range are left out. Empty bins are listed; density is the count over the total times the bin's width. All
    twelve tables come from one aggregate over at most 6 * bins groups.
    """
    spark = sites.sparkSession
    inside = sites.where(F.col("is_unique") & F.col("number_of_linkers").isin(4, 5, 6) & F.col("t_factor").between(0.0, 1.0))
    counted = inside.groupBy("number_of_linkers", "is_open", F.least(F.lit(bins - 1), F.floor(F.col("t_factor") * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(k, o) for k in (4, 5, 6) for o in (True, False)], "number_of_linkers int, is_open boolean").select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counted, ["number_of_linkers", "is_open", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("number_of_linkers", "is_open"))
    return out.withColumn("centre", (F.col("bin") + 0.5) / bins).withColumn("density", F.when(total > 0, F.col("n") * bins / total).otherwise(F.lit(0.0)))


def mass_volume_density(atoms: DataFrame, structures: DataFrame, elements: DataFrame) -> DataFrame:
    """By structure: atoms, mass (u), volume (Å³), density (g/cm³)."""
    by = atoms.join(F.broadcast(elements.select("symbol", "mass")), F.col("element") == F.col("symbol"), "left").groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.sum("mass").alias("mass"))
    return by.join(structures.select("structure_id", "volume"), "structure_id").select("*", (F.col("mass") * 1.66053906660 / F.col("volume")).alias("density"))


def presence(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """(structure_id, label): whether a structure has metal and carbon."""
    metal = F.broadcast(elements.select("symbol", "is_metal_curation"))
    by = atoms.join(metal, F.col("element") == F.col("symbol"), "left").groupBy("structure_id").agg(F.coalesce(F.bool_or("is_metal_curation"), F.lit(False)).alias("m"), F.coalesce(F.bool_or(F.col("element") == "C"), F.lit(False)).alias("c"))
    return by.select("structure_id", S.presence_label(F.col("m"), F.col("c")).alias("label"))


def map_structures(rows: DataFrame, function, schema: str, key: str = "structure_id") -> DataFrame:
    """A pandas function of each structure's rows: the extension point for operators of one's own."""
    return rows.groupBy(key).applyInPandas(function, schema)
