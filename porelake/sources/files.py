"""Other inputs and outputs: databases of records, archives, fragments, spectra, pore reports, predictions; writers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from porelake.functions.scalars import THZ_TO_WAVENUMBER
from porelake.sources.cif import write_text

#: Data sets of the record database: those with computation-ready subsets, and the flat one.
SUBSETS = {"CR-ASR": "ASR", "CR-FSR": "FSR", "CR-Ion": "Ion"}


def read_records(spark: SparkSession, ready_path: str, other_path: str) -> DataFrame:
    """Two JSON files -> (dataset, entry, record variant, units): CR-ASR, CR-FSR, CR-Ion by subset, NCR flat."""
    text = lambda p: spark.read.text(p, wholetext=True)
    ready = text(ready_path).select(F.from_json("value", "map<string,string>").alias("top"))
    parts = None
    for dataset, subset in SUBSETS.items():
        rows = ready.select(F.lit(dataset).alias("dataset"), F.explode(F.from_json(F.col("top")[subset], "map<string,string>")).alias("entry", "record"), F.col("top")["unit"].alias("units"))
        parts = rows if parts is None else parts.unionByName(rows)
    flat = text(other_path).select(F.lit("NCR").alias("dataset"), F.explode(F.from_json("value", "map<string,string>")).alias("entry", "record"), F.lit(None).cast("string").alias("units"))
    return parts.unionByName(flat).withColumn("record", F.parse_json("record"))


def lookup_record(records: DataFrame, dataset: str, entry: str) -> DataFrame:
    """The record of an entry; an unknown data set is an error, a missing entry gives no row."""
    if dataset not in (*SUBSETS, "NCR"):
        raise ValueError(f"no data set {dataset}; there are {', '.join((*SUBSETS, 'NCR'))}")
    return records.where((F.col("dataset") == dataset) & (F.col("entry") == entry))


def archive_members(archives: DataFrame, pattern: str = r"^(CR|NCR)/.*\.cif$") -> DataFrame:
    """archives (path, content) of ZIP bytes -> (archive, path, content): members whose names match, each archive opened once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        if re.search(pattern, name):
                            yield pd.DataFrame({"archive": [path], "path": [name], "content": [z.read(name)]})

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, content binary")


def connection_points(lines: DataFrame) -> DataFrame:
    """lines (path, line_no, value) of MOL2 atom records: on those with `*`, Du becomes H; labels get 1, 2, ... appended."""
    from pyspark.sql import Window

    word = F.split(F.trim("value"), r"\s+")
    atoms = lines.where(F.size(word) >= 6).withColumn("value", F.when(F.col("value").contains("*"), F.regexp_replace("value", "Du", "H")).otherwise(F.col("value")))
    n = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return atoms.select("path", "line_no", F.concat(word[1], n.cast("string")).alias("label"), word[5].alias("type"), *(word[k].cast("double").alias(c) for k, c in ((2, "x"), (3, "y"), (4, "z"))))


def vibrational_frequencies(lines: DataFrame) -> DataFrame:
    """(path, line_no, value) -> (path, line_no, frequency): the third word of all but the first three lines and the last."""
    from pyspark.sql import Window

    last = F.max("line_no").over(Window.partitionBy("path"))
    rows = lines.withColumn("_last", last).where((F.col("line_no") >= 3) & (F.col("line_no") < F.col("_last")))
    return rows.select("path", "line_no", F.split(F.trim("value"), r"\s+")[2].cast("double").alias("frequency"))


def densities_of_states(lines: DataFrame) -> DataFrame:
    """(path, line_no, value) -> (path, line_no, frequency, site, dos): one header line, frequencies to wavenumbers, a row for each column."""
    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    rows = lines.where("line_no >= 1 and trim(value) != ''").select("path", "line_no", v.alias("v"))
    return rows.select("path", "line_no", (F.col("v")[0] * THZ_TO_WAVENUMBER).alias("frequency"), F.posexplode(F.slice("v", 2, F.size("v"))).alias("site", "dos"))


def mesh_frequencies(files: DataFrame) -> DataFrame:
    """files (path, value) of mesh YAML -> (path, band, frequency): the first q-point's bands, in wavenumbers."""
    first = F.element_at(F.split("value", r"(?m)^\s*- q-position:"), 2)
    found = F.transform(F.regexp_extract_all(first, F.lit(r"frequency:\s*([-+0-9.eE]+)"), 1), lambda x: x.cast("double") * THZ_TO_WAVENUMBER)
    return files.select("path", F.posexplode(found).alias("band", "frequency"))


def structure_of_site(name: Column) -> Column:
    """The structure's name in a site's: all but the last part between underscores."""
    return F.regexp_extract(name, r"^(.*)_[^_]*$", 1)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files, each read whole so that its lines keep their numbers."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))
    return files.select("path", F.posexplode("lines").alias("line_no", "value"))


def pore_diameters(text: Column) -> list[Column]:
    """LCD, PLD and LFPD: the second to fourth word of the report's first line."""
    words = F.split(F.trim(F.element_at(F.split(text, "\n"), 1)), r"\s+")
    return [words[k].cast("double").alias(n) for k, n in ((1, "lcd"), (2, "pld"), (3, "lfpd"))]


def report_value(text: Column, key: str) -> Column:
    """The number behind `key:` in a report."""
    return F.regexp_extract(text, r"(?:^|\s)" + re.escape(key) + r":\s*([-+0-9.eE]+)", 1).try_cast("double")


def surface_area(text: Column) -> list[Column]:
    """Accessible and inaccessible surface in the report's three units."""
    return [report_value(text, k).alias(n) for k, n in (("ASA_A^2", "asa_a2"), ("ASA_m^2/cm^3", "asa_m2_cm3"), ("ASA_m^2/g", "asa_m2_g"), ("NASA_A^2", "nasa_a2"), ("NASA_m^2/cm^3", "nasa_m2_cm3"), ("NASA_m^2/g", "nasa_m2_g"))]


def pore_volume(text: Column) -> list[Column]:
    return [report_value(text, k).alias(n) for k, n in (("POAV_A^3", "poav_a3"), ("POAV_Volume_fraction", "poav_fraction"), ("POAV_cm^3/g", "poav_cm3_g"), ("PONAV_A^3", "ponav_a3"), ("PONAV_Volume_fraction", "ponav_fraction"), ("PONAV_cm^3/g", "ponav_cm3_g"))]


def channel_dimension(text: Column) -> Column:
    """The number behind `dimensionality` in the first line."""
    return F.regexp_extract(F.element_at(F.split(text, "\n"), 1), r"dimensionality\s+(\d+)", 1).try_cast("int")


def framework_dimensions(text: Column) -> list[Column]:
    """Dimension and the numbers of one-, two- and three-dimensional frameworks, of the first line; null where it has no such words."""
    words = F.split(F.trim(F.element_at(F.split(text, "\n"), 1)), r"\s+")
    return [F.element_at(words, -1).try_cast("int").alias("dimension"), *(F.get(words, F.lit(k)).try_cast("int").alias(n) for k, n in ((7, "n_1d"), (8, "n_2d"), (9, "n_3d")))]


def write_structures(kept: DataFrame, path: str) -> None:
    """kept (file_name, a, b, c, alpha, beta, gamma, atoms array<struct<label,element,fx,fy,fz>>) as CIF text, a folder for each file name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [write_text(r.file_name, [r.a, r.b, r.c, r.alpha, r.beta, r.gamma], [(s["label"], s["element"], s["fx"], s["fy"], s["fz"]) for s in r.atoms]) for r in batch.itertuples()]
            yield pd.DataFrame({"file_name": batch["file_name"], "value": texts})

    kept.mapInPandas(run, "file_name string, value string").write.partitionBy("file_name").mode("overwrite").text(path)


def write_summaries(rows: DataFrame, path: str, verbose: bool = False) -> None:
    """Records as JSON lines; normally without dihedrals."""
    out = rows if verbose else rows.drop(*(c for c in rows.columns if "dihedral" in c))
    out.write.mode("overwrite").json(path)


def write_cleaning_table(rows: DataFrame, path: str, append: bool = False) -> None:
    """The table of cleaning as CSV: a list-based run writes it anew, a charge-based run appends."""
    rows.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes)).write.mode("append" if append else "overwrite").csv(path, header=True)


def write_histogram(histogram: DataFrame, path: str) -> None:
    """Bin centres and values, blank-separated, a folder for each number of ligands and openness."""
    histogram.orderBy("number_of_linkers", "is_open", "bin").select("number_of_linkers", "is_open", F.concat_ws(" ", F.col("centre").cast("string"), F.col("n").cast("string")).alias("value")).write.partitionBy("number_of_linkers", "is_open").mode("overwrite").text(path)


def copy_subset(rows: DataFrame, target: str) -> DataFrame:
    """rows with path rewritten into target, checksums unchanged; None leaves it alone."""
    return rows if target is None else rows.withColumn("path", F.concat(F.lit(target.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1)))
