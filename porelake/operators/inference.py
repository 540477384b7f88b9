"""Predictions by models that the user brings: ensembles over sites, several temperatures, stability vectors, metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from porelake.functions.scalars import first_known, heat_capacity

EPSILON = 1e-7

Model = Callable[[pd.DataFrame], Sequence[float]]


def predict_sites(sites: DataFrame, models: dict[str, Model], features: list[str], schema_extra: str = "structure_id long, site_idx int, mass double") -> DataFrame:
    """(structure_id, site_idx, mass, model, prediction): each of the models on Arrow batches of feature columns; models go to the tasks."""
    keys = [c.split()[0] for c in schema_extra.split(", ")]

    def run(batches):
        for batch in batches:
            for name, model in models.items():
                yield batch[keys].assign(model=name, prediction=[float(x) for x in model(batch[features])])

    return sites.select(*keys, *features).mapInPandas(run, f"{schema_extra}, model string, prediction double")


def linear_predictions(sites: DataFrame, models: dict[str, tuple[float, dict[str, float]]], keys: list[str]) -> DataFrame:
    """The same for linear models (intercept, weights), as expressions."""
    terms = [F.struct(F.lit(name).alias("model"), reduce(lambda a, b: a + b, (w * F.col(f) for f, w in weights.items()), F.lit(b0)).alias("prediction")) for name, (b0, weights) in models.items()]
    return sites.select(*keys, F.explode(F.array(*terms)).alias("m")).select(*keys, "m.*")


def ensemble(predictions: DataFrame, by: list[str]) -> DataFrame:
    """predictions (by..., mass, model, prediction) -> mean and population deviation across models of the molar (per site) and gravimetric (per mass) value."""
    per_model = predictions.groupBy(*by, "model").agg((F.sum("prediction") / F.count(F.lit(1))).alias("molar"), (F.sum("prediction") / F.sum("mass")).alias("gravimetric"))
    return per_model.groupBy(*by).agg(F.avg("gravimetric").alias("gravimetric_mean"), F.stddev_pop("gravimetric").alias("gravimetric_std"), F.avg("molar").alias("molar_mean"), F.stddev_pop("molar").alias("molar_std"))


def by_temperature(predictions: DataFrame, temperatures: list[float]) -> DataFrame:
    """ensemble() for each temperature, side by side: columns <T>_gravimetric_mean and so on."""
    out = ensemble(predictions, ["structure_id", "temperature"])
    values = ["gravimetric_mean", "gravimetric_std", "molar_mean", "molar_std"]
    wide = out.groupBy("structure_id").pivot("temperature", temperatures).agg(*(F.first(v).alias(v) for v in values))
    return wide


def heat_capacity_sum(dos: DataFrame, temperatures: list[float], by: list[str]) -> DataFrame:
    """dos (by..., frequency, dos) -> a column for each temperature: the harmonic heat capacity summed over the spectrum."""
    return dos.where("frequency > 0").groupBy(*by).agg(*(F.sum(heat_capacity(F.col("frequency"), t) * F.col("dos")).alias(f"cv_{t:g}") for t in temperatures))


def site_labels(dos: DataFrame, n_sites: DataFrame, temperatures: list[float]) -> DataFrame:
    """By site the heat capacity at each temperature (pCv_<T>), of structures with as many sites as spectra."""
    columns = dos.groupBy("structure_id").agg(F.count_distinct("site").alias("spectra"))
    good = n_sites.join(columns, "structure_id").where("n_sites = spectra").select("structure_id")
    out = heat_capacity_sum(dos.join(good, "structure_id", "left_semi"), temperatures, ["structure_id", "site"])
    return out.select("structure_id", "site", *(F.col(f"cv_{t:g}").alias(f"pCv_{t:05.2f}".replace(".", "_")) for t in temperatures))


def _hits(p: Column) -> Column:
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def classification_metrics(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """precision, recall and f1 of clipped, rounded values, with an epsilon below the line."""
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    sums = rows.groupBy(*(by or [])).agg(F.sum(_hits(t * p)).alias("hit"), F.sum(_hits(p)).alias("said"), F.sum(_hits(t)).alias("there"))
    out = sums.withColumn("precision", F.col("hit") / (F.col("said") + EPSILON)).withColumn("recall", F.col("hit") / (F.col("there") + EPSILON))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPSILON)).drop("hit", "said", "there")


def feature_vector(names: list[str], *maps: Column) -> Column:
    """Features by name, each from the first map that has it."""
    return F.array(*(first_known(F.lit(n), *maps) for n in names))


def stability_vectors(rows: DataFrame, geometry: list[str], descriptors: list[str]) -> DataFrame:
    """solvent: geometry then descriptors; thermal: descriptors then geometry. rows have maps metal, linker, group, geometry."""
    maps = [F.col(c) for c in ("metal", "linker", "group", "geometry")]
    return rows.withColumn("solvent", feature_vector([*geometry, *descriptors], *maps)).withColumn("thermal", feature_vector([*descriptors, *geometry], *maps))


def standardised(vector: Column, means: list[float], scales: list[float]) -> Column:
    m, s = F.array(*map(F.lit, means)), F.array(*map(F.lit, scales))
    return F.transform(F.arrays_zip(vector.alias("v"), m.alias("m"), s.alias("s")), lambda x: (x["v"] - x["m"]) / x["s"])


def predict_vectors(rows: DataFrame, models: dict[str, tuple[str, Model]], key: str) -> DataFrame:
    """models: name -> (vector column, model) -> (key, name...): batches of vectors to each model."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({key: batch[key], **{n: [float(x) for x in m(pd.DataFrame(batch[c].tolist()))] for n, (c, m) in models.items()}})

    return rows.mapInPandas(run, ", ".join([f"{key} {kind}", *(f"{n} double" for n in models)]))


def difference_features(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of predictions merged on their keys, both columns kept."""
    return a.join(b, keys, "inner")
