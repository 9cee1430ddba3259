"""File sources and sinks (A4-A7, A15): JSON embeddings, reduced vectors,
model export, landed JSON feeds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_embeddings_json(spark: SparkSession, path: str) -> DataFrame:
    """A4: JSON lines holding either a bare array or ``{"embedding": [...]}``
    (read as text so both shapes parse with one schema-less pass)."""
    raw = spark.read.text(path)
    arr = F.from_json(F.col("value"), "array<double>")
    obj = F.from_json(F.col("value"), "struct<embedding:array<double>>")["embedding"]
    v = F.when(F.trim("value").startswith("["), arr).otherwise(obj)
    return raw.select(v.alias("embedding")).where(F.col("embedding").isNotNull())


def write_reduced_json(df: DataFrame, path: str, original_col: str = "embedding",
                       reduced_col: str = "reduced") -> None:
    """A5: ``{original_dims, reduced_dims, reduced_embedding}`` JSON lines."""
    (df.select(F.size(original_col).alias("original_dims"), F.size(reduced_col).alias("reduced_dims"),
               F.col(reduced_col).alias("reduced_embedding"))
     .write.mode("overwrite").json(path))


def export_model_json(spark: SparkSession, mean: list[float], model, path: str) -> None:
    """Model as one JSON document {n_components, mean, components,
    explained_variance_ratio} (the model is d × k numbers, driver-sized by
    construction)."""
    pc = model.pc.toArray()  # d × k
    doc = {"n_components": int(pc.shape[1]), "mean": [float(x) for x in mean],
           "components": [[float(x) for x in pc[:, j]] for j in range(pc.shape[1])],
           "explained_variance_ratio": [float(x) for x in model.explainedVariance.toArray()]}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_model(spark: SparkSession, mean: list[float], model, path: str) -> None:
    """MLlib writer for the PCA model plus the mean vector as Parquet."""
    model.write().overwrite().save(f"{path}/pca")
    spark.createDataFrame([(mean,)], "mean array<double>").write.mode("overwrite").parquet(f"{path}/mean")


def load_model(spark: SparkSession, path: str):
    """Load what ``save_model`` wrote -> (mean, PCAModel)."""
    from pyspark.ml.feature import PCAModel
    mean = list(spark.read.parquet(f"{path}/mean").first()["mean"])
    return mean, PCAModel.load(f"{path}/pca")


def read_landed_feed(spark: SparkSession, path: str, list_field: str, schema: str | None = None,
                     multi_line: bool = True) -> DataFrame:
    """Landed JSON documents (KEV / CVE lists, registry files) exploded
    to one row per entry.  ``multi_line`` reads one pretty-printed document
    per file; otherwise every line is a document.  Fetching over HTTP is not
    part of this engine."""
    r = spark.read.option("multiLine", "true" if multi_line else "false")
    if schema:
        r = r.schema(schema)
    doc = r.json(path)
    return doc.select(F.posexplode(F.col(list_field)).alias("entry_index", "entry")).select("entry_index", "entry.*")
