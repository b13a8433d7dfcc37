"""2-D projection with a stored model and a drift test. The projector is PCA from Spark ML."""

from __future__ import annotations

import json
import re

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import config


def _features(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("_f", array_to_vector(F.col(vector)))


def fit(rows: DataFrame, vector: str = "v") -> PCAModel | None:
    """A projector; none for fewer than three rows."""
    return PCA(k=2, inputCol="_f", outputCol="_p").fit(_features(rows, vector)) if rows.limit(3).count() == 3 else None


def transform(model: PCAModel | None, rows: DataFrame, vector: str = "v") -> DataFrame:
    """``rows`` with ``umap_x, umap_y``; zeros without a model."""
    if model is None:
        return rows.withColumn("umap_x", F.lit(0.0)).withColumn("umap_y", F.lit(0.0))
    p = vector_to_array(F.col("_p"))
    return model.transform(_features(rows, vector)).withColumn("umap_x", p[0]).withColumn("umap_y", p[1]).drop("_f", "_p")


def safe_dir(name: str) -> str:
    return re.sub(r"[^\w-]", "_", name) if name else "unnamed"


def save(model: PCAModel, name: str, ids: DataFrame, base: str) -> str:
    """Writes model, ids and a note; what was there before goes."""
    path = f"{base}/{safe_dir(name)}"
    model.write().overwrite().save(f"{path}/model")
    ids.toDF("id").write.mode("overwrite").parquet(f"{path}/ids")
    note = json.dumps({"dataset": name, "backend": "pca"})
    ids.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path


def load(spark: SparkSession, name: str, base: str) -> dict | None:
    """``{model, ids, meta}``, or None where anything is missing or broken."""
    path = f"{base}/{safe_dir(name)}"
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return {"model": PCAModel.load(f"{path}/model"), "ids": spark.read.parquet(f"{path}/ids"), "meta": meta}
    except Exception:
        return None


def clear(spark: SparkSession, name: str, base: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{safe_dir(name)}")
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def drift(saved: DataFrame, current: DataFrame, threshold: float = config.RETRAIN_DRIFT) -> DataFrame:
    """One row ``(n_saved, n_new, drift, retrain)``: share of new ids among the saved ones; removed ids do not count.

    Retrain if nothing is saved or the share exceeds the threshold.
    """
    old, now = saved.select(F.col(saved.columns[0]).alias("id")).distinct(), current.select(F.col(current.columns[0]).alias("id")).distinct()
    n_old = old.agg(F.count(F.lit(1)).alias("n_saved"))
    n_new = now.join(old, "id", "left_anti").agg(F.count(F.lit(1)).alias("n_new"))
    share = F.when(F.col("n_saved") > 0, F.col("n_new") / F.col("n_saved"))
    return n_old.crossJoin(n_new).select("n_saved", "n_new", F.round(share, 6).alias("drift"), F.coalesce(share > threshold, F.lit(True)).alias("retrain"))
