"""Token contributions to the predicted class of the linear model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.operators.classifier import PAIR, SentimentModel, with_pair
from tonecast.operators.cleaning import sample_rows


def background_mean(df: DataFrame, model: SentimentModel, n: int | None = None, seed: int = 42,
                    key: str = "review_id", aspect: str = "aspect") -> np.ndarray:
    """Mean feature vector of all rows, or of a repeatable sample of ``n``; one number per term reaches the driver."""
    rows = df.select(key, "review_text", aspect).na.drop()
    rows = rows if n is None else sample_rows(rows, n, seed, key)
    sums = model.features.sums(with_pair(rows, aspect), PAIR).toPandas()
    index, total = sums["index"].to_numpy(dtype="int64"), sums["s"].to_numpy()
    mean = np.zeros(len(model.features.idf))
    mean[index[index >= 0]] = total[index >= 0] / max(total[index < 0].sum(), 1)
    return mean


def explain(df: DataFrame, model: SentimentModel, mean: np.ndarray, top_k: int | None = 15, key: str = "review_id",
            aspect: str = "aspect") -> DataFrame:
    """Long rows (key, sentiment_pred, base_value, term, value, rank).

    A present term contributes ``weight * (x - mean)`` of the predicted class against the base value
    ``intercept + weight . mean``. Ranking by absolute value happens inside each row.
    """
    coefficients = model.regression.coefficientMatrix.toArray()
    base = model.regression.interceptVector.toArray() + coefficients @ mean
    scored = model.transform(df.select(key, "review_text", aspect), aspect, keep_features=True).select(
        key, "features", "sentiment_pred")
    index = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("sentiment_pred")).cast("int") - 1
    vectors = scored.withColumn("_c", index)

    @F.arrow_udf("array<struct<index:int,value:double>>")
    def contributions(v: pa.Array, c: pa.Array) -> pa.Array:
        indices = v.field("indices")
        at = indices.flatten().to_numpy(zero_copy_only=False)
        x = v.field("values").flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(indices.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        phi = coefficients[c.to_numpy(zero_copy_only=False)[row], at] * (x - mean[at])
        order = np.lexsort((at, -np.abs(phi), row))
        if top_k is not None:  # places inside the row
            order = order[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < top_k]
            sizes = np.minimum(sizes, top_k)
        cells = pa.StructArray.from_arrays([pa.array(at[order]), pa.array(phi[order])], ["index", "value"])
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(starts), cells)

    bases = F.element_at(F.array(*[F.lit(float(b)) for b in base]), F.col("_c") + 1)
    rows = vectors.select(key, "sentiment_pred", bases.alias("base_value"), F.posexplode(contributions("features", "_c")).alias("pos", "e"))
    return (rows.select(key, "sentiment_pred", "base_value", (F.col("pos") + 1).alias("rank"),
                        F.col("e.index").alias("index"), F.col("e.value").alias("value"))
            .join(model.features.names(df), "index").select(key, "sentiment_pred", "base_value", "term", "value", "rank"))
