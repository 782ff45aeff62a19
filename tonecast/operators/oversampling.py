"""Balancing of training classes with interpolated minority rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.functions import expressions as ex
from tonecast.operators import scaling, sparse_neighbours
from tonecast.operators.features import entries
from tonecast.session import materialize


def class_sizes(df: DataFrame, label: str) -> dict[str, int]:
    return {r[label]: r["count"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}


def _copies(rows: DataFrame, key: str, have: int, need: int, seed: int, label: str) -> DataFrame:
    """Every row repeated evenly until there are ``need`` new ones; ``copy`` numbers the repeats."""
    ranked = scaling.distributed_rank(rows, label, ex.seeded_hash(seed, F.col(key)), F.col(key))
    times = F.lit(need // have) + F.when(F.col("rank") <= need % have, 1).otherwise(0)
    return (ranked.withColumn("_t", times).filter(F.col("_t") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t", "rank"))


def repeat_minority(df: DataFrame, label: str = "sentiment", key: str = "review_id", seed: int = 42) -> DataFrame:
    """Plain oversampling: minority rows repeated up to the majority size (``copy`` 0 marks the originals)."""
    sizes = class_sizes(df, label)
    target = max(sizes.values())
    out = df.withColumn("copy", F.lit(0))
    for name, n in sizes.items():
        if n < target:
            out = out.unionByName(_copies(df.filter(F.col(label) == name), key, n, target - n, seed, label))
    return out


def _mix():
    @F.arrow_udf(VectorUDT())
    def mix(base: pa.Array, other: pa.Array, u: pa.Array) -> pa.Array:
        share = u.to_numpy(zero_copy_only=False)

        def parts(v, factor):
            sizes = np.diff(v.field("indices").offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = v.field("indices").flatten().to_numpy(zero_copy_only=False)
            return row, at, v.field("values").flatten().to_numpy(zero_copy_only=False) * factor[row]

        (r1, i1, x1), (r2, i2, x2) = parts(base, 1 - share), parts(other, share)
        row, at, x = np.concatenate([r1, r2]), np.concatenate([i1, i2]), np.concatenate([x1, x2])
        order = np.lexsort((at, row))
        row, at, x = row[order], at[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])])) if len(row) else row
        values = np.add.reduceat(x, first) if len(row) else x
        starts = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(share)))]).astype("int32")
        return pa.StructArray.from_arrays(
            [base.field("type"), base.field("size"),
             pa.ListArray.from_arrays(pa.array(starts), pa.array(at[first].astype("int32"))),
             pa.ListArray.from_arrays(pa.array(starts), pa.array(values))], ["type", "size", "indices", "values"])
    return mix


def interpolate_minority(vectors: DataFrame, label: str = "sentiment", key: str = "review_id", neighbours: int = 3,
                         seed: int = 42) -> DataFrame:
    """Originals plus synthetic minority rows: (key, label, features, copy).

    A synthetic row lies between a row and one of its nearest neighbours of the same class. The
    neighbours are exact and found through inverted lists of terms (see ``sparse_neighbours``), so features must not be
    negative. Apply it to training rows only.
    """
    # every class and every part of the result reads the vectors; they are made from the texts once
    rows = materialize(vectors.select(key, label, "features").filter(F.col(label).isNotNull()), "vectors")
    sizes = class_sizes(rows, label)
    target = max(sizes.values())
    out = rows.withColumn("copy", F.lit(0))
    terms = rows.first()["features"].size
    for name, n in sizes.items():
        if n >= target:
            continue
        own = rows.filter(F.col(label) == name)
        near = sparse_neighbours.nearest(own.select(key, entries(F.col("features")).alias("entries")), neighbours, terms, key)
        near = near.select(F.col("query_id").alias(key), F.col("document_id").alias("_near"), F.col("rank").alias("_pick"))
        copies = _copies(own, key, n, target - n, seed, label)
        hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("copy").cast("string")))
        available = min(neighbours, n - 1)
        copies = copies.withColumns({
            "_pick": (F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), F.lit(max(available, 1))) + 1).cast("int"),
            "_u": F.conv(F.substring(hashed, 9, 8), 16, 10).cast("double") / float(16 ** 8)})
        chosen = copies.join(near, [key, "_pick"], "left").withColumn("_near", F.coalesce("_near", F.col(key)))
        partner = own.select(F.col(key).alias("_near"), F.col("features").alias("_other"))
        paired = scaling.join_hot_keys(chosen, partner, "_near", "inner")  # a hub may be everybody's neighbour
        out = out.unionByName(paired.select(key, label, _mix()("features", "_other", "_u").alias("features"), "copy"))
    return out
