"""Inverted-file index of vectors for cosine similarity, exact through angle bounds.

Directions (centroids) are fitted on a bounded sample, then every vector is listed under its nearest direction and, inside
the list, in a ring of its angle to it. For a query at angle a of a direction, members of a ring between the angles low
and high lie at least max(0, low - a, a - high) away, so the cosine of that angle bounds their scores. A search first
probes the cells (list and ring) with the best bounds until they hold enough vectors, then, unless recall is enough,
those whose bound reaches the k-th score found: what is left cannot be among the best k.

How much the bounds spare depends on the vectors: tight groups spare nearly all, directions without any structure in many
dimensions spare little. Where the remaining cells hold more than ``SCAN_SHARE`` of all pairs, the rest is found by the plain
scan (``retrieval.nearest``), which gives the same rows for less.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.operators import scaling
from tonecast.operators.retrieval import keep_best, nearest, unit
from tonecast.session import materialize

#: Bounds of what is fitted and broadcast: vectors of the sample (in expectation), directions, rings of a list.
SAMPLE, MAX_LISTS, RINGS = 20_000, 4096, 64
FIRST_ROWS = 512  # vectors that the first probes of a query hold
BLOCK_ROWS = 20_000  # vectors of a task; larger cells are cut by id
QUERY_ROWS = 2_048  # queries that meet them there
SCAN_SHARE = 0.25
_SLICE = 256
_SLACK = 1e-9  # bounds are sums of rounded angles


def fit_directions(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit vectors (at most ``lists``) by spherical k-means, farthest-first on a small start."""
    rng = np.random.default_rng(seed)
    points = unit(sample)
    points = points[np.abs(points).sum(axis=1) > 0]
    if not len(points):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    chosen = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(rounds):
        best = np.concatenate([(points[k:k + 4096] @ chosen.T).argmax(axis=1) for k in range(0, len(points), 4096)])
        sums = np.zeros_like(chosen)
        np.add.at(sums, best, points)
        length = np.linalg.norm(sums, axis=1)
        chosen = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], chosen)
    return np.unique(chosen, axis=0)


@dataclass(frozen=True)
class Cells:
    """What is known of each cell: list (-1 holds the zero vectors), ring, least and largest angle, rows."""
    directions: np.ndarray
    list: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, cell): no member of the cell scores more. ``queries`` are unit or zero vectors."""
        out = np.zeros((len(queries), len(self.list)))
        real = self.list >= 0
        if real.any():
            angle = np.arccos(np.clip(queries @ self.directions.T, -1, 1))[:, self.list[real]]
            out[:, real] = np.cos(np.maximum(0, np.maximum(self.low[real] - angle, angle - self.high[real])))
        out[np.abs(queries).sum(axis=1) == 0] = 0.0
        return out

    def first(self, queries: np.ndarray, rows: int) -> list[np.ndarray]:
        """Per query the cells of the best bounds that hold ``rows`` vectors together."""
        bounds, out = self.bounds(queries), []
        for b in bounds:
            order = np.argsort(-b, kind="stable")
            out.append(order[:int(np.searchsorted(np.cumsum(self.rows[order]), rows)) + 1])
        return out

    def rest(self, queries: np.ndarray, rows: int, floor: np.ndarray) -> list[np.ndarray]:
        """Per query the cells not probed first that may hold a score of ``floor`` or more."""
        bounds = self.bounds(queries)
        return [np.setdiff1d(np.flatnonzero(b >= f - _SLACK), first) for b, f, first in
                zip(bounds, floor, self.first(queries, rows), strict=True)]


class VectorIndex:
    """Vectors of a table in cells; ``rows`` is written under the shared folder and may be searched any number of times."""

    def __init__(self, rows: DataFrame, cells: Cells, id_type: str):
        self.rows, self.cells, self.id_type = rows, cells, id_type

    @staticmethod
    def build(documents: DataFrame, key: str = "id", vector: str = "embedding", lists: int | None = None,
              sample: int = SAMPLE) -> "VectorIndex":
        """Fit the directions on about ``sample`` distinct vectors and list every row that has a vector.

        Without ``lists`` there are as many as the square root of the number of rows, at most ``MAX_LISTS``.
        """
        d = documents.select(F.col(key).alias("document_id"), F.col(vector).cast("array<double>").alias("dv")).filter(
            F.col("dv").isNotNull())
        n = d.count()
        share = min(1.0, sample / max(n, 1))
        hashed = F.xxhash64("dv")
        picked = d.select("dv", hashed.alias("h")).filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        found = picked.dropDuplicates(["h"]).select("dv").toPandas()["dv"]
        some = np.stack(found) if len(found) else np.zeros((0, 0))
        directions = fit_directions(some, min(lists or int(round(n ** 0.5)), MAX_LISTS))
        shared = d.sparkSession.sparkContext.broadcast(directions)
        id_type = d.schema["document_id"].dataType.simpleString()

        def assign(batches):
            chosen = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                v = unit(np.stack(pdf["dv"]).astype("float64"))
                zero = np.abs(v).sum(axis=1) == 0
                if len(chosen):
                    scores = np.concatenate([v[k:k + 1024] @ chosen.T for k in range(0, len(v), 1024)])
                    own = np.where(zero, -1, scores.argmax(axis=1))
                    angle = np.where(zero, 0.0, np.arccos(np.clip(scores.max(axis=1), -1, 1)))
                else:
                    own, angle = np.full(len(v), -1), np.zeros(len(v))
                ring = np.minimum((angle / np.pi * RINGS).astype("int32"), RINGS - 1)
                yield pd.DataFrame({"document_id": pdf["document_id"], "dv": list(v), "list": own.astype("int32"),
                                    "ring": ring, "angle": angle})
        rows = materialize(d.mapInPandas(assign, f"document_id {id_type}, dv array<double>, list int, ring int, angle double"),
                           "vectors")
        # at most MAX_LISTS times RINGS rows
        told = rows.groupBy("list", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"),
                                                F.count("*").alias("n")).orderBy("list", "ring").toPandas()
        return VectorIndex(rows, Cells(directions, *(told[c].to_numpy() for c in ("list", "ring", "low", "high", "n"))), id_type)

    def search(self, queries: DataFrame, k: int = 8, key: str = "id", vector: str = "embedding", include_self: bool = True,
               exact: bool = True, first_rows: int = FIRST_ROWS) -> DataFrame:
        """The ``k`` most similar vectors of every query: (query_id, document_id, score, rank).

        Exact ties go to the lowest id. With ``exact`` off only the first probes are made (see the measured recall).
        """
        q = queries.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("qv")).filter(
            F.col("qv").isNotNull())
        id_type = q.schema["query_id"].dataType.simpleString()
        drop_self = not include_self and id_type == self.id_type
        q = materialize(q, "queries")
        cells = q.sparkSession.sparkContext.broadcast(self.cells)

        def first(pdf):
            v = unit(np.stack(pdf["qv"]).astype("float64"))
            return v, cells.value.first(v, first_rows)

        def rest(pdf):
            v = unit(np.stack(pdf["qv"]).astype("float64"))
            return v, cells.value.rest(v, first_rows, pdf["floor"].to_numpy())
        found = self._scored(self._probes(q, id_type, first), id_type, k, drop_self)
        if not exact:
            return scaling.first_per_group(found, ["query_id"], [F.desc("score"), F.asc("document_id")], k)
        found = materialize(found, "probed")
        # fewer than k found bound nothing
        floors = scaling.first_per_group(found, ["query_id"], [F.desc("score"), F.asc("document_id")], k).groupBy("query_id").agg(
            F.when(F.count("*") == k, F.min("score")).otherwise(-2.0).alias("floor"))
        asked = materialize(q.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))), "floors")
        todo, pairs = self._share(asked, first_rows)
        if todo > SCAN_SHARE * pairs:
            return nearest(asked, self.rows, k, "query_id", "document_id", include_self=include_self, vectors=("qv", "dv"))
        more = self._scored(self._probes(asked, id_type, rest), id_type, k, drop_self)
        return scaling.first_per_group(found.union(more), ["query_id"], [F.desc("score"), F.asc("document_id")], k)

    def _share(self, asked: DataFrame, first_rows: int) -> tuple[int, int]:
        """Pairs that the bounds leave after the first probes, and all pairs."""
        cells = asked.sparkSession.sparkContext.broadcast(self.cells)

        def run(batches):
            for pdf in batches:
                for start in range(0, len(pdf), _SLICE):
                    part = pdf.iloc[start:start + _SLICE]
                    v, c = unit(np.stack(part["qv"]).astype("float64")), cells.value
                    left = sum(int(c.rows[x].sum()) for x in c.rest(v, first_rows, part["floor"].to_numpy()))
                    yield pd.DataFrame({"todo": [left], "pairs": [len(part) * int(c.rows.sum())]})
        r = asked.mapInPandas(run, "todo long, pairs long").agg(F.sum("todo"), F.sum("pairs")).first()
        return r[0] or 0, r[1] or 0

    def _probes(self, q: DataFrame, id_type: str, pick) -> DataFrame:
        """(query_id, qv, list, ring) of the cells that ``pick`` names for a batch of queries."""
        cells = q.sparkSession.sparkContext.broadcast(self.cells)

        def run(batches):
            for pdf in batches:
                for start in range(0, len(pdf), _SLICE):
                    part = pdf.iloc[start:start + _SLICE]
                    v, chosen = pick(part)
                    many = np.array([len(c) for c in chosen])
                    at = np.concatenate(chosen) if len(chosen) else np.zeros(0, int)
                    row = np.repeat(np.arange(len(part)), many)
                    if not len(row):
                        continue
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "qv": [v[i] for i in row],
                                        "list": cells.value.list[at].astype("int32"), "ring": cells.value.ring[at].astype("int32")})
        return q.mapInPandas(run, f"query_id {id_type}, qv array<double>, list int, ring int")

    def _scored(self, probes: DataFrame, id_type: str, k: int, drop_self: bool) -> DataFrame:
        """The best ``k`` of each query in each block of the probed cells, told by one matrix product a block."""
        probes = materialize(probes, "probes")
        asked = probes.groupBy("list", "ring").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("qs"))
        spark = probes.sparkSession
        told = spark.createDataFrame(pd.DataFrame({
            "list": self.cells.list, "ring": self.cells.ring, "ds": -(-self.cells.rows // BLOCK_ROWS)}),
            "list int, ring int, ds int") if len(self.cells.list) else spark.createDataFrame([], "list int, ring int, ds int")
        # one small row per cell
        deal = F.broadcast(told.join(asked, ["list", "ring"]))

        def numbers(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = probes.join(deal, ["list", "ring"]).withColumn("qb", F.pmod(F.xxhash64("query_id"), "qs").cast("int")).withColumn(
            "db", numbers("ds")).drop("qs", "ds")
        right = self.rows.join(deal, ["list", "ring"]).withColumn(
            "db", F.pmod(F.xxhash64("document_id"), "ds").cast("int")).withColumn("qb", numbers("qs")).select(
            "document_id", "dv", "list", "ring", "qb", "db")
        best = keep_best(k)

        def pair(a, b):
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "document_id": [], "score": []})
            ids, d, out = b["document_id"].to_numpy(), np.stack(b["dv"]), []
            for start in range(0, len(a), _SLICE):
                part = a.iloc[start:start + _SLICE]
                scores = np.stack(part["qv"]) @ d.T
                if drop_self:
                    scores[part["query_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                out.append(best(part["query_id"].to_numpy(), ids, scores))
            return pd.concat(out)
        by = ["list", "ring", "qb", "db"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
            pair, f"query_id {id_type}, document_id {self.id_type}, score double")
