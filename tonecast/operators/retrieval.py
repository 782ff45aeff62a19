"""Exact nearest neighbours and retrieval context for questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonecast import taxonomy as tx
from tonecast.functions import expressions as ex
from tonecast.operators import insights, scaling, tallies, trends
from tonecast.session import materialize

# queries whose vectors take at most this many bytes travel to every task; more are blocked
QUERY_BYTES = 32 * 1024 * 1024
# rows of a block; each row is copied once per block of the other side, so both sides have large ones
_QUERY_BLOCK = 16_384
_LEAST_BLOCK = 1024
_DOCUMENT_BLOCK = 20_000
_QUERY_SLICE = 256
_GROUP = 32
_PAIRS = 65_536


def keep_best(k: int, digits: int = 12):
    """Task-side helper: the k best documents of each query, lowest id first on equal scores."""
    def best(query_ids, document_ids, scores):
        scores = np.round(scores, digits)
        order = np.argsort(document_ids, kind="stable")
        ranked = np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]
        documents = order[ranked]
        found = np.take_along_axis(scores, documents, axis=1)
        kept = found > -np.inf
        return pd.DataFrame({"query_id": np.repeat(query_ids, kept.sum(axis=1)),
                             "document_id": document_ids[documents[kept]], "score": found[kept]})
    return best


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay."""
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length == 0, 1, length)


def _vectors(ids: np.ndarray, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, unit vectors and the same in single precision, without vectors that have no score."""
    m = unit(np.stack(rows).astype("float64"))
    told = np.isfinite(m).all(axis=1)
    ids, m = (ids, m) if told.all() else (ids[told], m[told])
    return ids, m, m.astype("float32")


def _reached(scores: np.ndarray, k: int) -> np.ndarray:
    """A score that at least ``k`` documents of each query reach: the k-th of the maxima of groups of documents."""
    n = scores.shape[1] // _GROUP
    if n < k:
        return np.full(len(scores), -np.inf, "float32")
    tops = scores[:, :n * _GROUP].reshape(len(scores), n, _GROUP).max(axis=2)
    return np.partition(tops, n - k, axis=1)[:, n - k]


def best_pairs(k: int, drop_self: bool, digits: int = 12):
    """Task-side helper: the ``k`` best documents of each query, lowest id first on equal scores.

    Products in single precision leave aside what lies below a score that ``k`` documents reach, by more than their
    error; the few others are scored again in double precision and sorted.
    """
    def best(queries: tuple, documents: tuple, floors: np.ndarray | None = None) -> pd.DataFrame:
        (query_ids, q, q32), (document_ids, d, d32) = queries, documents
        # error of single precision products of unit vectors, on both sides, and the digits that are rounded off
        slack = np.float32(4 * (q.shape[1] + 4) * 2.0 ** -24 + 10.0 ** -digits)
        sorted_ids = np.argsort(document_ids, kind="stable") if drop_self and document_ids.dtype.kind in "iu" else None
        parts = []
        for start in range(0, len(query_ids) if len(document_ids) else 0, _QUERY_SLICE):
            ids = query_ids[start:start + _QUERY_SLICE]
            s = q32[start:start + _QUERY_SLICE] @ d32.T
            if sorted_ids is not None:
                first, last = (np.searchsorted(document_ids, ids, side, sorter=sorted_ids) for side in ("left", "right"))
                for row in np.flatnonzero(last > first):
                    s[row, sorted_ids[first[row]:last[row]]] = -np.inf
            elif drop_self:
                s[ids[:, None] == document_ids[None, :]] = -np.inf
            least = _reached(s, k)
            if floors is not None:
                least = np.maximum(least, floors[start:start + _QUERY_SLICE].astype("float32"))
            row, at = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
            score = np.concatenate([np.einsum("ij,ij->i", q[start + row[i:i + _PAIRS]], d[at[i:i + _PAIRS]])
                                    for i in range(0, len(row), _PAIRS)] or [np.zeros(0)])
            found = pd.DataFrame({"_row": row, "query_id": ids[row], "document_id": document_ids[at], "score": np.round(score, digits)})
            found = found.sort_values(["_row", "score", "document_id"], ascending=[True, False, True], kind="stable")
            parts.append(found.groupby("_row").head(k).drop(columns="_row"))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "document_id": [], "score": []})
    return best


def nearest(queries: DataFrame, documents: DataFrame, k: int = 8, query_id: str = "id", document_id: str = "id",
            vector: str = "embedding", include_self: bool = True,
            query_bytes: int = QUERY_BYTES, vectors: tuple[str, str] | None = None) -> DataFrame:
    """The ``k`` most similar documents of every query: (query_id, document_id, score, rank). Exact.

    Few queries (their size is checked) are sent to the tasks and one pass over the documents keeps
    ``k`` rows per query and partition. Otherwise both sides are cut into blocks by id hash and every
    pair of blocks is scored as one matrix product; no pair of rows leaves a task unless it is among
    the best ``k`` of its block. Blocks are even, so no key is hot. ``vectors`` names both columns if they differ.
    """
    own, other = vectors or (vector, vector)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(own).alias("qv")).filter(F.col("qv").isNotNull())
    d = documents.select(F.col(document_id).alias("document_id"), F.col(other).alias("dv")).filter(F.col("dv").isNotNull())
    same_ids = q.schema["query_id"].dataType == d.schema["document_id"].dataType
    schema = (f"query_id {q.schema['query_id'].dataType.simpleString()}, "
              f"document_id {d.schema['document_id'].dataType.simpleString()}, score double")
    best = best_pairs(k, not include_self and same_ids)
    few = _collect_bounded(q, query_bytes)
    if few is not None:
        found = d.mapInPandas(_scan(few, best, k), schema)
    else:
        found = _blocked(q, d, best, schema)
    # every reader of a lazy result would compare all vectors again
    return materialize(scaling.first_per_group(found, ["query_id"], [F.desc("score"), F.asc("document_id")], k), "nearest")


def _collect_bounded(q: DataFrame, limit: int) -> pd.DataFrame | None:
    size = q.agg(F.sum(F.size("qv")) * 8).first()[0] or 0
    return q.toPandas() if size <= limit else None


def _scan(few: pd.DataFrame, best, k: int):
    ids, vectors = few["query_id"].to_numpy(), list(few["qv"])

    def run(batches):
        kept, floors, queries = None, None, _vectors(ids, vectors) if len(ids) else None
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            new = best(queries, _vectors(pdf["document_id"].to_numpy(), list(pdf["dv"])), floors)
            kept = new if kept is None else (
                pd.concat([kept, new]).sort_values(["query_id", "score", "document_id"], ascending=[True, False, True])
                .groupby("query_id").head(k))
            # what a query has found in earlier batches is the least that later ones must reach
            full = kept.groupby("query_id")["score"].agg(["size", "min"])
            floors = full["min"].where(full["size"] >= k, -np.inf).reindex(queries[0]).fillna(-np.inf).to_numpy()
        if kept is not None:
            yield kept
    return run


def _blocked(q: DataFrame, d: DataFrame, best, schema: str) -> DataFrame:
    many, n_d = q.count(), max(1, -(-d.count() // _DOCUMENT_BLOCK))
    # small inputs are cut finer, so that every core has a pair of blocks
    cells = 3 * q.sparkSession.sparkContext.defaultParallelism
    n_q = max(1, -(-many // _QUERY_BLOCK), min(-(-many // _LEAST_BLOCK), -(-cells // n_d)))

    def spread(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        numbers = F.sequence(F.lit(0), F.lit(n_other - 1))
        return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(numbers)))

    left = spread(q, "query_id", "qb", n_q, "db", n_d)
    right = spread(d, "document_id", "db", n_d, "qb", n_q)

    def pair(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "document_id": [], "score": []})
        return best(_vectors(a["query_id"].to_numpy(), list(a["qv"])), _vectors(b["document_id"].to_numpy(), list(b["dv"])))

    return left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInPandas(pair, schema)


def seed_documents(df: DataFrame, per_class: int | None = None, key: str = "review_id",
                   chars: int | None = None) -> DataFrame:
    """Positive and negative reviews of every aspect as retrieval documents with their metadata.

    ``per_class`` keeps the first reviews of each aspect and polarity only, ``chars`` cuts their texts.
    """
    rows = df.filter(F.col("sentiment").isin("Negative", "Positive") & F.col("aspect").isNotNull())
    first = rows if per_class is None else scaling.first_per_group(rows, ["aspect", "sentiment"], [F.asc(key)], per_class)
    text = F.coalesce("review_text", F.lit("")) if chars is None else ex.preview(F.col("review_text"), chars)
    return first.select(
        F.concat_ws("_", "aspect", key).alias("id"), text.alias("document"), "aspect",
        "sentiment", F.coalesce("source", F.lit("")).alias("source"),
        F.substring(F.col("created_at_date").cast("string"), 1, 10).alias("date"),
        F.coalesce("review_rating", F.lit(0)).alias("rating"))


def samples(df: DataFrame, k: int = 8, chars: int = 400, aspect: str = "aspect", sentiment: str = "sentiment",
            seed: int = 42, key: str = "review_id") -> DataFrame:
    """Up to ``k`` repeatable positive and negative samples per aspect."""
    rows = df.filter(F.col(sentiment).isin("Negative", "Positive") & F.col(aspect).isNotNull()).withColumns(
        {"aspect": F.col(aspect), "sentiment": F.col(sentiment), "_h": ex.seeded_hash(seed, F.col(key))})
    first = scaling.first_per_group(rows, ["aspect", "sentiment"], [F.asc("_h"), F.asc(key)], k)
    return first.select("aspect", "sentiment", "rank", key, ex.preview(F.col("review_text"), chars).alias("text"),
                        F.coalesce("review_rating", F.lit(0)).alias("rating"),
                        F.coalesce("source", F.lit("")).alias("source"),
                        F.substring(F.col("created_at_date").cast("string"), 1, 10).alias("date"))


def conversation_tail(turns: DataFrame, n: int = 6) -> DataFrame:
    """Last ``n`` turns of every conversation; ``turn`` keeps their order."""
    last = scaling.first_per_group(turns, ["conv_id"], [F.desc("turn")], n, "_back")
    return last.drop("_back")


def with_question_aspect(questions: DataFrame, text: str = "question") -> DataFrame:
    return questions.withColumn("aspect", ex.known_aspect(F.col(text), tx.QUESTION_WORDS))


def aspect_contexts(df: DataFrame, n_phrases: int = 5, max_texts: int | None = None) -> DataFrame:
    """Statistics record of every aspect: shares, trend, yearly and recent monthly scores, sources, lines,
    ratings, hometowns, phrases, action. Lists are texts in reading order.

    Expects calendar columns; scores are rounded to one place before they are compared or printed.
    One grouping-sets pass counts every list; hometowns, an open domain, are cut to five before lists form.
    """
    cuts = ["year", "year_month", "source", "bts_line", "review_rating", "reviewer_hometown"]
    present = df.filter(F.col("aspect").isNotNull()).select("aspect", "sentiment", *cuts)
    sets = [[F.col("aspect"), F.col(c)] for c in cuts]
    grouped = present.groupingSets(sets, F.col("aspect"), *[F.col(c) for c in cuts]).agg(
        F.grouping_id().alias("g"), *tallies.counts("sentiment"))
    full = 2 ** len(cuts) - 1
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cuts):
        used = F.col("g") == full - 2 ** (len(cuts) - 1 - i)
        kind, value = F.when(used, c).otherwise(kind), F.when(used, F.col(c).cast("string")).otherwise(value)
    cells = tallies.score(grouped.select("aspect", kind.alias("kind"), value.alias("value"), "rows", "pos", "neg", "neu"))
    rows = F.col("rows")
    percent = F.concat(ex.signed_percent(F.col("nss")), F.lit("%"))
    volume = F.concat(F.col("value"), F.lit(": NSS "), percent, F.lit(" ("), rows.cast("string"), F.lit(" reviews)"))
    text = (F.when(F.col("kind").isin("year", "year_month"), F.concat(F.col("value"), F.lit(": "), percent))
            .when(F.col("kind").isin("source", "bts_line"), volume)
            .when(F.col("kind") == "review_rating", F.concat(F.lit("★"), F.col("value"), F.lit(": "), rows.cast("string")))
            .otherwise(F.concat(F.col("value"), F.lit(" ("), rows.cast("string"), F.lit(")"))))
    cells = cells.withColumn("text", text)
    towns = scaling.first_per_group(cells.filter((F.col("kind") == "reviewer_hometown") & F.col("value").isNotNull()),
                                    ["aspect"], [F.desc("rows"), F.asc("value")], 5)
    towns = towns.withColumn("value", F.col("rank").cast("string"))
    kept = cells.filter(F.col("kind") != "reviewer_hometown").unionByName(towns.drop("rank"))

    def items(name: str) -> Column:
        chosen = F.when((F.col("kind") == name) & F.col("value").isNotNull(),
                        F.struct("value", "text", "pos", "neg", "rows"))
        return F.array_sort(F.collect_list(chosen))

    def joined(array: Column, separator: str) -> Column:
        return F.array_join(F.transform(array, lambda x: x["text"]), separator)

    # every row of an aspect falls into exactly one year cell (or the one without a year)
    in_year = F.col("kind") == "year"
    rated = (F.col("kind") == "review_rating") & F.col("value").isNotNull()
    lists = kept.groupBy("aspect").agg(
        *[F.sum(F.when(in_year, F.col(c))).alias(c) for c in ("rows", "pos", "neg", "neu")],
        F.sum(F.when(rated, F.col("value").cast("long") * F.col("rows"))).alias("rating_sum"),
        F.sum(F.when(rated, F.col("rows"))).alias("rated"),
        items("year").alias("years"), items("year_month").alias("months"), joined(items("source"), "; ").alias("sources"),
        joined(items("bts_line"), "; ").alias("bts_lines"), joined(items("review_rating"), ", ").alias("ratings"),
        joined(items("reviewer_hometown"), ", ").alias("hometowns"))
    lists = tallies.score(lists)

    def last(n: int) -> Column:
        return F.slice("months", F.greatest(F.size("months") - (n - 1), F.lit(1)), n)

    def half(months: Column) -> Column:
        """Rounded score pooled over some months."""
        total = F.aggregate(months, F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("r")),
                            lambda acc, m: F.struct((acc["d"] + m["pos"] - m["neg"]).alias("d"), (acc["r"] + m["rows"]).alias("r")))
        return F.bround(ex.nss(total["d"], F.lit(0), total["r"]), 1)

    base = lists.select(
        "aspect", F.bround("nss", 1).alias("nss"), "rows",
        F.bround(F.col("pos") / rows * 100, 1).alias("pct_positive"),
        F.bround(F.col("neu") / rows * 100, 1).alias("pct_neutral"),
        F.bround(F.col("neg") / rows * 100, 1).alias("pct_negative"),
        F.bround(F.col("rating_sum") / F.col("rated"), 2).alias("avg_rating"),
        joined(F.col("years"), ", ").alias("yearly_nss"), joined(last(12), ", ").alias("monthly_nss_last12"),
        joined(last(6), ", ").alias("monthly_nss_last6"), "sources", "bts_lines", "ratings", "hometowns",
        half(F.slice("months", F.floor(F.size("months") / 2).cast("int") + 1, F.size("months"))).alias("recent_nss"),
        half(F.slice("months", 1, F.floor(F.size("months") / 2).cast("int"))).alias("prior_nss"))
    base = base.withColumn("trend_delta", F.bround(F.col("recent_nss") - F.col("prior_nss"), 1))
    base = base.withColumn("trend_direction", trends.direction(F.col("trend_delta")))
    phrases = insights.phrase_lists(df, "aspect", "sentiment", n_phrases, "context", max_texts)
    out = base.join(phrases, "aspect", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("top_complaints", "top_praises")}).withColumn(
        "action", insights.action(F.col("aspect")))


def statistics_text(context: DataFrame) -> DataFrame:
    """One formatted statistics block per aspect."""
    def s(name: str):
        return F.col(name).cast("string")

    def or_missing(name: str):
        return F.when(F.col(name) == "", "N/A").otherwise(F.col(name))

    lines = [
        ["Live statistics for **", F.col("aspect"), "**:"],
        ["- NSS: ", s("nss"), "% | Volume: ", s("rows"), " reviews"],
        ["- Positive: ", s("pct_positive"), "% | Neutral: ", s("pct_neutral"), "% | Negative: ", s("pct_negative"), "%"],
        ["- Trend: ", F.col("trend_direction"), " (", ex.signed_percent(F.col("trend_delta")), "pp) | Recent NSS: ",
         s("recent_nss"), "% | Prior NSS: ", s("prior_nss"), "%"],
        ["- Year-over-year NSS: ", F.col("yearly_nss")],
        ["- Monthly NSS (last 6 months): ", F.col("monthly_nss_last6")],
        ["- By source: ", F.col("sources")],
        ["- By BTS line: ", or_missing("bts_lines")],
        ["- Avg rating: ", F.coalesce(s("avg_rating"), F.lit("N/A")), " | Rating dist: ", F.col("ratings")],
        ["- Top reviewer hometowns: ", or_missing("hometowns")],
        ["- Top negative phrases: ", F.col("top_complaints")],
        ["- Top positive phrases: ", F.col("top_praises")],
        ["- Recommended action: ", F.col("action")],
    ]
    cells = [F.concat(*[F.lit(p) if isinstance(p, str) else p for p in line]) for line in lines]
    return context.select("aspect", F.concat_ws("\n", *cells).alias("statistics"))


def no_statistics(aspect: Column) -> Column:
    """Statistics block of an aspect without reviews; null for a null aspect."""
    named = F.replace(F.lit(tx.NO_STATISTICS), F.lit("{aspect}"), aspect)
    return F.replace(named, F.lit("{action}"), insights.lookup(aspect, tx.ACTIONS, F.lit("")))


def question_sources(chunks: DataFrame, chars: int = 200) -> DataFrame:
    """Retrieved documents of each question as they are listed beside an answer: short texts with their metadata."""
    return chunks.select("question_id", "rank", ex.preview(F.col("text"), chars).alias("text"), "aspect", "sentiment", "date", "source")


def context_text(questions: DataFrame, chunks: DataFrame, statistics: DataFrame) -> DataFrame:
    """Prompt text per question: retrieved excerpts in rank order, then the statistics of its aspect.

    ``questions``: question_id, question. ``chunks``: question_id, rank, text, aspect, sentiment, date, source.
    A question naming no aspect takes the most frequent one of its chunks (the best-ranked on a tie).
    """
    head = F.concat(F.lit("["), F.concat_ws(" | ", "aspect", "sentiment", "date", "source"), F.lit("]\n"), F.col("text"))
    blocks = chunks.groupBy("question_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("rank"), head.alias("b")))), lambda x: x["b"]), "\n\n").alias("excerpts"))
    votes = chunks.groupBy("question_id", "aspect").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    mode = votes.groupBy("question_id").agg(
        F.min_by("aspect", F.struct(-F.col("n"), F.col("first"))).alias("voted"))
    asked = with_question_aspect(questions).join(blocks, "question_id", "left").join(mode, "question_id", "left")
    asked = asked.withColumn("aspect", F.coalesce("aspect", "voted"))
    # one short row per aspect of the taxonomy
    full = asked.join(statistics, "aspect", "left").withColumn("statistics", F.coalesce("statistics", no_statistics(F.col("aspect"))))
    return full.select("question_id", "aspect", F.concat(
        F.lit("Question: "), F.col("question"), F.lit("\n\nRetrieved reviews:\n"), F.coalesce("excerpts", F.lit("")),
        F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), F.col("statistics"), F.lit("\n")), F.lit(""))).alias("context"))
