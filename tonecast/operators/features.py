"""TF-IDF features of review texts: word and word-pair terms, smoothed idf, unit length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonecast.functions import tokens as tk
from tonecast.operators import frequent

MAX_FEATURES = 80_000
_ENTRY = "array<struct<index:int,value:double>>"
# words that a task handles at once, and rows of the batches it gives back
_WORDS, _ROWS = 1_000_000, 100_000


def with_terms(df: DataFrame, text: str, name: str = "_terms") -> DataFrame:
    """Unigrams followed by bigrams of the text as one array column."""
    split = df.withColumn("_uni", tk.terms(F.col(text)))
    return split.withColumn(name, F.concat("_uni", tk.ngrams(F.col("_uni"), 2))).drop("_uni")


def _splitting():
    """Function for tasks; defined inside, so that workers need not import this package."""
    def split(words: pa.ListArray, limit: int = _WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
        """Runs of rows of at most ``limit`` words (a longer row is one): rows, row and code of each word, the words of the codes."""
        ends, start = words.offsets.to_numpy().astype(np.int64), 0
        while start < len(words):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
            coded = words.slice(start, stop - start).flatten().dictionary_encode()
            row = np.repeat(np.arange(stop - start), np.diff(ends[start:stop + 1]))
            yield stop - start, row, coded.indices.to_numpy().astype(np.int64), coded.dictionary
            start = stop
    return split


def _counting():
    """Function for tasks: frequencies of all terms of some rows at a time."""
    split = _splitting()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, row, code, words in split(batch.column(0)):
                kinds, same = max(len(words), 1), row[1:] == row[:-1]
                pair = (code[:-1] * kinds + code[1:])[same]
                for key, at, name in ((code, row, lambda k: words.take(pa.array(k))),
                                      (pair, row[1:][same], lambda k: pc.binary_join_element_wise(
                                          words.take(pa.array(k // kinds)), words.take(pa.array(k % kinds)), " "))):
                    coded = pa.array(key).dictionary_encode()
                    index, found = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()
                    uses = np.bincount(index, minlength=len(found))
                    seen = np.bincount(pc.unique(pa.array(index * rows + at)).to_numpy() // rows, minlength=len(found))
                    for k in range(0, len(found), _ROWS):
                        part = slice(k, k + _ROWS)
                        yield pa.RecordBatch.from_arrays([name(found[part]).cast(pa.string()), pa.array(uses[part], pa.int64()),
                                                          pa.array(seen[part], pa.int64())], ["term", "cf", "df"])
    return count


def term_statistics(df: DataFrame, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """Corpus frequency ``cf`` and document frequency ``df`` of every term (or the ``wanted`` ones), in one aggregation by term.

    Tasks count whole Arrow batches of words, so each term of a batch is one row of the aggregation, and no
    (document, term) pair is shuffled.
    """
    each = df.select(tk.terms(F.col(text)).alias("_words")).mapInArrow(_counting(), "term string, cf long, df long")
    if wanted is not None:
        each = each.join(frequent.small(wanted), "term", "left_semi")
    return (each.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")))


def vocabulary(df: DataFrame, text: str, max_features: int = MAX_FEATURES, min_df: int = 2,
               capacity: int | None = None) -> pd.DataFrame:
    """The capped vocabulary (term, cf, df), most frequent terms first, ties by term.

    With a ``capacity`` the terms that summaries show as candidates are counted alone (see ``frequent``), unless rare
    ones, by ``min_df``, leave the cap unfilled or reach below what the summaries know.
    """
    def first(wanted: DataFrame | None) -> pd.DataFrame:
        return (term_statistics(df, text, wanted).filter(F.col("df") >= min_df)
                .orderBy(F.desc("cf"), "term").limit(max_features).toPandas())
    if capacity is not None:
        found = frequent.candidates(with_terms(df, text), "_terms", max_features, capacity)
        if found is not None:
            top = first(found[0].withColumnRenamed("item", "term"))
            # every other term occurs less than found[1] times
            if found[1] == 0 or (len(top) == max_features and top["cf"].iloc[-1] >= found[1]):
                return top
    return first(None)


@dataclass(frozen=True)
class TfIdf:
    """Fitted vocabulary (at most ``max_features`` terms) with idf weights in vocabulary order."""

    counter: CountVectorizerModel
    idf: np.ndarray
    sublinear: bool = True

    @staticmethod
    def fit(df: DataFrame, text: str, max_features: int = MAX_FEATURES, min_df: int = 2,
            sublinear: bool = True, capacity: int | None = None) -> "TfIdf":
        """Most frequent terms first, ties by term; the capped vocabulary is all the driver receives."""
        top = vocabulary(df, text, max_features, min_df, capacity)
        if not len(top):
            raise ValueError("no term reaches the minimum document frequency")
        n = df.count()
        # a table of one term a row fits in seconds; handing the terms over one by one takes a call each
        rows = df.sparkSession.createDataFrame(top[["term"]]).select(F.array("term").alias("_terms"))
        counter = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=len(top)).fit(rows)
        known = top.set_index("term")["df"].reindex(counter.vocabulary).to_numpy()
        return TfIdf(counter, np.log((1 + n) / (1 + known)) + 1, sublinear)

    @property
    def terms(self) -> list[str]:
        return self.counter.vocabulary

    def transform(self, df: DataFrame, text: str, name: str = "features") -> DataFrame:
        """Map-only: count and weigh the vocabulary terms of whole Arrow batches."""
        weigh, size = self._weights(), len(self.idf)

        @F.arrow_udf(VectorUDT())
        def vectors(v: pa.Array) -> pa.Array:
            starts, indices, weights = weigh(v)
            fields = [pa.array(np.zeros(len(v), np.int8)), pa.array(np.full(len(v), size, np.int32)),
                      pa.ListArray.from_arrays(starts, indices), pa.ListArray.from_arrays(starts, weights)]
            return pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])
        return df.withColumn(name, vectors(tk.terms(F.col(text))))

    def _weights(self):
        """Function from a batch of word lists to (row starts, indices in order, unit-length weights)."""
        idf, sublinear, split = self.idf, self.sublinear, _splitting()
        terms = pa.array(self.terms, pa.string())
        parts = pc.split_pattern(terms, " ")
        words = parts.flatten().unique()
        ends, spelt = parts.offsets.to_numpy(), pc.index_in(parts.flatten(), value_set=words).to_numpy().astype(np.int64)
        single = np.diff(ends) == 1
        # the term of each word, and of each pair of words
        alone = np.full(len(words), -1)
        alone[spelt[ends[:-1][single]]] = np.flatnonzero(single)
        head, tail = spelt[ends[:-1][~single]], spelt[ends[1:][~single] - 1]
        leads, follows = np.zeros(len(words) + 1, bool), np.zeros(len(words) + 1, bool)
        leads[head], follows[tail] = True, True
        order = np.argsort(head * len(words) + tail)
        pairs, paired = (head * len(words) + tail)[order], np.flatnonzero(~single)[order]

        def weigh(v: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
            sizes, indices, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for rows, row, code, spelled in split(v):
                known = pc.fill_null(pc.index_in(spelled, value_set=words), -1).to_numpy().astype(np.int64)
                word = known[code]
                near = np.flatnonzero((row[1:] == row[:-1]) & leads[word[:-1]] & follows[word[1:]])
                key = word[near] * len(words) + word[near + 1]
                at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
                hit = pairs[at] == key if len(pairs) else np.zeros(0, bool)
                term = alone[word] if len(alone) else word
                term[word < 0] = -1
                one = term >= 0
                cells = np.concatenate([row[one] * len(idf) + term[one], row[near[hit]] * len(idf) + paired[at[hit]]])
                cells, counts = np.unique(cells, return_counts=True)
                at, index = cells // len(idf), cells % len(idf)
                w = (1 + np.log(counts) if sublinear else counts) * idf[index]
                length = np.sqrt(np.bincount(at, w * w, minlength=rows))
                sizes.append(np.bincount(at, minlength=rows))
                indices.append(index)
                weights.append(w / length[at])
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("int32")
            return pa.array(starts), pa.array(np.concatenate(indices).astype("int32")), pa.array(np.concatenate(weights))
        return weigh

    def weigh_entries(self, df: DataFrame, text: str, name: str = "entries") -> DataFrame:
        """Non-zero weights of each row as an array of (index, value), in one pass over the Arrow batches."""
        weigh = self._weights()

        @F.arrow_udf(_ENTRY)
        def cells(v: pa.Array) -> pa.Array:
            starts, indices, weights = weigh(v)
            return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([indices, weights], ["index", "value"]))
        return df.withColumn(name, cells(tk.terms(F.col(text))))

    def sums(self, df: DataFrame, text: str) -> DataFrame:
        """Sum of the weights by index, added up in the tasks first; index -1 has the number of rows, so the texts are read once."""
        weigh, size = self._weights(), len(self.idf)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rows = np.zeros(size), 0
            for batch in batches:
                _, indices, weights = weigh(batch.column(0))
                total += np.bincount(indices.to_numpy(), weights.to_numpy(), size)
                rows += batch.num_rows
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype("int32")), pa.array(np.append(total[used], rows))],
                                             ["index", "s"])
        each = df.select(tk.terms(F.col(text))).mapInArrow(added, "index int, s double")
        return each.groupBy("index").agg(F.sum("s").alias("s"))

    def vocabulary(self, df: DataFrame) -> DataFrame:
        """The vocabulary as a table: index, term, idf."""
        pdf = pd.DataFrame({"index": np.arange(len(self.idf), dtype="int32"), "term": self.terms, "idf": self.idf})
        return df.sparkSession.createDataFrame(pdf, "index int, term string, idf double")

    def names(self, df: DataFrame) -> DataFrame:
        """Index and term of the vocabulary, broadcast while it is no longer than the default cap."""
        table = self.vocabulary(df).select("index", "term")
        return F.broadcast(table) if len(self.idf) <= MAX_FEATURES else table

    def save(self, path: str) -> None:
        self.counter.write().overwrite().save(f"{path}/counter")
        spark = SparkSession.active()
        table = self.vocabulary(spark.range(0)).withColumn("sublinear", F.lit(self.sublinear))
        table.write.mode("overwrite").parquet(f"{path}/idf")

    @staticmethod
    def load(path: str) -> "TfIdf":
        table = SparkSession.active().read.parquet(f"{path}/idf").orderBy("index").toPandas()
        return TfIdf(CountVectorizerModel.load(f"{path}/counter"), table["idf"].to_numpy(), bool(table["sublinear"].iloc[0]))


def entries(vector: Column) -> Column:
    """Non-zero entries of a sparse vector as an array of (index, value)."""
    @F.arrow_udf(_ENTRY)
    def unpack(v: pa.Array) -> pa.Array:
        indices, values = v.field("indices"), v.field("values")
        cells = pa.StructArray.from_arrays([indices.flatten(), values.flatten()], ["index", "value"])
        starts = np.concatenate([[0], np.cumsum(np.diff(indices.offsets.to_numpy()))]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(starts), cells)
    return unpack(vector)


def weights_table(model: TfIdf, df: DataFrame, text: str, key: str) -> DataFrame:
    """Long form (key, term, weight)."""
    weigh, terms = model._weights(), pa.array(model.terms, pa.string())

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, indices, weights = weigh(batch.column(1))
            row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(starts.to_numpy())))
            for k in range(0, len(row), _ROWS):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row[k:k + _ROWS]), terms.take(indices[k:k + _ROWS]),
                                                  weights[k:k + _ROWS]], [key, "term", "weight"])
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tk.terms(F.col(text))).mapInArrow(long, f"`{key}` {kind}, term string, weight double")
