"""Rows whose key several owners have, found by sorting keys and comparing neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.session import materialize


def of_several(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows of keys that at least two owners have (both columns are longs).

    Rows are sorted by key and owner in ranges, so a key of any number of rows is spread over tasks. A run of one key
    has several owners if its first and last differ; runs at the edge of a task that show one owner only are kept aside,
    and what their other parts show is told by a few rows per task.
    """
    names = rows.columns
    k, o = names.index(key), names.index(owner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[tuple[int, int]] = []  # (key, owner) that begin and end the first and the last run
        held, open_key, open_owner, open_several, in_first = [], None, None, False, True

        def out(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, kind, np.int32))], [*names, "_kind"])
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, owners = batch.column(k).to_numpy(), batch.column(o).to_numpy()
            start = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            stop = np.append(start[1:], len(keys))
            several = owners[start] != owners[stop - 1]
            if not ends:
                ends.append((int(keys[0]), int(owners[0])))
                open_key, open_owner = ends[0]
            if keys[0] == open_key:
                several[0] |= open_several or owners[0] != open_owner
                if several[0]:
                    yield from (out(x, 0) for x in held)
                    held = []
            elif in_first:
                yield from (out(x, 1) for x in held)
                ends.append((open_key, open_owner))
                held, in_first = [], False
            else:
                held = []
            if several.any():
                yield out(batch.filter(pa.array(np.repeat(several, stop - start))), 0)
            if in_first and len(start) > 1:  # the first run ends here
                if not several[0]:
                    yield from (out(x, 1) for x in (*held, batch.slice(0, int(stop[0]))))
                ends.append((open_key, int(owners[stop[0] - 1])))
                held, in_first = [], False
            elif len(start) > 1:
                held = []
            if not several[-1]:
                held.append(batch.slice(int(start[-1])))
            if keys[-1] != open_key:
                begin = int(owners[start[-1]])
            elif in_first:
                begin = ends[0][1]
            open_key, open_owner, open_several = int(keys[-1]), int(owners[-1]), bool(several[-1])
        if ends:
            yield from (out(x, 1) for x in held)
            ends += [(open_key, begin), (open_key, open_owner)]
            told = {k: [x for x, _ in ends], o: [x for _, x in ends]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(told[i], pa.int64()) if i in told else pa.nulls(len(ends), f) for i, f in enumerate(fields)]
                + [pa.array(np.full(len(ends), 2, np.int32))], [*names, "_kind"])
    fields = [{"bigint": pa.int64(), "int": pa.int32()}[t] for _, t in rows.dtypes]
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    found = materialize(rows.repartitionByRange(key, owner).sortWithinPartitions(key, owner).mapInArrow(
        run, schema + ", _kind int"), "several")
    # of an edge run that has several owners some ends differ
    mixed = found.where("_kind = 2").groupBy(key).agg(F.min(owner).alias("_a"), F.max(owner).alias("_b")).where("_a <> _b")
    aside = found.where("_kind = 1").join(mixed.select(key), key, "left_semi")
    return found.where("_kind = 0").select(*names).union(aside.select(*names))
