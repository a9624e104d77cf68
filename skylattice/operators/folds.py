"""Folds over sorted rows: for choices that depend on their own earlier choices and can't be a window.

Rows are dealt by a key and sorted, so a fold sees a key's rows in order as a stream of record batches; it
holds its state and never a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def folded(df: DataFrame, by: str, order: list[str], make: Callable[[], Callable[[tuple], tuple | None]], schema: str) -> DataFrame:
    """What a step gives for the rows of each key in order: make() starts a key, its result maps a row (a tuple of df's columns) to a row or None."""
    at = df.columns.index(by)
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if step is None or row[at] != key:
                    key, step = row[at], make()
                got = step(row)
                if got is not None:
                    out.append(got)
            yield pd.DataFrame(out, columns=names)

    return df.where(df[by].isNotNull()).repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key (the first columns) of batches that are sorted by it, one key after another; only one key's rows are held."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        starts = {0}
        for c in b.columns[:keys]:
            a, z = c.slice(1), c.slice(0, len(c) - 1)
            new = pc.or_(pc.fill_null(pc.not_equal(a, z), False), pc.not_equal(pc.is_null(a), pc.is_null(z)))
            starts.update(i + 1 for i in pc.indices_nonzero(new).to_pylist())
        starts = sorted(starts)
        for start, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
            now = tuple(c[start].as_py() for c in b.columns[:keys])
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held)
