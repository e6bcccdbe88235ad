"""Folds over the rows of each key in order, in batch and in streams, by one class for both.

A fold is an object with ``step(*values)`` that gives rows for a row, ``end()`` that gives rows after the last (in streams, after
each micro-batch that has rows of the key), and, for streams, ``dump()`` and a class method ``load(text)`` for its state.

Batch: rows are dealt by key and sorted, and a task reads them as a stream, so a key of any length takes the memory of its
state. Streams: the state is kept by key; each row is read once, in the order of its micro-batch, and micro-batches in turn.
Rows that a fold returns begin with the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROWS = 10_000  # of a batch that a fold gives
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs, for the streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _schema(df: DataFrame, by: str, out: str) -> str:
    return f"`{by}` {df.schema[by].dataType.simpleString()}, {out}"


def folded(df: DataFrame, start: Callable[[], Any], out: str, *, by: str, order: list[str], values: list[str]) -> DataFrame:
    """The key and what a fold gives (columns ``out``) of each key's rows in order. start makes a fold; for a stream, a fold class."""
    if df.isStreaming:
        return _streamed(df, start, out, by=by, order=order, values=values)
    schema = _schema(df, by, out)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, last, rows = None, None, []

        def take() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for key, *value in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if fold is None or key != last:
                    if fold is not None:
                        rows += [(last, *r) for r in fold.end()]
                    fold, last = start(), key
                rows += [(key, *r) for r in fold.step(*value)]
                if len(rows) >= ROWS:
                    yield take()
        if fold is not None:
            rows += [(last, *r) for r in fold.end()]
        yield take()

    return df.select(by, *order, *(v for v in values if v not in order and v != by)).repartition(by).sortWithinPartitions(by, *order).select(by, *values).mapInArrow(run, schema)


def _streamed(df: DataFrame, kind: Any, out: str, *, by: str, order: list[str], values: list[str]) -> DataFrame:
    with_state(df.sparkSession)
    names = [by, *(f.name for f in StructType.fromDDL(out).fields)]

    class Keyed(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getValueState("fold", "text string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            fold = kind.load(self.kept.get()[0]) if self.kept.exists() else kind()
            new = pd.concat([r[list(dict.fromkeys([*order, *values]))] for r in rows]).sort_values(order, kind="stable")
            found = [r for value in new[values].itertuples(index=False) for r in fold.step(*(None if v is None or v is pd.NA or v != v else v for v in value))]
            found += fold.end()
            self.kept.update((fold.dump(),))
            yield pd.DataFrame([(key[0], *r) for r in found], columns=names)

        def close(self) -> None:
            pass

    return df.groupBy(by).transformWithStateInPandas(Keyed(), _schema(df, by, out), "append", "None")
