"""Structured Streaming: event windows, sessions, deduplication, chunks folded per run, chat history per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.fusion import first_by_key


def tumbling(events: DataFrame, size: str, by: list[str], aggregates: list[Column], *, time: str = "ts", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by event-time window (and slide); late: the watermark, for streams."""
    e = events.withWatermark(time, late) if late else events
    rows = e.groupBy(F.window(time, size, slide or size), *by).agg(*aggregates)
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[c for c in rows.columns if c not in ("window", *by)])


def sessions(events: DataFrame, gap: str, by: list[str], aggregates: list[Column], *, time: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    rows = e.groupBy(F.session_window(time, gap), *by).agg(*aggregates)
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *[c for c in rows.columns if c not in ("session_window", *by)])


def once(events: DataFrame, keys: list[str], *, time: str = "ts", late: str = "1 hour", ties: str | None = None) -> DataFrame:
    """The first event of each key: by time, then ``ties``, in batch (found by a partial aggregation); of a stream, the first to arrive, as long as the watermark remembers it."""
    if not events.isStreaming:
        return first_by_key(events, keys, [time, ties] if ties else [time])
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def folded_chunks(chunks: DataFrame, *, run: str = "run_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """Batch: the chunks of each run in order, as one text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text])
    return chunks.groupBy(run).agg(F.array_join(parts, "").alias(text), F.count("*").alias("n_chunks"))


def chat_history(messages: DataFrame, *, session: str = "conv_id", order: str = "turn", text: str = "text", role: str = "role", keep: int = 0) -> DataFrame:
    """Stream: for each micro-batch and session with new messages, the session's history so far: session, n, transcript.

    State is one string per session and a count; keep > 0 holds only the last messages.
    """

    def append(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, lines = state.get if state.exists else (0, [])
        lines = list(lines)
        new = pd.concat(list(parts)).sort_values(order)
        lines += [f"{r}: {t}" for r, t in zip(new[role], new[text], strict=True)]
        n += len(new)
        lines = lines[-keep:] if keep else lines
        state.update((n, lines))
        yield pd.DataFrame({session: [key[0]], "n": [n], "transcript": ["\n".join(lines)]})

    kind = dict(messages.dtypes)[session]
    return messages.groupBy(session).applyInPandasWithState(append, f"{session} {kind}, n long, transcript string", "n long, lines array<string>", "update", GroupStateTimeout.NoTimeout)


def complete_items(chunks: DataFrame, *, run: str = "run_id", seq: str = "seq", text: str = "text", separator: str = ",") -> DataFrame:
    """Stream: items of a separated list as they complete: run, item_no, item. The unfinished tail is state."""

    def emit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, tail = state.get if state.exists else (0, "")
        for t in pd.concat(list(parts)).sort_values(seq)[text]:
            tail += t
        *done, tail = tail.split(separator)
        items = [x.strip() for x in done if x.strip()]
        state.update((n + len(items), tail))
        yield pd.DataFrame({run: [key[0]] * len(items), "item_no": range(n, n + len(items)), "item": items})

    kind = dict(chunks.dtypes)[run]
    return chunks.groupBy(run).applyInPandasWithState(emit, f"{run} {kind}, item_no long, item string", "n long, tail string", "append", GroupStateTimeout.NoTimeout)


def durations(events: DataFrame, *, run: str = "run_id", kind: str = "event", time: str = "ts") -> DataFrame:
    """Start and end events of each run paired: run, started, ended, seconds (null if unfinished)."""
    at = lambda suffix: F.min(F.when(F.col(kind).endswith(suffix), F.col(time)))
    rows = events.groupBy(run).agg(at("_start").alias("started"), F.coalesce(at("_end"), at("_error")).alias("ended"))
    return rows.withColumn("seconds", (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6)
