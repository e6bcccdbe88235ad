"""Streams with keyed state that expires: facts about entities, and runs judged as they end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.experiments import Evaluator
from docloom.operators.folds import with_state


def entity_facts(facts: DataFrame, keep: float, *, late: str = "0 seconds", entity: str = "entity", fact: str = "fact", time: str = "ts", by: str = "conv_id") -> DataFrame:
    """Stream: by, entity, fact, at and known: the latest fact about each entity of each conversation as it changes, and, ``keep``
    seconds of event time after it, that it is forgotten (fact null, known false).

    A key's state is one fact and a timer, however many facts there have been. Null facts say nothing; a fact that is older than
    the one known, or would be forgotten already, changes nothing; of facts of one time the greater one holds.
    """
    with_state(facts.sparkSession)
    names = [by, entity, fact, "at", "known"]
    keep_ms = int(keep * 1000)

    class Facts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("fact", "fact string, at long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            old = (self.kept.get()[1], self.kept.get()[0]) if self.kept.exists() else None
            best = old
            for r in rows:
                r = r[r[fact].notna() & r[time].notna()]
                for f, t in zip(r[fact], r[time].astype("datetime64[us]").astype("int64") // 1000, strict=True):
                    if int(t) + keep_ms > now and (best is None or (int(t), f) > best):
                        best = (int(t), f)
            if best != old:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(best[0] + keep_ms)
                self.kept.update((best[1], best[0]))
                yield pd.DataFrame([(*key, best[1], pd.Timestamp(best[0], unit="ms"), True)], columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.kept.clear()
            yield pd.DataFrame([(*key, None, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), False)], columns=names)

        def close(self) -> None:
            pass

    kinds = dict(facts.dtypes)
    schema = f"`{by}` {kinds[by]}, `{entity}` {kinds[entity]}, `{fact}` string, at timestamp, known boolean"
    rows = facts.withWatermark(time, late).select(by, entity, F.col(fact).cast("string").alias(fact), time)
    return rows.groupBy(by, entity).transformWithStateInPandas(Facts(), schema, "append", "EventTime")


def judged_runs(starts: DataFrame, ends: DataFrame, evaluators: dict[str, Evaluator], *, longest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """run_id, input, prediction, reference, status, feedback_key and score: each run judged as it ends, a row for each evaluator.

    starts: run_id, started, input, reference. ends: run_id, ended, prediction, error. A run that ends within ``longest`` is
    ``done`` or, with an error, ``failed``; one that hasn't, once the watermark has passed, is ``unfinished``. Only runs that
    are done have scores. Ends that come twice count once. Streams and tables alike; in a stream, what is kept are the starts
    and ends that the watermark (``late``) can still bring a partner for.
    """
    s = starts.select("run_id", "started", "input", "reference")
    e = ends.select(F.col("run_id").alias("end_id"), "ended", "prediction", "error")
    if starts.isStreaming:
        s, e = s.withWatermark("started", late), e.withWatermark("ended", late).dropDuplicatesWithinWatermark(["end_id"])
    else:
        e = e.groupBy("end_id").agg(F.min_by(F.struct("ended", "prediction", "error"), "ended").alias("x")).select("end_id", "x.*")
    fits = (F.col("run_id") == F.col("end_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {longest}"))
    status = F.when(F.col("end_id").isNull(), "unfinished").when(F.col("error").isNotNull(), "failed").otherwise("done")
    runs = s.join(e, fits, "left").withColumn("status", status)
    score = lambda f: F.when(F.col("status") == "done", f(F.col("prediction"), F.col("reference"), F.col("input")).cast("double"))
    made = [F.struct(F.lit(n).alias("feedback_key"), score(f).alias("score")) for n, f in evaluators.items()]
    return runs.select("run_id", "input", "prediction", "reference", "status", F.explode(F.array(*made)).alias("f")).select("run_id", "input", "prediction", "reference", "status", "f.feedback_key", "f.score")
