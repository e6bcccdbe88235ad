"""Datasets run through a chain and evaluators: mapping of inputs, evaluators by name, long and wide results, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import evaluate

#: a score from a prediction, a reference and an input
Evaluator = Callable[[Column, Column, Column], Column]
EVALUATORS: dict[str, Evaluator] = {
    "exact_match": lambda p, r, i: X.exact_match(p, r).cast("double"),
    "levenshtein": lambda p, r, i: X.normalized_levenshtein(p, r),
    "json_validity": lambda p, r, i: X.json_valid(p).cast("double"),
    "json_equality": lambda p, r, i: evaluate.json_equal(p, r).cast("double"),
    "contains": lambda p, r, i: F.contains(p, r).cast("double"),
    "token_overlap": lambda p, r, i: X.token_overlap(p, r),
}


def load_evaluators(names: list[str]) -> dict[str, Evaluator]:
    """Evaluators by name; an unknown name is an error."""
    if unknown := [n for n in names if n not in EVALUATORS]:
        raise ValueError(f"no evaluator {unknown}; there are {sorted(EVALUATORS)}")
    return {n: EVALUATORS[n] for n in names}


def single(values: Column | str, key: str | None = None, of: list[str] | None = None) -> Column:
    """One value of a struct or map: the one named, or the only one there is; of: a struct's field names."""
    v = F.col(values) if isinstance(values, str) else values
    if key is not None:
        return v[key]
    if of is not None:
        if len(of) != 1:
            raise ValueError(f"which of {of}?")
        return v[of[0]]
    wrong = F.raise_error(F.concat(F.lit("which of the values? "), F.to_json(v))).cast("string")
    return F.when(F.size(v) == 1, F.map_values(v)[0]).otherwise(wrong)


def run(dataset: DataFrame, chain: Callable[[DataFrame], DataFrame], evaluators: dict[str, Evaluator], *, key: str = "example_id", question: str = "input", reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """key, input, prediction, reference, feedback_key and score: a row for each example and evaluator. The chain adds the prediction."""
    done = chain(dataset).select(key, F.col(question).alias("input"), F.col(prediction).alias("prediction"), F.col(reference).alias("reference"))
    made = [F.struct(F.lit(n).alias("feedback_key"), f(F.col("prediction"), F.col("reference"), F.col("input")).cast("double").alias("score")) for n, f in evaluators.items()]
    return done.select("*", F.explode(F.array(*made)).alias("f")).select(key, "input", "prediction", "reference", "f.feedback_key", "f.score")


def wide(results: DataFrame, keys: list[str], *, key: str = "example_id") -> DataFrame:
    """A row for each example: its columns and a column feedback.<key> for each of the keys."""
    rest = [c for c in results.columns if c not in ("feedback_key", "score")]
    rows = results.groupBy(*rest).pivot("feedback_key", keys).agg(F.first("score", ignorenulls=True))
    return rows.select(*rest, *(F.col(f"`{k}`").alias(f"feedback.{k}") for k in keys))


def summary(results: DataFrame) -> DataFrame:
    """Each evaluator's count, mean, standard deviation, quartiles and extremes."""
    return evaluate.describe(results, "score", ["feedback_key"])
