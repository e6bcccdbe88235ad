"""Retrieval where a model is unsure: spans of unlikely tokens become questions, what is found becomes context, in rounds.

Models are functions of tables. ``generate`` gives the tokens of a sentence with their probabilities (query_id, pos, token,
prob), ``ask`` a question for each span, ``retrieve`` the context of each question, ``answer`` the sentence with that context.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import stored

FINISHED = "FINISHED"


def _said(tokens: DataFrame, by: str) -> DataFrame:
    """by and said: the tokens of each sentence in order."""
    token = F.struct(F.col("pos").cast("long").alias("pos"), "token", F.col("prob").cast("double").alias("prob"))
    return tokens.groupBy(by).agg(F.array_sort(F.collect_list(token)).alias("said"))


def _text(said: Column) -> Column:
    return F.array_join(F.transform(said, lambda x: x.token), "")


def _spans(said: Column, least: float, gap: int, pad: int) -> Column:
    """(span_no, start, end, span) of the unsure runs of a sentence's tokens."""

    def grown(runs: Column, x: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        more = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last.start.alias("start"), x.pos.alias("last"))))
        return F.when(F.coalesce(x.pos - last["last"] < gap, F.lit(False)), more).otherwise(F.concat(runs, F.array(F.struct(x.pos.alias("start"), x.pos.alias("last")))))

    low = F.filter(said, lambda x: (x.prob < least) & x.token.rlike(r"(?U)\w"))
    runs = F.aggregate(low, F.array().cast("array<struct<start:bigint,last:bigint>>"), grown)
    inside = lambda r: _text(F.filter(said, lambda x: (x.pos >= r.start) & (x.pos <= r["last"] + pad)))
    return F.transform(runs, lambda r, i: F.struct((i + 1).alias("span_no"), r.start.alias("start"), (r["last"] + pad + 1).alias("end"), inside(r).alias("span")))


def unsure_spans(tokens: DataFrame, *, least: float = 0.2, gap: int = 5, pad: int = 2, by: str = "query_id") -> DataFrame:
    """by, span_no (from 1), start, end and span: runs of tokens with a word in them that are less likely than ``least``.

    Two of them belong to one run if less than ``gap`` places lie between them; a run is padded by ``pad`` tokens.
    """
    return _said(tokens, by).select(by, F.inline(_spans(F.col("said"), least, gap, pad)))


def answered(questions: DataFrame, generate: Callable[[DataFrame], DataFrame], ask: Callable[[Column, Column, Column], Column], retrieve: Callable[[DataFrame], DataFrame], answer: Callable[[Column, Column, Column], Column], *, rounds: int = 10, least: float = 0.2, gap: int = 5, pad: int = 2) -> DataFrame:
    """query_id, question, response, rounds (how many a question took) and done (whether the model has said ``FINISHED``).

    In each round the questions that aren't done get a further sentence. If all of its tokens are likely, it stays. Else each
    unsure span gives a question (``ask``: question, response, span), ``retrieve`` finds texts (query_id, span_no, text) for
    those (query_id, span_no, asked), and the sentence is made anew (``answer``: question, response, context). Those that are
    done are left alone. A round shuffles the questions still open, their tokens and what is found, each once.
    """
    now = stored(questions.select("query_id", "question", F.lit("").alias("response"), F.lit(0).alias("rounds"), F.lit(False).alias("done")), "round")
    finished: list[DataFrame] = []
    for _ in range(rounds):
        said = now.join(_said(generate(now.select("query_id", "question", "response")), "query_id"), "query_id", "left")
        spans = F.transform(_spans(F.col("said"), least, gap, pad), lambda x: F.struct(x.span_no.alias("span_no"), x.span.alias("span")))
        said = said.select(*now.columns, _text(F.col("said")).alias("sentence"), F.coalesce(spans, F.array().cast("array<struct<span_no:int,span:string>>")).alias("spans"))
        said = stored(said, "said")
        asked = said.select("query_id", "question", "response", F.inline("spans"))
        asked = stored(asked.select("query_id", "span_no", ask(F.col("question"), F.concat_ws(" ", "response", "span"), F.col("span")).alias("asked")), "asked")
        found = retrieve(asked).select("query_id", "span_no", "text")
        context = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x.text), "\n\n").alias("context"))
        step = said.join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        more = F.when(F.size("spans") > 0, answer(F.col("question"), F.col("response"), F.col("context"))).otherwise(F.coalesce("sentence", F.lit("")))
        whole = F.trim(F.concat_ws(" ", F.trim("response"), F.trim(more)))
        end = F.contains(whole, F.lit(FINISHED)) | F.col("sentence").isNull()
        step = stored(step.select("query_id", "question", F.trim(F.replace(whole, F.lit(FINISHED), F.lit(""))).alias("response"), (F.col("rounds") + 1).alias("rounds"), end.alias("done")), "round")
        finished.append(step.where("done"))
        now = step.where("NOT done")
        if not now.take(1):
            break
    for part in finished:
        now = now.unionByName(part)
    return now
