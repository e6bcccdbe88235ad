"""Interfaces for models, with deterministic stand-ins: embedders, chat models, and the chains around them.

A model is a function from columns to a column. Real ones are pandas UDFs of the caller's; the ones here run offline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.operators import fusion, messages, search
from docloom.operators.terms import TermIndex
from docloom.session import stored

Model = Callable[[Column], Column]


def echo(prefix: str = "") -> Model:
    """A chat model that answers with its prompt."""
    return lambda prompt: F.concat(F.lit(prefix), prompt)


def canned(answers: dict[str, str], default: str = "") -> Model:
    """A chat model that answers by a word of the prompt."""

    def model(prompt: Column) -> Column:
        out = F.lit(default)
        for word, answer in reversed(answers.items()):
            out = F.when(F.contains(prompt, F.lit(word)), answer).otherwise(out)
        return out

    return model


def judged(df: DataFrame, template: str, model: Model, parse: Model, name: str = "score") -> DataFrame:
    """df with a model's verdict on a prompt made of its columns, parsed to a value."""
    return df.withColumn(name, parse(model(X.template(template))))


def filtered(df: DataFrame, template: str, model: Model) -> DataFrame:
    """Rows of which a model says yes."""
    return df.where(X.yes_no(model(X.template(template))))


def extracted(df: DataFrame, template: str, model: Model, text: str = "text") -> DataFrame:
    """df with what a model takes out of each text; rows of which nothing is left are dropped."""
    return df.withColumn(text, model(X.template(template))).where(F.length(F.trim(text)) > 0)


def multi_query(rows: DataFrame, queries: DataFrame, embed: Column, **how) -> DataFrame:
    """Rows found by any variant of a query (query_id, variant, text): each once, at its best rank."""
    q = queries.withColumn("__q", F.concat_ws("#", "query_id", "variant")).withColumn("query_embedding", embed)
    hits = search.top_k(rows, q.select(F.col("__q").alias("query_id"), "query_embedding"), **how)
    row_id = how.get("row_id", "id")
    return hits.withColumn("query_id", F.substring_index("query_id", "#", 1)).groupBy("query_id", row_id).agg(F.min("rank").alias("rank"))


def hybrid(rows: DataFrame, queries: DataFrame, *, k: int = 4, fetch: int = 20, row_id: str = "id", query_id: str = "query_id", text: str = "text", query_text: str = "query_text", weights: tuple[float, float] = (0.5, 0.5), where: Column | None = None, index: TermIndex | None = None) -> DataFrame:
    """Dense and sparse search of each query (query_id, query_embedding, query_text), fused by reciprocal ranks: query_id, row_id, score, position.

    index: one made before, with the columns that ``where`` asks for; else the texts are indexed here.
    """
    keep = [c for c in rows.columns if c not in (row_id, text, "embedding")]
    index = index or TermIndex.of_texts(rows, text=text, row_id=row_id, keep=keep if where is not None else None)
    queries = stored(queries.select(query_id, "query_embedding", query_text), "queries")
    dense = search.top_k_by_classes(rows, queries, k=fetch, row_id=row_id, query_id=query_id, where=where).select(query_id, F.lit(1).alias("list_id"), row_id, "rank")
    sparse = index.search(index.words(queries, text=query_text, query_id=query_id), k=fetch, query_id=query_id, where=where).select(query_id, F.lit(2).alias("list_id"), row_id, "rank")
    fused = fusion.reciprocal_rank_fusion(dense.unionByName(sparse), dict(zip((1, 2), weights, strict=True)), key=row_id, by=[query_id])
    return fused.where(F.col("position") <= k)


def cluster_representatives(rows: DataFrame, n: int, *, row_id: str = "id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """The row nearest to the centre of each of n clusters."""
    data = rows.select(row_id, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=n, seed=seed, maxIter=10).fit(data)
    centres = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    placed = model.transform(data).join(F.broadcast(centres), "prediction").withColumn("distance", V.euclidean(vector_to_array("features"), "centre"))
    return search.ranked(placed, ["prediction"], [F.asc("distance"), F.col(row_id)], 1).select(F.col("prediction").alias("cluster"), row_id, "distance")


def nearest_route(rows: DataFrame, routes: DataFrame, *, row_id: str = "id", route_id: str = "route_id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Each row's nearest route: row_id, route_id, score; ties by route id. Rows stream past the routes without a shuffle; routes
    that can't be broadcast at once are taken in slices, and the best of a row's slices is chosen then."""
    df = rows.select(F.col(row_id).alias("r"), F.col(vector).cast("array<double>").alias("v")).where("r IS NOT NULL AND v IS NOT NULL")
    schema = f"`{row_id}` {df.schema['r'].dataType.simpleString()}, `{route_id}` {routes.schema[route_id].dataType.simpleString()}, score double"

    def to(few: tuple[pa.Array, np.ndarray]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(few)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, to = shared.value
            order = np.argsort(pc.rank(ids).to_numpy(), kind="stable") if len(ids) else np.empty(0, int)
            for b in batches:
                if len(b) and len(to):
                    score = search.scores(metric, search.matrix(b.column(1), to.shape[1]), to[order])
                    at = score.argmax(axis=1) if metric in V.SIMILARITIES else score.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0), ids.take(pa.array(order[at])), pa.array(score[np.arange(len(at)), at])], [row_id, route_id, "score"])

        return df.mapInArrow(near, schema)

    parts = [to(few) for few in search.slices(routes, route_id, vector)]
    if len(parts) == 1:
        return parts[0]
    both = reduce(DataFrame.unionByName, parts)
    best = F.desc("score") if metric in V.SIMILARITIES else F.asc("score")
    return search.ranked(both, [row_id], [best, F.col(route_id)], 1).drop("rank")


def answered(questions: DataFrame, hits: DataFrame, model: Model, *, by: str = "query_id", text: str = "text", rank: str = "rank", template: str = "{context}\n\nQuestion: {question}") -> DataFrame:
    """Retrieved texts stuffed into one prompt for each question, and the model's answer."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda x: x[text])
    context = hits.groupBy(by).agg(F.array_join(parts, "\n\n").alias("context"))
    return questions.join(context, by, "left").withColumn("answer", model(X.template(template)))


def reduced(df: DataFrame, model: Model, length: Callable[[Column], Column], most: int, *, by: str, order: str, text: str = "text") -> DataFrame:
    """Map-reduce: texts of each group are answered in consecutive packs of ``most`` until one is left. Answers that get no fewer are an error."""
    df = stored(df.select(by, order, model(F.col(text)).alias(text)), "mapped")
    n = df.count()
    while df.groupBy(by).count().where("count > 1").take(1):
        packed = messages.pack_consecutive(df, length(F.col(text)), most, by=by, order=order)
        parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
        df = stored(packed.groupBy(by, "group_no").agg(F.array_join(parts, "\n").alias(text), F.min(order).alias(order)).select(by, order, model(F.col(text)).alias(text)), "reduced")
        n, before = df.count(), n
        if n == before:
            raise ValueError("the answers are too long to be put together")
    return df


def few_shot(examples: DataFrame, keep: int, similarity: Column, order: str) -> DataFrame:
    """The examples most similar to an input, the best last."""
    w = Window.orderBy(F.desc("__s"), order)
    return examples.withColumn("__s", similarity).orderBy(F.desc("__s"), order).limit(keep).withColumn("rank", F.row_number().over(w)).drop("__s")


def routed(df: DataFrame, model: Model, template: str, routes: dict[str, Column], default: str) -> DataFrame:
    """df with the destination that a model names for each row, and that route's answer; names that aren't routes go to the default."""
    if default not in routes:
        raise ValueError(f"no route {default!r}")
    said = F.trim(model(X.template(template)))
    rows = df.withColumn("destination", F.when(said.isin(list(routes)), said).otherwise(default))
    answer = F.lit(None).cast("string")
    for name, value in routes.items():
        answer = F.when(F.col("destination") == name, value).otherwise(answer)
    return rows.withColumn("answer", answer)


def tagged(df: DataFrame, template: str, model: Model, schema: str) -> DataFrame:
    """df with the fields of a schema that a model's JSON answer gives; null where it isn't JSON of that shape."""
    return df.withColumn("__v", F.from_json(model(X.template(template)), schema)).select(*df.columns, "__v.*")


def questions(chunks: DataFrame, model: Model, template: str) -> DataFrame:
    """Question and answer pairs that a model makes of each chunk (a JSON array of question and answer)."""
    pairs = F.from_json(model(X.template(template)), "array<struct<question:string,answer:string>>")
    return chunks.select("*", F.posexplode(pairs).alias("pair_no", "__p")).select(*chunks.columns, "pair_no", "__p.question", "__p.answer")


def revised(df: DataFrame, principles: list[tuple[Model, Callable[[Column, Column], Column]]], *, answer: str = "answer") -> DataFrame:
    """df with its answers critiqued and revised by each principle in turn: a critique (null: nothing to say), and a revision from answer and critique."""
    for critique, revise in principles:
        said = critique(F.col(answer))
        df = df.withColumn(answer, F.when(said.isNull(), F.col(answer)).otherwise(revise(F.col(answer), said)))
    return df


def allowed_url(url: Column | str, domains: list[str]) -> Column:
    """Whether a url's host is one of the domains; anything but http and https isn't."""
    u = F.col(url) if isinstance(url, str) else url
    good = F.try_parse_url(u, F.lit("HOST")).isin(domains) & F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https")
    return F.coalesce(good, F.lit(False))


def random_embedding(size: int, seed: int) -> Column:
    """Normal values, new for each row; the seed makes them repeatable for the same rows in the same partitions."""
    return F.array(*(F.randn(seed + i) for i in range(size)))


def moderated(df: DataFrame, flagged: Model, *, text: str = "text", message: str = "This text can't be shown.", error: bool = False) -> DataFrame:
    """df with texts that a model flags (a boolean column of the text) replaced by a message, or refused with an error."""
    bad = F.coalesce(flagged(F.col(text)), F.lit(False))
    wrong = F.raise_error(F.lit("text was flagged")).cast("string") if error else F.lit(message)
    return df.withColumn(text, F.when(bad, wrong).otherwise(F.col(text)))


def standalone(questions_: DataFrame, history: DataFrame, model: Model, *, by: str = "conv_id", question: str = "question", template: str = "{history}\nFollow up: {question}") -> DataFrame:
    """Questions that stand alone: those with a history (by, transcript) are rewritten by a model, others stay."""
    joined = questions_.join(history.select(by, F.col("transcript").alias("history")), by, "left")
    return joined.withColumn(question, F.when(F.col("history").isNull(), F.col(question)).otherwise(model(X.template(template)))).drop("history")


def with_sources(answers: DataFrame, hits: DataFrame, *, by: str = "query_id", source: str = "source") -> DataFrame:
    """answers with the distinct sources of the hits they rest on, in order of rank, joined by commas."""
    first = hits.groupBy(by, source).agg(F.min("rank").alias("r"))
    listed = first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", source))), lambda x: x[source]), ", ").alias("sources"))
    return answers.join(listed, by, "left").withColumn("sources", F.coalesce("sources", F.lit("")))
