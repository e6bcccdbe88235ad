"""Queries that score: string and JSON evaluators, precision and recall, roll-ups, descriptions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import evaluate
from docloom.plans.catalogue import query
from docloom.session import table


@query("SELECT p_partkey, levenshtein(p_name, p_type)::INT AS d, round(CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 0 ELSE levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) END, 6) AS normalized FROM part")
def levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("d"), F.round(X.normalized_levenshtein("p_name", "p_type"), 6).alias("normalized"))


@query("SELECT p_partkey, round(1 - jaro_similarity(p_name, p_type), 6) AS jaro, damerau_levenshtein(p_name, p_type)::DOUBLE AS damerau FROM part")
def string_distances(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(evaluate.string_distance("p_name", "p_type", "jaro"), 6).alias("jaro"), evaluate.string_distance("p_name", "p_type", "damerau_levenshtein").alias("damerau"))


@query("""SELECT p_partkey, (lower(p_brand) = lower('BRAND#' || (p_partkey % 50)))::INT AS brand, (regexp_replace(lower(p_name), '[0-9]', '', 'g') = regexp_replace(lower('Part ' || p_partkey), '[0-9]', '', 'g'))::INT AS name FROM part""")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", X.exact_match("p_brand", F.concat(F.lit("BRAND#"), (F.col("p_partkey") % 50).cast("string")), ignore_case=True).alias("brand"), X.exact_match("p_name", F.concat(F.lit("Part "), F.col("p_partkey").cast("string")), ignore_case=True, ignore_numbers=True).alias("name"))


@query("SELECT p_partkey, regexp_matches(p_type, '^(?:[A-Z]+ )')::INT AS matched FROM part")
def regex_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.regex_match("p_type", "[A-Z]+ ").alias("matched"))


@query("SELECT event_id, json_valid(props)::INT AS valid FROM events")
def json_validity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.json_valid("props").alias("valid"))


@query("""SELECT event_id, 1 AS same, damerau_levenshtein(json(props)::VARCHAR, '{}') / length(json(props)::VARCHAR)::DOUBLE AS distance FROM events""")
def json_equality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", evaluate.json_equal("props", F.concat(F.lit(" "), "props")).alias("same"), evaluate.json_distance("props", F.lit("{}")).alias("distance"))


@query("""WITH j AS (SELECT l.quality = 0 AS gold, d.n_chars < 400 AS found, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
c AS (SELECT lang, sum((gold AND found)::INT) AS tp, sum((NOT gold AND found)::INT) AS fp, sum((gold AND NOT found)::INT) AS fn FROM j GROUP BY lang),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS q FROM c)
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM r""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = evaluate.confusion(rows, F.col("quality") == 0, F.col("n_chars") < 400, ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""SELECT source, sum(n_chars)::BIGINT AS n_chars, round(CASE WHEN sum(toxic + 1) > 0 THEN sum(quality::DOUBLE * (toxic + 1)) / sum(toxic + 1) ELSE 0 END, 6) AS quality
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def weighted_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", F.col("n_chars").cast("long").alias("n_chars"), F.col("quality").cast("double").alias("quality"), (F.col("toxic") + 1).alias("w"))
    return evaluate.weighted_rollup(rows, ["source"], ["n_chars"], ["quality"], "w").withColumn("quality", F.round("quality", 6))


@query("""SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM events GROUP BY event_type""")
def describe(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.describe(table(spark, d, "events"), "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q1", "q2", "q3")})


@query("""SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value END), 4) AS click, round(sum(CASE WHEN event_type = 'view' THEN value END), 4) AS view FROM events GROUP BY user_id""")
def pivot_feedback(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.sum("value"))
    return p.select("user_id", F.round("click", 4).alias("click"), F.round("view", 4).alias("view"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\pL\\pN_])yes([^\\pL\\pN_]|$)') AS yes, CASE WHEN regexp_matches(upper(text), 'THE') THEN 1 ELSE 0 END AS has FROM documents""".replace("\\\\", "\\"))
def word_checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.has_word("text", "yes").alias("yes"), F.upper("text").contains("THE").cast("int").alias("has"))


@query("""SELECT p_partkey, lower(regexp_replace(p_brand, '([A-Z])', '_\\1', 'g')) AS raw, CASE WHEN p_type LIKE '%BRASS' THEN 'metal' WHEN p_size > 25 THEN 'big' ELSE 'other' END AS branch FROM part""".replace("\\\\", "\\"))
def branch_and_case(spark: SparkSession, d: str) -> DataFrame:
    from docloom.operators.algebra import branch

    kind = branch((F.col("p_type").endswith("BRASS"), F.lit("metal")), (F.col("p_size") > 25, F.lit("big")), default=F.lit("other"))
    return table(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_brand", "([A-Z])", "_$1")).alias("raw"), kind.alias("branch"))
