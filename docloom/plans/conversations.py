"""Queries on conversations and events."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import approximate_tokens
from docloom.operators import messages
from docloom.plans.catalogue import query
from docloom.session import table
from docloom.streaming import events as E


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


@query("""WITH m AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role OR role = 'tool' THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, min(turn) AS turn, min(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM r GROUP BY conv_id, run""")
def merge_message_runs(spark: SparkSession, d: str) -> DataFrame:
    return messages.merge_runs(_talk(spark, d))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def buffer_window(spark: SparkSession, d: str) -> DataFrame:
    return messages.last_turns(_talk(spark, d), 2).select("conv_id", "turn", "role")


_TOKENS = "(ceil((length(text) + length(role)) / 4e0) + 3)"


@query(f"SELECT conv_id, turn FROM (SELECT *, sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM conversations) WHERE s <= 200")
def trim_last_tokens(spark: SparkSession, d: str) -> DataFrame:
    return messages.trim(_talk(spark, d), 200, approximate_tokens("text", "role")).select("conv_id", "turn")


@query(f"""WITH s AS (SELECT *, sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations), k AS (SELECT * FROM s WHERE s <= 300),
e AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM k) SELECT conv_id, turn FROM e WHERE turn <= last""")
def trim_first_tokens(spark: SparkSession, d: str) -> DataFrame:
    return messages.trim(_talk(spark, d), 300, approximate_tokens("text", "role"), strategy="first", end_on=["user"]).select("conv_id", "turn")


@query(f"""WITH t AS (SELECT *, {_TOKENS} AS t, turn = min(turn) OVER (PARTITION BY conv_id) AND role = 'system' AS lead FROM conversations),
b AS (SELECT *, 300 - coalesce(sum(CASE WHEN lead THEN t END) OVER (PARTITION BY conv_id), 0) AS spare, sum(CASE WHEN lead THEN 0 ELSE t END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM t),
k AS (SELECT * FROM b WHERE lead OR s <= spare), f AS (SELECT *, min(CASE WHEN role = 'user' AND NOT lead THEN turn END) OVER (PARTITION BY conv_id) AS first FROM k)
SELECT conv_id, turn, role FROM f WHERE lead OR turn >= first""")
def trim_keep_system(spark: SparkSession, d: str) -> DataFrame:
    return messages.trim(_talk(spark, d), 300, approximate_tokens("text", "role"), keep_system=True, start_on=["user"]).select("conv_id", "turn", "role")


@query(f"SELECT conv_id, sum({_TOKENS})::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return messages.count_tokens(_talk(spark, d))


@query("""SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' WHEN 'system' THEN 'System' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def transcript(spark: SparkSession, d: str) -> DataFrame:
    return messages.transcript(_talk(spark, d))


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'system') AND turn <> 0")
def filter_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages.keep(_talk(spark, d), include_roles=["user", "system"], exclude_ids=[0], id_="turn").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context_lag_lead(spark: SparkSession, d: str) -> DataFrame:
    return messages.neighbours(_talk(spark, d), "text", by="conv_id", order="turn").select("conv_id", "turn", "previous_text", "next_text")


@query("SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s < 400")
def length_budget(spark: SparkSession, d: str) -> DataFrame:
    return messages.within_budget(_talk(spark, d), F.length("text"), 400, by="conv_id", order="turn").select("conv_id", "turn")


@query(f"""SELECT conv_id, min(turn) AS cutoff FROM (SELECT *, sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM conversations) WHERE s <= 250 AND role <> 'tool' GROUP BY conv_id""")
def summary_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return messages.summary_cutoff(_talk(spark, d), 250, approximate_tokens("text", "role"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, len AS total, 0 AS group_no FROM c WHERE n = 1 UNION ALL
SELECT c.conv_id, c.turn, c.n, CASE WHEN f.total + c.len > 5000 THEN c.len ELSE f.total + c.len END, f.group_no + CASE WHEN f.total + c.len > 5000 THEN 1 ELSE 0 END FROM f JOIN c ON c.conv_id = f.conv_id AND c.n = f.n + 1)
SELECT conv_id, turn, group_no FROM f""")
def pack_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return messages.pack_consecutive(_talk(spark, d), F.length("text"), 5000, by="conv_id", order="turn").select("conv_id", "turn", "group_no")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(table(spark, d, "events"), "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])


@query("""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * i AS start, event_id FROM events, range(0, 2) t(i))
SELECT start, start + INTERVAL 1 HOUR AS "end", count(*) AS n FROM w GROUP BY start""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(table(spark, d, "events"), "1 hour", [], [F.count("*").alias("n")], slide="30 minutes")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"), "30 minutes", ["user_id"], [F.count("*").alias("n")])


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_no, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 5 AS over_limit FROM events")
def call_limits(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = table(spark, d, "events").withColumn("at", F.row_number().over(w))
    return messages.call_numbers(numbered, 5, by="user_id", order="at").select("event_id", "call_no", "over_limit")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100")
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n_chunks FROM conversations GROUP BY conv_id")
def folded_chunks(spark: SparkSession, d: str) -> DataFrame:
    return E.folded_chunks(_talk(spark, d), run="conv_id", seq="turn")


@query("""SELECT a.event_id, (SELECT max(b.value) FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.event_type = 'purchase' AND c.user_id = a.user_id AND c.ts <= a.ts)) AS last_value
FROM events a WHERE a.event_type = 'view'""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    from docloom.operators.fusion import as_of

    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return as_of(views, bought, by=["user_id"], time="ts", values=["last_value"]).select("event_id", "last_value")
