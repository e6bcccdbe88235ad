"""Queries on documents and pages: deduplication, indexing, splitting, text functions, personal data."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import personal, text as X
from docloom.operators import fusion, indexing, split, summaries
from docloom.plans.catalogue import query
from docloom.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_by_key(_docs(spark, d).select("doc_id", "text"), ["text"], ["doc_id"])


@query("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, text ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def dedup_composite_key(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "lang", "source", F.sha2("text", 256).alias("body"))
    return fusion.first_by_key(docs, ["lang", "source", "body"], ["doc_id"]).drop("body")


@query(r"SELECT min(doc_id) AS doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body FROM documents GROUP BY trim(regexp_replace(text, '\s+', ' ', 'g'))")
def dedup_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy(F.md5(X.compact("text")).alias("body")).agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT doc_id, sha256(sha256(text) || sha256('{"lang": "' || lang || '", "source": "' || source || '"}')) AS key FROM documents""")
def index_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", indexing.document_hash("text", indexing.metadata_json(lang="lang", source="source")).alias("key"))


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, d).select("doc_id", "source", F.sha2("text", 256).alias("key"))
    old = docs.where("doc_id % 3 = 0").unionByName(spark.createDataFrame([(-1, "src1", "gone-1"), (-2, "elsewhere", "gone-2")], "doc_id long, source string, key string"))
    state = old.groupBy("key").agg(F.min("source").alias("group_id")).select(F.lit("ns").alias("namespace"), "key", "group_id", F.lit(1.0).alias("updated_at"))
    return docs.where("doc_id % 2 = 0"), state


_STATE = """WITH docs AS (SELECT doc_id, source, sha256(text) AS key FROM documents), batch AS (SELECT * FROM docs WHERE doc_id % 2 = 0),
old AS (SELECT key, source FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT * FROM (VALUES ('gone-1', 'src1'), ('gone-2', 'elsewhere')) v(key, source)),
state AS (SELECT key, min(source) AS group_id FROM old GROUP BY key)"""


@query(_STATE + """, m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM batch)
SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN s.key IS NULL THEN 'added' ELSE 'skipped' END AS action, count(*) AS n FROM m LEFT JOIN state s ON s.key = m.key GROUP BY 1""")
def index_classify_counts(spark: SparkSession, d: str) -> DataFrame:
    batch, state = _state(spark, d)
    return indexing.classify(batch, state, "ns", order="doc_id").groupBy("action").agg(F.count("*").alias("n"))


def _cleanup(how: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        batch, state = _state(spark, d)
        return indexing.step(batch, state, "ns", 2.0, cleanup=how, source="source", order="doc_id").state.select("key", "updated_at")

    return run


_AFTER = _STATE + """, gone AS (SELECT key FROM state WHERE key NOT IN (SELECT key FROM batch) {scope})
SELECT DISTINCT key, 2e0 AS updated_at FROM batch UNION ALL SELECT key, 1e0 FROM state WHERE key NOT IN (SELECT key FROM batch) AND key NOT IN (SELECT key FROM gone)"""


@query(_AFTER.format(scope=""))
def cleanup_full(spark: SparkSession, d: str) -> DataFrame:
    return _cleanup("full")(spark, d)


@query(_AFTER.format(scope="AND group_id IN (SELECT source FROM batch)"))
def cleanup_scoped_full(spark: SparkSession, d: str) -> DataFrame:
    return _cleanup("scoped_full")(spark, d)


@query(_AFTER.format(scope="AND group_id IN (SELECT source FROM batch)"))
def cleanup_incremental(spark: SparkSession, d: str) -> DataFrame:
    return _cleanup("incremental")(spark, d)


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, (i / 40)::INT AS chunk_no, array_to_string(w[i + 1:i + 50], ' ') AS chunk FROM t, LATERAL (SELECT unnest(range(0, greatest(len(w) - 10 - 1, 0) + 1, 40)) AS i) WHERE len(w) > 0""")
def token_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = _docs(spark, d).select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.posexplode(split.token_windows("w", 50, 10)).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.array_join("c", " ").alias("chunk"))


@query()
def recursive_split(spark: SparkSession, d: str) -> DataFrame:
    return split.split_documents(_docs(spark, d).select("doc_id", "text"), lambda t: split.recursive(t, 1000, 100), overlap=100)


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, i, piece, sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, piece FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE piece <> '')),
z AS (SELECT doc_id, i, upto, upto - length(piece) - 1 AS before FROM p),
-- where a chunk ends at e, the next one holds piece e + 1 and begins as early as the overlap and the size let it
b AS (SELECT e.doc_id, e.i AS e, e.upto, n.upto AS nupto, coalesce(min(s.i), e.i + 1) AS s FROM z e JOIN z n ON n.doc_id = e.doc_id AND n.i = e.i + 1
  LEFT JOIN z s ON s.doc_id = e.doc_id AND s.i <= e.i AND e.upto - s.before - 1 <= 50 AND n.upto - s.before - 1 <= 500 GROUP BY e.doc_id, e.i, e.upto, n.upto),
f AS (SELECT doc_id, 0 AS e, 1 AS s FROM z WHERE i = 1 UNION ALL SELECT doc_id, e, s FROM b),
t AS (SELECT f.doc_id, f.e AS prior, f.s, greatest(f.e + 1, coalesce(max(x.i), 0)) AS e FROM f JOIN z a ON a.doc_id = f.doc_id AND a.i = f.s LEFT JOIN z x ON x.doc_id = f.doc_id AND x.i > f.e AND x.upto - a.before - 1 <= 500 GROUP BY f.doc_id, f.e, f.s),
c AS (SELECT doc_id, s, e, 1 AS k FROM t WHERE prior = 0 UNION ALL SELECT t.doc_id, t.s, t.e, c.k + 1 FROM c JOIN t ON t.doc_id = c.doc_id AND t.prior = c.e),
j AS (SELECT c.doc_id, k, regexp_replace(string_agg(piece, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS chunk FROM c JOIN p ON p.doc_id = c.doc_id AND p.i BETWEEN c.s AND c.e GROUP BY c.doc_id, k)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_no, chunk FROM j WHERE chunk <> ''""")
def character_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(split.character_chunks("text", "\n", 500, 50)).alias("chunk_no", "chunk"))


@query()
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(split.sentence_chunks("text", 400)).alias("chunk_no", "chunk"))


@query()
def html_header_split(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    how = {"h1": "h1", "h2": "h2", "h3": "h3"}
    return pages.select("page_id", F.posexplode(split.sections_column("html", lambda t: split.html_sections(t, how))).alias("chunk_no", "s")).select("page_id", "chunk_no", "s.content", "s.metadata")


@query()
def json_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.posexplode(split.json_chunk_column("props", 60)).alias("chunk_no", "chunk"))


@query(r"""WITH l AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM l)
SELECT doc_id, b::BIGINT AS block_no, string_agg(line, chr(10) ORDER BY line_no) AS block FROM m GROUP BY doc_id, b""")
def numbered_blocks(spark: SparkSession, d: str) -> DataFrame:
    return split.numbered_blocks(_docs(spark, d), start="^[A-Z][a-z]+ ")


@query(r"""SELECT doc_id, regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED_EMAIL]', 'g') AS text FROM documents""")
def pii_email_redact(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", personal.apply("text", "email").alias("text"))


_IP = r"\b(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b"


@query(rf"SELECT doc_id, regexp_replace(text, '{_IP}', '*.*.*.\1', 'g') AS text FROM documents")
def pii_ip_mask(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", personal.apply("text", "ip", "mask").alias("text"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b')) AS card FROM documents),
d AS (SELECT doc_id, card, regexp_replace(card, '[^0-9]', '', 'g') AS n FROM m)
SELECT doc_id, card FROM d WHERE list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i % 2 = 0 THEN (2 * n[16 - (15 - i)]::INT) // 10 + (2 * n[16 - (15 - i)]::INT) % 10 ELSE n[16 - (15 - i)]::INT END)) % 10 = 0""")
def pii_cards(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(personal.matches("text", "credit_card")).alias("card"))


def _replaced(text: str, pattern: str, new: str) -> str:
    """SQL for a text with each match m[i] of a pattern replaced."""
    pieces, found = f"string_split_regex({text}, '{pattern}')", f"regexp_extract_all({text}, '{pattern}', 0)"
    return f"(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(m) THEN '' ELSE {new} END), '') FROM (SELECT {pieces} AS p, {found} AS m))"


_HASH = "'<{0}_hash:' || substr(sha256(m[i]), 1, 8) || '>'"
_LUHN = "list_sum(list_transform(range(0, 16), lambda j: CASE WHEN j % 2 = 0 THEN (2 * regexp_replace(m[i], '[^0-9]', '', 'g')[j + 1]::INT) // 10 + (2 * regexp_replace(m[i], '[^0-9]', '', 'g')[j + 1]::INT) % 10 ELSE regexp_replace(m[i], '[^0-9]', '', 'g')[j + 1]::INT END)) % 10 = 0"
_MARK = "CASE WHEN contains(m[i], '-') THEN '-' WHEN contains(m[i], ' ') THEN ' ' ELSE '' END"


@query(f"""WITH a AS (SELECT doc_id, {_replaced("coalesce(text, '')", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", _HASH.format("email"))} AS t FROM documents),
b AS (SELECT doc_id, {_replaced("t", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b", _HASH.format("ip"))} AS t FROM a)
SELECT doc_id, {_replaced("t", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", f"CASE WHEN {_LUHN} THEN '****' || {_MARK} || '****' || {_MARK} || '****' || {_MARK} || right(regexp_replace(m[i], '[^0-9]', '', 'g'), 4) ELSE m[i] END")} AS text FROM b""")
def pii_hash(spark: SparkSession, d: str) -> DataFrame:
    return personal.rules(_docs(spark, d).select("doc_id", "text"), "text", {"email": "hash", "ip": "hash", "credit_card": "mask"})


@query(r"""WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, 'href=["'']([^"''#]+)', 1), lambda x: NOT regexp_matches(x, '^(javascript:|mailto:|#)') AND NOT regexp_matches(regexp_replace(x, '[?#].*$', ''), '\.(css|js|ico|png|jpg|jpeg|gif|svg|csv|bz2|zip|epub|webp|pdf|docx|xlsx|pptx|pptm)$')) AS l FROM pages)
SELECT page_id, len(list_distinct(l))::INT AS n_links, (SELECT string_agg(x, ' ' ORDER BY x) FROM (SELECT DISTINCT unnest(l) AS x)) AS links FROM l""")
def regex_extract_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", X.links("html").alias("l"))
    return pages.select("page_id", F.size("l").alias("n_links"), F.when(F.size("l") > 0, F.array_join(F.array_sort("l"), " ")).alias("links"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS compacted, lower(regexp_replace(regexp_replace(text, '[*_`#>\-]+', '', 'g'), '\s+', '', 'g')) AS for_match,
CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 80 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 80)) || '...' END AS preview,
contains(text, 'the') OR contains(text, 'und') AS marked FROM documents""")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.compact("text").alias("compacted"), X.for_match("text").alias("for_match"), X.preview("text").alias("preview"), X.contains_any("text", ["the", "und"]).alias("marked"))


@query("""SELECT doc_id, 'Source: ' || source || ' (' || lang || ')' || chr(10) || text AS prompt FROM documents""")
def prompt_template(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.template("Source: {source} ({lang})\n{text}").alias("prompt"))


@query("""SELECT lang, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY lang""")
def stuff_documents(spark: SparkSession, d: str) -> DataFrame:
    return summaries.stuffed(_docs(spark, d), by="lang", order="doc_id")


@query("""WITH c AS (SELECT doc_id, doc_id % 100 AS parent_id, n_chars FROM documents), h AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM c),
t AS (SELECT parent_id, min(rank) AS first_rank FROM h WHERE rank <= 50 GROUP BY parent_id)
SELECT t.parent_id, first_rank, source FROM t JOIN documents d ON d.doc_id = t.parent_id""")
def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "n_chars", "source")
    best = docs.orderBy(F.desc("n_chars"), "doc_id").limit(50).select((F.col("doc_id") % 100).alias("parent_id"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return fusion.parents(best, docs.select(F.col("doc_id").alias("parent_id"), "source"))


@query("""SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE contains(text, 'tion') GROUP BY lang""")
def where_document(spark: SparkSession, d: str) -> DataFrame:
    from docloom.operators import filters

    docs = _docs(spark, d).where(filters.from_dict({"text": {"$contains": "tion"}}))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
