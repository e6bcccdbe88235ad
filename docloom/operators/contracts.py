"""Contract review: clauses of Markdown contracts, matching of labelled and found risks, metrics by participant and policy."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import for_match
from docloom.operators import evaluate, messages, split

RISK = "risk_id:string,title:string,clause_text:string,explanation:string,suggestion:string,status:string"
SCHEMA = f"contract_id string, full_contract_text string, labels array<struct<{RISK}>>, participants map<string,array<struct<{RISK}>>>"
CLAUSE_MATCH, RISK_MATCH = 0.33, 0.45
FIELDS = ("title", "clause_text", "explanation", "suggestion")
ADOPTED = ("accept", "partial")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def clauses(contracts: DataFrame) -> DataFrame:
    """contract_id, clause_id, clause_no, clause_text, and the previous and next clause's first line."""
    rows = split.numbered_blocks(contracts, key="contract_id", text="full_contract_text").where(F.trim("block") != "")
    rows = rows.select("contract_id", F.concat_ws("#", "contract_id", F.col("block_no").cast("string")).alias("clause_id"), F.col("block_no").alias("clause_no"), F.col("block").alias("clause_text"), F.substring_index("block", "\n", 1).alias("head"))
    return messages.neighbours(rows, "head", by="contract_id", order="clause_no").drop("head")


def risks(contracts: DataFrame) -> DataFrame:
    """Labelled and found risks in one table: contract_id, origin (label or the participant), and the risk's fields."""
    gold = contracts.select("contract_id", F.lit("label").alias("origin"), F.explode("labels").alias("r"))
    found = contracts.select("contract_id", F.explode("participants").alias("origin", "rs")).select("contract_id", "origin", F.explode("rs").alias("r"))
    return gold.unionByName(found).select("contract_id", "origin", "r.*")


def to_clauses(risk_rows: DataFrame, clause_rows: DataFrame, threshold: float = CLAUSE_MATCH) -> DataFrame:
    """Each risk with the clause that its text is most like, if more than the threshold; others have no row."""
    c = clause_rows.select("contract_id", "clause_id", F.col("clause_text").alias("__clause"))
    keyed = risk_rows.withColumn("__key", F.concat_ws("|", "contract_id", "origin", "risk_id"))
    return evaluate.best_match(keyed, c, ["contract_id"], evaluate.text_similarity(for_match("clause_text"), for_match("__clause")), threshold, left_id="__key", right_id="clause_id").drop("__key", "__clause")


def matched(gold: DataFrame, found: DataFrame, threshold: float = RISK_MATCH) -> DataFrame:
    """One-to-one pairs of gold and found risks within a participant's clause: grp, gold_id, found_id, score (the best of four fields)."""
    g = gold.select("clause_id", F.col("risk_id").alias("gold_id"), *(F.col(f).alias(f"g_{f}") for f in FIELDS))
    p = found.select("clause_id", "origin", F.col("risk_id").alias("found_id"), *(F.col(f).alias(f"p_{f}") for f in FIELDS))
    score = F.greatest(*(evaluate.text_similarity(F.coalesce(f"g_{f}", F.lit("")), F.coalesce(f"p_{f}", F.lit(""))) for f in FIELDS))
    scored = g.join(p, "clause_id").select(F.concat_ws("|", "origin", "clause_id").alias("grp"), "gold_id", "found_id", score.alias("score"))
    return evaluate.greedy_pairs(scored, "grp", threshold, left_id="gold_id", right_id="found_id")


def evaluated(contracts: DataFrame, policies: tuple[str, ...] = ("all", "adopted")) -> DataFrame:
    """origin, policy, clause-level and risk-level counts and ratios."""
    c, placed = clauses(contracts), None
    placed = to_clauses(risks(contracts), c)
    found = placed.where("origin <> 'label'")
    everyone = contracts.select(F.explode(F.map_keys("participants")).alias("origin")).distinct()  # also those without any risk in its place
    out = None
    for policy in policies:
        gold = placed.where("origin = 'label'")
        gold = gold.where(F.col("status").isin(*ADOPTED)) if policy == "adopted" else gold
        pairs = matched(gold, found).select(F.substring_index("grp", "|", 1).alias("origin")).groupBy("origin").agg(F.count("*").alias("tp"))
        per = everyone.join(found.groupBy("origin").agg(F.count("*").alias("found")), "origin", "left").crossJoin(F.broadcast(gold.agg(F.count("*").alias("gold")))).join(pairs, "origin", "left").fillna(0, ["tp", "found"])
        one = per.select("origin", F.lit(policy).alias("policy"), "tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"))
        one = one.select("*", *evaluate.ratios("tp", "fp", "fn"))
        out = one if out is None else out.unionByName(one)
    return out


def anchors(paragraphs: DataFrame, clause_rows: DataFrame, by: str = "contract_id") -> DataFrame:
    """The paragraph each clause belongs at: one contained in the clause or containing it, the longest first."""
    p = paragraphs.select(by, "paragraph_no", F.col("text").alias("__p"))
    a, b = for_match("__p"), for_match("clause_text")
    score = F.when(F.contains(a, b) | F.contains(b, a), 1000 + F.least(F.length(a), F.length(b))).otherwise(0)
    rows = clause_rows.join(p, by).withColumn("score", score).where("score > 0")
    w = Window.partitionBy("clause_id").orderBy(F.desc("score"), "paragraph_no")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("clause_id", "paragraph_no", "score")


def status(text: Column | str) -> Column:
    """accept, partial, reject or other, by the first marker of a reviewer's note."""
    t = F.col(text) if isinstance(text, str) else text
    has = lambda *ms: t.rlike("|".join(ms))
    return F.when(has("部分采纳", "部分接受", "partial"), "partial").when(has("不采纳", "未采纳", "拒绝", "reject"), "reject").when(has("采纳", "接受", "accept"), "accept").otherwise("other")


def _risk_items(text: str | None) -> list[dict[str, str]]:
    """The risks a model's answer holds: the list "risks" of the last JSON object that has one; of broken JSON, what its lines say field by field."""
    body = (text or "").rsplit("</think>", 1)[-1].strip()
    decode = json.JSONDecoder().raw_decode
    at = len(body)
    while (at := body.rfind("{", 0, at)) >= 0:
        try:
            value = decode(body, at)[0]
        except ValueError:
            continue
        if isinstance(value, dict) and isinstance(value.get("risks"), list):
            return [{f: str(x.get(f) or "").strip() for f in FIELDS} for x in value["risks"] if isinstance(x, dict)]
    items: list[dict[str, str]] = [{}]
    line = re.compile(rf'"({"|".join(FIELDS)})":\s*(?:"(.*)"|"?(.*?)),?\s*$')
    for raw in (text or "")[max(0, (text or "").rfind('"risks"')) :].splitlines() if '"risks"' in (text or "") else ():
        if raw.strip() in ("{", "}", "},"):
            items.append({})
        elif m := line.match(raw.strip()):
            items[-1][m[1]] = (m[2] if m[2] is not None else m[3]).strip()
    return [{f: x.get(f, "") for f in FIELDS} for x in items if any(x.values())]


def risks_in(answer: Column | str) -> Column:
    """The risks in a model's answer: an array of structs of the four fields."""

    @F.pandas_udf("array<struct<title:string,clause_text:string,explanation:string,suggestion:string>>")
    def items(x: pd.Series) -> pd.Series:
        return pd.Series([_risk_items(t) for t in x], dtype=object)

    return items(answer)


def dataset(texts: DataFrame, labels: DataFrame, found: DataFrame) -> DataFrame:
    """Contracts in the shape of ``SCHEMA``: texts (contract_id, full_contract_text), labels and found (with participant) risks as rows."""
    names = [f.split(":")[0] for f in RISK.split(",")]
    row = F.struct(*(F.col(n).cast("string").alias(n) for n in names))
    gold = labels.groupBy("contract_id").agg(F.array_sort(F.collect_list(row)).alias("labels"))
    each = found.groupBy("contract_id", "participant").agg(F.array_sort(F.collect_list(row)).alias("rs"))
    people = each.groupBy("contract_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("participant", "rs")))).alias("participants"))
    none = f"array<struct<{RISK}>>"
    joined = texts.join(gold, "contract_id", "left").join(people, "contract_id", "left")
    return joined.select("contract_id", "full_contract_text", F.coalesce("labels", F.array().cast(none)).alias("labels"), F.coalesce("participants", F.create_map().cast(f"map<string,{none}>")).alias("participants"))


def chosen_file(files: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first file of each contract and participant by priority."""
    w = Window.partitionBy(*by).orderBy(*order)
    return files.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def comment_notes(comments: DataFrame, *, by: str = "contract_id", anchor: str = "anchor", text: str = "text", order: str = "comment_id") -> DataFrame:
    """by, number and note: comments whose anchor begins with a risk's number, joined by " | " in order."""
    rows = comments.withColumn("number", F.regexp_extract(anchor, r"^\s*(\d+)\s*[.、)）]", 1).try_cast("int")).where("number IS NOT NULL")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(by, "number").agg(F.array_join(parts, " | ").alias("note"))


def side_by_side(placed: DataFrame, participants: list[str]) -> DataFrame:
    """contract_id, clause_id and a column of titles for each participant, joined by "; ": what each found in a clause."""
    rows = placed.groupBy("contract_id", "clause_id").pivot("origin", participants).agg(F.array_join(F.array_sort(F.collect_list("title")), "; "))
    return rows.select("contract_id", "clause_id", *(F.coalesce(F.col(f"`{p}`"), F.lit("")).alias(p) for p in participants))


def annotated(lines: DataFrame, notes: DataFrame, *, by: str = "contract_id", order: str = "line_no", text: str = "text") -> DataFrame:
    """lines with the notes (by, quoted, note) whose quoted text they hold put behind them as "[note: ...]", each at its first line."""
    a, b = for_match(text), for_match("quoted")
    hits = lines.select(by, order, text).join(notes, by).where(F.contains(a, b) & (F.length(b) > 0))
    first = hits.groupBy(by, "quoted", "note").agg(F.min(order).alias(order))
    joined = first.groupBy(by, order).agg(F.array_join(F.transform(F.array_sort(F.collect_set("note")), lambda n: F.concat(F.lit(" [note: "), n, F.lit("]"))), "").alias("__notes"))
    return lines.join(joined, [by, order], "left").withColumn(text, F.concat(text, F.coalesce("__notes", F.lit("")))).drop("__notes")
