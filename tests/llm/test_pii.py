import hashlib
import random
import re
import time

import pytest

from docloom.llm import pii
from docloom.llm import queries as Q

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    spans = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if good(k, m[0]))
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    return (*(sum(s[2] == k for s in spans) for k in BASE), hashlib.sha256(joined.encode()).hexdigest())


def texts():
    r = random.Random(4)
    bits = ["a@b.co", "_x@y.com", "@", ".", "..", "a.b@c", "1.2.3.4", "255.255.255.256", "0001.0.0.00255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "+1 (212) 555-0100", "+49 30 1234567", "+1+2", "12", "-", " ", "é", "x", "9", "4845168114407329", "😀", "\n", "+", "(", "a%b+c@d-e.f-g.h"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(400)]
    return [*out, None, "", "a" * 100_000, "1" * 100_000, "1.2" * 20_000, "a@b" + ".c" * 20_000, "+" + "1 " * 20_000, "1 " * 50_000, "ab@" * 20_000, "1.1.1.1 " * 800, "é a@b.co +49 30 1234567\n" * 5000]


def test_base_spans_match_brute_force(spark):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, spans string")
    got = {r[0]: tuple(r)[1:6] for r in Q.personal_data(df).collect()}
    for i, t in docs:
        assert got[i] == brute(t), t[:300]


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("pay to DE89370400440532013000 now", "iban:7:29"),
        ("pay to GB29 NWBK 6016 1331 9268 19.", "iban:7:34"),
        ("pay to DE88370400440532013000 now", ""),
        ('my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret:12:52"),
        ("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", ""),
    ],
)
def test_added_kinds(spark, text, spans):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert Q.personal_data(df).first()["spans"] == spans


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!", "k"), (2, None, "k"), (3, "clean", "k"), (4, "", "k")], "doc_id long, text string, __x string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert {r[0]: r[1] for r in got.collect()} == {1: "é [EMAIL], [IP]!", 2: None, 3: "clean", 4: ""}


def test_context_scores(spark):
    df = spark.createDataFrame([("server address 10.0.0.1",), ("version 10.0.0.1",), ("so 10.0.0.1",)], "text string")
    assert [round(r["spans"][0]["score"], 2) for r in pii.with_spans(df).collect()] == [0.9, 0.3, 0.6]


def test_upper_case_secrets(spark):
    df = spark.createDataFrame([(1, 'my TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"')], "doc_id long, text string")
    assert Q.personal_data(df).first()["spans"] == "secret:12:52"
    assert pii.redact(df).first()["text"] == 'my TOKEN = "[SECRET]"'


def test_a_hundred_thousand_matches_in_one_text(spark):
    text = "".join(f"é u{i}@b.co 1.2.3.{i % 300}\n" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert tuple(Q.personal_data(df).first())[1:6] == brute(text)
    want = re.sub(r"1\.2\.3\.(\d+)", lambda m: "[IP]" if int(m[1]) < 256 else m[0], re.sub(r"u\d+@b\.co", "[EMAIL]", text))
    assert pii.redact(df).first()["text"] == want
    assert time.time() - began < 60


def test_overlapping_spans_are_redacted_as_one(spark):
    text = "x 4111111111111111@b.co y " + "z" * 2500 + " 1.2.3.4.5 a@1.2.3.4 end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(df).first()["text"] == "x [EMAIL] y " + "z" * 2500 + " [IP].5 [EMAIL] end"
