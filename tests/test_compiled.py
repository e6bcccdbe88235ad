"""Compiled templates: what they say, and what they refuse; spans of unsure tokens by their definition."""

import random
import re

import pytest

from docloom.functions import jinja
from docloom.operators import flare

SCHEMA = "name string, n long, x double, tags array<string>, ok boolean, who struct<first:string,_secret:string>, items array<struct<a:int,b:string>>"
ROWS = [("Ann", 3, 1.5, ["a", "b"], True, ("F", "s"), [(1, "x"), (2, None)]), (None, 0, None, [], False, None, None)]


@pytest.mark.parametrize("text,want", [
    ("Hi {{ name }}!", ["Hi Ann!", "Hi !"]),
    ("{{ name | default('nobody') | upper }}", ["ANN", "NOBODY"]),
    ("{% if n > 2 and ok %}many{% elif n %}some{% else %}none{% endif %}", ["many", "none"]),
    ("{% if not tags or 'z' in tags %}-{% else %}{{ tags | join(', ') }}{% endif %}", ["a, b", "-"]),
    ("{% for i in items -%}  {{ loop.index }}{{ i.a }}{{ i.b }}{% if not loop.last %},{% endif %}{%- endfor %}", ["11x,22", ""]),
    ("{% for t in tags %}{% for u in tags %}{{ t ~ u }} {% endfor %}{% else %}empty{% endfor %}", ["aa ab ba bb ", "empty"]),
    ("{{ who.first }}{# gone #}{{ (n + 1) * 2 }} {{ ok }} {{ x | round(0) }} {{ tags | first }}{{ tags | length }}", ["F8 True 2.0 a2", "2 False  0"]),
    ("{{ 'it\\'s' | replace('i', 'I') | capitalize }} {{ -n }} {{ 7 % 4 }}", ["It's -3 3", "It's 0 3"]),
])
def test_templates(spark, text, want):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], f"i int, {SCHEMA}")
    assert [r["prompt"] for r in jinja.rendered(df, text).orderBy("i").collect()] == want


@pytest.mark.parametrize("text", ["{{ unknown }}", "{{ who._secret }}", "{{ _x }}", "{{ name.upper() }}", "{{ name.__class__ }}", "{{ tags[0] }}", "{{ n() }}", "{{ who.none }}", "{% import os %}", "{% set a = 1 %}", "{% for i in n %}{% endfor %}",
                                  "{% if ok %}", "{{ name | safe }}", "{{ name", "{{ n + }}", "{% endif %}", "{% for _ in tags %}{% endfor %}", "{{ a b }}", "{{ n | round(1 }}"])
def test_refused(spark, text):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError):
        jinja.rendered(df, text)


def test_unsure_spans(spark):
    r = random.Random(4)
    rows = [(q, i, r.choice([" the", ".", "é", "!", " 7"]), r.choice([0.05, 0.9, 0.9, 0.5])) for q in range(30) for i in range(r.randrange(40))]
    want = []
    for q in range(30):
        tokens = [x for x in rows if x[0] == q]
        low = [i for _, i, t, p in tokens if p < 0.2 and re.search(r"\w", t)]
        spans = []
        for a, b in zip([None, *low], low, strict=False):
            if a is not None and b - a < 4:
                spans[-1][1] = b + 3
            else:
                spans.append([b, b + 3])
        want += [(q, n, "".join(t for _, i, t, _ in tokens[a:b])) for n, (a, b) in enumerate(spans, 1)]
    df = spark.createDataFrame(rows, "query_id long, pos int, token string, prob double")
    assert sorted((x["query_id"], x["span_no"], x["span"]) for x in flare.unsure_spans(df, gap=4).collect()) == sorted(want)
