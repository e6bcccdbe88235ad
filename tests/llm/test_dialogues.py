import hashlib
import heapq
import random
import zlib

import pytest

from docloom.llm import dialogues as D

WHITE = " \t\n\x0b\f\r"


def damaged(turns):
    out = {}
    for conv, turn, role, text in turns:
        rows = out.setdefault(conv, [])
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0], x[1].encode(), x[2].encode())) for c, r in out.items()}


def cheapest(rows):
    """Least cost, then least audit, by search over all edits: (cost, audit, lines)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, roles, lines = heapq.heappop(queue)
        tail = roles[-1:]
        state = (at, {"": 0, "s": 1, "u": 2, "a": 3}[tail])
        if state in done and not (at == len(rows)):
            continue
        if at == len(rows) and tail in ("", "a"):
            return cost, audit, lines
        done.add(state)
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
        for name in ("user", "assistant"):
            if name[0] in follow:
                heapq.heappush(queue, (cost + 3, audit + "I", at, roles + name[0], (*lines, name + ":")))
        if at < len(rows):
            (_, role, text), fault = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in follow:
                    heapq.heappush(queue, (cost + extra, audit + "K", at + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if name[0] in follow:
                        heapq.heappush(queue, (cost + 3 + extra, audit + "R", at + 1, roles + name[0], (*lines, f"{name}:{text}")))
    raise AssertionError


def brute(turns):
    out = []
    for conv, rows in damaged(turns).items():
        seen, faults = set(), []
        for _, role, text in rows:
            rest = text.rstrip(WHITE)
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None)
            seen.add((role, text))
        turn = [t for t, _, _ in rows if t is not None]
        gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest(list(zip(rows, faults, strict=True)))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def make(seed, n=120, longest=12):
    r = random.Random(seed)
    turns = []
    for conv in [*range(n), None]:
        last = ""
        for turn in range(r.randrange(1, longest)):
            if r.random() < 0.1:
                continue
            role = r.choice(["user", "assistant", "user" if turn % 2 == 0 else "assistant", r.choice(["system", "tool", "", None, "aide", "User"]) if r.random() < 0.4 else "user"])
            text = r.choice([last, f"Hello {turn}.", f"Open end {turn}", "Same. \t", " \n", None, "É日!", f"x{r.randrange(3)}?"])
            last = text
            turns.append((conv, r.choice([turn, turn, turn, None, turn - 1]), role, text))
    return [*turns, (7000, 1, "user", "x")]


@pytest.mark.parametrize("long,seed", [(D.LONG, 1), (4, 2)])
def test_equals_search(spark, long, seed):
    turns = make(seed)
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, block int, edit string").repartition(3)
    got = D.audited(df, long=long).collect()
    assert sorted(map(tuple, got), key=repr) == brute(turns)


def test_one_long_conversation_lies_in_many_tasks(spark):
    r = random.Random(3)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), r.choice([f"A {t}.", f"B {t}", "Same."])) for t in range(4000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = (D.repair(df, long=n) for n in (10_000, 100))
    assert many.where("conv = 1").select("block").distinct().count() > 4
    line = lambda x: sorted(map(tuple, D.summaries(x).collect()))
    assert line(one) == line(many)
    assert line(one)[1][1:8] == (0, 0, 0, 0, 0, 0, "KK")


def test_edits_name_what_they_do(spark):
    rows = [("c", 1, "assistant", "Late."), ("c", 2, "user", "Why"), ("c", 3, "user", " "), ("c", None, "system", "S.")]
    got = D.repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).orderBy("place").collect()
    assert [(x["edit"], x["turn"], x["was"], x["role"], x["text"], x["fault"], x["cost"]) for x in got] == [
        ("K", None, "system", "system", "S.", None, 0), ("I", None, None, "user", "", None, 3), ("K", 1, "assistant", "assistant", "Late.", None, 0),
        ("D", 2, "user", None, None, "truncated", 4), ("D", 3, "user", None, None, "blank", 4)]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert D.audited(empty).collect() == [] and D.repair(empty).collect() == []
