"""The record log: one writer of two on a version tries again, and nothing is lost."""

import threading

import pytest

from docloom.sources import record_log
from docloom.sources.record_log import Records

KEYS = "key string, group_id string"


def keys(spark, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r, None) for r in rows], KEYS)


def known(records, **bounds):
    return sorted(r["key"] for r in records.list_keys(**bounds).collect())


def test_update_list_exists_delete(spark, tmp_path):
    times = iter([100.0, 200.0, 150.0, 300.0, 10.0])
    r = Records(spark, str(tmp_path), "a/b ns", clock=lambda: next(times))
    assert r.version() == 0 and known(r) == []
    assert r.update(keys(spark, ("k1", "g1"), ("k2", "g2"), ("k1", "g0"), (None, "g"))) == 1
    assert r.update(keys(spark, ("k2", "g3"), ("k3", "g3"))) == 2
    assert known(r, after=150) == ["k2", "k3"] and known(r, before=150) == ["k1"] and known(r, group_ids=["g3"]) == ["k2", "k3"] and len(known(r, limit=1)) == 1
    r.update(keys(spark, "k4"))  # the clock went back: the change is as late as the one before
    assert {x["key"]: x["updated_at"] for x in r.state().collect()} == {"k1": 100, "k2": 200, "k3": 200, "k4": 200}
    r.delete(keys(spark, "k2", "unknown").select("key"))
    assert {x["key"]: x["found"] for x in r.exists(keys(spark, "k1", "k2", "k9").select("key")).collect()} == {"k1": True, "k2": False, "k9": False}
    assert sorted(x["key"] for x in r.state(2).collect()) == ["k1", "k2", "k3"]  # a version stays as it was
    with pytest.raises(ValueError, match="clock"):
        r.update(keys(spark, "k5"), at_least=20.0)
    assert known(Records(spark, str(tmp_path), "other")) == []


def test_the_later_of_two_writers_tries_again(spark, tmp_path):
    one, two = (Records(spark, str(tmp_path), "ns") for _ in range(2))
    asked = []

    def make(state, now):
        asked.append(sorted(x["key"] for x in state.collect()))
        if len(asked) == 1:
            two.update(keys(spark, "theirs"))  # while this change is under way
        return keys(spark, "mine"), None

    assert one.commit(make) == 2 and asked == [[], ["theirs"]]
    assert known(one) == ["mine", "theirs"] and one.manifest(1)["parts"] == one.manifest(2)["parts"][:1]
    with pytest.raises(TimeoutError):
        Records(spark, str(tmp_path), "ns", retries=0).commit(lambda state, now: (two.update(keys(spark, "x")), (keys(spark, "y"), None))[1])
    assert known(one) == ["mine", "theirs", "x"]


def test_many_writers_and_a_new_state_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(record_log, "COMPACT", 3)
    errors = []

    def write(i):
        try:
            mine = Records(spark, str(tmp_path), "ns", retries=100)
            for j in range(3):
                mine.update(keys(spark, f"k{i}-{j}"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    r = Records(spark, str(tmp_path), "ns")
    assert not errors and r.version() == 9 and known(r) == sorted(f"k{i}-{j}" for i in range(3) for j in range(3)) and len(r.manifest()["parts"]) <= 3


def test_cleanup_spares_what_another_has_just_updated(spark, tmp_path):
    r, other = (Records(spark, str(tmp_path), "ns") for _ in range(2))
    docs = lambda *rows: spark.createDataFrame(list(rows), "key string, source string, text string")
    store = {}

    def apply(write, delete):
        store.update({x["key"]: x["text"] for x in write.collect()})
        for x in delete.collect():
            store.pop(x["key"], None)

    assert r.index(docs(("a", "s", "1"), ("b", "s", "2"), ("c", "t", "3")), apply, source="source")["num_added"] == 3
    done = []

    def slow(write, delete):
        if not done:
            done.append(1)
            other.delete(spark.createDataFrame([("a",)], "key string"))
        apply(write, delete)

    counts = r.index(docs(("a", "s", "1"), ("d", "s", "4")), slow, source="source", cleanup="incremental")
    assert counts == {"num_added": 2, "num_updated": 0, "num_skipped": 0, "num_deleted": 1}  # asked again: "a" was gone by then
    assert known(r) == ["a", "c", "d"] and store == {"a": "1", "c": "3", "d": "4"}
    assert r.index(docs(("a", "s", "1")), apply, source="source", cleanup="full")["num_deleted"] == 2 and known(r) == ["a"]
