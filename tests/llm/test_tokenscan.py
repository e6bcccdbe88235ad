import random

import numpy as np

from docloom.llm import tokenscan as T
from docloom.llm.tokens import Encoder, default_vocabulary


def test_any_block_size_matches_brute_force(spark, tmp_path):
    r = random.Random(1)
    want = []
    for name in ("a", "b", "empty", "open", "one"):
        ids = [] if name == "empty" else [r.choice([9, 9, 3]) for _ in range(200)]
        ids = [3] * 40 if name == "open" else [9] if name == "one" else ids
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u4").tobytes() + (b"\1" if name == "b" else b""))
        start = doc = 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((name, doc, start, i - start, True))
                start, doc = i + 1, doc + 1
        if start < len(ids):
            want.append((name, doc, start, len(ids) - start, False))
    for block in (1, 7, 64, 1000):
        got = T.documents(spark, f"file://{tmp_path}", end=9, block=block, width=4).collect()
        assert sorted((x["path"].rsplit("/", 1)[1][:-4], *tuple(x)[1:]) for x in got) == sorted(want)


def test_counts_of_a_table(spark):
    texts = ["one two", "", None, "x " * 5000, "<|endoftext|>", "é\n\n"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, path int").coalesce(1)
    got = sorted(map(tuple, T.scan_table(df).collect()))
    encoder, at = Encoder(default_vocabulary()), 0
    encoder.special = ()
    for i, t in enumerate(texts):
        n = len(encoder.encode(t)) // 4
        assert got[i] == (0, i, at, n, True)
        at += n + 1
    assert T.scan_table(df.limit(0)).collect() == []
