"""Many patterns at once against plain containment."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import metrics, patterns


def test_occurrences(spark, monkeypatch):
    rng = np.random.default_rng(7)
    say = lambda n: "".join("abñ ."[x] for x in rng.integers(0, 5, n))
    texts = [(i, say(40), "clash") for i in range(30)] + [(1, None, ""), (2, "", ""), (2, "", ""), (3, "x" * 300_000 + "needle", "")]
    asked = sorted({say(int(n)) for n in rng.integers(1, 6, 200)} | {"needle", "nowhere"})
    df = spark.createDataFrame(texts, "id int, t string, p string")
    want = lambda ps: sorted((i, c, p) for i, t, c in texts if t is not None for p in ps if p in t)
    found = lambda ps: sorted((r.id, r.p, r.pattern) for r in patterns.occurrences(df, F.col("t"), spark.createDataFrame([(p,) for p in [*ps, *ps, None]], "w string")).collect())
    assert found(asked) == want(asked)
    monkeypatch.setattr(patterns, "PART_BYTES", 64)  # several automata
    assert found(asked) == want(asked) and found([*asked, ""]) == want([*asked, ""])
    assert found([]) == []


def test_group_hits_gather_nothing(spark):
    expected = spark.createDataFrame([(1, [["A", "b"], ["zz"]]), (2, [["c"]]), (3, [])], "id int, expected array<array<string>>")
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 3, "a b"), (1, 2, "bb"), (4, 1, "c")], "id int, rank int, hay string")
    found = metrics.group_hits(expected, ranked)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2), (1, 1, None), (2, 0, None)]
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
