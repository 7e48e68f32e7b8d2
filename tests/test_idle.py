"""State that leaves by itself: decisions as with state kept for ever, idle keys gone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.streaming import idle

SCHEMA = "who string, t double, ord long, cooldown double"


def run(spark, folder, batches, of):
    """Each batch is a file of its own; files are taken one by one in order of their names."""
    for i, rows in enumerate(batches):
        where = folder / "new" / f"{i:03d}"
        (spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows).coalesce(1).write.parquet(f"file://{where}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/new/*")
    out = of(stream)
    with idle.keyed_state(spark):
        q = out.writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/log").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"file://{folder}/out")


def forever(rows, rule):
    """The rule a row at a time, with state that never leaves."""
    state, out = {}, []
    for who, t, _, cooldown in sorted(rows, key=lambda r: (r[1], r[2])):
        kept = state.get(who, [])
        if rule == "due":
            ok = not kept or t - kept[0] >= 10.0
            kept = [t] if ok else kept
        elif rule == "throttled":
            kept = [x for x in kept if t - x <= 30.0]
            ok = len(kept) < 3
            kept = [*kept, t] if ok else kept
        else:
            ok = not kept or t >= kept[0]
            kept = kept if cooldown is None else [t + min(20.0, cooldown)]
        state[who] = kept
        out.append((who, t, ok))
    return sorted(out, key=str)


@pytest.mark.parametrize("rule", ["due", "throttled", "cooled"])
def test_decisions_are_those_of_state_that_stays(spark, tmp_path, rule):
    rng = np.random.default_rng(3)
    at = np.sort(np.round(rng.uniform(1000, 1400, 900) * 4) / 4)  # ties
    who = [None if x == 0 else f"k{x}" for x in rng.integers(0, 9, 900)]
    rows = [(w, float(t), i, float(rng.integers(0, 40)) if rng.random() < 0.2 else None) for i, (w, t) in enumerate(zip(who, at, strict=True))]
    batches = [rows[i : i + 180] for i in range(0, 900, 180)]
    of = {"due": lambda s: idle.due(s, "who", 10.0, "1 second"), "throttled": lambda s: idle.throttled(s, "who", 3, 30.0, "1 second"), "cooled": lambda s: idle.cooled(s, "who", 20.0, "1 second")}[rule]
    got = sorted([tuple(r) for r in run(spark, tmp_path, batches, of).collect()], key=str)
    assert got == forever(rows, rule)


def test_idle_keys_leave_and_come_back(spark, tmp_path):
    batches = [[("a", 100.0, 1, None), ("b", 101.0, 2, None)], [("b", 300.0, 3, None)], [("b", 500.0, 4, None), ("c", None, 5, None)], [("a", 900.0, 6, None)]]
    rows = [tuple(r) for r in run(spark, tmp_path, batches, lambda s: idle.due(s, "who", 10.0, "1 second", tell_idle=True)).collect()]
    assert sorted(rows, key=lambda r: (r[0], r[1])) == [("a", 100.0, True), ("a", 110.0, None), ("a", 900.0, True), ("b", 101.0, True), ("b", 300.0, True), ("b", 500.0, True), ("b", 510.0, None)]


def test_a_hot_key_with_a_million_rows_in_one_batch(spark, tmp_path):
    hot = spark.range(1_000_000).selectExpr("if(id % 1000 = 7, 'cold', 'hot') who", "1000 + id / 100.0D t", "id ord", "cast(null as double) cooldown")
    found = run(spark, tmp_path, [hot], lambda s: idle.due(s, "who", 100.0))
    got = {r.key: (r.n, r.ok) for r in found.groupBy("key").agg(F.count("*").alias("n"), F.max("accepted").alias("ok")).collect()}
    assert got == {"hot": (999_000, True), "cold": (1000, True)}
    assert found.where("accepted and key = 'hot'").count() == 100


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_throttle_by_jumps(limit):
    t = np.sort(np.random.default_rng(limit).integers(0, 200, 300).astype(float))
    ok, kept = idle.Throttled(limit, 9.0).decide([], t, None)
    held, want = [], []
    for x in t:
        held = [h for h in held if x - h <= 9.0]
        want.append(len(held) < limit)
        held += [x] * want[-1]
    assert ok.tolist() == want and len(kept) <= max(limit, 0)
