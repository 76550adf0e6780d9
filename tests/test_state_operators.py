"""Recurrences: segmented walks against whole ones, streams with state and timers, restarts."""

import random

import pytest

from factloom.operators import progress
from factloom.streaming import jobs
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_maps_equal_walks(seed):
    rng = random.Random(seed)
    for _ in range(150):
        threshold, cooldown = rng.randint(1, 3), rng.randint(1, 9)
        now = 0
        calls = []
        for _ in range(rng.randint(0, 40)):
            now += rng.choice([0, 0, 1, 1, 2, 9])
            calls.append((now, rng.choice(["success", "failure", "failure", "config_error", None])))
        m = progress._CircuitMap(threshold, cooldown)
        for state in [*(("closed", f) for f in range(threshold)), *(("open", t) for t in range(-12, 3))]:
            cut = rng.randint(0, len(calls))
            want = state
            for call in calls:
                want = progress.circuit_step(threshold, cooldown, want, *call)[0]
            got = state
            for part in (calls[:cut], calls[cut:]):
                got = m.apply(m.summarize(part), got)
            assert got == want
        ratio = rng.choice([0.5, 0.1, 0.999, 1.0, 2.0])
        gate = progress._GateMap(ratio)
        values = [(rng.choice([0.0, -1.0, 1.0, 2.0, 3.0, 1e9, -7.5, None, rng.uniform(-5, 50)]), rng.random() < 0.9) for _ in range(rng.randint(0, 40))]
        for last in (None, 0.0, 1.0, 1.5, 2.0, -1.0, 6.0, rng.uniform(-5, 50)):
            want = last
            for v in values:
                want = progress.gate_step(ratio, want, *v)[0]
            assert gate.apply(gate.summarize(values), last) == want


def test_gate_maps_stay_small():
    rng = random.Random(4)
    kept = progress._GateMap(0.5).summarize([(rng.uniform(1, 1000), True) for _ in range(3000)])
    assert len(kept) < 60


def test_one_key_with_all_rows_is_split_and_equals_the_walk(spark):
    rng = random.Random(8)
    data = [(None if k % 5 == 0 else 1, k // 7, k, rng.choice(["success", "failure", "failure", None]), rng.uniform(0, 100), rng.choice([True, True, False, None])) for k in range(3000)]
    df = spark.createDataFrame(data, "k int, day int, n int, r string, v double, g boolean").withColumn("t", F.timestamp_seconds(F.col("n") * 600))
    whole = progress.circuit_states(df, "k", "t", "n", "r", 3, 5400)
    split = progress.circuit_states(df, "k", "t", "n", "r", 3, 5400, F.col("day"))
    assert rows(split, "n", "circuit", "allowed") == rows(whole, "n", "circuit", "allowed")
    whole = progress.released_values(df, "k", ["n"], "v", "g")
    split = progress.released_values(df, "k", ["n"], "v", "g", bucket=F.when(F.col("day") > 3, F.col("day")))
    assert rows(split, "n", "gate_decision", "released_value") == rows(whole, "n", "gate_decision", "released_value")
    assert progress.released_values(df.limit(0), "k", ["n"], "v", "g", bucket=F.col("day")).count() == 0


def files(spark, folder, df, column):
    for n, x in enumerate(r[0] for r in df.select(column).distinct().orderBy(column).collect()):
        df.where(F.col(column) == x).drop(column).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
        yield f"{folder}/{n}"


def test_gate_goes_on_after_a_restart(spark, tmp_path):
    data = [("a", 1, 10.0, True, 0), ("b", 1, 5.0, True, 0), ("a", 2, 40.0, True, 0), (None, 1, 3.0, True, 0), ("a", 3, 12.0, True, 1), ("b", 2, 6.0, False, 1), ("b", 3, 7.0, None, 1), (None, 2, None, True, 1), ("a", 4, 13.0, True, 2), ("b", 4, 7.0, True, 2)]
    df = spark.createDataFrame(data, "k string, n int, v double, g boolean, batch int")
    paths = list(files(spark, tmp_path / "all", df, "batch"))
    schema = df.drop("batch").schema
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return jobs.gated_releases(stream, "k", ["n"], "v", "g", path=f"file://{tmp_path}/gate")

    want = rows(progress.released_values(df, "k", ["n"], "v", "g"), "k", "n", "gate_decision", "released_value")
    for n, path in enumerate(paths):  # each turn starts a new query on the same path
        for m, part in enumerate(sorted(__import__("pathlib").Path(path).glob("part-*"))):
            part.rename(folder / f"f{n}-{m}.parquet")
        out = rows(run(), "k", "n", "gate_decision", "released_value")
        seen = {tuple(r[:2]) for r in out}
        assert out == [r for r in want if r[:2] in seen]
    assert out == want
    assert spark.conf.get(jobs._STORE[0], "") != jobs._STORE[1]


def test_timers_turn_facts_stale(spark, tmp_path):
    data = [("a", 0, 0), ("b", 50, 0), ("a", 90, 1), (None, 95, 1), ("b", 140, 2), ("c", 205, 3), ("c", None, 3)]
    df = spark.createDataFrame(data, "k string, s int, batch int").withColumn("at", F.timestamp_seconds("s")).drop("s")
    folder = tmp_path / "in"
    folder.mkdir()
    for n, path in enumerate(files(spark, tmp_path / "all", df, "batch")):
        for m, part in enumerate(sorted(__import__("pathlib").Path(path).glob("part-*"))):
            part.rename(folder / f"f{n}-{m}.parquet")
    stream = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = jobs.expiries(stream, ["k"], "at", 100, delay="100 seconds")
    got = {(r["k"], int(r["deadline"].timestamp())) for r in out.collect()}
    # By 205 s less the delay nothing is overdue yet.
    assert got == set()
    stream = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = jobs.expiries(stream, ["k"], "at", 100)
    got = {(r["k"], r["deadline"].timestamp()) for r in out.collect()}
    assert got == {("a", 190.0), (None, 195.0)}
