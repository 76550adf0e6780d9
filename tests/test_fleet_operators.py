"""Fleet operators on rows with nulls, repeats and unknown ids."""

from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import fleet


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_roll_backs(spark):
    log = spark.createDataFrame([("s", "r1", "active", 1, 1), ("s", "r1", "superseded", 2, 1), ("s", "r2", "active", 3, 1), ("t", "r3", "active", 1, 1), ("s", "r4", "draft", 1, 1)], "spec string, revision string, to_status string, at int, tie int")
    asks = [("a", "r2", "r1", 9), ("a", "r2", "r1", 9), ("b", "r2", "r3", 9), ("c", "r1", "r2", 9), ("d", "r2", "r4", 9), ("e", "r2", None, 9), ("f", "r9", "r1", 9)]
    requests = spark.createDataFrame(asks, "operation_key string, active_revision string, restore_revision string, at int")
    approvals = spark.createDataFrame([("r1", "rejected", 1, 1), ("r1", "approved", 2, 1), ("r4", "approved", 1, 1), ("r4", "rejected", 2, 1)], "revision string, decision string, at int, tie int")
    done, refused = fleet.roll_back(log, requests, approvals)
    assert rows(done, "spec", "revision", "from_status", "to_status", "operation_key") == [("s", "r1", "superseded", "active", "a:restored"), ("s", "r2", "active", "rolled_back", "a:rolled-back")]
    assert rows(refused, "operation_key", "why") == [("b", "other_spec"), ("c", "not_active"), ("d", "not_approved"), ("e", "unknown_revision"), ("f", "unknown_revision")]


def test_replays(spark):
    deliveries = spark.createDataFrame([(1, 7, "e1", "dead_letter", "k1"), (2, 7, "e2", "delivered", "k2"), (3, 8, "e3", "dead_letter", "7:e1:replay:old"), (4, 8, "e4", None, None)], "delivery_id int, subscription_id int, event_id string, status string, delivery_key string")
    requests = spark.createDataFrame([("o1", 1, "new"), ("o2", 1, "new"), ("o3", 1, "old"), ("o4", 2, "new"), ("o5", 9, "new"), ("o6", 4, "new"), ("o7", None, "new"), ("o1", 1, "new")], "operation_key string, delivery_id int, batch_key string")
    got = {r["operation_key"]: (r["replay_key"], r["state"]) for r in fleet.replays(requests, deliveries).collect()}
    assert got == {"o1": ("7:e1:replay:new", "queued"), "o2": ("7:e1:replay:new", "duplicate"), "o3": ("7:e1:replay:old", "duplicate"), "o4": (None, "not_dead"), "o5": (None, "unknown"), "o6": (None, "not_dead"), "o7": (None, "unknown")}


def test_signatures(spark):
    key = b"0123456789abcdef"
    df = spark.createDataFrame([("p",)], "p string").withColumn("h", C.hmac_sha256(key, F.lit("100.p")))
    state = lambda header, now=100, payload="p": df.select(C.webhook_state(F.lit(payload).cast("string"), header, key, F.lit(now))).first()[0]
    good = F.concat(F.lit("t=100,v1="), "h")
    assert [state(good), state(good, 400), state(good, 401), state(good, -200), state(good, payload="q"), state(good, payload=None)] == ["verified", "verified", "expired", "verified", "mismatch", "malformed"]
    assert [state(F.lit(x).cast("string")) for x in ("t=100", "v1=ab", "t=x,v1=ab", "t=100,v1=ab", "", None)] == ["malformed", "malformed", "malformed", "mismatch", "malformed", "malformed"]


def test_outcomes_stages_and_catalog_with_nulls(spark):
    log = spark.createDataFrame([("a", 1, True, 3), ("a", 2, True, None), ("a", 3, None, None), ("b", 1, False, 2)], "k string, n int, bad boolean, attempt int").withColumn("at", F.timestamp_seconds("n"))
    out = fleet.outcome_schedule(log, "k", ["n"], F.col("bad"), "at", "attempt", 2, 1000, 4000, 5000, 700)
    due = [(r["k"], r["n"], r["health_state"], round(r["next_due"].timestamp() - r["n"], 3)) for r in out.orderBy("k", "n").collect()]
    assert due == [("a", 1, "cooling", 4.0), ("a", 2, "failing", 5.0), ("a", 3, "healthy", 1.0), ("b", 1, "healthy", round(1 + (2 * 2654435761 % 700) / 1000, 3))]
    empty = spark.createDataFrame([(None,) * 15], ", ".join(f"{c} int" for c in "total_cases passed_cases critical_failures false_events maximum_critical_failures maximum_false_events minimum_pass_rate".split()) + ", " + ", ".join(f"{c} boolean" for c in "extraction_ok events_ok identity_stable schema_compatible mapping_compatible require_identity_stable require_held_out_pass".split()) + ", stage string")
    assert not fleet.stage_passes(empty, "stage", "held_out").first()["passes"]
    sources = spark.createDataFrame([(1, "active", "public"), (2, "active", None), (3, "gone", "public"), (None, "active", "public")], "source_id int, lifecycle string, visibility string")
    endpoints = spark.createDataFrame([(10, 1, True), (11, 1, None), (12, 2, True), (13, None, True)], "endpoint_id int, source_id int, public boolean")
    collectors = spark.createDataFrame([(5,)], "collector_id int")
    links = spark.createDataFrame([(1, 5, 1, 10), (2, 6, 1, 10), (3, 5, None, None), (4, 5, 1, 11), (5, 5, 2, 10), (6, 5, 1, None)], "id int, collector_id int, source_id int, endpoint_id int")
    seen, listed = fleet.catalog(sources, endpoints, collectors, links, links)
    assert rows(seen.where("kind = 'binding'"), "id", "why") == [("1", None), ("2", "unknown_collector"), ("3", None), ("4", "endpoint_not_shown"), ("5", "source_not_shown"), ("6", "endpoint_not_shown")]
    assert rows(seen.where("kind = 'certification'"), "id", "why")[2] == ("3", "source_not_shown")
    assert rows(seen.where("kind = 'endpoint'"), "id", "why") == [("10", None), ("11", "not_public"), ("12", "source_not_shown"), ("13", "source_not_shown")]
    assert rows(listed.where("source_id = 1"), "n_endpoints", "n_certifications", "n_bindings") == [(1, 1, 1)]
