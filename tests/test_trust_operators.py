"""Operators and column helpers on small hand-made rows: ties, nulls, empty tables, round trips with plain Python."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F, types as T

from factloom.functions import columns as C
from factloom.operators import facts, governance, health, identity, provenance, quality, reconcile
from factloom.sources import ingest
from factloom.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


ENTITY = "entity_id long, provider string, model_id string, external_ids array<string>, name string, family string, version string, aliases array<string>"
INPUT = "provider string, model_id string, external_ids array<string>, key string, name string, family string, version string"


def test_identity_decisions(spark):
    entities = spark.createDataFrame(
        [(1, "a", "m1", ["x"], "One", "f", "2024", ["one"]), (2, "a", "m2", [], "Two", "f", "2025", None), (3, "b", "m3", [], "Same", "g", None, []), (4, "b", "m4", [], "Same", "g", None, [])], ENTITY
    )
    inputs = spark.createDataFrame(
        [
            ("a", "m1", None, "k", "One", "f", "2024"),
            ("a", "m1", None, "k", "One", "f", "2030"),
            ("b", None, None, "k", "Same", "g", None),
            ("z", "m1", None, "k", "One", "f", "2024"),
            ("a", "m1", None, "k", "One", "f", "2024"),
        ],
        INPUT,
    )
    got = rows(identity.resolve(inputs, entities), "provider", "version", "score", "entity_id", "decision")
    assert got == sorted(
        [("a", "2024", 130, 1, "auto_link"), ("a", "2030", 55, None, "rejected"), ("b", None, 75, None, "needs_review"), ("z", "2024", -10, None, "create_new")], key=repr
    )
    assert identity.resolve(inputs.limit(0), entities).count() == 0
    assert {r["decision"] for r in identity.resolve(inputs, entities.limit(0)).collect()} == {"create_new"}


def test_survivors(spark):
    merges = spark.createDataFrame([(i, i + 1) for i in range(1, 90)] + [(200, 201), (201, 202), (202, 201), (300, 300), (None, 1), (5, None)], "entity_id long, merged_into long")
    want = [(i, 90, False) for i in range(1, 90)] + [(i, None, True) for i in (200, 201, 202, 300)]
    assert rows(identity.survivors(merges), "entity_id", "survivor_id", "on_cycle") == sorted(want, key=repr)
    assert identity.survivors(merges.limit(0)).count() == 0


def test_evidence_paths_take_the_smallest(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "t"), ("c", "t"), ("t", "a"), ("t", "u"), ("a", "b"), (None, "t")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("t",), ("lone",)], "root string")
    targets = spark.createDataFrame([("t", "run"), ("u", "source")], "node string, kind string")
    found = provenance.evidence_paths(edges, roots, targets)
    assert rows(found, "root", "kind", "depth", F.array_join("path", ">")) == sorted(
        [("a", "run", 2, "a>b>t"), ("a", "source", 3, "a>b>t>u"), ("t", "run", 0, "t"), ("t", "source", 1, "t>u")], key=repr
    )
    assert rows(provenance.uncovered(roots, found, ["run"]), "root") == [("lone",)]
    near = provenance.neighbourhood(edges, spark.createDataFrame([("u",)], "root string"), 2)
    assert rows(near, "node", "depth") == [("a", 2), ("b", 2), ("c", 2), ("t", 1), ("u", 0)]


def test_ingest_states(spark):
    new = spark.createDataFrame([(1, "k1", "p"), (2, "k1", "p"), (3, "k1", "q"), (4, "k2", "p"), (5, "k2", "z"), (6, None, "p")], "n long, k string, v string")
    stored = spark.createDataFrame([("k2", "z")], "k string, v string")
    got = rows(ingest.ingest(new, stored, "k", "v", ["n"]), "n", "ingest_state")
    assert got == [(1, "accepted"), (2, "duplicate"), (3, "rejected"), (4, "rejected"), (5, "duplicate"), (6, "rejected")]


def test_read_snapshot_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"a": 1}\nnot json\n')
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "all.json").write_text(json.dumps([{"a": 2}, {"a": 3}]))
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert rows(ingest.read_snapshot(spark, str(tmp_path / "rows.json"), schema), "a", "state") == [(1, "ready"), (None, "invalid")]
    assert rows(ingest.read_snapshot(spark, str(tmp_path / "list"), schema, True), "a", "state") == [(2, "ready"), (3, "ready")]


def test_quorum_and_changes(spark):
    candidates = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 2, "a"), ("m", 1, "a"), ("m", 1, "a"), ("n", 1, "a"), ("n", 1, "b"), ("n", 2, "a"), ("n", 2, "b"), ("k", None, "c")], "k string, v long, g string")
    got = rows(reconcile.by_quorum(candidates, ["k"], "v", "g", 2), "k", "value", "n_candidates", "n_values", "outcome")
    assert got == [("k", 1, 3, 2, "release"), ("m", None, 2, 1, "withhold"), ("n", None, 4, 2, "conflict")]
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "k string, v long")
    after = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("e", 5)], "k string, v long")
    assert rows(reconcile.detect_changes(before, after, ["k"], "v"), "k", "change_type") == [("b", "updated"), ("d", "absent"), ("e", "created")]


def test_source_health_and_triage(spark):
    seen = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 2, False), ("a", 2, 3, None), ("b", 1, 4, False), ("c", 1, 5, True)], "s string, t long, i long, ok boolean")
    got = rows(health.source_health(seen, "s", "t", "i", F.col("ok")), "s", "state", "consecutive_failures", "last_success_at")
    assert got == [("a", "failing", 2, 1), ("b", "failing", 1, None), ("c", "healthy", 0, 1)]
    out = health.triage(seen, {"soft_block": F.col("i") > 3, "dead_page": F.col("i") == 4, "semantic_swap": F.lit(None).cast("boolean")})
    assert rows(out, "i", "classification", "action")[2:] == [(3, "unknown", "human_review"), (4, "dead_page", "mark_dead"), (5, "soft_block", "quarantine")]


def test_gate_counts_null_as_violation(spark):
    df = spark.createDataFrame([(1,), (None,)], "v int")
    assert rows(quality.gate(df, {"negative": F.col("v") < 0}, {}), "v", "decision") == [(1, "verified"), (None, "quarantined")]


def test_subscriptions_with_wildcards(spark):
    events = spark.createDataFrame([(1, "up"), (2, "down"), (3, None)], "event_id long, kind string")
    subscriptions = spark.createDataFrame([("all", []), ("ups", ["up"])], "subscription_id string, kinds array<string>")
    assert rows(governance.subscribed(events, subscriptions), "event_id", "subscription_id") == [(1, "all"), (1, "ups"), (2, "all"), (3, "all")]


def test_versions_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, t long, v long, i long")
    assert facts.as_versions(df, ["k"], "t", "v", "i").count() == 0
    assert governance.retention_report(df.withColumn("retention", F.lit("kept"))).first()["n_scanned"] == 0


def test_stream_deduplicates_over_several_files(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in (1, 2):
        spark.createDataFrame([(i, i) for i in range(n, n + 3)], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")).write.mode("append").parquet(path)
    out = jobs.run_available(jobs.deduplicated(jobs.read_stream(spark, path), ["k"], "ts"), "t")
    assert rows(out, "k") == [(1,), (2,), (3,), (4,)]


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: C.parse_magnitude(F.lit("1,200K")), 1_200_000.0),
        (lambda: C.parse_number(F.lit("$1,299.50")), 1299.5),
        (lambda: C.normalize_url(F.lit("HTTPS://Example.com/A/b/#x")), "https://example.com/A/b"),
        (lambda: C.unsafe_url_reason(F.lit("https://10.0.0.1/x")), "private_host"),
        (lambda: C.unsafe_url_reason(F.lit("https://me@example.com/")), "credentials"),
        (lambda: C.unsafe_url_reason(F.lit("https://example.com/a@b")), None),
        (lambda: C.usd_per_million(F.lit(0.5), F.lit("thousand_tokens")), 500.0),
        (lambda: C.duration_ms(F.lit(2.0), F.lit("minutes")), 120000.0),
        (lambda: C.enum_map(F.lit(" Live "), {"live": "active"}), "active"),
        (lambda: C.enum_map(F.lit("?"), {"live": "active"}), None),
        (lambda: C.split_part(F.lit("a.b"), ".", 1), "b"),
        (lambda: C.split_part(F.lit("a.b"), ".", 5), None),
        (lambda: C.combine("-", F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b")), "a-b"),
        (lambda: C.version_token(F.lit("model-2024-05-01-x")), "2024-05-01"),
        (lambda: C.version_token(F.lit("model-120245")), None),
        (lambda: C.mask_secret_pairs(F.lit('a Token = "abc" b')), 'a Token="[REDACTED]" b'),
        (lambda: C.hmac_sha256(b"key" * 40, F.lit("body é")), hmac.new(b"key" * 40, "body é".encode(), hashlib.sha256).hexdigest()),
    ],
)
def test_columns(spark, column, expected):
    assert value(spark, column()) == expected
