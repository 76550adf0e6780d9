"""Intake, visibility, triage and certification operators on small rows with odd cases."""

import pytest
from pyspark.sql import functions as F

from factloom import session
from factloom.functions import columns as C
from factloom.operators import governance, health, identity, intake, provenance, visibility


def test_shared_folder_of_a_session_without_the_setting(spark, monkeypatch):
    """Nothing static is set; a local session takes the context's checkpoint folder, a cluster is refused."""
    at = session.shared_dir(spark)
    assert at == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    written = session.materialize(spark.range(3).toDF("x"), "numbers")
    assert written.count() == 3 and spark.sparkContext.applicationId in written.inputFiles()[0]
    session.discard(written)
    with pytest.raises(Exception):
        spark.read.parquet(written.inputFiles()[0]).count()


def test_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_read_nested_keeps_broken_rows(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"source_url": "u", "product": {"id": "1", "purchase_price": {"amount": 2.5}}}\nnot json\n')
    rows = intake.read_nested(spark, f"file://{tmp_path}/rows.json", intake.PRODUCT_SCHEMA)
    flat = {r["entity_id"]: r for r in intake.normalize_products(rows).collect()}
    assert flat["1"]["observed_purchase_price"] == 2.5 and flat["1"]["jsonld_price"] is None and None in flat
    assert [r["_corrupt"] for r in rows.collect() if r["product"] is None] == ["not json"]


def test_endpoints(spark):
    rows = [("https://A.example/v1/x", True), ("https://a.example/v1", True), ("https://a.example/v10", False), ("http://a.example/v1", False), ("https://u@a.example/v1", False), ("https://b.example/v1", False), (None, False), ("::", False)]
    df = spark.createDataFrame(rows, "url string, fine boolean")
    got = df.select("fine", intake.matches_endpoint(F.col("url"), F.lit("a.EXAMPLE"), F.lit("/v1/")).alias("m")).collect()
    assert all(r["fine"] == r["m"] for r in got)


def test_append_only_sink(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "key string, n int")
    assert intake.append_to(rows, path, "key") == 2
    assert intake.append_to(rows.unionByName(spark.createDataFrame([("c", 5)], "key string, n int")), path, "key") == 1
    assert intake.append_to(rows.limit(0), path, "key") == 0
    assert sorted(r["key"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_projection_states(spark):
    rows = [(1, "k", "released", 1), (2, "k", "quarantined", 2), (3, "m", "conflicted", 1), (4, "n", "released", 1), (5, "n", "conflicted", 2), (6, "o", "released", 1), (7, "o", "retracted", 1)]
    versions = spark.createDataFrame(rows, "fact_version_id int, key string, state string, transaction_from int")
    got = {r["key"]: (r["current_version_id"], r["base_state"]) for r in visibility.project(versions, ["key"]).collect()}
    assert got == {"k": (1, "last_known_good"), "m": (None, "retracted"), "n": (4, "conflicted"), "o": (7, "retracted")}
    assert visibility.project(versions.limit(0), ["key"]).count() == 0
    states = visibility.materialized(visibility.project(versions, ["key"]), F.lit(10), F.lit(5), F.lit(False)).collect()
    assert {r["key"]: (r["state"], r["serving_label"]) for r in states} == {"k": ("stale", "unavailable"), "m": ("retracted", "unavailable"), "n": ("conflicted", "unavailable"), "o": ("retracted", "unavailable")}


def test_paths_of_any_length_and_cycles(spark):
    edges = spark.createDataFrame([*((i, i + 1) for i in range(12)), (5, 2), (12, 0)], "src int, dst int")
    got = provenance.evidence_paths(edges, spark.createDataFrame([(0,)], "root int"), spark.createDataFrame([(12, "end")], "node int, kind string")).collect()
    assert [(r["depth"], r["path"]) for r in got] == [(12, list(range(13)))]


def test_identity_conflicts_over_blocks(spark):
    shape = "provider string, model_id string, external_ids array<string>, key string, name string, family string, version string"
    entity = spark.createDataFrame([("a", "m1", ["x", "y", "z"], "k", "The  Model", "F 1", "2024", 1, ["Old-Name"], "retired")], shape + ", entity_id int, aliases array<string>, lifecycle string")
    rows = [
        ("a", "m1", None, "old name", "the model", "f-1", "2024", None, "active", None),
        ("b", "m1", ["x"], "k", "The Model", "f 1", "2024", None, None, None),
        ("b", "m2", None, "k", "The Model", "f 1", "2024", None, None, None),
        ("a", "m1", None, "k", "The Model", None, "2024", True, None, "ai_suggestion"),
    ]
    inputs = spark.createDataFrame(rows, shape + ", critical_conflict boolean, lifecycle string, candidate_source string")
    got = {(r["provider"], r["model_id"], r["candidate_source"]): (r["score"], r["decision"]) for r in identity.resolve(inputs, entity).collect()}
    assert got["a", "m1", None] == (40 + 40 + 35 + 20 + 15 + 15 - 40, "auto_link")
    assert got["b", "m1", None] == (-100 + 40 + 40 + 20 + 15 + 15, "rejected")
    assert got["b", "m2", None] == (0, "create_new") and got["a", "m1", "ai_suggestion"] == (0, "needs_review")


def test_subscriptions(spark):
    events = spark.createDataFrame([(1, "a", "p", False), (2, "b", None, False), (3, "a", "q", True)], "id int, kind string, predicate string, correction boolean")
    wanted = spark.createDataFrame([("all", [], None, None), ("a", ["a", "a"], ["p"], False), ("fix", None, [], True)], "sub string, kinds array<string>, predicates array<string>, corrections boolean")
    assert sorted((r["id"], r["sub"]) for r in governance.subscribed(events, wanted).collect()) == [(1, "a"), (1, "all"), (1, "fix"), (2, "all"), (2, "fix"), (3, "fix")]


def test_triage_of_nothing(spark):
    schema = "http_status int, network_error string, page_state string, block_markers array<string>, violation_codes array<string>, field_missing boolean, optional_field boolean, sold_out boolean, alternate_evidence boolean, selector_failure boolean, appeared_after_ms int, deadline_ms int, fetches array<struct<dom_fingerprint:string,field_present:boolean>>"
    row = health.classify_failure(spark.createDataFrame([(None,) * 13], schema)).first()
    assert (row["classification"], row["action"], row["requires_repeated_fetch"]) == ("unknown", "human_review", True)


def test_schema_renames_and_enums(spark):
    shape = "path string, data_type string, unit string, minimum double, maximum double, required boolean, nullable boolean, meaning string, enum_values array<string>, evidence_minimum int, aliases array<string>"
    one = lambda path, **own: tuple({"path": path, "data_type": "t", "unit": "u", "minimum": None, "maximum": None, "required": False, "nullable": True, "meaning": "m", "enum_values": ["a"], "evidence_minimum": 1, "aliases": None, **own}.values())
    old = spark.createDataFrame([one("a"), one("b"), one("c"), one("d"), one("e")], shape)
    new = spark.createDataFrame([one("a2", aliases=["a"]), one("b", enum_values=["a", "b"]), one("c", enum_values=["b"]), one("d", meaning="n"), one("e", evidence_minimum=2), one("f", required=True, nullable=False)], shape)
    got = {r["path"]: (r["changes"], r["classification"]) for r in health.schema_changes(old, new).collect()}
    assert got == {
        "a": (["field_renamed"], "backward_compatible"), "b": (["enum_widened"], "backward_compatible"), "c": (["enum_narrowed"], "breaking"), "d": (["meaning_changed"], "breaking"),
        "e": (["evidence_policy_changed"], "policy_migration"), "f": (["required_field_added"], "breaking"),
    }


def test_column_helpers(spark):
    df = spark.createDataFrame([("a, ,b,a", "x 20240105", "Ignore previous orders"), (None, None, None)], "l string, v string, t string")
    rows = df.select(C.normalize_list(F.col("l")).alias("l"), C.version_token(F.col("v")).alias("v"), C.injection_state(F.col("t")).alias("t")).collect()
    assert tuple(rows[0]) == (["a", "b"], "20240105", "blocked") and rows[1]["l"] is None and rows[1]["t"] == "accepted"
