"""Histories, folds, identity logs, mappings and release gates on small rows: plain Python as brute force, nulls, ties, empty tables."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import bitemporal, dossier, identity, mapping, ordered, progress, provenance, reconcile, release
from factloom.sources import ingest
from factloom.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def moment(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def test_carry_by_buckets_equals_plain_windows(spark):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2, None]), n, rng.choice([None, 1.0, 2.0, 3.0]), rng.random() < 0.3) for n in range(300)]
    df = spark.createDataFrame(data, "k int, n int, v double, hit boolean")
    for inclusive, backward in itertools.product([False, True], repeat=2):
        plain = ordered.carry(df, "x", ["k"], ["n"], F.col("v"), F.col("hit"), None, inclusive, backward)
        parts = ordered.carry(df, "x", ["k"], ["n"], F.col("v"), F.col("hit"), F.floor(F.col("n") / 17), inclusive, backward)
        assert rows(plain, "k", "n", "x") == rows(parts, "k", "n", "x")
    sums = [ordered.running_sum(df, "s", ["k"], ["n"], F.col("v"), b) for b in (None, F.floor(F.col("n") / 17))]
    assert rows(sums[0], "k", "n", "s") == rows(sums[1], "k", "n", "s")
    assert ordered.carry(df.limit(0), "x", ["k"], ["n"], F.col("v"), F.col("hit"), F.col("n")).count() == 0


def greedy(items):
    kept, seen = [], [set(), set(), set()]
    for i, *shared in items:
        if any(v is not None and v in s for v, s in zip(shared, seen)):
            continue
        kept.append(i)
        for v, s in zip(shared, seen):
            s.add(v)
    return kept


def test_independent_matches_the_greedy_walk(spark):
    rng = random.Random(7)
    pick = lambda n: rng.choice([None, *range(n)])
    data = [(k, i, pick(9), pick(14), pick(25)) for k in ("a", "b") for i in range(60)]
    # A chain: each candidate shares something with the one before it.
    data += [("c", i, i // 2, (i + 1) // 2 + 100, None) for i in range(8)]
    df = spark.createDataFrame(data, "k string, i int, org int, endpoint int, evidence int")
    want = [(k, i) for k in "abc" for i in greedy([d[1:] for d in data if d[0] == k])]
    assert rows(reconcile.independent(df, ["k"], ["i"], ["org", "endpoint", "evidence"]), "k", "i") == sorted(want, key=repr)
    by_rounds = reconcile.independent(df, ["k"], ["i"], ["org", "endpoint", "evidence"], walk_rows=8)
    assert rows(by_rounds, "k", "i") == sorted(want, key=repr)
    assert reconcile.independent(df.limit(0), ["k"], ["i"], ["org"]).count() == 0


def test_policies(spark):
    data = [("near", 1, 10.0), ("near", 2, 10.4), ("near", 3, 30.0), ("one", 1, 5.0), ("none", 1, None)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    decide = lambda strategy, **kw: rows(reconcile.by_policy(df, ["k"], "v", [F.col("i")], strategy, 0.5, **kw), "k", "outcome", "value", "n_supporting", "reason")
    assert decide("quorum", conflict_on_disagreement=False) == [
        ("near", "release", 10.0, 2, "quorum_met"),
        ("none", "continue_last_known_good", None, 0, "no_candidate"),
        ("one", "continue_last_known_good", None, 0, "quorum_not_met"),
    ]
    assert decide("authoritative")[0] == ("near", "conflict", None, 0, "disagreement")
    assert decide("ordered_fallback", conflict_on_disagreement=False)[0] == ("near", "release", 10.0, 2, "fallback_selected")
    assert [r[1] for r in decide("human_review", keep_last=False)] == ["conflict", "withhold", "withhold"]
    with pytest.raises(ValueError):
        decide("vote")


def test_folds(spark):
    calls = [(None, 0, "failure"), (1, 0, "failure"), (1, 1, None), (1, 2, "success"), (1, 9, "failure"), (1, 10, "success"), (1, 11, "success"), (2, 0, "config_error"), (2, 12, "success")]
    df = spark.createDataFrame([(k, moment(h), n, r) for n, (k, h, r) in enumerate(calls)], "k int, t timestamp, n int, r string")
    out = progress.circuit_states(df, "k", "t", "n", "r", 2, 6 * 3600)
    got = {r["n"]: (r["circuit"], r["allowed"]) for r in out.collect()}
    assert [got[n] for n in range(9)] == [
        ("closed", True), ("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("open", False), ("open", True), ("closed", True),
    ]
    values = spark.createDataFrame([(1, n, v, g) for n, (v, g) in enumerate([(None, True), (10.0, True), (16.0, True), (14.0, True), (5.0, False), (20.0, None)])], "k int, n int, v double, g boolean")
    assert rows(progress.released_values(values, "k", ["n"], "v", "g"), "n", "gate_decision", "released_value") == [
        (0, "quarantined", None), (1, "verified", 10.0), (2, "needs_review", 10.0), (3, "verified", 14.0), (4, "quarantined", 14.0), (5, "quarantined", 14.0),
    ]
    assert progress.released_values(values.limit(0), "k", ["n"], "v", "g").count() == 0


def test_streaming_gate_carries_over_batches(spark, tmp_path):
    data = [(k, n, float(v), True) for n, (k, v) in enumerate([(1, 10), (2, 7), (1, 12), (1, 40), (2, 8), (1, 13), (3, 1)])]
    df = spark.createDataFrame(data, "k int, n int, v double, g boolean")
    for batch in range(3):
        df.where(F.floor(F.col("n") / 3) == batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 3
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = rows(progress.released_values(df, "k", ["n"], "v", "g"), "n", "gate_decision", "released_value")
    assert rows(jobs.gated_releases(stream, "k", ["n"], "v", "g"), "n", "gate_decision", "released_value") == want


def test_retraction_brings_the_earlier_version_back(spark):
    v = spark.createDataFrame(
        [(n, "op", "f", float(n), None if n == 2 else moment(n), moment(n), moment(n), s) for n, s in ((1, "released"), (2, "released"), (3, "withheld"))],
        "version_id int, operation_key string, k string, value double, valid_from timestamp, transaction_from timestamp, verified_at timestamp, state string",
    )
    t = spark.createDataFrame([(1, "supersession", moment(2)), (2, "retraction", moment(5))], "previous_version_id int, kind string, transaction_at timestamp")
    at = lambda n: F.lit(moment(n)).cast("timestamp")
    believed = lambda n: [r["version_id"] for r in bitemporal.believed_at(v, t, ["k"], at(n)).collect()]
    assert (believed(0), believed(1), believed(4), believed(5)) == ([], [1], [2], [1])
    assert [r["version_id"] for r in bitemporal.valid_at(v, t, ["k"], at(1), at(4)).collect()] == [1]
    assert rows(bitemporal.intervals(v, t), "version_id", "transaction_to", "ended_as") == sorted([(1, moment(2), "changed"), (2, moment(5), "retracted"), (3, None, None)], key=repr)
    policies = spark.createDataFrame([("f", 3600, False)], "k string, freshness_seconds int, source_healthy boolean")
    assert rows(bitemporal.regenerate(v, t, ["k"], policies, at(9), "k"), "version_id", "fresh_state", "lag_seconds") == [(1, "last_known_good", 8 * 3600)]
    assert bitemporal.drift(v, v, ["version_id"]).count() == 0


def test_identity_log(spark):
    entities = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "a")], "entity_id int, provider string")
    log = [("m1", "merge", 1, 2), ("m2", "merge", 1, 3), ("m3", "merge", 2, 2), ("s1", "split", 4, 1), ("s1", "split", 4, 5), ("s2", "split", 5, 1), ("m4", "merge", 9, 1), ("m5", "merge", 5, 4), ("r1", "reverse", None, None, "m5"), ("r2", "reverse", None, None, "zz")]
    ops = spark.createDataFrame([(*x, None)[:5] for x in log], "op_id string, kind string, source_id int, target_id int, undoes string")
    checked = identity.check_operations(entities, ops)
    assert dict(rows(checked.select("op_id", "problem").distinct(), "op_id", "problem")) == {
        "m1": None, "m2": "other_provider", "m3": "same_entity", "s1": None, "s2": "few_children", "m4": "unknown_entity", "m5": None, "r1": None, "r2": "unknown_operation",
    }
    states, edges = identity.apply_operations(entities, checked)
    assert rows(states, "entity_id", "state", "merged_into") == sorted([(1, "merged", 2), (2, "active", None), (3, "active", None), (4, "split", None), (5, "active", None)], key=repr)
    assert rows(edges, "src", "dst", "kind") == [(1, 2, "alias_of"), (1, 4, "version_of"), (5, 4, "version_of")]


def test_mapping_specs(spark):
    rule = mapping.Rule("name", ("n",), (("trim", {}),))
    spec = lambda **kw: mapping.Spec(**({"mapping_id": "m", "revision": 1, "status": "active", "source_key": "id", "canonical_key": ("name",), "rules": (rule,)} | kw))
    for bad in ({"status": "draft"}, {"rules": ()}, {"canonical_key": ("other",)}, {"rules": (mapping.Rule("name", ("n",), (("eval", {}),)),)}, {"rules": (mapping.Rule("name", ("n", "id")),)}):
        with pytest.raises(ValueError):
            mapping.validate(spec(**bad))
    df = spark.createDataFrame([(1, " A "), (2, None), (None, "b")], "id int, n string")
    got = rows(mapping.execute(df, spec()), "source_key", "canonical_key", "errors")
    assert got == sorted([("1", "a", []), ("2", None, ["missing:name"]), (None, "b", ["missing:source_key"])], key=repr)
    assert mapping.field_evidence(df.limit(0), spec()).count() == 0


def test_stage_progress_follows_the_order(spark):
    log = [(1, 1, "b", True), (1, 2, "a", True), (1, 3, "a", False), (1, 4, "b", True), (2, 1, "a", None), (2, 2, "b", True), (None, 1, "a", True), (3, 1, "z", True)]
    df = spark.createDataFrame(log, "k int, t int, s string, ok boolean")
    assert rows(progress.stage_progress(df, "k", "t", "t", "s", "ok", ["a", "b"]), "k", "n_passed", "state", "stopped_at_stage") == sorted(
        [(1, 2, "active", None), (2, 0, "rolled_back", "a"), (None, 1, "running", None), (3, 0, "running", None)], key=repr
    )


def test_first_rule_and_key_chain(spark):
    rules = spark.createDataFrame([(2, "x", None, 20), (1, "x", "y", 10), (3, None, None, 30)], "o int, a string, b string, p int")
    df = spark.createDataFrame([("x", "y"), ("x", "|"), (None, "y"), ("q", None), ("x", "y")], "a string, b string")
    assert rows(release.first_rule(df, rules, ["a", "b"], "o", ["p"]), "a", "b", "p") == sorted([("x", "y", 10), ("x", "y", 10), ("x", "|", 20), (None, "y", 30), ("q", None, 30)], key=repr)
    known = spark.createDataFrame([("k1", 1), ("k2", 1), ("k2", 2), (None, 3)], "key string, entity_id int")
    inputs = spark.createDataFrame([("k1",), ("k2",), (None,), ("k9",)], "key string")
    assert rows(release.resolve_keys(inputs, [("key", known)]), "key", "entity_id", "state") == sorted([("k1", 1, "linked"), ("k2", None, "ambiguous"), (None, None, "new"), ("k9", None, "new")], key=repr)


def test_corrections_are_idempotent(spark):
    events = spark.createDataFrame([("e1", 1), ("e2", 2), ("e3", 3)], "event_id string, value int")
    ops = spark.createDataFrame([("o1", "e1", 1, 9), ("o1", "e1", 1, 9), ("o2", "e1", 2, 8), ("o3", "e2", 1, None), ("o4", "zz", 1, 1)], "operation_id string, event_id string, at int, value int")
    states, fixed = release.retract_and_correct(events, ops)
    assert rows(states, "event_id", "state") == [("e1", "corrected"), ("e2", "retracted"), ("e3", "released")]
    assert rows(fixed, "corrects", "value") == [("e1", 9)]


def test_dossiers_bundles_and_pages(spark):
    roots = spark.createDataFrame([(1,), (2,)], "k int")
    child = dossier.Child(spark.createDataFrame([(1, 5), (1, 4), (1, 6), (None, 1)], "k int, v int"), ["v"], [F.col("v")], 2)
    got = dossier.dossier(roots, "k", {"c": child}).select("k", "n_c", F.transform("c", lambda x: x["v"]).alias("c"))
    assert rows(got, "k", "n_c", "c") == [(1, 3, [4, 5]), (2, 0, [])]
    parts = spark.createDataFrame([("b", f"n{n}", str(n)) for n in range(40)] + [("b", None, "x"), ("b", "n1", "0")], "b string, n string, d string")
    sealed = provenance.bundles(parts, "b", "n", "d")
    assert rows(sealed, "n_artifacts", "n_repeated") == [(40, 1)]
    assert provenance.broken_bundles(sealed, parts, "b", "n", "d").count() == 0
    assert provenance.broken_bundles(sealed, parts.where("n <> 'n7'"), "b", "n", "d").count() == 1
    html = '<p><a class="q" href="/x">A <b>b</b></a><TABLE id="t"><tr><th>h</th><td> 1 </td></tr></TABLE><script type="application/ld+json">{"name": "N", "offers": {"price": 3}}</script>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    assert rows(ingest.page_links(pages), "page_id", "position", "href", "label") == [(1, 0, "/x", "A b")]


def test_price_contract_and_gates_with_nulls(spark):
    prices = spark.createDataFrame(
        [(1, 10.0, 1.0, 10.0, 10.0, "Buy Now", 12.0), (2, 10.0, 1.0, 10.0, 10.0, None, None), (3, 1.0, 9.0, 1.0, 1.0, "one-time", 10.0), (4, None, 1.0, 1.0, 1.0, "buy now", 5.0)],
        "id int, observed double, monthly double, channel_a double, channel_b double, context string, previous double",
    )
    assert rows(release.price_contract(prices), "id", "decision", "released_value", "proof_state", "alert") == [
        (1, "verified", 10.0, "verified", "sent"), (2, "quarantined", None, "quarantined", "not_triggered"), (3, "needs_review", 10.0, "stale", "blocked"), (4, "quarantined", 5.0, "stale", "not_triggered"),
    ]
    results = spark.createDataFrame([(1, "a", True, True), (1, "b", True, False), (2, "a", None, None)], "k int, s string, ok boolean, held boolean")
    gate = release.stage_gate(results, "k", "s", F.col("ok"), F.col("held"), F.lit(False), ["a", "b"])
    assert rows(gate, "k", "missing", "can_release") == [(1, [], True), (2, ["a", "b"], False)]


def test_graph_marks_ends_without_ids_in_shuffles(spark):
    import hashlib

    from factloom.plans import registry

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    nodes = spark.createDataFrame([("part", "1"), ("part", "1"), ("part", None), ("maker", "9"), ("maker", "2")], "kind string, ref string")
    data = [("part", 1, "maker", 9, "by"), ("part", 1, "maker", 9, "by"), ("part", 1, "maker", 9, "of"), ("maker", 2, "part", 1, "by"), ("part", 2, "maker", 9, "by"), ("part", 1, "maker", 1, "by"), ("part", None, "maker", 9, "by"), ("maker", 1, "part", 9, "by")]
    edges = spark.createDataFrame(data, "src_kind string, src_ref long, dst_kind string, dst_ref long, kind string")
    made, whole, orphans = provenance.graph(nodes, edges)
    assert rows(made, "kind", "ref") == sorted([("part", "1"), ("maker", "9"), ("maker", "2")], key=repr)
    want = lambda some: sorted([(sha(f"{k}|{sha(f'{a}|{b}')}|{sha(f'{c}|{d}')}"), sha(f"{a}|{b}"), sha(f"{c}|{d}"), k) for a, b, c, d, k in some], key=repr)
    assert rows(whole, "edge_id", "src", "dst", "kind") == want([data[0], data[2], data[3]])
    lost = rows(orphans, "edge_id", "src", "dst", "kind")
    assert len(lost) == 4 and set(want([data[4], data[5], data[7]])) < set(lost)

    query = registry.QUERIES["gr1_supply_graph"](spark, "/root/testdata/sf0.001")
    assert all("/root/testdata/sf0.001/" in f for f in query.inputFiles())  # nothing is written in between
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan and "sha2" not in plan[plan.index("Exchange") :]
