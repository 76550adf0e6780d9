"""Gauntlet scores and public shapes on rows with nulls."""


from factloom.operators import gauntlet, visibility


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_case_runs(spark):
    base = [(n, "pass", True, False, None, True) for n in range(3)]
    runs = {"good": base, "twice": [*base[:2], base[0]], "short": base[:2], "lost": [*base[:2], (2, None, True, False, None, True)], "heal": [*base[:2], (2, "pass", None, True, None, True)], "gone": [*base[:2], (2, "pass", None, None, None, None)]}
    df = spark.createDataFrame([(k, *r) for k, v in runs.items() for r in v], "run string, case_id int, outcome string, critical boolean, false_heal boolean, false_release boolean, preserved boolean")
    got = {r["run"]: (r["status"], r["n_critical"]) for r in gauntlet.case_runs(df, "run", 3).collect()}
    assert got == {"good": ("completed", 0), "twice": ("incomplete", 0), "short": ("incomplete", 0), "lost": ("failed", 1), "heal": ("failed", 0), "gone": ("failed", 0)}


def test_metrics(spark):
    cases = spark.createDataFrame([("s", 1, "held_out", True, "identity", "retry", ["a", "b"]), ("s", 2, None, None, None, None, None)], "suite string, case_id int, visibility string, critical boolean, category string, expected_relation string, expected_events array<string>")
    results = [("r1", "s", 1, "pass", True, True, None, None, ["a", "x"], 10), ("r1", "s", 2, "pass", True, True, False, False, None, None), ("r2", "s", 1, None, None, None, True, True, None, None), ("r2", "s", 9, "pass", True, True, None, None, ["q"], None)]
    df = spark.createDataFrame(results, "run string, suite string, case_id int, outcome string, extraction_ok boolean, event_ok boolean, false_heal boolean, false_event boolean, emitted_events array<string>, recovery_ms int")
    got = {r["run"]: r.asDict() for r in gauntlet.fleet_metrics(cases, df, "suite", "run").collect()}
    assert got["r1"] == {
        "run": "r1", "complete": True, "catch_rate": 1.0, "triage_rate": 1.0, "false_heal_rate": 0.0, "held_out_rate": 1.0, "identity_precision": 1.0, "event_precision": 0.5, "event_recall": 0.5, "correction_accuracy": 1.0,
        "n_false_events": 0, "recovery_ms": 10.0, "availability": 1.0, "fresh": 1,
    }
    assert (got["r2"]["complete"], got["r2"]["catch_rate"], got["r2"]["false_heal_rate"], got["r2"]["event_precision"], got["r2"]["fresh"]) == (False, 0.0, 0.5, 0.0, 0)


def test_suites(spark):
    full = [(k, True, 1, 1, k == "unit", "product_pricing" if k == "unit" else None, 4) for k in gauntlet.REQUIRED_KINDS]
    suites = {"good": full, "kind": full[1:], "event": [*full[:1], ("rendering", True, 2, 1, False, None, 4), *full[1:]], "held": [(*r[:4], None, *r[5:]) for r in full], "null": [(None,) * 7]}
    df = spark.createDataFrame([(k, *r) for k, v in suites.items() for r in v], "suite string, kind string, extraction_ok boolean, observed_events int, expected_events int, held_out boolean, regression_suite string, duration_ms int")
    got = {r["suite"]: (r["passed"], r["missing_kinds"], r["n_false_events"], r["mean_ms"]) for r in gauntlet.fleet_suites(df, "suite").collect()}
    assert got["good"] == (True, [], 0, 4.0) and got["kind"] == (False, ["structural"], 0, 4.0)
    assert got["event"] == (False, [], 1, 4.0) and got["held"] == (False, [], 0, 4.0) and got["null"][0] is False


def test_public_shapes(spark):
    events = spark.createDataFrame([(1, "t", 5, None, "released", 9, None), (2, "t", 5, "p", "withheld", 9, None), (None, "t", 5, "p", "released", 9, None)], "event_id int, event_type string, entity_id int, predicate string, state string, observed_at int, certificate_id int")
    evidence = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b")], "event_id int, evidence_ref string")
    assert rows(visibility.public_events(events, evidence), "id", "entity_id") == [("1", "5")]
    assert visibility.public_events(events, evidence).first()["trust"]["evidence_count"] == 1
    conflicts = spark.createDataFrame([(1, 2, "p", "r", [3, 4], 7), (2, 2, "p", "r", None, 7)], "conflict_id int, entity_id int, predicate string, reason string, observation_ids array<int>, opened_at int")
    fixed = spark.createDataFrame([(1, 8, 1), (1, 9, 2), (1, 7, 2)], "conflict_id int, fact_version_id int, at int")
    assert rows(visibility.public_conflicts(conflicts, fixed), "id", "status", "released_fact_version_id", "candidate_observation_ids") == [("1", "resolved", "9", ["3", "4"]), ("2", "open", None, None)]
