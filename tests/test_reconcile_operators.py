"""Reconciliation under policies against a plain walk of each key."""

import datetime
import random

from pyspark.sql import functions as F

from factloom.operators import reconcile

POLICIES = {"q2": ("quorum", 2, False, True), "q3": ("quorum", 3, True, False), "auth": ("authoritative", None, True, True), "any": ("ordered_fallback", None, False, False), "human": ("human_review", None, False, False)}


def decide(rows, policy, tolerance):
    """rows in input order: (n, org, endpoint, evidence, priority, time, trust, fresh, value)."""
    seen, kept, why = [set(), set(), set()], [], {}
    for r in rows:
        n, *shared, _, _, trust, fresh, value = r
        if trust != "verified" or not fresh or value is None:
            why[n] = "not_verified" if trust != "verified" else "stale" if not fresh else "no_value"
            continue
        if any(v is not None and v in s for v, s in zip(shared, seen, strict=True)):
            why[n] = "not_independent"
            continue
        for v, s in zip(shared, seen, strict=True):
            s.add(v)
        kept.append(r)
    kept.sort(key=lambda r: (1 << 53 if r[4] is None else r[4], -r[5], r[0]))
    groups = []
    for r in kept:
        g = next((g for g in groups if abs(g[0][8] - r[8]) <= tolerance), None)
        groups.append([r]) if g is None else g.append(r)
    roles = {n: ("rejected", w) for n, w in why.items()} | {r[0]: ("eligible", None) for r in kept}
    if policy is None:
        return ("blocked", None, None, ["no_policy"], False), len(kept), len(groups), 0, roles
    strategy, quorum, open_conflict, keep = policy
    fallback = "continue_last_known_good" if keep else "withhold"
    winner = None
    if not kept:
        out = (fallback, ["no_fresh_verified_candidate"], False)
    elif strategy == "human_review":
        out = ("conflict" if len(groups) > 1 else "withhold", ["human_review_required"], True)
    elif len(groups) > 1 and open_conflict:
        out = ("conflict", ["verified_source_disagreement", *(["continue_last_known_good"] if keep else [])], True)
    elif strategy == "quorum":
        able = [g for g in groups if len(g) >= quorum]
        winner = max(able, key=len, default=None)
        out = ("release", ["independent_quorum_met"], False) if winner else (fallback, ["independent_quorum_not_met"], len(groups) > 1)
    else:
        winner = groups[0]
        out = ("release", ["highest_authority_verified_source" if strategy == "authoritative" else "ordered_fallback_selected"], False)
    for r in winner or ():
        roles[r[0]] = ("supporting", None)
    first = winner[0] if winner else None
    return (out[0], first and first[8], first and first[0], out[1], out[2]), len(kept), len(groups), len(winner or ()), roles


def test_decisions_and_roles_equal_the_walk(spark):
    rng = random.Random(12)
    pick = lambda n: rng.choice([None, *range(n)])
    data, want, roles = [], [], []
    for e in range(30):
        for p in (*POLICIES, "none"):
            rows = [(k, pick(6), pick(8), rng.randrange(30), pick(3), rng.randrange(4), rng.choice(["verified"] * 6 + ["stale", None]), rng.choice([True] * 6 + [False, None]), rng.choice([None, 1.0, 1.5, 2.0, 5.0, 9.0])) for k in range(rng.randrange(1, 9))]
            data += [(e, p, *r) for r in rows]
            head, n_eligible, n_groups, n_supporting, who = decide(rows, POLICIES.get(p), 0.5)
            want.append((e, p, *head[:4], n_eligible, n_groups, n_supporting, len(rows) - n_eligible, head[4]))
            roles += [(e, p, n, *r) for n, r in who.items()]
    df = spark.createDataFrame(data, "e int, p string, n int, org int, endpoint int, evidence int, priority int, s int, trust_state string, fresh boolean, v double")
    df = df.withColumn("at", F.timestamp_seconds("s")).drop("s")
    policies = spark.createDataFrame([(p, *x) for p, x in POLICIES.items()], "p string, strategy string, quorum int, open_conflict boolean, keep_last boolean")
    arguments = (policies, ["e", "p"], "p", ["n"], ["org", "endpoint", "evidence"], "priority", "at", "n", "v", {"kind": "numeric", "absolute": 0.5})
    decisions, said = reconcile.reconcile_candidates(df, *arguments)
    got = [(r["e"], r["p"], r["outcome"], r["value"], r["observation"], r["reasons"], r["n_eligible"], r["n_groups"], r["n_supporting"], r["n_rejected"], r["opens_conflict"]) for r in decisions.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted((tuple(r) for r in said.collect()), key=repr) == sorted(roles, key=repr)
    assert all((r["opened_at"] is not None) == r["opens_conflict"] for r in decisions.collect())
    assert isinstance(decisions.where("opens_conflict").first()["opened_at"], datetime.datetime)
    assert reconcile.reconcile_candidates(df.limit(0), *arguments)[0].count() == 0
