"""Ranks, equivalence groups and identity classes against plain walks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import ranks, reconcile


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_nearest_ranks(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, None, rng.random()])) for _ in range(900)] + [("one", 5.0), ("none", None)]
    data += [("hot", 7.0)] * 4000
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    want = []
    for k in {k for k, v in data if v is not None}:
        x = sorted(v for j, v in data if j == k and v is not None)
        at = lambda p: x[max(1, math.ceil(len(x) * p)) - 1]  # noqa: B023, E731
        want.append((k, len(x), x[0], at(0.5), at(0.95), at(1.0), x[-1]))
    got = ranks.nearest_ranks(df, "k", "v", {"m": 0.5, "p": 0.95, "q": 1.0})
    assert rows(got, "k", "n", "min_value", "m", "p", "q", "max_value") == sorted(want, key=repr)
    assert ranks.nearest_ranks(df.limit(0), "k", "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("absolute, percent", [(1.5, 0.0), (0.0, 10.0), (0.5, 20.0), (0.0, 0.0), (0.0, 100.0), (2.0, 99.0)])
def test_groups_equal_the_greedy_walk(spark, absolute, percent):
    rng = random.Random(int(absolute * 10 + percent))
    data = [(rng.choice(["a", "b", None]), k, rng.choice([0.0, -1.0, 1.0, 1e6, None, rng.uniform(-20, 20), rng.gauss(10, 2)])) for k in range(300)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    near = lambda a, b: abs(a - b) <= absolute or abs(a - b) / max(abs(a), abs(b), 2.220446049250313e-16) * 100 <= percent
    want, leads, members = {}, {}, {}
    for k, i, v in data:
        if v is None:
            continue
        mine = leads.setdefault(k, [])
        lead = next((x for x in mine if near(x[1], v)), None)
        if lead is None:
            lead = (i, v)
            mine.append(lead)
        want[k, i] = lead
        members[k, lead] = members.get((k, lead), 0) + 1
    rule = {"kind": "numeric", "absolute": absolute, "percent": percent}
    out = reconcile.equivalence_groups(df, ["k"], ["i"], "v", rule)
    expected = [(k, i, None, None) if v is None else (k, i, want[k, i][1], members[k, want[k, i]]) for k, i, v in data]
    assert rows(out, "k", "i", "group_value", "group_size") == sorted(expected, key=repr)
    some = df.where("i < 60")  # the same by rounds, with null keys among the large ones
    whole = reconcile.equivalence_groups(some, ["k"], ["i"], "v", rule)
    split = reconcile.equivalence_groups(some, ["k"], ["i"], "v", rule, walk_rows=18)
    assert rows(split, "k", "i", "group_value", "group_size") == rows(whole, "k", "i", "group_value", "group_size")


def test_groups_of_texts_and_sets(spark):
    df = spark.createDataFrame([(1, 1, "A  b"), (1, 2, "a b "), (1, 3, None), (1, 4, "x"), (2, 5, "ecks"), (2, 6, "X")], "k int, i int, v string")
    rule = {"kind": "text", "collapse_whitespace": True, "case_insensitive": True, "aliases": {"ecks": "x"}}
    got = rows(reconcile.equivalence_groups(df, ["k"], ["i"], "v", rule), "i", "group_value", "group_size")
    assert got == [(1, "A  b", 2), (2, "A  b", 2), (3, None, None), (4, "x", 1), (5, "ecks", 2), (6, "ecks", 2)]
    df = spark.createDataFrame([(1, ["a", "B"]), (2, ["b", "a", "a"]), (3, None), (4, [])], "i int, v array<string>").withColumn("k", F.lit(1))
    got = rows(reconcile.equivalence_groups(df, ["k"], ["i"], "v", {"kind": "set", "case_insensitive": True}), "i", "group_value", "group_size")
    assert got == [(1, ["a", "B"], 2), (2, ["a", "B"], 2), (3, None, None), (4, [], 1)]
    assert reconcile.equivalence_groups(df.limit(0), ["k"], ["i"], "v", {"kind": "exact"}).count() == 0


def test_resolution_equals_scoring_of_all_pairs(spark):
    from factloom.operators import identity

    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    entities = [
        (k, pick("a", "a", "b", None), pick("m1", "m2", None, None), pick(["x"], ["y", "x"], [], None), pick("k1", "k2", None, None), pick("One", "TWO", "three", None), pick("f", "g", "h i", None), pick("1", "2", "3", None), pick(["Old"], ["k1", "k3"], [], None), pick("active", "retired", None))
        for k in range(60)
    ]
    inputs = [
        (pick("a", "b", "c", None), pick("m1", "m9", None, None), pick(["x"], ["z"], None, None), pick("k1", "old", "k2", "-"), pick("one", "four", None), pick("F", "h-i", "q", None), pick("1", "3", "9", None), pick(True, False, None), pick("active", "retired", None), pick(None, None, None, "ai_suggestion"))
        for _ in range(250)
    ]
    shape = "provider string, model_id string, external_ids array<string>, key string, name string, family string, version string"
    e = spark.createDataFrame(entities, "entity_id int, " + shape + ", aliases array<string>, lifecycle string")
    i = spark.createDataFrame(inputs, shape + ", critical_conflict boolean, lifecycle string, candidate_source string")
    norm = lambda x: None if x is None else "".join(c if c.isalnum() else "-" for c in x.lower()).strip("-")
    eq = lambda x, y: x is not None and x == y
    P = identity.POINTS
    want = set()
    for row in {(*r[:2], tuple(r[2]) if r[2] is not None else None, *r[3:]) for r in inputs}:
        provider, model, ext, key, name, family, version, critical, life, source = row
        scored = []
        for n, p2, m2, x2, k2, n2, f2, v2, a2, l2 in entities:
            hit = {"model_id": eq(model, m2), "external_id": bool(set(ext or ()) & set(x2 or ())), "alias": norm(key) in [norm(a) for a in a2 or ()]}
            if not (eq(provider, p2) or hit["model_id"] or hit["external_id"]):
                continue
            hit |= {"provider": eq(provider, p2), "provider_conflict": not eq(provider, p2), "name": eq(norm(name), norm(n2)), "family": eq(norm(family), norm(f2)), "version": eq(version, v2)}
            hit |= {"version_conflict": None not in (version, v2) and version != v2, "critical_conflict": bool(critical), "lifecycle_conflict": life == "active" and l2 == "retired" and eq(version, v2)}
            strong = hit["model_id"] or hit["external_id"] or hit["alias"] or eq(key, k2)
            scored.append((sum(P[x] for x, on in hit.items() if on), -n, hit["provider_conflict"] or hit["version_conflict"], strong))
        best = max(scored, default=(0, 0, False, False))
        ties = sum(s[0] == best[0] for s in scored)
        decision = "needs_review" if source else "create_new" if best[0] <= 0 else "rejected" if best[2] else "auto_link" if ties == 1 and best[3] else "needs_review"
        want.add((*row, 0 if source else best[0], decision, -best[1] if decision == "auto_link" else None))
    got = identity.resolve(i, e).collect()
    assert len(got) == len(want)
    assert {(*r[:2], tuple(r[2]) if r[2] is not None else None, *r[3:10], r["score"], r["decision"], r["entity_id"]) for r in got} == want
