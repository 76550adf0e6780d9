"""Quorum reconciliation over independent sources and semantic change detection."""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.functions.columns import canonical, equivalent
from factloom.session import discard, materialize


def by_quorum(candidates: DataFrame, keys: list[str], value: str, group: str, quorum: int) -> DataFrame:
    """Release a value that enough independent groups report (CDC-3, CDC-10, AG-14).

    Only partial aggregates are shuffled, so a hot key needs no array. Null
    values are absent. Returns keys, value (null unless released),
    n_candidates, n_values and outcome: release, conflict (several values have
    a quorum) or withhold.
    """
    per_value = candidates.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"), F.count_distinct(group).alias("__groups"))
    enough = F.col("__groups") >= quorum
    out = per_value.groupBy(*keys).agg(
        F.sum("__n").alias("n_candidates"),
        F.count("*").alias("n_values"),
        F.count_if(enough).alias("__winners"),
        F.max(F.when(enough, F.col(value))).alias("value"),
    )
    outcome = F.when(F.col("__winners") == 1, "release").when(F.col("__winners") > 1, "conflict").otherwise("withhold")
    return out.withColumn("outcome", outcome).withColumn("value", F.when(F.col("outcome") == "release", F.col("value"))).drop("__winners")


def detect_changes(previous: DataFrame, current: DataFrame, keys: list[str], value: str, same: Column | None = None) -> DataFrame:
    """Events between two states with one row per key (CDC-5, CDC-6).

    same: equivalence over before_value and after_value, null-safe equality by
    default. A key that is missing now is absent, never removed (CDC-9).
    Returns keys, before_value, after_value, change_type (created, updated,
    absent) and event_id, which depends on nothing else; unchanged keys give no row.
    """
    before = previous.select(*keys, F.col(value).alias("before_value"), F.lit(True).alias("__b"))
    after = current.select(*keys, F.col(value).alias("after_value"), F.lit(True).alias("__a"))
    same = F.col("before_value").eqNullSafe(F.col("after_value")) if same is None else F.coalesce(same, F.lit(False))
    kind = F.when(F.col("__b").isNull(), "created").when(F.col("__a").isNull(), "absent").when(~same, "updated")
    out = before.join(after, keys, "full_outer").withColumn("change_type", kind).where("change_type is not null")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, "change_type", "before_value", "after_value")]
    return out.withColumn("event_id", F.sha2(F.concat_ws("|", *text), 256)).drop("__a", "__b")


def independent(candidates: DataFrame, keys: list[str], order: list[str], shared: list[str], walk_rows: int = 100_000) -> DataFrame:
    """The candidates of each key that share nothing with an earlier kept one (CDC-1).

    Walks a key's candidates by `order` (unique within the key) and keeps one
    if no kept one has the same value in any column of `shared`; null shares
    nothing. Keys are not null. A key of up to walk_rows candidates is walked as
    a sorted stream, which holds the shared values of that key alone. Larger
    keys are decided in rounds: a candidate that comes first in all its groups
    is kept, those that share with it go, the rest stays for the next round. So
    no such key is sorted or held in one task; a round ends at least one
    candidate of each key, and most in practice. Both ways keep the same rows.
    """
    sizes = materialize(candidates.groupBy(*keys).agg((F.count("*") > walk_rows).alias("__many")), "key-sizes")
    many = sizes.where("__many").select(*keys)
    if many.limit(1).count() == 0:
        return _walk_independent(candidates, keys, order, shared)
    few = _walk_independent(candidates.join(many, keys, "left_anti"), keys, order, shared)
    return few.unionByName(_independent_in_rounds(candidates.join(many, keys, "left_semi").select(*candidates.columns), keys, order, shared))


def _walk_independent(candidates: DataFrame, keys: list[str], order: list[str], shared: list[str]) -> DataFrame:
    def walk(batches):
        current, seen = None, []
        for batch in batches:
            keep = []
            for key, values in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in shared), strict=True), strict=True):
                if key != current:
                    current, seen = key, [set() for _ in shared]
                mine = not any(v is not None and v in s for v, s in zip(values, seen, strict=True))
                if mine:
                    for v, s in zip(values, seen, strict=True):
                        s.add(v)
                keep.append(mine)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return candidates.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(walk, candidates.schema)


def _independent_in_rounds(candidates: DataFrame, keys: list[str], order: list[str], shared: list[str]) -> DataFrame:
    names, at = candidates.columns, F.struct(*order)
    left, kept = candidates.withColumn("__at", at), None
    while True:
        marked = left
        for n, column in enumerate(shared):
            first = left.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.min("__at").alias(f"__first{n}"))
            marked = marked.join(first, [*keys, column], "left")
        leads = F.lit(True)
        for n in range(len(shared)):
            leads = leads & F.coalesce(F.col("__at") == F.col(f"__first{n}"), F.lit(True))
        marked = materialize(marked.select(*names, "__at", leads.alias("__leads")), "independent")
        won = marked.where("__leads")
        rest = marked.where("not __leads").drop("__leads")
        for column in shared:
            rest = rest.join(won.select(*keys, column).distinct(), [*keys, column], "left_anti")
        kept = won.select(*names) if kept is None else kept.unionByName(won.select(*names))
        left = materialize(rest.select(*names, "__at"), "undecided")
        if left.limit(1).count() == 0:
            return kept


def by_policy(candidates: DataFrame, keys: list[str], value: str, order: list[Column], strategy: str, tolerance: float = 0.0, quorum: int = 2, conflict_on_disagreement: bool = True, keep_last: bool = True) -> DataFrame:
    """Decide one value per key from independent candidates (CDC-2, CDC-3).

    Values that are nearly equal to a group's first one, in the order of
    `order` (best first), join that group; null values take no part. strategy:
    authoritative or ordered_fallback (the best candidate), quorum (the
    greatest group of at least `quorum`, the first of equals), human_review.
    candidates come from `independent`, so a key has no more of them than there
    are kinds of source, which bounds its array.

    Returns keys, outcome (release, conflict, withhold,
    continue_last_known_good), value, n_supporting, n_groups and reason.
    """
    if strategy not in {"authoritative", "ordered_fallback", "quorum", "human_review"}:
        raise ValueError(f"unknown strategy {strategy}")
    item = F.when(F.col(value).isNotNull(), F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)], F.col(value).cast("double").alias("v")))
    lists = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    near = lambda a, b: F.abs(a - b) <= tolerance

    def add(groups: Column, x: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: near(g["v"], x["v"])), True)
        grown = F.transform(groups, lambda g, i: F.struct(g["v"].alias("v"), (g["n"] + F.when(i + 1 == at, 1).otherwise(0)).alias("n")))
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(F.struct(x["v"].alias("v"), F.lit(1).alias("n")))))

    none = F.expr("cast(array() as array<struct<v:double,n:int>>)")
    grouped = lists.withColumn("__groups", F.aggregate("__items", none, add))
    most = F.array_max(F.transform("__groups", lambda g: g["n"]))
    winner = F.filter("__groups", lambda g: (g["n"] >= quorum) & (g["n"] == most))
    best = F.try_element_at("__items", F.lit(1))["v"]
    fallback = F.lit("continue_last_known_good" if keep_last else "withhold")
    nothing, several = F.size("__items") == 0, F.size("__groups") > 1
    disagree = several & F.lit(conflict_on_disagreement)
    unmet = F.lit(strategy == "quorum") & (F.size(winner) == 0)
    review = F.lit(strategy == "human_review")
    outcome = F.when(nothing, fallback).when(review, F.when(several, "conflict").otherwise("withhold")).when(disagree, "conflict").when(unmet, fallback).otherwise("release")
    met = {"authoritative": "highest_authority", "ordered_fallback": "fallback_selected", "quorum": "quorum_met", "human_review": "human_review"}[strategy]
    reason = F.when(nothing, "no_candidate").when(review, "human_review").when(disagree, "disagreement").when(unmet, "quorum_not_met").otherwise(met)
    chosen = F.try_element_at(winner, F.lit(1))["v"] if strategy == "quorum" else best
    out = grouped.withColumn("outcome", outcome).withColumn("value", F.when(F.col("outcome") == "release", chosen))
    supporting = F.size(F.filter("__items", lambda x: near(x["v"], F.col("value"))))
    if strategy == "quorum":
        supporting = F.try_element_at(winner, F.lit(1))["n"]
    n = F.when(F.col("outcome") == "release", supporting).otherwise(0).cast("long")
    return out.select(*keys, "outcome", "value", n.alias("n_supporting"), F.size("__groups").cast("long").alias("n_groups"), reason.alias("reason"))


def _cell(value: Column, absolute: float, percent: float) -> Column:
    """A whole number that differs by at most 1 between values within the tolerance of each other."""
    share, slack = percent / 100, 1 + 1e-9
    if share >= 1:
        return F.lit(0).cast("long")
    if absolute > 0 and share == 0:
        return F.floor(value / (absolute * slack))
    # Both ends of a relative tolerance lie within -log(1 - share) of each other on a log scale.
    width = -math.log1p(-share) * slack if share else 1.0
    if absolute > 0:
        return F.floor(F.signum(value) * F.log1p(F.abs(value) / absolute) / max(width, slack))
    far = 4_000_000_000
    scaled = F.floor(F.log(F.abs(value)) / width)
    return F.when(value == 0, 0).when(value > 0, scaled + far).otherwise(-scaled - far).cast("long")


def equivalence_groups(candidates: DataFrame, keys: list[str], order: list[str], value: str, rule: dict, walk_rows: int = 1_000_000) -> DataFrame:
    """Add the value of the group that each candidate belongs to, and the group's size (CDC-2): group_value, group_size.

    Walking a key's candidates by `order` (unique within the key), one joins the
    earliest group whose first value, its leader, is equivalent under FN-18's
    rule, else it leads a new group. Equivalence within a tolerance is not
    transitive, so the order matters.

    Exact, text and set rules have a canonical form, so the groups are plain
    aggregates. For numbers, a key of up to walk_rows candidates is walked as a
    sorted stream. For larger keys, values are dealt to cells so that
    equivalents lie in the same or the next cell. In rounds, the first candidate
    of a cell leads if the cells beside it hold no earlier one; those it covers
    take no further part. So no such key is sorted or held in one task, and a
    chain of candidates ends after as many rounds as their order turns. Both
    ways give the same groups. Nulls and NaN are in no group and come back with
    nulls.
    """
    kind = rule["kind"]
    absolute, percent = rule.get("absolute", 0.0), rule.get("percent", 0.0)
    at = F.struct(*order)
    same_keys = lambda n: [F.col(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)]
    if kind != "numeric" or (absolute == 0 and percent == 0):
        form = canonical(F.col(value), rule) if kind != "numeric" else F.col(value)
        work = candidates.withColumn("__form", form)
        there = work.where(F.col(value).isNotNull())
        first = there.groupBy(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__form").alias("__f")).agg(F.min_by(value, at).alias("group_value"), F.count("*").alias("group_size"))
        on = reduce(and_, same_keys(0), F.col("__form") == F.col("__f")) & F.col(value).isNotNull()
        return work.join(first, on, "left").select(*candidates.columns, "group_value", "group_size")
    names, marks = [f"__k{n}" for n in range(len(keys))], [f"__o{n}" for n in range(len(order))]
    number = F.col(value).cast("double")
    points = candidates.where(number.isNotNull() & ~F.isnan(number)).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(o).alias(m) for o, m in zip(order, marks, strict=True)], number.alias("__v"))
    same = lambda n: F.col(f"__a.{n}").eqNullSafe(F.col(f"__b.{n}"))
    sizes = materialize(points.groupBy(*names).agg((F.count("*") > walk_rows).alias("__many")), "key-sizes")
    many = sizes.where("__many")
    on = reduce(and_, [same(n) for n in names])
    if many.limit(1).count():
        few = _walked(points.alias("__a").join(many.alias("__b"), on, "left_anti"), names, marks, rule)
        own = few.unionByName(_in_rounds(points.alias("__a").join(many.alias("__b"), on, "left_semi"), names, marks, rule))
    else:
        own = _walked(points, names, marks, rule)
    own = materialize(own, "members")
    counts = own.groupBy(*names, "__lead").agg(F.count("*").alias("group_size"))
    sized = own.alias("__a").join(counts.alias("__b"), on & (F.col("__a.__lead") == F.col("__b.__lead")))
    sized = sized.select(*[F.col(f"__a.{n}").alias(n) for n in (*names, *marks)], F.col("__a.__lead").alias("group_value"), "group_size")
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip((*keys, *order), (*names, *marks), strict=True)])
    return candidates.join(sized, on, "left").select(*candidates.columns, "group_value", "group_size")


def _walked(points: DataFrame, names: list[str], marks: list[str], rule: dict) -> DataFrame:
    """points with __lead, by a walk of each key in one task, which holds the leaders of one key."""
    absolute, percent = rule.get("absolute", 0.0), rule.get("percent", 0.0)

    def near(a: float, b: float) -> bool:
        gap = abs(a - b)
        return gap <= absolute or gap / max(abs(a), abs(b), 2.220446049250313e-16) * 100 <= percent

    def walk(batches):
        current, values, first = None, [], {}
        for batch in batches:
            keyed = list(zip(*[batch[n].astype(object).where(batch[n].notna(), None) for n in names], strict=True))
            found = []
            for key, v in zip(keyed, batch["__v"], strict=True):
                if key != current:
                    current, values, first = key, [], {}
                i = bisect_left(values, v)
                # Leaders are apart, so below 100 percent only the next one on each side can be near.
                close = [x for x in (values[max(0, i - 1) : i + 1] if percent < 100 else values) if near(x, v)]
                lead = min(close, key=first.__getitem__, default=None)
                if lead is None:
                    lead = v
                    values.insert(i, v)
                    first[v] = len(first)
                found.append(lead)
            batch["__lead"] = found
            yield batch

    schema = T.StructType([*points.schema.fields, T.StructField("__lead", T.DoubleType())])
    return points.repartition(*[F.col(n) for n in names]).sortWithinPartitions(*names, *marks).mapInPandas(walk, schema)


def _in_rounds(points: DataFrame, names: list[str], marks: list[str], rule: dict) -> DataFrame:
    """points with __lead, by rounds of aggregates and joins over cells; no key is held or sorted in one task."""
    points = materialize(points.withColumn("__at", F.struct(*marks)).withColumn("__cell", _cell(F.col("__v"), rule.get("absolute", 0.0), rule.get("percent", 0.0))), "points")
    left, leaders = points, None
    beside = F.explode(F.array(F.col("__cell") - 1, F.col("__cell"), F.col("__cell") + 1))

    def meet(rows: DataFrame, leads: DataFrame, how: str, extra: Column | None = None) -> DataFrame:
        """Rows beside the leaders that cover them."""
        spread = leads.select(*[F.col(n).alias(f"{n}l") for n in names], F.col("__at").alias("__lead_at"), F.col("__v").alias("__lead"), beside.alias("__near"))
        on = reduce(and_, [F.col(n).eqNullSafe(F.col(f"{n}l")) for n in names], F.col("__cell") == F.col("__near"))
        on = on & equivalent(F.col("__lead"), F.col("__v"), rule)
        return rows.join(spread, on if extra is None else on & extra, how)

    while True:
        firsts = left.groupBy(*names, "__cell").agg(F.min(F.struct("__at", "__v")).alias("__first"))
        around = firsts.select(*names, F.col("__first.__at").alias("__at"), beside.alias("__cell")).groupBy(*names, "__cell").agg(F.min("__at").alias("__least"))
        on = reduce(and_, [F.col(f"__a.{n}").eqNullSafe(F.col(f"__b.{n}")) for n in names], F.col("__a.__cell") == F.col("__b.__cell"))
        won = firsts.alias("__a").join(around.alias("__b"), on).where(F.col("__a.__first.__at") == F.col("__b.__least"))
        won = materialize(won.select(*[F.col(f"__a.{n}").alias(n) for n in names], F.col("__a.__cell").alias("__cell"), F.col("__a.__first.__at").alias("__at"), F.col("__a.__first.__v").alias("__v")), "leaders")
        leaders = won if leaders is None else leaders.unionByName(won)
        rest = materialize(meet(left, won, "left_anti"), "points")
        if left is not points:
            discard(left)
        left = rest
        if left.limit(1).count() == 0:
            break
    # A leader covers itself, so every point meets one.
    met = meet(points, leaders, "inner", F.col("__lead_at") <= F.col("__at"))
    own = met.groupBy(*names, *marks, "__v").agg(F.min(F.struct("__lead_at", "__lead"))["__lead"].alias("__lead"))
    return own


def reconcile_candidates(candidates: DataFrame, policies: DataFrame, keys: list[str], predicate: str, order: list[str], shared: list[str], priority: str, observed: str, observation: str, value: str, rule: dict) -> tuple[DataFrame, DataFrame]:
    """Decide one value per key under its predicate's policy (CDC-1 to CDC-3, CDC-10).

    candidates: trust_state and fresh beside the named columns; `predicate` is
    one of the keys, `order` (unique within a key) is the order in which
    independence is walked, `observation` is unique within a key. policies, one
    row per predicate: strategy (authoritative, ordered_fallback, quorum,
    human_review), quorum, open_conflict, keep_last. Only candidates that are
    verified, fresh and have a value are looked at; of these the independent
    ones (`independent`) are eligible. They are ranked by priority (nulls last),
    then the latest observed, then the observation, and grouped in that order
    (`equivalence_groups`).

    Returns decisions, one row per key: outcome (release, conflict, withhold,
    continue_last_known_good), value and observation selected, n_eligible,
    n_groups, n_supporting, n_rejected, reasons, opens_conflict and opened_at;
    and roles, the keys, observation, role (supporting, eligible, rejected) and
    why a candidate was rejected. A predicate without a policy gives blocked,
    reason no_policy. Keys are not null.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    number = F.col(value).cast("double")
    why = (
        F.when(~flag(F.col("trust_state") == "verified"), "not_verified").when(~flag(F.col("fresh")), "stale").when(number.isNull() | F.isnan(number), "no_value")
    )
    judged = candidates.withColumn("__why", why)
    kept = independent(judged.where(F.col("__why").isNull()).select(*[c for c in dict.fromkeys([*keys, *order, *shared, priority, observed, observation, value])]), keys, order, shared)
    none = 1 << 53
    ranked = kept.withColumn("__priority", F.coalesce(F.col(priority).cast("long"), F.lit(none))).withColumn("__late", -F.unix_micros(F.col(observed).cast("timestamp")))
    by = ["__priority", "__late", observation]
    grouped = materialize(equivalence_groups(ranked, keys, by, value, rule), "eligible")
    rank = F.struct(*by)
    groups = grouped.groupBy(*keys, "group_value").agg(F.count("*").alias("__size"), F.min(F.struct(rank.alias("at"), F.col(value).alias("value"), F.col(observation).alias("observation"))).alias("__first"), F.max(observed).alias("__last"))
    # The largest group wins, of equal ones the first; a struct's maximum takes the smallest place by its negation.
    size = F.struct(F.col("__size").alias("n"), (-F.col("__first.at.__priority")).alias("p"), (-F.col("__first.at.__late")).alias("l"))
    most = F.max_by(F.struct("__first", "__size", "group_value"), size)
    per_key = groups.groupBy(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)]).agg(
        F.sum("__size").alias("n_eligible"), F.count("*").alias("n_groups"), F.min_by(F.struct("__first", "__size", "group_value"), F.col("__first")).alias("__best"), most.alias("__most"), F.max("__last").alias("opened_at")
    )
    total = candidates.groupBy(*keys).agg(F.count("*").alias("__all"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)])
    policy = policies.select(F.col(predicate).alias("__predicate"), "strategy", "quorum", "open_conflict", "keep_last")
    rows = total.join(per_key, same, "left").join(policy, F.col(predicate) == F.col("__predicate"), "left")
    fallback = F.when(flag(F.col("keep_last")), "continue_last_known_good").otherwise("withhold")
    several = F.col("n_groups") > 1
    is_, nothing, unknown = lambda name: F.col("strategy") == name, F.col("n_eligible").isNull(), F.col("strategy").isNull()
    disagree = several & flag(F.col("open_conflict"))
    unmet = is_("quorum") & (F.col("__most.__size") < F.coalesce("quorum", F.lit(2)))
    outcome = (
        F.when(unknown, "blocked").when(nothing, fallback).when(is_("human_review"), F.when(several, "conflict").otherwise("withhold")).when(disagree, "conflict").when(unmet, fallback).otherwise("release")
    )
    reasons = (
        F.when(unknown, F.array(F.lit("no_policy")))
        .when(nothing, F.array(F.lit("no_fresh_verified_candidate")))
        .when(is_("human_review"), F.array(F.lit("human_review_required")))
        .when(disagree, F.array_compact(F.array(F.lit("verified_source_disagreement"), F.when(flag(F.col("keep_last")), F.lit("continue_last_known_good")))))
        .when(unmet, F.array(F.lit("independent_quorum_not_met")))
        .when(is_("quorum"), F.array(F.lit("independent_quorum_met")))
        .when(is_("authoritative"), F.array(F.lit("highest_authority_verified_source")))
        .otherwise(F.array(F.lit("ordered_fallback_selected")))
    )
    opens = ~unknown & ~nothing & (is_("human_review") | disagree | (unmet & several))
    released = F.col("outcome") == "release"
    chosen = F.when(released, F.when(is_("quorum"), F.col("__most")).otherwise(F.col("__best")))
    decided = rows.withColumn("outcome", outcome).withColumn("__chosen", chosen)
    decisions = decided.select(
        *keys,
        "outcome",
        F.col("__chosen.__first.value").alias("value"),
        F.col("__chosen.__first.observation").alias("observation"),
        F.coalesce("n_eligible", F.lit(0)).alias("n_eligible"),
        F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
        F.coalesce("__chosen.__size", F.lit(0)).alias("n_supporting"),
        (F.col("__all") - F.coalesce("n_eligible", F.lit(0))).alias("n_rejected"),
        reasons.alias("reasons"),
        flag(opens).alias("opens_conflict"),
        F.when(opens, F.col("opened_at")).alias("opened_at"),
        F.col("__chosen.group_value").alias("__group"),
    )
    decisions = materialize(decisions, "decisions")
    marks = [F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)]
    members = grouped.select(*marks, F.col(observation).alias("__o"), "group_value")
    roles = judged.select(*keys, observation, "__why").join(members, same & F.col(observation).eqNullSafe(F.col("__o")), "left").drop(*[f"__k{n}" for n in range(len(keys))])
    roles = roles.join(decisions.select(*marks, "__group"), same, "left")
    role = F.when(F.col("__o").isNull(), "rejected").when(F.col("group_value") == F.col("__group"), "supporting").otherwise("eligible")
    reason = F.when(F.col("__o").isNull(), F.coalesce("__why", F.lit("not_independent")))
    return decisions.drop("__group"), roles.select(*keys, observation, role.alias("role"), reason.alias("why"))


def conflict_rows(candidates: DataFrame, keys: list[str], observation: str, value: str, time: str) -> DataFrame:
    """Open conflicts of keys with several values (CDC-4): keys, observation_ids (sorted), n_values, opened_at (the latest time), conflict_id.

    A key's candidates are those of its sources, so the list is short. Null
    values are no candidates; an observation that repeats counts once.
    """
    rows = candidates.where(F.col(value).isNotNull() & F.col(observation).isNotNull())
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(observation).cast("string"))).alias("observation_ids"), F.count_distinct(value).alias("n_values"), F.max(time).alias("opened_at")).where("n_values > 1")
    name = F.concat_ws("|", F.lit("source-conflict"), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.array_join("observation_ids", ","))
    return found.withColumn("conflict_id", F.sha2(name, 256))


def rejected(candidates: DataFrame, eligible: DataFrame, observation: str) -> DataFrame:
    """The candidates that are not eligible (SET-3), by observation id; a null id is never eligible."""
    return candidates.join(eligible.select(observation), observation, "left_anti")
