"""What may be released: the price contract, observation checks, risk rules, stage gates and event states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.quality import gate

# Words of the price contract.
POSITIVE_CONTEXT = ["purchase price", "one-time", "buy now"]
FORBIDDEN_CONTEXT = ["per month", "monthly", "financing", "split the total"]

# Risk rules of a selector, as label, points and pattern.
RISK_RULES = [
    ("semantic_anchor", 25, r"(?i)aria-label|purchase-heading|one-time|buy now"),
    ("structured_source", 25, r"(?i)jsonld|product_api|tag_response"),
    ("context_validation", 20, r"(?i)monthly|financing|purchase_context|nearby_text"),
    ("positional_selector", -20, r"(?i)nth-child|nth-of-type"),
    ("generated_class", -15, r"(?i)\._?next|__[A-Za-z0-9_-]{5,}|class\*?="),
    ("broad_number", -20, r"(?i)\$\(\"body\"\)|document\.body|first\(\).*\d"),
]
RISK_PASS = 40


def price_contract(prices: DataFrame, tolerance: float = 0.01, ratio: float = 0.5) -> DataFrame:
    """Decide on observed purchase prices (DQ-2, DQ-3, DQ-4).

    prices: observed, monthly, channel_a, channel_b (two independent channels),
    context (text around the price) and previous (last verified value, may be
    null). Adds decision, violations, released_value (observed if verified, else
    previous), proof_state (verified, stale, or the decision) and alert (sent,
    blocked or not_triggered for a price below the previous one). A missing
    number or context violates its rules.
    """
    text = F.lower("context")
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    swapped = ~has(POSITIVE_CONTEXT) | has(FORBIDDEN_CONTEXT) | near("observed", "monthly")
    jump = F.col("previous").isNotNull() & F.coalesce(F.try_divide(F.abs(F.col("observed") - F.col("previous")), F.col("previous")) >= ratio, F.lit(False))
    out = gate(
        prices,
        {"semantic_swap": swapped, "source_disagreement": ~near("channel_a", "channel_b"), "independent_source_mismatch": ~(near("observed", "channel_a") & near("observed", "channel_b"))},
        {"historical_delta": jump},
    )
    fine = F.col("decision") == "verified"
    dropped = F.coalesce(F.col("observed") < F.col("previous"), F.lit(False))
    return (
        out.withColumn("released_value", F.when(fine, F.col("observed")).otherwise(F.col("previous")))
        .withColumn("proof_state", F.when(fine, "verified").when(F.col("previous").isNotNull(), "stale").otherwise(F.col("decision")))
        .withColumn("alert", F.when(~dropped, "not_triggered").when(fine, "sent").otherwise("blocked"))
    )


def risk_score(df: DataFrame, text: str) -> DataFrame:
    """Add risk_score, risk_status (pass, needs_review, deferred without text) and matched_rules (DQ-6)."""
    source = F.col(text)
    hit = lambda pattern: F.coalesce(source.rlike(pattern), F.lit(False))
    rules = F.array_compact(F.array(*[F.when(hit(p), F.lit(label)) for label, _, p in RISK_RULES]))
    # The score reads the matched labels, so each pattern runs once.
    score = sum((F.when(F.array_contains("matched_rules", label), points).otherwise(0) for label, points, _ in RISK_RULES), F.lit(0))
    empty = source.isNull() | (source == "")
    out = df.withColumn("matched_rules", rules).withColumn("risk_score", score)
    return out.withColumn("risk_status", F.when(empty, "deferred").when(F.col("risk_score") >= RISK_PASS, "pass").otherwise("needs_review"))


def check_observations(observations: DataFrame, policies: DataFrame) -> DataFrame:
    """Add violations and decision (invalid, quarantined, verified) to nested observations (DQ-1, PF-2).

    observations: source_type, url, records (array of structs with kind and
    key), contexts (array of texts), content_hash; policies: source_type, host,
    kind and prefixes (array of paths), one row for each source_type and host.
    The hash is that of the contexts joined by line feeds. A missing type, url
    or empty records is invalid.
    """
    host, path = F.lower(F.try_parse_url("url", F.lit("HOST"))), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    known = policies.select(F.col("source_type"), F.col("host").alias("__host"), F.col("kind").alias("__kind"), F.col("prefixes").alias("__prefixes"))
    out = observations.withColumn("__host", host).join(known, ["source_type", "__host"], "left")
    allowed = F.coalesce(F.exists("__prefixes", lambda p: path.startswith(p)), F.lit(False))
    kinds = F.coalesce(F.forall("records", lambda r: F.col("__kind").isNull() | (r["kind"] == F.col("__kind"))), F.lit(False))
    names = F.transform("records", lambda r: F.concat_ws(":", r["kind"], r["key"].cast("string")))
    same = F.col("content_hash").eqNullSafe(F.sha2(F.array_join("contexts", "\n"), 256))
    invalid = F.col("source_type").isNull() | F.col("url").isNull() | (F.coalesce(F.size("records"), F.lit(0)) <= 0)
    found = F.array_compact(
        F.array(
            F.when(~allowed, "source_policy_mismatch"), F.when(~kinds, "record_type_mismatch"), F.when(F.size(names) != F.size(F.array_distinct(names)), "duplicate_source_key"), F.when(~same, "evidence_hash_mismatch")
        )
    )
    out = out.withColumn("violations", F.when(invalid, F.array(F.lit("schema_invalid"))).otherwise(found))
    decision = F.when(invalid, "invalid").when(F.size("violations") > 0, "quarantined").otherwise("verified")
    return out.withColumn("decision", decision).drop("__host", "__kind", "__prefixes")


def failed_conditions(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Add failed (names of conditions that are not true; null counts as false) and eligible (PF-8, PF-10)."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
    return df.withColumn("failed", names).withColumn("eligible", F.size("failed") == 0)


def stage_gate(results: DataFrame, key: str, stage: str, passed: Column, held_out: Column, critical: Column, required: list[str]) -> DataFrame:
    """Whether each subject may be released (AG-4, AG-15, DQ-10, SET-4).

    Needs every required stage passed at least once, a held-out case and no
    critical failure. Returns key, n_cases, n_passed, n_critical, missing
    (array of required stages, in order) and can_release. Only flags are
    aggregated, so a hot key needs no list.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = [F.max(yes((F.col(stage) == s) & passed)).alias(f"__s{n}") for n, s in enumerate(required)]
    out = results.groupBy(key).agg(F.count("*").alias("n_cases"), F.count_if(passed).alias("n_passed"), F.count_if(critical).alias("n_critical"), F.max(yes(held_out)).alias("__held"), *flags)
    missing = F.array_compact(F.array(*[F.when(~F.col(f"__s{n}"), F.lit(s)) for n, s in enumerate(required)]))
    out = out.withColumn("missing", missing)
    can = (F.size("missing") == 0) & F.col("__held") & (F.col("n_critical") == 0)
    return out.select(key, "n_cases", "n_passed", "n_critical", "missing", can.alias("can_release"))


def fleet_summary(results: DataFrame, suite: str) -> DataFrame:
    """Totals of test suites (AG-2, AG-3): results have kind, passed, expected, observed, held_out, duration_ms (integer).

    Returns suite, n_cases, n_passed, n_false_events (observed differs from
    expected), total_ms, n_kinds, precision and recall of events (1 where there
    is nothing to find), held_out_passed and passed (all, with a held-out case).
    """
    good = F.coalesce(F.col("passed"), F.lit(False)) & F.col("expected").eqNullSafe(F.col("observed"))
    hits = F.least("expected", "observed")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    held = F.coalesce(F.col("held_out"), F.lit(False))
    out = results.groupBy(suite).agg(
        F.count("*").alias("n_cases"),
        F.count_if(good).alias("n_passed"),
        F.count_if(~F.col("expected").eqNullSafe(F.col("observed"))).alias("n_false_events"),
        F.sum("duration_ms").alias("total_ms"),
        F.count_distinct("kind").alias("n_kinds"),
        ratio(F.sum(hits), F.sum("observed")).alias("precision"),
        ratio(F.sum(hits), F.sum("expected")).alias("recall"),
        F.count_if(held).alias("__held"),
        F.count_if(held & ~good).alias("__held_bad"),
    )
    out = out.withColumn("held_out_passed", (F.col("__held") > 0) & (F.col("__held_bad") == 0))
    return out.withColumn("passed", F.col("held_out_passed") & (F.col("n_passed") == F.col("n_cases"))).drop("__held", "__held_bad")


def semantic_events(changes: DataFrame, keys: list[str], same: Column, needed_absences: int = 2, need_statement: bool = True, need_approval: bool = False) -> DataFrame:
    """Class of each reconciled change (CDC-5, CDC-6, CDC-9).

    changes: before_value, after_value, conflicted, intent (text or null),
    explicit_removal, n_absences, approved, before_look, after_look (hashes of
    the presentation). same: a column of equivalence, null is false; it is
    tested before removal. Adds event_type (null: no event), business_event and
    event_id. A removal that the policy doesn't allow gives no event.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    before, after = F.col("before_value"), F.col("after_value")
    equal = before.isNotNull() & yes(same)
    drifted = yes(F.col("before_look") != F.col("after_look"))
    removal = yes(F.col("intent") == "removal") | yes(F.col("explicit_removal"))
    allowed = yes(F.col("n_absences") >= needed_absences)
    if need_statement:
        allowed = allowed & yes(F.col("explicit_removal"))
    if need_approval:
        allowed = allowed & yes(F.col("approved"))
    by_intent = F.when(before.isNull(), "fact_created")
    for intent, kind in {"correction": "fact_corrected", "rename": "entity_renamed", "deprecation": "entity_deprecated", "reactivation": "entity_reactivated"}.items():
        by_intent = by_intent.when(F.col("intent") == intent, kind)
    kind = (
        F.when(yes(F.col("conflicted")), "source_conflict_started")
        .when(after.isNull(), None)
        .when(equal & drifted, "presentation_drift")
        .when(equal, None)
        .when(removal & ~allowed, None)
        .otherwise(by_intent.when(removal, "fact_removed").otherwise("fact_updated"))
    )
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, "event_type", "before_value", "after_value")]
    out = changes.withColumn("event_type", kind)
    out = out.withColumn("business_event", F.col("event_type").isNotNull() & (F.col("event_type") != "presentation_drift"))
    return out.withColumn("event_id", F.when(F.col("event_type").isNotNull(), F.sha2(F.concat_ws("|", *text), 256)))


def retract_and_correct(events: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event states and correction events after a log of operations (CDC-8).

    events: event_id, value; operations: operation_id, event_id, at, value
    (null: retraction only). Repeated operation_ids count once (the smallest
    at); an event is retracted by its first operation, later ones do nothing;
    unknown events are left alone. Returns events with state (released,
    retracted, corrected) and corrections (event_id, corrects, value).
    """
    once = operations.groupBy("operation_id").agg(F.min(F.struct("at", "event_id", "value")).alias("o")).select("operation_id", "o.*")
    first = once.groupBy("event_id").agg(F.min(F.struct("at", "operation_id", "value")).alias("__op"))
    state = F.when(F.col("__op").isNull(), "released").when(F.col("__op.value").isNull(), "retracted").otherwise("corrected")
    joined = events.join(first, "event_id", "left").withColumn("state", state)
    fixed = joined.where("state = 'corrected'")
    made = F.sha2(F.concat_ws("|", F.lit("correction"), F.col("event_id").cast("string"), F.col("__op.operation_id").cast("string")), 256)
    return joined.drop("__op"), fixed.select(made.alias("event_id"), F.col("event_id").alias("corrects"), F.col("__op.value").alias("value"))


def first_rule(candidates: DataFrame, rules: DataFrame, on: list[str], ordinal: str, take: list[str]) -> DataFrame:
    """Add `take` of the first rule that matches each row (JN-7); a null in a rule's column matches anything; null if none does.

    Each row looks up its 2^n wildcard forms by an equi-join and keeps the rule
    of the smallest ordinal, in one aggregate over distinct candidate values; no
    table is broadcast by force and no pair is tried in vain. A null value of a
    row matches wildcards only.
    """
    values = candidates.select(*on).distinct()
    forms = None
    for mask in range(2 ** len(on)):
        wild = [bool(mask >> n & 1) for n in range(len(on))]
        key = F.concat_ws("|", *[F.lit("*") if w else F.concat(F.lit("="), F.base64(F.encode(F.col(c).cast("string"), "UTF-8"))) for w, c in zip(wild, on)])
        usable = F.lit(True)
        for w, c in zip(wild, on):
            usable = usable if w else usable & F.col(c).isNotNull()
        forms = F.array(F.when(usable, key)) if forms is None else F.concat(forms, F.array(F.when(usable, key)))
    exploded = values.withColumn("__key", F.explode(F.array_compact(forms)))
    rule_key = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.base64(F.encode(F.col(c).cast("string"), "UTF-8"))), F.lit("*")) for c in on])
    best = rules.groupBy(rule_key.alias("__key")).agg(F.min(F.struct(F.col(ordinal).alias("__o"), *take)).alias("__rule"))
    found = exploded.join(best, "__key").groupBy(*on).agg(F.min("__rule").alias("__rule"))
    renamed = found.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(on)], "__rule")
    same = F.lit(True)
    for n, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{n}"))
    out = candidates.join(renamed, same, "left")
    return out.select(*candidates.columns, *[F.col("__rule")[t].alias(t) for t in take])


def resolve_keys(inputs: DataFrame, levels: list[tuple[str, DataFrame]]) -> DataFrame:
    """Entity of each input by the first level of keys that knows it (JN-3).

    levels: (input column, table with that column and entity_id), strongest
    first. Adds level (from 1, null: new), entity_id (null if ambiguous or new)
    and state: linked, ambiguous (several entities at that level), new.
    """
    out, level, entity, several = inputs, F.lit(None).cast("int"), None, None
    for n, (column, known) in enumerate(levels, start=1):
        owners = known.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("entity_id").alias(f"__low{n}"), F.max("entity_id").alias(f"__high{n}"))
        out = out.join(owners, column, "left")
    low = F.coalesce(*[F.when(F.col(f"__low{n}").isNotNull(), F.struct(F.lit(n).alias("n"), F.col(f"__low{n}").alias("a"), F.col(f"__high{n}").alias("b"))) for n in range(1, len(levels) + 1)])
    out = out.withColumn("__hit", low)
    level, entity, several = F.col("__hit.n"), F.col("__hit.a"), F.col("__hit.a") != F.col("__hit.b")
    state = F.when(level.isNull(), "new").when(several, "ambiguous").otherwise("linked")
    return out.select(*inputs.columns, level.alias("level"), F.when(~several, entity).alias("entity_id"), state.alias("state"))


def proposals(events: DataFrame) -> DataFrame:
    """What a consumer may do about released events (CDC-12), once for each event_id.

    events: event_id, event_type, state, n_evidence. Events that aren't released
    or lack evidence give none; of repeated ids one counts. Returns event_id and
    action: add, deprecate, update or review.
    """
    kind = F.col("event_type")
    action = F.when(kind == "fact_created", "add").when(kind.isin("entity_deprecated", "fact_removed"), "deprecate").when(kind.isin("fact_updated", "fact_corrected"), "update").otherwise("review")
    usable = events.where((F.col("state") == "released") & (F.col("n_evidence") > 0) & F.col("event_id").isNotNull())
    return usable.groupBy("event_id").agg(F.min(action).alias("action"))


def apply_resolutions(conflicts: DataFrame, resolutions: DataFrame, key: str, time: str, tie: str, verdict: str) -> DataFrame:
    """Add status (open, resolved) and the latest resolution of each conflict (CDC-11)."""
    latest = resolutions.groupBy(key).agg(F.max_by(verdict, F.struct(time, tie)).alias("resolution"))
    return conflicts.join(latest, key, "left").withColumn("status", F.when(F.col("resolution").isNull(), "open").otherwise("resolved"))
