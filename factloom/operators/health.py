"""Failure triage, source health, stuck jobs, jumps and schema compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.ordered import carry

# The action for each class of failure.
ACTIONS = {
    "dead_page": "mark_dead", "soft_block": "quarantine", "transport_failure": "retry", "legitimate_empty": "do_not_heal", "semantic_swap": "heal",
    "render_timing": "heal", "ab_variant": "gather_more_evidence", "structural_drift": "heal", "unknown": "human_review",
}


def triage(signals: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Add classification and action: the first class of ACTIONS whose condition holds, else unknown (DQ-5). Null counts as false."""
    kind = F.lit("unknown")
    for name in reversed(list(ACTIONS)):
        if name in conditions:
            kind = F.when(F.coalesce(conditions[name], F.lit(False)), name).otherwise(kind)
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return signals.withColumn("classification", kind).withColumn("action", F.element_at(action, F.col("classification")))


def classify_failure(signals: DataFrame) -> DataFrame:
    """Triage by the nine rules, in their order (DQ-5, AG-7).

    signals: http_status, network_error, page_state, block_markers (array),
    violation_codes (array), field_missing, optional_field, sold_out,
    alternate_evidence, selector_failure, appeared_after_ms, deadline_ms and
    fetches (array of structs with dom_fingerprint and field_present). Nulls
    count as absent. Adds n_variants and n_presences (distinct over the
    fetches), classification, action and requires_repeated_fetch.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    status, state = F.col("http_status"), F.coalesce("page_state", F.lit("unknown"))
    out = signals.withColumn("n_variants", F.coalesce(F.size(F.array_distinct("fetches.dom_fingerprint")), F.lit(0))).withColumn("n_presences", F.coalesce(F.size(F.array_distinct("fetches.field_present")), F.lit(0)))
    conditions = {
        "dead_page": status.isin(404, 410) | (state == "not_found"),
        "soft_block": status.isin(401, 403, 429) | (state == "blocked") | (F.size("block_markers") > 0),
        "transport_failure": F.col("network_error").isNotNull() | (status >= 500),
        "legitimate_empty": has("field_missing") & has("optional_field") & (has("sold_out") | (state == "empty")),
        "semantic_swap": F.array_contains("violation_codes", "semantic_swap"),
        "render_timing": F.col("appeared_after_ms") > F.coalesce("deadline_ms", F.lit(5000)),
        "ab_variant": (F.col("n_variants") > 1) | (F.col("n_presences") > 1),
        "structural_drift": has("field_missing") & (has("selector_failure") | has("alternate_evidence")),
    }
    # A condition that is null in one part may hold by another.
    out = triage(out, {name: _any_true(c) for name, c in conditions.items()})
    few = F.coalesce(F.size("fetches"), F.lit(0)) < 3
    return out.withColumn("requires_repeated_fetch", (F.col("classification") == "ab_variant") | ((F.col("classification") == "unknown") & few))


def _any_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def source_health(observations: DataFrame, source: str, time: str, tie: str, verified: Column) -> DataFrame:
    """State, failures since the last success and totals of each source (AG-8).

    Two aggregations and a join by source, so no source is sorted in one task.
    Returns source, state (healthy, failing), consecutive_failures, n_observations, last_success_at.
    """
    marked = observations.select(source, F.struct(time, tie).alias("__at"), F.coalesce(verified, F.lit(False)).alias("__ok"))
    success = marked.where("__ok").groupBy(source).agg(F.max("__at").alias("__success"))
    joined = marked.join(success, source, "left")
    later = F.col("__success").isNull() | (F.col("__at") > F.col("__success"))
    out = joined.groupBy(source).agg(F.count_if(later).alias("consecutive_failures"), F.count("*").alias("n_observations"), F.max("__success").alias("__success"))
    state = F.when(F.col("consecutive_failures") == 0, "healthy").otherwise("failing")
    return out.select(source, state.alias("state"), "consecutive_failures", "n_observations", F.col(f"__success.{time}").alias("last_success_at"))


def job_states(progress: DataFrame, job: str, time: str, now: Column, idle_seconds: int, total_seconds: int, attempts: int) -> DataFrame:
    """State of each job from its progress log (ST-5): exhausted, timed_out, stuck or active, in this order."""
    out = progress.groupBy(job).agg(F.count("*").alias("n_attempts"), F.min(time).alias("__first"), F.max(time).alias("__last"))
    micros = lambda c: F.unix_micros(c)
    idle, total = micros(now) - micros(F.col("__last")), micros(now) - micros(F.col("__first"))
    state = F.when(F.col("n_attempts") >= attempts, "exhausted").when(total > total_seconds * 1_000_000, "timed_out").when(idle > idle_seconds * 1_000_000, "stuck").otherwise("active")
    return out.select(job, "n_attempts", idle.alias("idle_micros"), state.alias("state"))


def jumps(df: DataFrame, keys: list[str], order: list[str], value: str, verified: Column, ratio: float = 0.5, bucket: Column | None = None) -> DataFrame:
    """Add last_verified (before this row) and jumped: a relative change of at least `ratio` against it (WN-2). bucket: see ordered.carry."""
    out = carry(df, "last_verified", keys, order, F.col(value), verified & F.col(value).isNotNull(), bucket)
    change = F.try_divide(F.abs(F.col(value) - F.col("last_verified")), F.abs("last_verified"))
    return out.withColumn("jumped", F.coalesce(change >= ratio, F.lit(False)))


def schema_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Compatibility of two revisions' fields (AG-9).

    Both have path, data_type, unit, minimum, maximum, required and nullable,
    and may have meaning, enum_values (array), evidence_minimum and aliases
    (array; of `current`, the old paths that a field still answers to).
    Returns path, changes (array) and classification: breaking,
    policy_migration or backward_compatible; fields without a change give no row.
    """
    for name, kind in (("meaning", "string"), ("enum_values", "array<string>"), ("evidence_minimum", "int"), ("aliases", "array<string>")):
        previous, current = (df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind)) for df in (previous, current))
    renamed = current.select(F.explode("aliases").alias("path")).distinct().withColumn("__renamed", F.lit(True))
    answered = current.select(F.col("path").alias("__new"), F.explode("aliases").alias("path")).join(previous.select("path"), "path", "left_semi").select(F.col("__new").alias("path")).distinct().withColumn("__answers", F.lit(True))
    b = previous.select(*[F.col(c).alias(c if c == "path" else f"b_{c}") for c in previous.columns], F.lit(True).alias("__b"))
    a = current.select(*[F.col(c).alias(c if c == "path" else f"a_{c}") for c in current.columns], F.lit(True).alias("__a"))
    differs = lambda c: ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    both = F.col("__a") & F.col("__b")
    wider_low = F.col("a_minimum").isNull() | F.coalesce(F.col("a_minimum") <= F.col("b_minimum"), F.lit(False))
    wider_high = F.col("a_maximum").isNull() | F.coalesce(F.col("a_maximum") >= F.col("b_maximum"), F.lit(False))
    relaxed = (~F.col("a_required") | F.col("a_nullable")) & (F.col("b_required") | ~F.col("b_nullable"))
    added, range_differs, rule_differs = F.col("__b").isNull() & F.col("__answers").isNull(), differs("minimum") | differs("maximum"), differs("required") | differs("nullable")
    values = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    enum_differs = ~F.array_sort(values(F.col("b_enum_values"))).eqNullSafe(F.array_sort(values(F.col("a_enum_values"))))
    lost_value = F.size(F.array_except(values(F.col("b_enum_values")), values(F.col("a_enum_values")))) > 0
    kinds = {
        "field_renamed": (F.col("__a").isNull() & F.col("__renamed"), False),
        "field_removed": (F.col("__a").isNull() & F.col("__renamed").isNull(), True),
        "required_field_added": (added & F.col("a_required") & ~F.col("a_nullable"), True),
        "field_added": (added & (~F.col("a_required") | F.col("a_nullable")), False),
        "type_changed": (both & differs("data_type"), True),
        "meaning_changed": (both & differs("meaning"), True),
        "unit_changed": (both & differs("unit"), True),
        "constraint_relaxed": (both & rule_differs & relaxed, False),
        "constraint_tightened": (both & rule_differs & ~relaxed, True),
        "range_widened": (both & range_differs & wider_low & wider_high, False),
        "range_narrowed": (both & range_differs & ~(wider_low & wider_high), True),
        "enum_widened": (both & enum_differs & ~lost_value, False),
        "enum_narrowed": (both & enum_differs & lost_value, True),
        "evidence_policy_changed": (both & differs("evidence_minimum"), None),
    }
    pick = lambda names: F.array_compact(F.array(*[F.when(kinds[n][0], F.lit(n)) for n in names]))
    rows = b.join(a, "path", "full_outer").join(renamed, "path", "left").join(answered, "path", "left")
    out = rows.select("path", pick(kinds).alias("changes"), pick([n for n in kinds if kinds[n][1]]).alias("__breaking"))
    worst = F.when(F.size("__breaking") > 0, "breaking").when(F.array_contains("changes", "evidence_policy_changed"), "policy_migration").otherwise("backward_compatible")
    return out.where(F.size("changes") > 0).select("path", "changes", worst.alias("classification"))
