"""Running a fleet of sources: who may run, what an outcome leads to, stages and roll-backs, replays, the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.quality import failure_streaks
from factloom.operators.release import failed_conditions


def fair_eligibility(candidates: DataFrame, now: Column) -> DataFrame:
    """Add failed, the names of conditions that don't hold, and eligible (PF-10).

    All 17 must hold: the binding is for production and active, or cooling with
    its health and past its cooldown; the core gate is certified and not
    bypassed; the certificate is certified and matches; the source is approved,
    active, public and official, its endpoint approved and public; the policy is
    enabled; health is not failing, and past the cooldown if cooling; quota and
    concurrency have room. A null counts as a condition that doesn't hold, but
    for cooldown_until, where it means that no cooldown has run out, and
    bypass_core, where it means no.
    """
    c, is_ = F.col, lambda name, value: F.col(name) == value
    over = F.coalesce(c("cooldown_until") <= now, F.lit(False))
    runs = is_("binding_lifecycle", "active") | (is_("binding_lifecycle", "cooling") & is_("health_state", "cooling") & over)
    conditions = {
        "binding_kind": is_("binding_kind", "production"),
        "binding_can_run": runs,
        "core_gate": is_("core_gate_status", "certified"),
        "core_not_bypassed": ~F.coalesce(c("bypass_core"), F.lit(False)),
        "certification": is_("certification_status", "certified"),
        "certification_matches": c("certification_matches"),
        "source_approval": is_("source_approval_status", "approved"),
        "source_lifecycle": is_("source_lifecycle", "active"),
        "source_visibility": is_("source_visibility", "public"),
        "source_official": c("source_official"),
        "endpoint_approval": is_("endpoint_approval_status", "approved"),
        "endpoint_public": c("endpoint_public"),
        "policy_enabled": c("policy_enabled"),
        "not_failing": c("health_state") != "failing",
        "cooldown": (c("health_state") != "cooling") | over,
        "quota": c("quota_used") < c("daily_quota"),
        "concurrency": c("active_leases") < c("max_concurrency"),
    }
    return failed_conditions(candidates, conditions)


def outcome_schedule(outcomes: DataFrame, key: str, order: list[str], failed: Column, time: str, attempt: str, threshold: int, interval_ms: int, base_ms: int, most_ms: int, jitter_ms: int = 0, bucket: Column | None = None) -> DataFrame:
    """Add streak, health_state (healthy, cooling, failing) and next_due after each outcome (WN-4, FN-21).

    A source cools after a failure and fails from `threshold` failures in a row
    on. It is due again after an interval and a jitter that depends on the
    attempt alone, or after a failure by the streak's exponential delay, at most
    most_ms. A null outcome counts as success, a null attempt as 0. bucket: see
    ordered.carry.
    """
    out = failure_streaks(outcomes, [key], order, failed, bucket)
    n = F.col("streak")
    state = F.when(n == 0, "healthy").when(n >= threshold, "failing").otherwise("cooling")
    jitter = F.pmod(F.coalesce(F.col(attempt), F.lit(0)).cast("long") * F.lit(2654435761).cast("long"), F.lit(jitter_ms).cast("long")) if jitter_ms else F.lit(0).cast("long")
    delay = F.least(F.lit(float(most_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(n - 1, F.lit(60)))).cast("long")
    wait = F.when(n > 0, delay).otherwise(F.lit(interval_ms).cast("long") + jitter)
    return out.withColumn("health_state", state).withColumn("next_due", F.timestamp_micros(F.unix_micros(F.col(time).cast("timestamp")) + wait * 1000))


def stage_passes(runs: DataFrame, stage: str, held_out_stage: str) -> DataFrame:
    """Add passes: whether a canary stage's counts meet its thresholds (DQ-9).

    runs: total_cases, passed_cases, critical_failures, false_events,
    extraction_ok, events_ok, identity_stable, schema_compatible,
    mapping_compatible and the thresholds minimum_pass_rate,
    maximum_critical_failures, maximum_false_events, require_identity_stable,
    require_held_out_pass. No cases are a rate of 0; a null is a no, also where
    a threshold is null, but a requirement that is null is none.
    """
    c = F.col
    rate = F.coalesce(F.try_divide(c("passed_cases").cast("double"), c("total_cases").cast("double")), F.lit(0.0))
    must = lambda name: F.coalesce(c(name), F.lit(False))
    good = (
        (rate >= c("minimum_pass_rate"))
        & (c("critical_failures") <= c("maximum_critical_failures"))
        & (c("false_events") <= c("maximum_false_events"))
        & c("extraction_ok")
        & c("events_ok")
        & c("schema_compatible")
        & c("mapping_compatible")
        & (~must("require_identity_stable") | must("identity_stable"))
        & (~must("require_held_out_pass") | (c(stage) != held_out_stage) | (c("passed_cases") == c("total_cases")))
    )
    return runs.withColumn("passes", F.coalesce(good, F.lit(False)))


def roll_back(transitions: DataFrame, requests: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transitions that roll a mapping back to a named revision, and the requests that can't be met (WN-7).

    transitions: spec, revision, to_status, at, tie; requests: operation_key,
    active_revision, restore_revision, at; approvals: revision, decision, at,
    tie. A request needs two revisions of one spec, of which the first is in
    force and the second has its latest approval approved. Returns transitions
    (spec, revision, from_status, to_status, operation_key, at), two for each
    request, and the requests with why: unknown_revision, other_spec,
    not_active or not_approved. An operation key that repeats counts once, with
    its smallest request; two requests for one revision that is in force both
    stand, as both were right when the log was read.
    """
    order = F.struct("at", "tie")
    latest = transitions.groupBy("revision").agg(F.max_by("spec", order).alias("spec"), F.max_by("to_status", order).alias("status"))
    verdict = approvals.groupBy("revision").agg(F.max_by("decision", order).alias("decision"))
    once = requests.groupBy("operation_key").agg(F.min(F.struct("at", "active_revision", "restore_revision")).alias("r")).select("operation_key", "r.*")
    side = lambda name: latest.select(F.col("revision").alias(f"{name}_revision"), F.col("spec").alias(f"{name}_spec"), F.col("status").alias(f"{name}_status"))
    rows = once.join(side("active"), "active_revision", "left").join(side("restore"), "restore_revision", "left").join(verdict.withColumnRenamed("revision", "restore_revision"), "restore_revision", "left")
    why = (
        F.when(F.col("active_spec").isNull() | F.col("restore_spec").isNull(), "unknown_revision")
        .when(F.col("active_spec") != F.col("restore_spec"), "other_spec")
        .when(~F.coalesce(F.col("active_status") == "active", F.lit(False)), "not_active")
        .when(~F.coalesce(F.col("decision") == "approved", F.lit(False)), "not_approved")
    )
    rows = rows.withColumn("why", why)
    made = lambda name, to, suffix: F.struct(F.col(f"{name}_spec").alias("spec"), F.col(f"{name}_revision").alias("revision"), F.col(f"{name}_status").alias("from_status"), F.lit(to).alias("to_status"), F.concat("operation_key", F.lit(suffix)).alias("operation_key"), "at")
    both = F.explode(F.array(made("active", "rolled_back", ":rolled-back"), made("restore", "active", ":restored")))
    done = rows.where(F.col("why").isNull()).select(both.alias("t")).select("t.*")
    return done, rows.where(F.col("why").isNotNull()).select("operation_key", "active_revision", "restore_revision", "why")


def replays(requests: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Deliveries to queue again from dead letters (CDC-13), and what became of each request.

    requests: operation_key, delivery_id, batch_key; deliveries: delivery_id,
    subscription_id, event_id, status, delivery_key. The new key names
    subscription, event, replay and batch, so a batch queues a delivery once.
    Returns operation_key, delivery_id, replay_key (null unless queued or there
    already) and state: queued, duplicate (such a key is queued already, or an
    earlier operation of the same requests queues it), not_dead or unknown.
    """
    once = requests.groupBy("operation_key").agg(F.min(F.struct("delivery_id", "batch_key")).alias("r")).select("operation_key", "r.*")
    rows = once.join(deliveries.select("delivery_id", "subscription_id", "event_id", "status", F.lit(True).alias("__there")), "delivery_id", "left")
    dead = F.coalesce(F.col("status") == "dead_letter", F.lit(False))
    key = F.when(dead, F.concat_ws(":", F.col("subscription_id").cast("string"), F.col("event_id").cast("string"), F.lit("replay"), "batch_key"))
    rows = rows.withColumn("replay_key", key)
    first = rows.where(F.col("replay_key").isNotNull()).groupBy("replay_key").agg(F.min("operation_key").alias("__first"))
    stored = deliveries.select(F.col("delivery_key").alias("replay_key"), F.lit(True).alias("__stored")).distinct()
    rows = rows.join(first, "replay_key", "left").join(stored, "replay_key", "left")
    state = F.when(F.col("__there").isNull(), "unknown").when(~dead, "not_dead").when(F.col("__stored") | (F.col("operation_key") != F.col("__first")), "duplicate").otherwise("queued")
    return rows.select("operation_key", "delivery_id", "replay_key", state.alias("state"))


def catalog(sources: DataFrame, endpoints: DataFrame, collectors: DataFrame, certifications: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The public catalog of sources and the rows that are not consistent with it (JN-16).

    sources: source_id, lifecycle, visibility; endpoints: endpoint_id,
    source_id, public; collectors: collector_id; certifications and bindings:
    id, collector_id, source_id, endpoint_id. A source is shown if it is public
    and in a known state, an endpoint if it and its source are. A certification
    or binding needs a known collector and a shown endpoint of its own shown
    source; a binding may also name neither (a regression binding).

    Returns rows (kind, id, source_id, why; why null for those shown) of
    endpoints, certifications and bindings, and per shown source n_endpoints,
    n_certifications and n_bindings. Nulls in flags count as no.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    shown = sources.where(yes(F.col("visibility") == "public") & F.col("lifecycle").isin("draft", "onboarding", "active", "paused", "retired")).select(F.col("source_id").alias("__source")).distinct()
    ends = endpoints.join(shown, F.col("source_id") == F.col("__source"), "left")
    ends = ends.select("endpoint_id", "source_id", F.when(F.col("__source").isNull(), "source_not_shown").when(~yes(F.col("public")), "not_public").alias("why"))
    known = ends.where(F.col("why").isNull()).select(F.col("endpoint_id").alias("__endpoint"), F.col("source_id").alias("__owner")).distinct()
    workers = collectors.select(F.col("collector_id").alias("__collector")).distinct()

    def judged(rows: DataFrame, kind: str, may_be_free: bool) -> DataFrame:
        out = rows.join(workers, F.col("collector_id") == F.col("__collector"), "left").join(shown, F.col("source_id") == F.col("__source"), "left").join(known, F.col("endpoint_id") == F.col("__endpoint"), "left")
        free = F.col("source_id").isNull() & F.col("endpoint_id").isNull() if may_be_free else F.lit(False)
        why = (
            F.when(F.col("__collector").isNull(), "unknown_collector")
            .when(free, None)
            .when(F.col("__source").isNull(), "source_not_shown")
            .when(F.col("__endpoint").isNull(), "endpoint_not_shown")
            .when(F.col("__owner") != F.col("source_id"), "endpoint_of_other_source")
        )
        return out.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "source_id", why.alias("why"))

    rows = ends.select(F.lit("endpoint").alias("kind"), F.col("endpoint_id").cast("string").alias("id"), "source_id", "why")
    rows = rows.unionByName(judged(certifications, "certification", False)).unionByName(judged(bindings, "binding", True))
    good = rows.where(F.col("why").isNull() & F.col("source_id").isNotNull())
    counts = good.groupBy(F.col("source_id").alias("__id")).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("endpoint", "certification", "binding")])
    listed = shown.join(counts, F.col("__source") == F.col("__id"), "left")
    return rows, listed.select(F.col("__source").alias("source_id"), *[F.coalesce(f"n_{k}s", F.lit(0)).alias(f"n_{k}s") for k in ("endpoint", "certification", "binding")])
