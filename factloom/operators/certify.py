"""Repair certification: tribunal checks, case results, the final gate, context and certificate extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.release import price_contract, risk_score


def tribunal(candidates: DataFrame) -> DataFrame:
    """Checks of repair candidates before approval (DQ-7), four rows for each.

    candidates: candidate_id, expected (the last verified price), selector, and
    the columns of price_contract() without previous. Returns candidate_id,
    check (preview_contract, evidence_support, selector_risk, human_review) and
    status (pass, fail, needs_review, deferred).
    """
    rows = risk_score(price_contract(candidates.withColumn("previous", F.col("expected"))), "selector")
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail")
    evidence = (F.col("channel_a") == F.col("expected")) & (F.col("channel_b") == F.col("expected")) & F.contains(F.lower("context"), F.lit("one-time"))
    checks = {
        "preview_contract": yes((F.col("decision") == "verified") & (F.col("observed") == F.col("expected"))),
        "evidence_support": yes(evidence),
        "selector_risk": F.col("risk_status"),
        "human_review": F.lit("needs_review"),
    }
    structs = F.array(*[F.struct(F.lit(name).alias("check"), status.alias("status")) for name, status in checks.items()])
    return rows.select("candidate_id", F.explode(structs).alias("c")).select("candidate_id", "c.check", "c.status")


def case_results(cases: DataFrame) -> DataFrame:
    """Outcomes of collected cases and negative controls (DQ-8).

    cases: case_id, candidate_id, visibility, expected (last known good),
    detected and expected_state (of negative controls) and the columns of
    price_contract() without previous. Adds outcome, false_heal and
    false_release. A case passes if it is verified at the expected value; a
    negative control if its state is the expected one.
    """
    rows = price_contract(cases.withColumn("previous", F.col("expected")))
    control, verified = F.col("visibility") == "negative_control", F.col("decision") == "verified"
    at_value = F.coalesce(F.col("observed") == F.col("expected"), F.lit(False))
    passed = F.when(control, F.coalesce(F.col("detected") == F.col("expected_state"), F.lit(False))).otherwise(verified & at_value)
    return rows.select(*cases.columns, F.when(passed, "pass").otherwise("fail").alias("outcome"), (control & ~passed).alias("false_heal"), (~control & verified & ~at_value).alias("false_release"))


def may_certify(checks: DataFrame, results: DataFrame, approvals: DataFrame, n_cases: int = 8) -> DataFrame:
    """Final gate (DQ-10): approved by a person, every check but human_review passed or deferred, and n_cases cases that all passed.

    checks: candidate_id, check, status; results: candidate_id, outcome;
    approvals: candidate_id, approved. One row for each candidate in approvals:
    n_cases, n_failed, checks_pass and can_release.
    """
    fine = checks.where("check <> 'human_review'").groupBy("candidate_id").agg(F.bool_and(F.coalesce(F.col("status").isin("pass", "deferred"), F.lit(False))).alias("checks_pass"))
    cases = results.groupBy("candidate_id").agg(F.count("*").alias("n_cases"), F.count_if(~F.col("outcome").eqNullSafe("pass")).alias("n_failed"))
    out = approvals.join(fine, "candidate_id", "left").join(cases, "candidate_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.select("candidate_id", F.coalesce("approved", F.lit(False)).alias("approved"), zero(F.col("n_cases")).alias("n_cases"), zero(F.col("n_failed")).alias("n_failed"), F.coalesce("checks_pass", F.lit(True)).alias("checks_pass"))
    return out.withColumn("can_release", F.col("approved") & F.col("checks_pass") & (F.col("n_cases") == n_cases) & (F.col("n_failed") == 0))


def tribunal_context(impacts: DataFrame, conflicts: DataFrame, assessments: DataFrame) -> DataFrame:
    """Context of each assessment (AG-13).

    impacts: assessment_id, kind, target_id, identity_risk; conflicts:
    entity_id, status, independent_group_count; assessments: assessment_id,
    alternate_coverage. Returns assessment_id, field_count, fact_count,
    open_conflict_count, independent_support and identity_change_risk.
    """
    entity = F.col("kind") == "entity"
    counts = impacts.groupBy("assessment_id").agg(
        F.count_if(F.col("kind") == "canonical_field").alias("field_count"), F.count_if(F.col("kind") == "current_fact").alias("fact_count"), F.max(entity & F.col("identity_risk")).alias("identity_change_risk")
    )
    # Conflicts are counted by entity before they meet the impacts.
    open_ = conflicts.where("status = 'open'").groupBy("entity_id").agg(F.count("*").alias("n"), F.max(F.col("independent_group_count") > 1).alias("several"))
    hit = impacts.where(entity).join(open_.withColumnRenamed("entity_id", "target_id"), "target_id").groupBy("assessment_id").agg(F.sum("n").alias("open_conflict_count"), F.max("several").alias("several"))
    out = assessments.join(counts, "assessment_id", "left").join(hit, "assessment_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select("assessment_id", zero("field_count"), zero("fact_count"), zero("open_conflict_count"), (no("alternate_coverage") | no("several")).alias("independent_support"), no("identity_change_risk").alias("identity_change_risk"))


def extend_certificates(certificates: DataFrame, affected: DataFrame, bundles: DataFrame) -> DataFrame:
    """Certificates with what they touch (GR-6).

    affected: certificate_id, canonical_field, entity_id; bundles:
    certificate_id, manifest_digest, passed and canary_active. Only
    certificates with a passed fleet run and an active canary are extended.
    Adds affected_fields (sorted, distinct), affected_entity_count,
    manifest_digest and extension_digest.
    """
    touched = affected.groupBy("certificate_id").agg(F.array_sort(F.collect_set("canonical_field")).alias("affected_fields"), F.count_distinct("entity_id").alias("affected_entity_count"))
    good = bundles.where(F.col("passed") & F.col("canary_active")).select("certificate_id", "manifest_digest")
    out = certificates.join(good, "certificate_id").join(touched, "certificate_id", "left")
    out = out.withColumn("affected_fields", F.coalesce("affected_fields", F.array().cast("array<string>"))).withColumn("affected_entity_count", F.coalesce("affected_entity_count", F.lit(0)).cast("long"))
    text = F.concat_ws("\n", F.array_join("affected_fields", ","), F.col("affected_entity_count").cast("string"), "manifest_digest")
    return out.withColumn("extension_digest", F.sha2(text, 256))


def gauntlet(cases: DataFrame, evaluate: Callable[[DataFrame], DataFrame], passed: Column) -> DataFrame:
    """The caller's evaluation of all cases (UD-1): evaluate takes and returns a DataFrame, so it stays a plan. Adds outcome; null counts as failed."""
    return evaluate(cases).withColumn("outcome", F.when(F.coalesce(passed, F.lit(False)), "pass").otherwise("fail"))
