"""Scores of repair runs: case runs, fleet metrics and suites with their gates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds of mutations that a suite has to cover, and the regression suite that must pass.
REQUIRED_KINDS = ("structural", "semantic_decoy", "rendering", "identity", "unit")
REGRESSION = "product_pricing"


def _yes(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _share(hits: Column, of: Column) -> Column:
    """A fraction; 1 where there is nothing to count."""
    return F.coalesce(F.try_divide(hits.cast("double"), of.cast("double")), F.lit(1.0))


def case_runs(results: DataFrame, run: str, n_cases: int = 8) -> DataFrame:
    """Status of each benchmark run (AG-4): run, n_results, n_distinct, n_passed, n_critical, n_false_heals, n_false_releases, status.

    results: case_id, outcome, critical, false_heal, false_release, preserved.
    incomplete: not exactly n_cases results of as many cases; completed: all
    pass, nothing false or critical, and the last known good always preserved;
    else failed. Nulls count as a case that did not pass, and as no for flags.
    """
    passed = _yes(F.col("outcome") == "pass")
    out = results.groupBy(run).agg(
        F.count("*").alias("n_results"),
        F.count_distinct("case_id").alias("n_distinct"),
        F.count_if(passed).alias("n_passed"),
        F.count_if(_yes("critical") & ~passed).alias("n_critical"),
        F.count_if(_yes("false_heal")).alias("n_false_heals"),
        F.count_if(_yes("false_release")).alias("n_false_releases"),
        F.min(_yes("preserved")).alias("__kept"),
    )
    whole = (F.col("n_results") == n_cases) & (F.col("n_distinct") == n_cases)
    good = (F.col("n_passed") == n_cases) & (F.col("n_critical") + F.col("n_false_heals") + F.col("n_false_releases") == 0) & F.col("__kept")
    return out.withColumn("status", F.when(~whole, "incomplete").when(good, "completed").otherwise("failed")).drop("__kept")


def fleet_metrics(cases: DataFrame, results: DataFrame, suite: str, run: str) -> DataFrame:
    """Rates of each run over the cases of its suite (AG-2); a rate without anything to count is 1.

    cases: suite, case_id, visibility, critical, category, expected_relation,
    expected_events (array); results: run, suite, case_id, outcome,
    extraction_ok, event_ok, false_heal, false_event, emitted_events (array),
    recovery_ms. A result passes if its outcome is pass, both assertions hold
    and nothing is false. Returns run, complete (one result for each case),
    catch_rate (critical cases), triage_rate, false_heal_rate, held_out_rate,
    identity_precision, event_precision, event_recall, correction_accuracy,
    n_false_events, recovery_ms (mean, 0 without any), availability (share that
    healed nothing falsely) and fresh (1 if the run passed, else 0). Arrays
    that are null are empty; results of unknown cases count as results only.
    """
    arrays = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    known = cases.select(suite, "case_id", "visibility", "critical", "category", "expected_relation", arrays("expected_events").alias("__expected"), F.lit(True).alias("__known"))
    rows = results.join(known, [suite, "case_id"], "left")
    passed = _yes(F.col("outcome") == "pass") & _yes("extraction_ok") & _yes("event_ok") & ~_yes("false_heal") & ~_yes("false_event")
    rows = rows.withColumns({"__passed": passed, "__emitted": arrays("emitted_events")})
    hits = F.size(F.filter("__emitted", lambda e: _yes(F.array_contains(F.coalesce("__expected", F.array().cast("array<string>")), e))))
    rate = lambda among: _share(F.count_if(_yes(among) & F.col("__passed")), F.count_if(_yes(among)))
    held, critical = F.col("visibility") == "held_out", F.col("critical")
    out = rows.groupBy(run, suite).agg(
        F.count("*").alias("__n"),
        F.count_distinct(F.when(F.col("__known"), F.col("case_id"))).alias("__cases"),
        rate(critical).alias("catch_rate"),
        rate(F.col("expected_relation").isin("quarantine", "retry", "do_not_heal")).alias("triage_rate"),
        _share(F.count_if(_yes("false_heal")), F.count("*")).alias("false_heal_rate"),
        rate(held).alias("held_out_rate"),
        rate(F.col("category") == "identity").alias("identity_precision"),
        _share(F.sum(hits), F.sum(F.size("__emitted"))).alias("event_precision"),
        F.sum(hits).alias("__hits"),
        rate(F.col("category") == "semantic_decoy").alias("correction_accuracy"),
        F.count_if(_yes("false_event")).alias("n_false_events"),
        F.coalesce(F.avg("recovery_ms"), F.lit(0.0)).alias("recovery_ms"),
        _share(F.count_if(~_yes("false_heal")), F.count("*")).alias("availability"),
        F.count_if(~F.col("__passed")).alias("__failed"),
    )
    of_suite = known.groupBy(suite).agg(F.count("*").alias("__all"), F.sum(F.size("__expected")).alias("__wanted"))
    out = out.join(of_suite, suite, "left")
    complete = _yes((F.col("__n") == F.col("__all")) & (F.col("__cases") == F.col("__all")))
    fresh = F.when((F.col("__failed") == 0) & (F.col("n_false_events") == 0), 1).otherwise(0)
    return out.select(
        run, complete.alias("complete"), "catch_rate", "triage_rate", "false_heal_rate", "held_out_rate", "identity_precision", "event_precision",
        _share(F.col("__hits"), F.coalesce("__wanted", F.lit(0))).alias("event_recall"), "correction_accuracy", "n_false_events", "recovery_ms", "availability", fresh.alias("fresh"),
    )


def fleet_suites(results: DataFrame, suite: str, required: tuple[str, ...] = REQUIRED_KINDS, regression: str = REGRESSION) -> DataFrame:
    """Whether each suite passes (AG-3): suite, n_cases, n_passed, n_false_events, mean_ms, missing_kinds, held_out_passed, regression_passed, passed.

    results: kind, extraction_ok, observed_events, expected_events (counts),
    held_out, regression_suite, duration_ms. A result passes if extraction held
    and as many events came as expected. A suite passes if it covers every
    required kind, all results pass, there are held-out ones, and one of the
    regression suite. Only flags and sums are aggregated.
    """
    matched = F.coalesce(F.col("observed_events") == F.col("expected_events"), F.lit(False))
    good = _yes("extraction_ok") & matched
    seen = [F.max(_yes(F.col("kind") == k)).alias(f"__k{n}") for n, k in enumerate(required)]
    out = results.groupBy(suite).agg(
        F.count("*").alias("n_cases"),
        F.count_if(good).alias("n_passed"),
        F.count_if(~matched).alias("n_false_events"),
        F.avg(F.coalesce("duration_ms", F.lit(0))).alias("mean_ms"),
        F.count_if(_yes("held_out")).alias("__held"),
        F.count_if(_yes("held_out") & ~good).alias("__lost"),
        F.max(_yes(F.col("regression_suite") == regression) & good).alias("regression_passed"),
        *seen,
    )
    missing = F.array_compact(F.array(*[F.when(~F.col(f"__k{n}"), F.lit(k)) for n, k in enumerate(required)]))
    held = (F.col("__held") > 0) & (F.col("__lost") == 0)
    gates = reduce(and_, [F.size("missing_kinds") == 0, F.col("n_passed") == F.col("n_cases"), F.col("held_out_passed"), F.col("regression_passed")])
    out = out.withColumn("missing_kinds", missing).withColumn("held_out_passed", held).withColumn("passed", gates)
    return out.select(suite, "n_cases", "n_passed", "n_false_events", "mean_ms", "missing_kinds", "held_out_passed", "regression_passed", "passed")
