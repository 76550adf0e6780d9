"""State that depends on order: circuits, stages, revisions and budgets."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.operators.ordered import fold, segmented_fold


def circuit_step(threshold: int, cooldown: int, now: tuple, t: int, result: str | None) -> tuple:
    """The state (closed, failures) or (open, since) after a call, its name, and whether the call was allowed."""
    kind, n = now
    if kind == "open" and t - n < cooldown:
        return now, kind, False
    if result == "success":
        return ("closed", 0), "closed", True
    trips = kind == "open" or result == "config_error" or n + 1 >= threshold
    return ("open", t) if trips else ("closed", n + 1), "open" if trips else "closed", True


class _CircuitMap:
    """What a run of calls makes of any state: an exit for each count of failures, and for each time since when it is open.

    An open circuit meets its probe at the first call that is late enough, and
    all after that depends on that call alone. So the map of open states has one
    step for each run of calls with the same exit.
    """

    def __init__(self, threshold: int, cooldown: int):
        self.threshold, self.cooldown = threshold, cooldown

    def summarize(self, rows: list[tuple]) -> tuple:
        times = [t for t, _ in rows]
        n = len(rows)
        closed = [("closed", f) for f in range(self.threshold)]  # exits from closed states before the row at hand
        opened: list[tuple] = [()] * n  # exit of a circuit opened at a row
        probed: list[tuple] = [()] * n  # exit if the row is a probe
        for i in range(n - 1, -1, -1):
            t, result = rows[i]
            k = bisect_left(times, t + self.cooldown, i + 1)
            opened[i] = probed[k] if k < n else ("open", t)
            probed[i] = closed[0] if result == "success" else opened[i]
            if result == "success":
                closed = [closed[0]] * self.threshold
            else:
                trips = [result == "config_error" or f + 1 >= self.threshold for f in range(self.threshold)]
                closed = [opened[i] if trip else closed[f + 1] for f, trip in enumerate(trips)]
        steps = [(t, out) for i, (t, out) in enumerate(zip(times, probed, strict=True)) if i == n - 1 or probed[i + 1] != out]
        return closed, steps

    def apply(self, summary: tuple, state: tuple) -> tuple:
        closed, steps = summary
        if state[0] == "closed":
            return closed[state[1]]
        k = bisect_left(steps, state[1] + self.cooldown, key=lambda s: s[0])
        return steps[k][1] if k < len(steps) else state


def circuit_states(calls: DataFrame, key: str, time: str, tie: str, outcome: str, threshold: int, cooldown_seconds: float, bucket: Column | None = None) -> DataFrame:
    """Add circuit (state after each call) and allowed (WN-5).

    outcome: success, failure or config_error; null counts as failure. A
    circuit opens at `threshold` failures since the last success, or at once on
    config_error. While it is open, calls are not allowed and change nothing,
    until one comes at least cooldown_seconds after it opened: that probe closes
    it (success) or opens it again. Rows with a null key share one circuit; a null time counts as 1970.

    bucket: a value that grows with time; a key is then split over its buckets
    (ordered.segmented_fold). Without it a key is walked in one task.
    """
    cooldown = int(cooldown_seconds * 1_000_000)
    work = calls.withColumn("__at", F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(0)))
    outputs = {"circuit": T.StringType(), "allowed": T.BooleanType()}
    step = partial(circuit_step, threshold, cooldown)
    if bucket is None:
        return fold(work, [key], ["__at", tie], ["__at", outcome], outputs, lambda *_: ("closed", 0), step).drop("__at")
    return segmented_fold(work, key, bucket, ["__at", tie], ["__at", outcome], outputs, ("closed", 0), step, _CircuitMap(threshold, cooldown)).drop("__at")


def gate_step(ratio: float, last: float | None, v: float | None, fine: bool | None) -> tuple:
    """The last release after a row, the row's decision and the value released with it."""
    if not fine or v is None:
        return last, "quarantined", last
    if last is not None and (abs(v - last) >= ratio * abs(last) if last else v != 0):
        return last, "needs_review", last
    return v, "verified", v


class _GateMap:
    """What a run of rows makes of any last release: the first value that the gate lets pass decides all that follows.

    Kept are the values that can be the first for some release, with the exit
    that each leads to. A value is left out if earlier ones let pass every
    release that it lets pass; a margin wider than rounding errors makes sure.
    """

    MARGIN = 1e-9

    def __init__(self, ratio: float):
        self.ratio = ratio

    def passes(self, last: float | None, v: float) -> bool:
        return gate_step(self.ratio, last, v, True)[1] == "verified"

    def _accepted(self, v: float, margin: float) -> tuple[float, float] | None:
        """The releases from which v is let pass, narrowed or widened by a margin; None where they are no such interval."""
        if not 0 < self.ratio < 1 or v == 0 or not math.isfinite(v):
            return None
        a, b = sorted((v / (1 + self.ratio), v / (1 - self.ratio)))
        slack = margin * max(abs(a), abs(b))
        return a + slack, b - slack

    def summarize(self, rows: list[tuple]) -> list[tuple]:
        values = [v for v, fine in rows if fine and v is not None]
        exits = list(values)
        for j in range(len(values) - 2, -1, -1):
            k = next((k for k in range(j + 1, len(values)) if self.passes(values[j], values[k])), None)
            exits[j] = values[j] if k is None else exits[k]
        kept, seen, covered = [], set(), []
        for v, out in zip(values, exits, strict=True):
            if v in seen:
                continue
            seen.add(v)
            wide, narrow = self._accepted(v, -self.MARGIN), self._accepted(v, self.MARGIN)
            if kept and wide is not None:
                i = bisect_right(covered, (wide[0], math.inf)) - 1
                if i >= 0 and covered[i][0] <= wide[0] and wide[1] <= covered[i][1]:
                    continue
            kept.append((v, out))
            if narrow is not None:
                lo, hi = narrow
                apart = [c for c in covered if c[1] < lo or c[0] > hi]
                meet = [c for c in covered if not (c[1] < lo or c[0] > hi)]
                covered = sorted([*apart, (min([lo, *(c[0] for c in meet)]), max([hi, *(c[1] for c in meet)]))])
        return kept

    def apply(self, summary: list[tuple], state: float | None) -> float | None:
        return next((out for v, out in summary if self.passes(state, v)), state)


def released_values(rows: DataFrame, key: str, order: list[str], value: str, good: str, ratio: float = 0.5, bucket: Column | None = None) -> DataFrame:
    """Carry releases forward through a gate that looks at the last release (BT-7, DQ-2, DQ-3).

    A row whose `good` isn't true, or whose value is null, is quarantined; one
    that differs from the last release by `ratio` of it or more needs review;
    any other is verified and becomes the release. After a release of 0 only 0
    is verified. Adds gate_decision and released_value (null before the first).
    bucket: a value that grows with order, as in circuit_states.
    """
    outputs = {"gate_decision": T.StringType(), "released_value": T.DoubleType()}
    step = partial(gate_step, ratio)
    if bucket is None:
        return fold(rows, [key], order, [value, good], outputs, lambda *_: None, step)
    return segmented_fold(rows, key, bucket, order, [value, good], outputs, None, step, _GateMap(ratio))


def stage_progress(results: DataFrame, key: str, time: str, tie: str, stage: str, passed: str, stages: list[str]) -> DataFrame:
    """How far each run got through stages that must come in order (WN-8, DQ-9).

    A result counts if its stage is the one expected at that time; the first of
    those decides, others are ignored. One that didn't pass (or is null) rolls
    the run back. Returns key, n_passed long, state (running, rolled_back,
    active) and stopped_at_stage. One aggregate per stage; no run is sorted.
    """
    at = F.struct(F.col(time).alias("t"), F.col(tie).alias("i"))
    rows = results.select(key, at.alias("__at"), F.col(stage).alias("__stage"), F.coalesce(F.col(passed), F.lit(False)).alias("__passed"))
    state = rows.select(key).distinct().select(key, F.lit(None).cast(rows.schema["__at"].dataType).alias("__last"), F.lit(0).cast("long").alias("n_passed"), F.lit(None).cast("string").alias("stopped_at_stage"))
    for n, name in enumerate(stages):
        waiting = state.where((F.col("n_passed") == n) & F.col("stopped_at_stage").isNull()).select(F.col(key).alias("__k"), F.col("__last").alias("__since"))
        after = F.col("__since").isNull() | (F.col("__at") > F.col("__since"))
        hits = rows.where(F.col("__stage") == name).join(waiting, F.col(key).eqNullSafe(F.col("__k"))).where(after)
        first = hits.groupBy(F.col("__k")).agg(F.min(F.struct("__at", "__passed")).alias("__hit"))
        state = state.join(first, F.col(key).eqNullSafe(F.col("__k")), "left").select(
            key,
            F.coalesce(F.col("__hit.__at"), F.col("__last")).alias("__last"),
            (F.col("n_passed") + F.when(F.col("__hit.__passed"), 1).otherwise(0)).alias("n_passed"),
            F.coalesce("stopped_at_stage", F.when(~F.col("__hit.__passed"), name)).alias("stopped_at_stage"),
        )
    label = F.when(F.col("stopped_at_stage").isNotNull(), "rolled_back").when(F.col("n_passed") == len(stages), "active").otherwise("running")
    return state.select(key, "n_passed", label.alias("state"), "stopped_at_stage")


def active_revisions(transitions: DataFrame, spec: str, revision: str, time: str, tie: str, state: str) -> DataFrame:
    """The revision in force of each spec (WN-7): of those whose latest state is active, the one activated last.

    Returns spec, active_revision (null if none) and n_superseded, the older active ones, by partial aggregates only.
    """
    at = F.struct(time, tie)
    latest = transitions.groupBy(spec, revision).agg(F.max_by(state, at).alias("__state"), F.max(at).alias("__at"))
    on = F.col("__state") == "active"
    newest = F.max_by(F.when(on, F.col(revision)), F.when(on, F.col("__at"))).alias("active_revision")
    return latest.groupBy(spec).agg(newest, F.greatest(F.count_if(on) - 1, F.lit(0)).cast("long").alias("n_superseded"))


def budget_use(usage: DataFrame, keys: list[str], units: str, budget: float, reserved: float = 0.3) -> DataFrame:
    """Use of a budget per key, such as provider and day (AG-16): used, available beside the reserved share, exhausted."""
    out = usage.groupBy(*keys).agg(F.coalesce(F.sum(units), F.lit(0)).alias("used"))
    free = budget * (1 - reserved)
    return out.withColumn("available", F.greatest(F.lit(0.0), F.lit(free) - F.col("used"))).withColumn("exhausted", F.col("used") >= free)


def usage_rollup(logs: dict[str, tuple[DataFrame, str]], scope: str, time: str, period: str = "month") -> DataFrame:
    """Activity per scope and period (AG-12): n_<log> and cost_<log> of each log, given as (rows, cost column); 0 where absent."""
    parts = []
    for name, (rows, cost) in logs.items():
        parts.append(rows.select(scope, F.date_trunc(period, time).alias("period"), F.lit(name).alias("__log"), F.col(cost).cast("double").alias("__cost")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    sums = []
    for name in logs:
        mine = F.col("__log") == name
        sums += [F.count_if(mine).alias(f"n_{name}"), F.coalesce(F.sum(F.when(mine, F.col("__cost"))), F.lit(0.0)).alias(f"cost_{name}")]
    return union.groupBy(scope, "period").agg(*sums)
