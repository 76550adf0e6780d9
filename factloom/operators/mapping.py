"""Declarative mapping of source rows to canonical fields: a spec becomes columns of one select."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import columns as C

RUNNABLE = ("shadow", "canary", "active")


def _unit_convert(c: Column, unit: str) -> Column:
    prices = {"per_token": "token", "per_thousand_tokens": "thousand_tokens", "per_million_tokens": "million_tokens"}
    if unit in prices:
        return C.usd_per_million(c.try_cast("double"), F.lit(prices[unit]))
    return C.duration_ms(c.try_cast("double"), F.lit(unit))


#: The closed list of transforms (UD-2): specs hold names and parameters, never code.
TRANSFORMS: dict[str, Callable[..., Column]] = {
    "rename": lambda c: c,
    "trim": lambda c: F.trim(c),
    "normalize_whitespace": C.normalize_whitespace,
    "normalize_case": lambda c, case: F.upper(c) if case == "upper" else F.lower(c),
    "normalize_identifier": C.normalize_identifier,
    "parse_number": C.parse_number,
    "parse_magnitude": C.parse_magnitude,
    "parse_date": C.parse_date,
    "normalize_boolean": C.normalize_boolean,
    "normalize_url": C.normalize_url,
    "normalize_list": C.normalize_list,
    "unit_convert": _unit_convert,
    "enum_map": C.enum_map,
    "split": lambda c, separator, index: C.split_part(c, separator, index),
    "combine": lambda *cs, separator: C.combine(separator, *cs),
    "default": lambda c, value: F.coalesce(c, F.lit(value)),
}


@dataclass(frozen=True)
class Rule:
    """One canonical field: where it comes from and the transforms in order, as (name, parameters)."""

    target: str
    source: tuple[str, ...]
    transforms: tuple[tuple[str, dict], ...] = ()
    required: bool = True
    evidence: tuple[str, ...] = ()


@dataclass(frozen=True)
class Spec:
    """A revision of a mapping; canonical_key names targets."""

    mapping_id: str
    revision: int
    status: str
    source_key: str
    canonical_key: tuple[str, ...]
    rules: tuple[Rule, ...]


def validate(spec: Spec) -> None:
    """Raise ValueError for a spec that can't be run (MAP-1)."""
    targets = [r.target for r in spec.rules]
    if not targets or len(set(targets)) < len(targets):
        raise ValueError("a spec needs rules with distinct targets")
    if spec.status not in RUNNABLE:
        raise ValueError(f"revision {spec.revision} of {spec.mapping_id} is {spec.status}")
    if spec.revision < 1 or not spec.canonical_key or not set(spec.canonical_key) <= set(targets):
        raise ValueError("revision must be positive and canonical_key must name targets")
    for r in spec.rules:
        if not r.source:
            raise ValueError(f"{r.target} has no source")
        unknown = [name for name, _ in r.transforms if name not in TRANSFORMS]
        if unknown:
            raise ValueError(f"{r.target}: unknown transforms {unknown}")
        if len(r.source) > 1 and (not r.transforms or r.transforms[0][0] != "combine"):
            raise ValueError(f"{r.target}: several sources must be combined first")


def _steps(rule: Rule) -> list[tuple[str, Column]]:
    """Value after each transform, the raw one first."""
    parts = [F.col(path) for path in rule.source]
    out = [("source", parts[0])]
    for n, (name, parameters) in enumerate(rule.transforms):
        out.append((name, TRANSFORMS[name](*(parts if n == 0 else [out[-1][1]]), **parameters)))
    return out


def execute(records: DataFrame, spec: Spec) -> DataFrame:
    """Canonical rows of source records (MAP-2, MAP-3), one for each.

    Returns source_key, canonical_key (null if a part is missing), one column
    for each target, errors (array: required fields without a value and a
    missing source key) and output_digest over all fields. A conversion that
    fails gives null, so only its own row is rejected.
    """
    validate(spec)
    values = {r.target: _steps(r)[-1][1] for r in spec.rules}
    mapped = records.select(F.col(spec.source_key).cast("string").alias("source_key"), *[v.alias(t) for t, v in values.items()])
    missing = lambda c: F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == "")
    errors = [F.when(missing(t), F.lit(f"missing:{t}")) for t in ["source_key", *[r.target for r in spec.rules if r.required]]]
    key_parts = [F.lower(F.trim(F.col(f"`{t}`").cast("string"))) for t in spec.canonical_key]
    fields = F.to_json(F.struct(*[F.col(f"`{t}`") for t in values]), {"ignoreNullFields": "false"})
    # concat is null if any part is.
    joined = F.concat(*[x for p in key_parts for x in (F.lit(":"), p)][1:])
    return mapped.select("source_key", joined.alias("canonical_key"), *[F.col(f"`{t}`") for t in values], F.array_compact(F.array(*errors)).alias("errors"), C.digest(fields).alias("output_digest"))


def field_evidence(records: DataFrame, spec: Spec) -> DataFrame:
    """Where each canonical field came from, one row for each record and field.

    Returns source_key, field, value (as text), trail (array of transform name
    and output as text) and source_fields. All fields come from one pass.
    """
    validate(spec)
    rows = []
    for r in spec.rules:
        steps = _steps(r)
        trail = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("output")) for n, v in steps])
        paths = F.array_distinct(F.array(*[F.lit(p) for p in (*r.source, *r.evidence)]))
        rows.append(F.struct(F.lit(r.target).alias("field"), steps[-1][1].cast("string").alias("value"), trail.alias("trail"), paths.alias("source_fields")))
    return records.select(F.col(spec.source_key).cast("string").alias("source_key"), F.explode(F.array(*rows)).alias("__row")).select("source_key", "__row.*")
