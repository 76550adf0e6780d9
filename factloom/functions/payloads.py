"""JSON payloads: canonical form, digests and redaction; Unicode normalisation."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.functions.columns import digest

# Names of secret fields and the shapes of secret values, the depth and the items that are looked at.
SECRET_KEY = re.compile(r"authorization|api[-_]?key|secret|password|private[-_]?key|token|cookie", re.IGNORECASE)
SECRET_VALUE = re.compile(r"\b(?:kv_(?:live|test|dev)|whsec|sk|Bearer)[_-]?[A-Za-z0-9._-]{12,}\b", re.IGNORECASE | re.ASCII)
DEPTH, ITEMS = 8, 100


def _number(x: float) -> str:
    """A number as JSON.stringify writes it: no fraction where there is none, the shortest digits, plain exponents."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    text = repr(x)
    if x == int(x) and abs(x) < 1e21:
        return "0" if x == 0 else str(int(Decimal(text)))
    if "e" not in text:
        return text
    digits, exponent = text.split("e")
    power = int(exponent)
    if -7 < power < 0:  # such numbers are written without an exponent
        sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return f"{sign}0.{'0' * (-power - 1)}{digits.replace('.', '')}"
    return f"{digits}e{'+' if power > 0 else '-'}{abs(power)}"


def _text(value, out: list[str]) -> None:
    if isinstance(value, dict):
        out.append("{")
        for n, (k, v) in enumerate(sorted(value.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))):
            out.append(("," if n else "") + json.dumps(k, ensure_ascii=False) + ":")
            _text(v, out)
        out.append("}")
    elif isinstance(value, list):
        out.append("[")
        for n, v in enumerate(value):
            if n:
                out.append(",")
            _text(v, out)
        out.append("]")
    elif isinstance(value, bool) or value is None or isinstance(value, str):
        out.append(json.dumps(value, ensure_ascii=False))
    else:
        out.append(_number(float(value)) if isinstance(value, float) or abs(value) >= 1 << 53 else str(value))


def canonical_text(value) -> str:
    """A parsed JSON value as text: keys in byte order, no blanks, numbers as doubles print."""
    out: list[str] = []
    _text(value, out)
    return "".join(out)


def redact_value(value, depth: int = 0) -> tuple[object, int]:
    """A parsed JSON value without secrets, and how many places were blanked.

    Values of secret names and parts of texts that look like secrets become
    [REDACTED]; below DEPTH levels [TRUNCATED] stands for the rest; of an array
    or object the first ITEMS are kept.
    """
    if depth > DEPTH:
        return "[TRUNCATED]", 0
    if isinstance(value, str):
        return SECRET_VALUE.subn("[REDACTED]", value)
    if isinstance(value, list):
        items = [redact_value(v, depth + 1) for v in value[:ITEMS]]
        return [v for v, _ in items], sum(n for _, n in items)
    if isinstance(value, dict):
        out, hits = {}, 0
        for k, v in list(value.items())[:ITEMS]:
            out[k], n = ("[REDACTED]", 1) if SECRET_KEY.search(k) else redact_value(v, depth + 1)
            hits += n
        return out, hits
    return value, 0


def _walk(df: DataFrame, column: str, outputs: dict[str, T.DataType], of) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in outputs.items()]])
    kinds = [pa.string() if isinstance(t, T.StringType) else pa.int64() for t in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(column).to_pylist():
                try:
                    made.append((None,) * len(outputs) if text is None else of(json.loads(text)))
                except (ValueError, RecursionError):
                    made.append(of(None, False))
            new = [pa.array([m[n] for m in made], kind) for n, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *outputs])

    return df.mapInArrow(run, schema)


def canonical_json(df: DataFrame, column: str) -> DataFrame:
    """Add canonical (keys in byte order, numbers in one form) and its digest of a column of JSON texts (FN-15).

    Texts that are no JSON keep their own text's digest and have a null
    canonical form; a null text has nulls. Of a repeated key the last counts.
    """
    out = _walk(df, column, {"canonical": T.StringType()}, lambda value, good=True: (canonical_text(value) if good else None,))
    return out.withColumn("digest", F.when(F.col(column).isNotNull(), digest(F.coalesce("canonical", F.col(column)))))


def redacted_json(df: DataFrame, column: str) -> DataFrame:
    """Add redacted (canonical JSON without secrets) and n_hits for a column of JSON texts (FN-17, GOV-3).

    Texts that are no JSON become [INVALID] as a JSON text, with no hit counted,
    so nothing unread passes; a null text has nulls.
    """

    def of(value, good=True):
        if not good:
            return '"[INVALID]"', 0
        clean, hits = redact_value(value)
        return canonical_text(clean), hits

    return _walk(df, column, {"redacted": T.StringType(), "n_hits": T.LongType()}, of)


def nfkc(c: Column) -> Column:
    """Unicode NFKC of a text (FN-2, FN-3). Only texts beyond ASCII are sent out of the JVM, in Arrow batches."""

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        # Arrow's own utf8_normalize leaves accents apart under this form.
        return pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    wide = c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(normal(F.when(wide, c)), c)
