"""Scalar helpers, Column to Column; a value that can't be converted gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalize_whitespace(c: Column) -> Column:
    """Trim and fold runs of white space, also Unicode's, to one blank (FN-1)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_identity(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one '-', none at the edges (FN-3, ASCII)."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_identifier(c: Column) -> Column:
    """Lower case, every other character than a-z, 0-9, '.', '_' and '-' as '-', none of these at the edges (FN-2, ASCII)."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def parse_number(c: Column) -> Column:
    """Drop everything but digits, dot and signs, then cast; null where no number is left (FN-4)."""
    return F.regexp_replace(c, "[^0-9.+-]", "").try_cast("double")


def parse_magnitude(c: Column) -> Column:
    """Numbers with a K, M or B suffix as plain numbers, else null (FN-5)."""
    pattern = r"^(-?\d+(?:\.\d+)?)\s*([KMB]?)$"
    text = F.replace(F.upper(F.trim(c)), F.lit(","), F.lit(""))
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")
    unit = F.regexp_extract(text, pattern, 2)
    return number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)


def normalize_boolean(c: Column) -> Column:
    """The words for yes and no as booleans, else null (FN-7)."""
    text = F.lower(F.trim(c))
    return F.when(text.isin("true", "yes", "1", "supported"), True).when(text.isin("false", "no", "0", "unsupported"), False)


def normalize_list(c: Column) -> Column:
    """A comma list as trimmed, non-empty, distinct items in order (FN-9)."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def backoff_seconds(attempt: Column, base: int = 60, most: int = 86400) -> Column:
    """Exponential delay before the next attempt, capped (FN-21)."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def nearly_equal(left: Column, right: Column, absolute: float, percent: float) -> Column:
    """Numeric equivalence within an absolute or a relative tolerance (FN-18)."""
    gap = F.abs(left - right)
    return (gap <= absolute) | (gap <= F.greatest(F.abs(left), F.abs(right)) * (percent / 100.0))


def normalize_url(c: Column) -> Column:
    """Without fragment and trailing slashes of a path, scheme and host in lower case (FN-8)."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), "#.*$", ""), "^([A-Za-z]+://[^/]+/.*[^/])/+$", "$1")
    head = F.regexp_extract(plain, "^([A-Za-z]+://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(plain, F.length(head) + 1, F.length(plain)))


def unsafe_url_reason(c: Column, allowed_hosts: list[str] | None = None) -> Column:
    """Why a public URL is refused: not_https, credentials, private_host or host_not_approved; null if it is fine (PF-4).

    Private are loopback and link-local names and addresses, and IPv4 addresses
    of private ranges; a name that only begins like one is not. allowed_hosts:
    the only hosts that are fine, whatever their case; None allows all.
    """
    address = r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(c, address, 1)), r"\.$", "")
    octet = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    four = host.rlike(rf"^(?:{octet}\.){{3}}{octet}$")
    private = (four & host.rlike(r"^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\.")) | host.rlike(r"^(localhost|.*\.localhost|.*\.local|\[::1\])$")
    foreign = ~host.isin([h.lower() for h in allowed_hosts]) if allowed_hosts is not None else F.lit(False)
    return (
        F.when(c.isNull() | ~c.rlike("(?i)^https://"), "not_https")
        .when(c.rlike("^[A-Za-z]+://[^/?#]*@"), "credentials")
        .when(private | (host == ""), "private_host")
        .when(foreign, "host_not_approved")
    )


def parse_date(c: Column) -> Column:
    """An ISO-8601 date or date and time as a timestamp (FN-6), in UTC where it names no zone; null for anything else."""
    text = F.trim(c)
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?([Zz]|[+-][0-9]{2}:?[0-9]{2})?)?$")
    zoned = F.regexp_replace(F.regexp_replace(text, "z$", "Z"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    zoned = F.regexp_replace(zoned, "^(.{16})($|[Z+-])", "$1:00$2")  # Spark's cast wants seconds before a zone
    named = zoned.rlike(r"(Z|:[0-9]{2}[+-][0-9]{2}:[0-9]{2}|\.[0-9]+[+-][0-9]{2}:[0-9]{2})$")
    timed = F.length(zoned) > 10
    whole = F.when(~timed, F.concat(zoned, F.lit("T00:00:00Z"))).when(named, zoned).otherwise(F.concat(zoned, F.lit("Z")))
    return F.when(iso, whole).try_cast("timestamp")


def tokens(amount: Column, unit: Column) -> Column:
    """Quantities of tokens as tokens (FN-10); null for an unknown unit."""
    return amount * F.when(unit == "tokens", 1.0).when(unit == "thousand_tokens", 1e3).when(unit == "million_tokens", 1e6)


def path_value(record: Column, observation: Column, path: str) -> Column:
    """The text at a dotted path of a record, or of its observation under the prefix `$observation.` (FN-13); both are VARIANT. Null where nothing is."""
    prefix = "$observation."
    of, names = (observation, path.removeprefix(prefix)) if path.startswith(prefix) else (record, path)
    return F.try_variant_get(of, "$." + names, "string")


def usd_per_million(amount: Column, denominator: Column) -> Column:
    """Prices per token, per thousand or per million tokens as prices per million (FN-10); null for other units."""
    factor = F.when(denominator == "token", 1e6).when(denominator == "thousand_tokens", 1e3)
    return amount * factor.when(denominator.isin("million_tokens", "million_input_tokens", "million_output_tokens"), 1.0)


def duration_ms(amount: Column, unit: Column) -> Column:
    """Durations in milliseconds (FN-10); null for an unknown unit."""
    factor = F.when(unit == "milliseconds", 1.0).when(unit == "seconds", 1e3).when(unit == "minutes", 6e4)
    return amount * factor.when(unit == "hours", 3.6e6).when(unit == "days", 8.64e7)


def enum_map(c: Column, values: dict[str, str], fallback: str | None = None) -> Column:
    """Map trimmed, lower-cased words to canonical ones (FN-11)."""
    key, out = F.lower(F.trim(c)), F.lit(fallback)
    for word, canonical in values.items():
        out = F.when(key == word, canonical).otherwise(out)
    return out


def split_part(c: Column, separator: str, index: int) -> Column:
    """One part of a text, counted from 0; null beyond the end (FN-12)."""
    return F.try_element_at(F.split(c, r"\Q" + separator + r"\E"), F.lit(index + 1))


def combine(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined (FN-12)."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


# Fixed value: a year of these two centuries, with a month and a day where they follow.
VERSION = r"(?<![0-9])(?:19|20)\d{2}(?:[-_]?(?:0[1-9]|1[0-2])(?:[-_]?(?:0[1-9]|[12]\d|3[01]))?)?(?![0-9])"


def version_token(c: Column) -> Column:
    """The first date-like version of a text, such as 2024, 2024-05 or 20240501, else null (FN-14)."""
    return F.nullif(F.regexp_extract(c, VERSION, 0), F.lit(""))


def digest(c: Column) -> Column:
    """'sha256:' and the hex digest of a text (FN-15)."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def hmac_sha256(key: bytes, body: Column) -> Column:
    """Hex HMAC-SHA256 of a text (FN-16); the pads are made here, the hashing stays in the JVM."""
    import hashlib

    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in padded).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)


def webhook_state(payload: Column, signature: Column, key: bytes, now: Column, tolerance: int = 300) -> Column:
    """Whether a header `t=<seconds>,v1=<hex>` signs a payload (FN-16): verified, malformed, expired or mismatch.

    Parts may stand in any order, of a repeated one the last counts. A time
    further than `tolerance` seconds from now (in seconds) is expired. Nulls are
    malformed.
    """
    if len(key) < 16:
        raise ValueError("a signing key has at least 16 bytes")
    part = lambda name: F.regexp_extract(signature, rf"^(?:.*,)?{name}=([^,=]*)", 1)
    time = F.when(part("t").rlike(r"^-?[0-9]{1,15}$"), part("t").try_cast("long"))
    right = hmac_sha256(key, F.concat(time.cast("string"), F.lit("."), payload))
    bad = payload.isNull() | signature.isNull() | time.isNull() | (part("v1") == "")
    state = F.when(F.abs(now - time) > tolerance, "expired").when(F.lower(part("v1")) == right, "verified").otherwise("mismatch")
    return F.when(F.coalesce(bad, F.lit(True)), "malformed").otherwise(state)


SECRET_PAIR = r'(?i)\b(token|secret|password|api_key|apikey)\s*[=:]\s*"[^"]+"'


def mask_secret_pairs(c: Column) -> Column:
    """Values assigned to secret names in a text become [REDACTED] (FN-17)."""
    return F.regexp_replace(c, SECRET_PAIR, '$1="[REDACTED]"')


def equivalent(left: Column, right: Column, rule: dict) -> Column:
    """Whether two values are the same under a rule (FN-18).

    rule: kind exact (of equal text), numeric (absolute, percent), text or
    identifier (collapse_whitespace, case_insensitive, aliases) or set
    (case_insensitive; arrays of text, in any order, repeats count once). Two
    nulls are the same but for numbers and sets; a null differs from any value.
    """
    kind = rule["kind"]
    if kind == "numeric":
        gap = F.abs(left - right)
        scale = F.greatest(F.abs(left), F.abs(right), F.lit(2.220446049250313e-16))
        return F.coalesce((gap <= rule.get("absolute", 0.0)) | (gap / scale * 100 <= rule.get("percent", 0.0)), F.lit(False))
    return canonical(left, rule).eqNullSafe(canonical(right, rule)) if kind != "set" else F.coalesce(canonical(left, rule) == canonical(right, rule), F.lit(False))


def canonical(c: Column, rule: dict) -> Column:
    """The form that all values equivalent under an exact, text, identifier or set rule share; see equivalent()."""
    kind = rule["kind"]
    fold = F.lower if rule.get("case_insensitive") else (lambda x: x)
    if kind == "exact":
        return c
    if kind == "set":
        return F.array_sort(F.array_distinct(F.transform(c, fold)))
    out = fold(normalize_whitespace(c) if rule.get("collapse_whitespace") else c)
    aliases = rule.get("aliases") or {}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), out), out) if aliases else out


# Phrases of attempts to give orders to a model.
INJECTION = r"(?i)ignore previous|system prompt|developer message|tool call"


def injection_state(c: Column, most: int = 20000) -> Column:
    """too_large beyond `most` characters, blocked if a text holds an injection phrase, else accepted (FN-19); null is accepted."""
    return F.when(F.length(c) > most, "too_large").when(c.rlike(INJECTION), "blocked").otherwise("accepted")


def union_of(*arrays: Column) -> Column:
    """The distinct values of several arrays, in order of their first place (SET-2); a null array counts as empty."""
    empty = F.array()
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays]))
