"""Manifests of tables, their comparison after a restore, and erasure that starts from a verified one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.session import exists


def row_text(columns: list[str]) -> Column:
    """A row as a text that tells nulls, empty texts and separators apart: each value with its length, nulls as a dash."""
    one = lambda c: F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat_ws("|", *[one(c) for c in columns])


def _content(columns: list[str]) -> list[Column]:
    """Sums of two independent 60-bit parts of each row's SHA-256: rows in any order and any partitions give the same, repeats count."""
    code = F.sha2(row_text(columns), 256)
    part = lambda lo: F.coalesce(F.sum(F.conv(F.substring(code, lo, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return [part(1).alias("digest_a"), part(16).alias("digest_b")]


def manifest(tables: dict[str, DataFrame], witnesses: dict[str, tuple[str, Column, str]] | None = None) -> DataFrame:
    """What tables hold (AG-10): name, kind, n_rows, digest_a, digest_b; one row per table and witness.

    A table's digests are order-insensitive sums over its whole rows, taken as
    partial aggregates, with its columns in order of name; so a changed, added,
    lost or repeated row shows. A witness is given as (table, condition, id
    column): how many rows fulfil the condition, and the digest of the smallest
    id among them (null ids are no witnesses).
    """
    out = []
    for name, df in tables.items():
        flat = df.select(*[(F.to_json(f.name) if f.dataType.typeName() in {"array", "map", "struct"} else F.col(f.name)).alias(f.name) for f in df.schema.fields])
        out.append(flat.agg(F.lit(name).alias("name"), F.lit("table").alias("kind"), F.count("*").alias("n_rows"), *_content(sorted(df.columns))).select("name", "kind", "n_rows", "digest_a", "digest_b"))
    for name, (of, condition, key) in (witnesses or {}).items():
        hits = tables[of].where(condition & F.col(key).isNotNull())
        first = F.coalesce(F.sha2(F.min(key).cast("string"), 256), F.lit(""))
        out.append(hits.agg(F.lit(name).alias("name"), F.lit("witness").alias("kind"), F.count("*").alias("n_rows"), first.alias("digest_a"), F.lit("").alias("digest_b")))
    return reduce(DataFrame.unionByName, out)


def verify_restore(captured: DataFrame, present: DataFrame) -> DataFrame:
    """A captured manifest beside the present one: name, kind, state (same, missing, added, count_differs, content_differs)."""
    both = captured.alias("a").join(present.alias("b"), ["name", "kind"], "full_outer")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    state = F.when(F.col("b.n_rows").isNull(), "missing").when(F.col("a.n_rows").isNull(), "added").when(differs("n_rows"), "count_differs").when(differs("digest_a") | differs("digest_b"), "content_differs").otherwise("same")
    return both.select("name", "kind", state.alias("state"))


def erase_project(spark: SparkSession, path: str, stages: dict[str, tuple[DataFrame, str, dict[str, str | None]]], subjects: DataFrame, verified: DataFrame) -> DataFrame:
    """Rewrite several tables without the payloads of the subjects' rows, stage by stage (GOV-2).

    stages: for each table, in order, its rows, the column that names the
    subject, and the payload columns with what they become (null or a text).
    Each is written to `path`/name with a tombstone column, the digest of what
    was there, which is null for rows that stay. subjects: one column of ids,
    whatever its name; nulls erase nothing. verified: the report of
    verify_restore; anything but "same" in all its rows stops the job before
    the first write, and so does an empty report.

    Started again with the same path, finished stages are left as they are: a
    table counts as finished when its writer has committed. Returns one row:
    state and, for each table, <name>_rows and <name>_erased, counted over what
    was written; the row is kept in `path`/_tombstone.
    """
    ids = subjects.select(F.col(subjects.columns[0]).alias("__subject")).where("__subject is not null").distinct()
    tombstone = f"{path}/_tombstone"
    if exists(spark, f"{tombstone}/_SUCCESS"):
        return spark.read.parquet(tombstone)
    states = {r["state"] for r in verified.select("state").distinct().collect()}
    if states != {"same"}:
        raise ValueError(f"erasure needs a verified manifest, found {sorted(states)}")
    counts = []
    for name, (df, key, payload) in stages.items():
        at = f"{path}/{name}"
        if not exists(spark, f"{at}/_SUCCESS"):
            marked = df.join(ids, F.col(key) == F.col("__subject"), "left")
            gone = F.col("__subject").isNotNull()
            fresh = {c: F.when(gone, F.lit(to).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, to in payload.items()}
            held = marked.withColumn("tombstone", F.when(gone, F.sha2(row_text(sorted(payload)), 256)))
            held.select(*[fresh.get(c, F.col(c)).alias(c) for c in df.columns], "tombstone").write.mode("overwrite").parquet(at)
        done = spark.read.parquet(at)
        counts.append(done.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.count("tombstone").alias("erased")))
    long = reduce(DataFrame.unionByName, counts)
    pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c))).alias(f"{name}_{c}")
    row = long.agg(F.lit("deleted").alias("state"), *[pick(name, c) for name in stages for c in ("rows", "erased")])
    row.write.mode("overwrite").parquet(tombstone)
    return spark.read.parquet(tombstone)
