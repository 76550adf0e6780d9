"""Exact ranks of values within keys, without a key's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from factloom.session import discard, materialize


def nearest_ranks(rows: DataFrame, key: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """Values at nearest ranks ceil(n * p) of each key (AG-5): key, n, min_value, max_value and one column per fraction.

    Equal values of a key are counted first. The distinct values are dealt by
    ranges of (key, value), so a key with many of them lies in several parts;
    sums of the parts tell which part holds a rank, and only that part's values
    of the key are put in order. Null values take no part; a null key is a key.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("c"))
    placed = materialize(counted.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()), "ranked-values")
    parts = placed.groupBy("key", "part").agg(F.sum("c").alias("m"), F.min("value").alias("low"), F.max("value").alias("high"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    totals = parts.groupBy("key").agg(F.sum("m").alias("n"), F.min("low").alias("min_value"), F.max("high").alias("max_value"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("n") * p)).cast("long").alias("rank")) for name, p in fractions.items()]))
    targets = totals.select(F.col("key").alias("k"), asked.alias("t")).select("k", "t.*")
    holds = F.col("key").eqNullSafe(F.col("k")) & (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("m"))
    wanted = parts.join(targets, holds).select("k", F.col("part").alias("p"), "name", (F.col("rank") - F.col("before")).alias("place"))
    near = placed.join(wanted.select("k", "p").distinct(), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")), "left_semi")
    upto = F.sum("c").over(Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("upto", upto)
    at = F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")) & (F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("c"))
    found = near.join(wanted, at).groupBy("key").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in fractions])
    out = totals.join(found.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).drop("k")
    out = materialize(out.withColumnRenamed("key", key), "ranks")
    discard(placed)
    return out
