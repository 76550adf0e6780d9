"""Sharding by global byte-size prefix sums, cut at equal targets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import materialize, query


def assign_shards(df: DataFrame, id_col: str = "doc_id", size_col: str = "size", shards: int = 16) -> DataFrame:
    """Put rows into contiguous shards of nearly equal byte size.

    The rows are range-partitioned and sorted on the id (nulls first). Only one
    total per partition is summed over the cluster; prefix sums of these totals
    give each partition its global offset, and a running sum inside the
    partition does the rest. A row goes to the shard in which its middle byte
    falls, so shards are contiguous and differ by at most about one row.

    Returns the columns of df with `shard` int and `slot` long (gapless from 0
    within a shard); input columns of these names are replaced.

    Null sizes count as 0. Rows with equal ids keep their order of reading and
    may be split between partitions, so one hot id is no bottleneck. If all
    sizes are 0, all rows go to shard 0. An empty table gives no rows.
    """
    df = df.drop("shard", "slot")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.monotonically_increasing_id()
    placed = df.withColumn("__tie", tie)
    placed = placed.repartitionByRange(n, F.col(id_col).asc_nulls_first(), "__tie").sortWithinPartitions(F.col(id_col).asc_nulls_first(), "__tie")
    # The partition number is written with the rows: reading them back may split files.
    placed = placed.select("*", F.spark_partition_id().alias("__part")).drop("__tie")
    written = materialize(_numbered(placed, size_col), "shards")
    # One row per partition, so the driver holds as many numbers as there are partitions.
    totals = sorted((r[0], r[1] or 0, r[2]) for r in written.groupBy("__part").agg(F.max("__end"), F.count("*")).collect())
    starts, rows_before, total, count = {}, {}, 0, 0
    for part, size, rows in totals:
        starts[part], rows_before[part] = total, count
        total, count = total + size, count + rows
    spark = df.sparkSession
    bases = spark.createDataFrame([(p, starts[p], rows_before[p]) for p in starts], "__part int, __base long, __rows long")
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    middle = (F.col("__base") + F.col("__end")) * 2 - size
    shard = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2 * max(total, 1)))).cast("int")
    out = written.join(F.broadcast(bases), "__part").select(*df.columns, shard.alias("shard"), (F.col("__rows") + F.col("__row")).alias("__row"))
    first = out.groupBy("shard").agg(F.min("__row").alias("__first"))
    return out.join(F.broadcast(first), "shard").select(*df.columns, "shard", (F.col("__row") - F.col("__first")).alias("slot"))


def _numbered(placed: DataFrame, size_col: str) -> DataFrame:
    """Add the row number `__row` and the running size `__end` within each partition."""
    names = placed.columns

    def run(batches):
        row = end = 0
        for batch in batches:
            sizes = np.nan_to_num(batch.column(names.index(size_col)).to_numpy(zero_copy_only=False).astype("float64")).astype("int64")
            ends = end + np.cumsum(sizes)
            rows = row + np.arange(len(sizes))
            if len(sizes):
                row, end = row + len(sizes), int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64()), pa.array(ends, pa.int64())], names=[*names, "__row", "__end"])

    from pyspark.sql import types as T

    schema = T.StructType([*placed.schema.fields, T.StructField("__row", T.LongType()), T.StructField("__end", T.LongType())])
    return placed.mapInArrow(run, schema)


OP4_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i AS c, 0 AS n FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8
), crc AS (SELECT list(c ORDER BY byte) AS steps FROM bits WHERE n = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
sized AS (
  SELECT doc_id, n + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc
), placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, CAST(least(15, (2 * upto - size) * 16 // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""


@query("op4_shard_by_bytes", OP4_SQL)
def op4_shard_by_bytes(spark, sf_dir):
    """All documents in 16 contiguous shards (by doc_id) of nearly equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
