"""Nested views of an entity and what belongs to it, and listings of several logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Child:
    """Rows that belong to a root by the same key: the columns to show, their order and how many are shown."""

    rows: DataFrame
    columns: list[str]
    order: list[Column]
    most: int = 20


def dossier(roots: DataFrame, key: str, children: dict[str, Child]) -> DataFrame:
    """Roots with n_<name> (all) and <name> (array of the first `most` structs, in order) of each child (JN-9 to JN-19, TK-5).

    The lists are top-n reports: Spark cuts a key to `most` rows before the
    shuffle too, and the counts are partial aggregates, so a root with a third
    of all children fits. A root without children has 0 and an empty array; rows
    with a null key belong to no root. roots holds each key once.
    """
    out = roots
    for name, child in children.items():
        rows = child.rows.where(F.col(key).isNotNull())
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*child.order))
        top = rows.withColumn("__rank", rank).where(F.col("__rank") <= child.most)
        item = F.struct("__rank", F.struct(*child.columns).alias("row"))
        lists = top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]).alias(name))
        counts = rows.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
        out = out.join(counts, key, "left").join(lists, key, "left")
        empty = F.expr("array()").cast(out.schema[name].dataType)
        out = out.withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long"))).withColumn(name, F.coalesce(F.col(name), empty))
    return out


def timeline(logs: dict[str, tuple[DataFrame, str, str, Column]], newest: int | None = None) -> DataFrame:
    """Several logs as one (SET-1): id, at, kind, label; each log gives rows, id column, time column and label.

    newest: keep that many of the latest, ties to the smaller kind and id (TK-2).
    """
    out = None
    for kind, (rows, name, time, label) in logs.items():
        part = rows.select(F.col(name).cast("string").alias("id"), F.col(time).cast("timestamp").alias("at"), F.lit(kind).alias("kind"), label.cast("string").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out if newest is None else out.orderBy(F.desc("at"), "kind", "id").limit(newest)


def page(rows: DataFrame, key: str, after: object | None, limit: int) -> DataFrame:
    """The next rows by a unique key after the last one seen (TK-1); limit is held between 1 and 50. No offset is counted."""
    following = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return following.orderBy(key).limit(max(1, min(50, limit)))


def fair_order(due: DataFrame, source: str, finish: str, weight: str, claimed: str, item: str) -> DataFrame:
    """One due item per source, the least weighted finish, in a fair order (TK-3).

    Sorted by last claim (never claimed first), weighted finish, source and
    item. A weight of 0 or null comes last. The best of a source is a partial aggregate.
    """
    share = F.coalesce(F.try_divide(F.col(finish), F.col(weight)), F.lit(float("inf")))
    best = F.min(F.struct(share.alias("weighted_finish"), F.col(item))).alias("__best")
    top = due.groupBy(source).agg(best, F.max(claimed).alias(claimed))
    flat = top.select(source, F.col(f"__best.{item}").alias(item), "__best.weighted_finish", claimed)
    return flat.orderBy(F.asc_nulls_first(claimed), "weighted_finish", source, item)
