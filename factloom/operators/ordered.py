"""Running values of a key's ordered rows that don't need the whole key in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def _marked(df: DataFrame, keys: list[str], bucket: Column, per_bucket: Column, over: Column, backward: bool) -> DataFrame:
    """df with __bucket and __before: `over`, a window expression on per_bucket, of the buckets before the row's own."""
    work = df.withColumn("__bucket", bucket)
    totals = work.groupBy(*keys, "__bucket").agg(per_bucket.alias("__part"))
    order = F.col("__bucket").desc_nulls_last() if backward else F.col("__bucket").asc_nulls_first()
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marks = totals.select(*[F.col(k).alias(f"__m{n}") for n, k in enumerate([*keys, "__bucket"])], over.over(earlier).alias("__before"))
    same = F.lit(True)
    for n, k in enumerate([*keys, "__bucket"]):
        same = same & F.col(k).eqNullSafe(F.col(f"__m{n}"))
    return work.join(marks, same).drop(*[f"__m{n}" for n in range(len(keys) + 1)])


def carry(df: DataFrame, name: str, keys: list[str], order: list[str], value: Column, when: Column, bucket: Column | None = None, inclusive: bool = False, backward: bool = False) -> DataFrame:
    """Add the key's latest `value` before each row (with it, if inclusive) among rows where `when` is true.

    backward: the next one after each row instead. A null `when` is false; a
    null value is carried like any other. order is unique within a key.

    bucket: a value that grows with order, such as the day. Then the latest of
    each bucket comes from an aggregate with partial results, is carried over
    the few buckets, and rows are sorted within one bucket only, so a key with
    any share of the rows spreads over its buckets. Without it a key is sorted
    in one task.
    """
    item = F.when(F.coalesce(when, F.lit(False)), F.struct(value.alias("v")))
    at = F.struct(*order)
    work = df.withColumn("__item", item)
    if bucket is not None:
        latest = (F.min_by if backward else F.max_by)(F.col("__item"), F.when(F.col("__item").isNotNull(), at))
        work = _marked(work, keys, bucket, latest, F.last("__part", ignorenulls=True), backward)
    by = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    inside = Window.partitionBy(*keys, *(["__bucket"] if bucket is not None else [])).orderBy(*by)
    near = F.last("__item", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    found = near if bucket is None else F.coalesce(near, F.col("__before"))
    return work.withColumn(name, found["v"]).drop("__item", "__before", "__bucket")


def running_sum(df: DataFrame, name: str, keys: list[str], order: list[str], amount: Column, bucket: Column | None = None) -> DataFrame:
    """Add the sum of amounts up to and with each row; null amounts count nothing. bucket: as in `carry`."""
    work = df.withColumn("__amount", F.coalesce(amount, F.lit(0)))
    if bucket is not None:
        work = _marked(work, keys, bucket, F.sum("__amount"), F.sum("__part"), False)
    inside = Window.partitionBy(*keys, *(["__bucket"] if bucket is not None else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("__amount").over(inside)
    if bucket is not None:
        total = total + F.coalesce("__before", F.lit(0))
    return work.withColumn(name, total).drop("__amount", "__before", "__bucket")


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: dict[str, T.DataType], start: Callable, step: Callable) -> DataFrame:
    """Walk each key's rows in order with a small state and add output columns; for recurrences that no window expresses.

    start(first input values) gives the state before a key's first row;
    step(state, input values) gives the next state and the outputs. Nulls come as
    None; rows with null keys are one key. Rows are spread by keys and sorted by
    Spark, on disk where needed, then read batch by batch, so the memory of a
    task doesn't grow with its keys; one key is walked by one task. See
    segmented_fold for keys with many rows.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in outputs.items()]])
    work = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)

    def walk(batches: Iterator) -> Iterator:
        state, current = None, None
        for batch in batches:
            made = []
            for k, values in _rows(batch, keys, inputs):
                if k != current:
                    state, current = start(*values), k
                state, *out = step(state, *values)
                made.append(out)
            out = batch[names].copy()
            for n, name in enumerate(outputs):
                out[name] = [m[n] for m in made]
            yield out

    return work.mapInPandas(walk, schema)


def _rows(batch: pd.DataFrame, keys: list[str], inputs: list[str]) -> Iterator[tuple[tuple, tuple]]:
    plain = [batch[c].astype(object).where(batch[c].notna(), None) for c in (*keys, *inputs)]
    for row in zip(*plain, strict=True):
        yield row[: len(keys)], row[len(keys) :]


class Transition(Protocol):
    """A map from the state before a run of rows to the state after it."""

    def summarize(self, rows: list[tuple]) -> Any:
        """The map of a run of rows, given as their input values; a small value that can be pickled."""

    def apply(self, summary: Any, state: Any) -> Any:
        """The state after the run."""


def segmented_fold(df: DataFrame, key: str, bucket: Column, order: list[str], inputs: list[str], outputs: dict[str, T.DataType], initial: Any, step: Callable, transition: Transition) -> DataFrame:
    """fold() with each key split into segments, the rows of one bucket, which are worked on side by side.

    bucket grows with order (such as the day; nulls first), and so cuts a key
    into runs. First each segment becomes a map from any state before it to the
    state after it. The maps of a key are applied one after the other, from
    `initial`, which gives the state before each segment. Then all segments are
    walked from their own states. Only a key's maps meet in one task, as a
    stream, and a segment's inputs are held while its map is made.
    """
    work = df.withColumn("__bucket", bucket)
    types = {f.name: f.dataType for f in work.schema.fields}
    parts = T.StructType([T.StructField("__key", types[key]), T.StructField("__part", types["__bucket"]), T.StructField("__map", T.BinaryType())])

    def summarize(batches: Iterator) -> Iterator:
        current, held = None, []
        for batch in batches:
            out = []
            for k, values in _rows(batch, [key, "__bucket"], inputs):
                if k != current:
                    if current is not None:
                        out.append((*current, pickle.dumps(transition.summarize(held))))
                    current, held = k, []
                held.append(values)
            yield pd.DataFrame(out, columns=parts.names)
        if current is not None:
            yield pd.DataFrame([(*current, pickle.dumps(transition.summarize(held)))], columns=parts.names)

    def chain(batches: Iterator) -> Iterator:
        state, current = initial, None
        for batch in batches:
            out = []
            for (k, part), (summary,) in _rows(batch, ["__key", "__part"], ["__map"]):
                if current is None or k != current[0]:
                    state, current = initial, (k,)
                out.append((k, part, pickle.dumps(state)))
                state = transition.apply(pickle.loads(summary), state)
            yield pd.DataFrame(out, columns=parts.names)

    slim = list(dict.fromkeys([key, "__bucket", *order, *inputs]))
    maps = work.select(*slim).repartition(F.col(key), F.col("__bucket")).sortWithinPartitions(key, "__bucket", *order).mapInPandas(summarize, parts)
    starts = maps.repartition(F.col("__key")).sortWithinPartitions("__key", "__part").mapInPandas(chain, parts)
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__part"))
    placed = work.join(starts, same).drop("__key", "__part")
    # The state before a segment comes with each of its rows; the first one's counts.
    entered = lambda *values: pickle.loads(values[-1])
    walked = fold(placed, [key, "__bucket"], order, [*inputs, "__map"], outputs, entered, lambda state, *values: step(state, *values[:-1]))
    return walked.drop("__bucket", "__map")
