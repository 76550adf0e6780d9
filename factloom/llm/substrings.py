"""Exact removal of repeated substrings with a logarithmic family of suffix arrays.

A window is a string of `length` bytes inside one text. Each window has an
anchor: the smallest hash among its grams of `GRAM` bytes. Equal windows have
equal anchors, and neighbouring windows mostly share theirs, so a text falls
into segments of windows with one anchor. Segments are sent to the bucket of
their anchor, where every copy of a window meets the others. Inside a bucket
segments arrive in batches by (doc_id, start): each batch gets a suffix array
over its windows, is merge-scanned against the sorted levels that exist, and
becomes a level itself; levels of equal size are merged, so their sizes grow
geometrically.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import materialize, mix64, query, row_chunks, text_bytes

GRAM = 16
#: Segments overlap by nearly a window, so they are worth a slow compression before they are sent.
_CODEC = pa.Codec("zstd", compression_level=6)
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CHUNK = 1 << 20


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each position, by doubling (gram is a power of two)."""
    h, size = _CODES[data], 1
    while size < gram:
        h = mix64(h[:-size] * np.uint64(0xA24BAED4963EE407) + h[size:]) if size >= 8 else h[:-size] * np.uint64(0xA24BAED4963EE407) + (h[size:] ^ np.uint64(size * 0x51ED2701))
        size *= 2
    return h


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of `width` values from each position."""
    m, size = values, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[:-rest], m[rest:]) if rest else m


_NONE = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))


def _close_repeats(grams: np.ndarray, width: int) -> np.ndarray:
    """Places around which a window may equal one that starts less than `width` later.

    Such windows have `width` equal grams in a row, so it is enough to look at every width-th gram.
    """
    padded = np.append(grams, np.zeros(width, np.uint64))
    ahead = np.lib.stride_tricks.sliding_window_view(padded[1:], width - 1)[: len(grams) : width]
    return np.flatnonzero((ahead == grams[::width, None]).any(axis=1)) * width


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, anchor, and possible repeats inside, of each segment of the rows' windows."""
    if len(data) < length:
        return _NONE
    width = length - GRAM + 1
    grams = _gram_hashes(data, GRAM)
    anchors = _window_minima(grams, width)
    starts = np.arange(len(anchors))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchors)]
    inside = starts + length <= offsets[rows + 1]  # windows that don't cross into the next row
    starts, rows, anchors = starts[inside], rows[inside], anchors[inside]
    if not len(starts):
        return _NONE
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    close = _close_repeats(grams, width)
    at = np.searchsorted(close, starts[first] - width)
    inner = (at < len(close)) & (np.append(close, len(data) + 2 * width)[at] <= starts[last] + width)
    # Windows that are further apart in one segment are not among the close ones.
    inner |= last - first >= width
    return rows[first], starts[first], starts[last], anchors[first], inner


def _single_windows(data: np.ndarray, length: int, rows, first, last, anchor, inner, hot: np.ndarray):
    """Segments of hot anchors as single windows, with a hash of the window for an anchor; the other segments as they are."""
    is_hot = np.isin(anchor, hot)
    if not is_hot.any():
        return rows, first, last, anchor, inner
    count = (last - first + 1)[is_hot]
    start = np.repeat(first[is_hot], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    grams, key = _gram_hashes(data, GRAM), np.zeros(len(start), np.uint64)
    for at in [*range(0, length - GRAM, GRAM), length - GRAM]:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grams[start + at])
    cold = ~is_hot
    return (
        np.concatenate([rows[cold], np.repeat(rows[is_hot], count)]), np.concatenate([first[cold], start]), np.concatenate([last[cold], start]),
        np.concatenate([anchor[cold], key]), np.concatenate([inner[cold], np.zeros(len(start), bool)]),
    )


def _count_anchors(length: int):
    """How many different segments of each batch have each anchor."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            found, seen = [np.zeros(0, np.uint64)], set()
            for lo, hi in row_chunks(offsets, _CHUNK):
                part = data[offsets[lo] : offsets[hi]]
                _, first, last, anchor, _ = segments(part, offsets[lo : hi + 1] - offsets[lo], length)
                raw = part.tobytes()
                pieces = [hash(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
                fresh = [i for i, p in enumerate(pieces) if not (p in seen or seen.add(p))]
                found.append(anchor[fresh])
            anchors, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    return run


def hot_anchors(docs: DataFrame, length: int, most: int, share: int = 64) -> np.ndarray:
    """Anchors of more than `most` segments, by the documents of one in `share` hashes of the id.

    This decides how work is dealt, never a result. There are at most 50,000: the bound rises with the table.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    counts = materialize(sample.mapInArrow(_count_anchors(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") > max(most / share, total / 50_000)).select("anchor").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _cut(length: int, buckets: int, hot: np.ndarray):
    """Texts to segments. Of equal segments in a batch only the first is sent on; the others repeat it for sure."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            data, offsets = text_bytes(batch.column(1).take(pa.array(order)))
            seen: dict[bytes, int] = {}
            docs, starts, anchors, parts, inners = [], [], [], [], []
            gone: list[np.ndarray] = []
            for lo, hi in row_chunks(offsets, _CHUNK):
                at = offsets[lo]
                part = data[at : offsets[hi]]
                found = segments(part, offsets[lo : hi + 1] - at, length)
                rows, first, last, anchor, inner = _single_windows(part, length, *found, hot) if len(hot) else found
                raw = part.tobytes()
                fresh = np.zeros(len(first), bool)
                for i, (a, b) in enumerate(zip(first.tolist(), (last + length).tolist(), strict=True)):
                    piece = raw[a:b]
                    if piece not in seen:
                        seen[piece] = i
                        fresh[i] = True
                        parts.append(piece)
                doc = ids[lo + rows]
                begin = first - (offsets[lo + rows] - at)
                docs.append(doc[fresh])
                starts.append(begin[fresh])
                anchors.append(anchor[fresh])
                inners.append(inner[fresh])
                old = ~fresh
                gone.append(np.stack([doc[old], begin[old], begin[old] + (last - first)[old] + length]))
            if not docs:
                continue
            doc, start, anchor = np.concatenate(docs), np.concatenate(starts), np.concatenate(anchors)
            bucket = (mix64(anchor) % np.uint64(buckets)).astype(np.int64)
            sizes = np.array([len(x) for x in parts], np.int64)
            sizes[np.concatenate(inners)] *= -1  # the sign says that windows may repeat inside
            yield from _packed(bucket, doc, start, anchor, sizes, parts)
            again = np.concatenate(gone, axis=1)
            if again.shape[1]:
                yield _row(-1, again[0], again[1], np.zeros(0, np.uint64), again[2] - again[1], b"")

    return run


_BLOB = "bucket int, docs binary, starts binary, anchors binary, sizes binary, bytes binary"


def _row(bucket: int, docs, starts, anchors, sizes, data: bytes) -> pa.RecordBatch:
    """A row of packed columns: ids as differences, anchors cut to the 32 bits that the bucket number leaves."""
    values = [np.diff(docs, prepend=0).astype(np.int64), starts.astype(np.int32), (anchors >> np.uint64(32)).astype(np.uint32), sizes.astype(np.int32), data]
    packed = [_pack(x if isinstance(x, bytes) else x.tobytes()) for x in values]
    return pa.RecordBatch.from_arrays([pa.array([int(bucket)], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["bucket", "docs", "starts", "anchors", "sizes", "bytes"])


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(_unpack(x.as_py()), kind) for x in table.column(name)])


def _documents(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(_unpack(x.as_py()), np.int64)) for x in table.column("docs")])


def _packed(bucket, doc, start, anchor, sizes, parts):
    """One row for each bucket with all of its segments."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        pick = order[lo:hi]
        yield _row(bucket[pick[0]], doc[pick], start[pick], anchor[pick], sizes[pick], b"".join([parts[i] for i in pick.tolist()]))


class Levels:
    """Sorted window arrays whose sizes grow geometrically; a window's earliest place is kept with it."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def known(self, sorted_windows: np.ndarray) -> np.ndarray:
        """Which of these windows, in sorted order, stand in a level: a merge scan against each."""
        found = np.zeros(len(sorted_windows), bool)
        for level in self.levels:
            if len(level) > 8 * len(sorted_windows):
                # A long level is skipped through: each window looks from where it would stand.
                at = np.searchsorted(level, sorted_windows)
                at[at == len(level)] = 0
                found |= level[at] == sorted_windows
            else:
                both = np.concatenate([level, sorted_windows])
                order = np.argsort(both, kind="stable")  # two sorted runs: a merge, of equal windows the level's first
                merged = both[order]
                again = np.flatnonzero(merged[1:] == merged[:-1]) + 1
                found[order[again] - len(level)] = True
        return found

    def add(self, sorted_windows: np.ndarray) -> None:
        """Put in a new level and merge equal-sized ones."""
        if not len(sorted_windows):
            return
        self.levels.append(sorted_windows)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            both = np.concatenate([a, b])
            both.sort(kind="stable")  # two sorted runs: a merge
            self.levels.append(both)


def _find(length: int, batch_windows: int):
    """Segments of one bucket to the runs of bytes that repeat an earlier window."""

    def run(table: pa.Table) -> pa.Table:
        docs, starts, sizes = _documents(table), _column(table, "starts", np.int32).astype(np.int64), _column(table, "sizes", np.int32).astype(np.int64)
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"doc_id": docs, "start": starts, "end": starts + sizes})
        anchors = _column(table, "anchors", np.uint32)
        inner_repeats, sizes = sizes < 0, np.abs(sizes)
        data = np.frombuffer(b"".join([_unpack(x.as_py()) for x in table.column("bytes")]), np.uint8)
        at = np.cumsum(sizes) - sizes
        # An anchor that came once has no window to share, but for repeats inside its segment.
        _, which, counts = np.unique(anchors, return_inverse=True, return_counts=True)
        pick = np.flatnonzero((counts[which] > 1) | inner_repeats)
        pick = pick[np.lexsort((starts[pick], docs[pick]))]
        windows = sizes[pick] - length + 1
        levels, out = Levels(), ([], [], [])
        batch_of = (np.cumsum(windows) - 1) // batch_windows
        for lo, hi in _runs(batch_of):
            rows, n = pick[lo:hi], windows[lo:hi]
            segment = np.repeat(np.arange(len(rows)), n)
            inner = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
            keys = np.lib.stride_tricks.sliding_window_view(data, length)[at[rows][segment] + inner]
            keys = np.ascontiguousarray(keys).view(f"V{length}").ravel()
            suffixes = _suffix_array(keys)
            ordered = keys[suffixes]
            same = np.zeros(len(ordered), bool)
            same[1:] = ordered[1:] == ordered[:-1]
            text = ordered[~same].view(f"S{length}")
            known = levels.known(text)
            levels.add(text[~known])
            # A stable order puts the earliest copy of a window first in its run.
            repeated = same.copy()
            repeated[~same] = known
            hit = np.zeros(len(keys), bool)
            hit[suffixes] = repeated
            doc, start = docs[rows][segment], starts[rows][segment] + inner
            first, last = _hit_runs(hit, segment)
            out[0].append(doc[first])
            out[1].append(start[first])
            out[2].append(start[last] + length)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"doc_id": columns[0], "start": columns[1], "end": columns[2]})

    return run


def _suffix_array(keys: np.ndarray) -> np.ndarray:
    """The windows' places in byte order; equal windows keep their order."""
    words = np.ascontiguousarray(keys.view(np.uint8).reshape(len(keys), -1))
    text = words.view(f"S{words.shape[1]}").ravel()
    return np.argsort(text, kind="stable")


def _runs(groups: np.ndarray):
    cuts = np.flatnonzero(np.diff(groups, prepend=-1))
    return zip(cuts, np.append(cuts, len(groups))[1:], strict=True)


def _hit_runs(hit: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of hits inside a segment."""
    first, last = hit.copy(), hit.copy()
    if len(hit) > 1:
        joined = segment[1:] == segment[:-1]
        first[1:] &= ~(hit[:-1] & joined)
        last[:-1] &= ~(hit[1:] & joined)
    return np.flatnonzero(first), np.flatnonzero(last)


def repeated_spans(documents: DataFrame, length: int = 100, bucket_bytes: int = 4 << 20, batch_windows: int = 1 << 17, hot_segments: int = 1 << 18) -> DataFrame:
    """Byte runs of texts that are covered by windows with an earlier start: doc_id, start, end.

    Earlier is a smaller doc_id, or the same doc_id and an earlier start. The
    runs of one document may overlap. doc_ids must be distinct and not null.
    Null and empty texts and texts shorter than `length` have none.

    A bucket holds about bucket_bytes of text. Windows of an anchor with more
    than hot_segments different segments are dealt singly, by a hash of the
    whole window, so that no gram of a template gathers its texts in one task.
    """
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, total // bucket_bytes)
    cut = docs.mapInArrow(_cut(length, buckets, hot_anchors(docs, length, hot_segments)), _BLOB)
    # Runs found in the map tasks travel under keys of their own, spread over as many buckets.
    cut = cut.withColumn("key", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("docs"), F.lit(max(8, buckets)))).otherwise(F.col("bucket")))
    return cut.groupBy("key").applyInArrow(_find(length, batch_windows), "doc_id long, start long, end long")


def remove_repeats(documents: DataFrame, length: int = 100, hot_segments: int = 1 << 18) -> DataFrame:
    """doc_id, text bytes, kept bytes and the merged removed runs (array<struct<start,end>>) of every document.

    Texts count as UTF-8 bytes; kept bytes may cut a character, so they are
    binary. Null texts count as empty. Rows of equal ids are ordered by their
    text, rows without an id come last; if there are any such rows, all rows are
    numbered in that order first. An empty table gives no rows. Other columns
    are left out.
    """
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows != ids:
        order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
        # The numbers grow with the partitions, which are ranges of the order.
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id())
        docs = materialize(docs, "numbered")
        out = _removed(docs.drop("__id"), length, hot_segments)
        return out.join(docs.select("doc_id", "__id"), "doc_id").select(F.col("__id").alias("doc_id"), "bytes", "kept", "removed")
    return _removed(docs, length, hot_segments)


def _removed(documents: DataFrame, length: int, hot_segments: int) -> DataFrame:
    """remove_repeats() for distinct ids."""
    spans = repeated_spans(documents, length, hot_segments=hot_segments).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))

    def run(batches):
        for batch in batches:
            kept, runs = [], []
            found = batch.column(2)
            values = found.flatten()
            begin, end = (values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            counts = np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(counts)])
            for i, data in enumerate(batch.column(1).to_pylist()):
                a, b = begin[edges[i] : edges[i + 1]], end[edges[i] : edges[i + 1]]
                pieces, merged, at = [], [], 0
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a, top = a[order], np.maximum.accumulate(b[order])
                    new = np.flatnonzero(np.append(True, a[1:] > top[:-1]))
                    for x, y in zip(a[new].tolist(), top[np.append(new[1:], len(a)) - 1].tolist(), strict=True):
                        pieces.append(data[at:x])
                        merged.append({"start": x, "end": y})
                        at = y
                pieces.append(data[at:])
                kept.append(b"".join(pieces))
                runs.append(merged)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "bytes", "kept", "removed"],
            )

    joined = docs.join(spans, "doc_id", "left").select("doc_id", "bytes", "spans")
    return joined.mapInArrow(run, "doc_id long, bytes binary, kept binary, removed array<struct<start:long,end:long>>")


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark, sf_dir):
    """What is left of every document without the 100-byte strings that start earlier too."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.octet_length("bytes").cast("long")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
