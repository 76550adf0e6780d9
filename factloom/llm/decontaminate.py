"""Benchmark decontamination with an FM-index per training shard.

A shard (a batch of documents in a task) becomes a sequence of word numbers.
Words that no test phrase holds cannot stand in a match, so only maximal runs
of phrase words that are long enough are indexed, each behind a separator. The
index is the Burrows-Wheeler transform of that sequence in a wavelet matrix:
all phrases are searched backwards at once, their occurrences are located by
walking to sampled suffix positions, and overlapping ones merge into removal
spans.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import materialize, query, row_chunks, text_bytes, words

_CHUNK = 1 << 20
_SAMPLE = 8


class WaveletMatrix:
    """Rank and access over a sequence of small numbers, one bit level at a time."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = ((sequence >> level) & 1).astype(bool)
            ones = np.zeros(len(sequence) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            zeros = len(sequence) - int(ones[-1])
            self.levels.append((level, bit, ones, zeros))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        at, start = places, np.zeros_like(places)
        for level, _, ones, zeros in self.levels:
            one = ((symbols >> level) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return at - start

    def access(self, places: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        at, symbol = places, np.zeros_like(places)
        for _, bit, ones, zeros in self.levels:
            one = bit[at]
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return symbol


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling; separators (0) count as distinct, by place."""
    rank = sequence.astype(np.int64)
    gaps = np.flatnonzero(sequence == 0)
    rank += len(gaps)
    rank[gaps] = np.arange(len(gaps))
    n, size = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        if n < 2 or (sorted_rank[1:] != sorted_rank[:-1]).all():
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - size)] = rank[size:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        size *= 2


class FmIndex:
    """Backward search and locating over a sequence that ends with a separator."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        order = suffix_array(sequence)
        self.n = len(sequence)
        bwt = sequence[order - 1]
        self.matrix = WaveletMatrix(bwt, max(1, int(symbols).bit_length()))
        self.before = np.append(0, np.cumsum(np.bincount(sequence, minlength=symbols + 1)))
        self.kept = order % _SAMPLE == 0
        self.kept_rank = np.append(0, np.cumsum(self.kept))
        self.samples = order[self.kept]
        # Separators are told apart, so that walking back over one is never needed: a text starts after it.
        self.at_gap = bwt == 0
        self.gap_place = order

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the phrases; they are right-aligned in a matrix."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            on = np.flatnonzero((lengths > step) & (low < high))
            symbols = phrases[on, width - 1 - step]
            low[on] = self.before[symbols] + self.matrix.rank(symbols, low[on])
            high[on] = self.before[symbols] + self.matrix.rank(symbols, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        out = np.full(len(rows), -1, np.int64)
        left, walked = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(left):
            done = self.kept[rows] | self.at_gap[rows]
            hit = rows[done]
            sampled = self.kept[hit]
            place = np.where(sampled, self.samples[np.minimum(self.kept_rank[hit], len(self.samples) - 1)], self.gap_place[hit])
            out[left[done]] = place + walked
            left, rows = left[~done], rows[~done]
            symbols = self.matrix.access(rows)
            rows = self.before[symbols] + self.matrix.rank(symbols, rows)
            walked += 1
        return out


class Phrases:
    """The windows of test items as places in one sequence of word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        _, _, rows, hashes = words(data, offsets)
        self.words, numbers = np.unique(hashes, return_inverse=True)
        self.symbols = (numbers + 1).astype(np.int32)
        count = np.bincount(rows, minlength=len(items))
        windows = np.where(count > 0, np.maximum(1, count - window + 1), 0)
        self.names = [name for name, _ in items]
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), windows)
        first = (np.cumsum(count) - count)[self.item]
        self.at = (first + np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
        self.lengths = np.minimum(count[self.item], window).astype(np.int32)
        self.width = int(self.lengths.max(initial=1))
        self.shortest = int(self.lengths.min(initial=1))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.words & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def matrix(self, pick: np.ndarray) -> np.ndarray:
        """The words of these windows, right-aligned."""
        places = self.at[pick, None].astype(np.int64) + self.lengths[pick, None] - self.width + np.arange(self.width)
        return self.symbols[np.maximum(places, 0)].astype(np.int64)

    def possible(self, sequence: np.ndarray) -> np.ndarray:
        """The windows all of whose words stand in a sequence."""
        present = np.zeros(len(self.words) + 1, bool)
        present[sequence] = True
        missing = np.append(0, np.cumsum(~present[self.symbols], dtype=np.int32))
        return np.flatnonzero(missing[self.at + self.lengths] == missing[self.at])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, 0 for words of no phrase."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.words):
            maybe = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
            same = self.words[at] == hashes[maybe]
            out[maybe[same]] = at[same] + 1
        return out


def _indexed_runs(symbols: np.ndarray, rows: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of long enough runs of phrase words in a row, each after a separator, and its words' numbers."""
    inside = symbols > 0
    first, last = inside.copy(), inside.copy()
    if len(symbols) > 1:
        same = rows[1:] == rows[:-1]
        first[1:] &= ~(inside[:-1] & same)
        last[:-1] &= ~(inside[1:] & same)
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - start >= shortest
    start, size = start[long], (end - start)[long]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.repeat(start, size + 1) + np.arange(int((size + 1).sum())) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1) - 1
    gap = np.cumsum(size + 1) - (size + 1)
    sequence = symbols[word]
    sequence[gap] = 0
    return np.append(sequence, 0), np.append(word, -1)


def _occurrences(phrases: Phrases, index: FmIndex, sequence: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows in an indexed sequence, and the windows' numbers."""
    places, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    possible = phrases.possible(sequence)
    for lo in range(0, len(possible), step):
        pick = possible[lo : lo + step]
        low, high = index.search(phrases.matrix(pick), phrases.lengths[pick])
        count = np.maximum(high - low, 0)
        suffix = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        places.append(index.locate(suffix))
        windows.append(np.repeat(pick, count))
    return np.concatenate(places), np.concatenate(windows)


def _hits(phrases: Phrases, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    """n_words, n_hit, items and spans of one shard's texts, through its FM-index."""
    data, offsets = text_bytes(column)
    n = len(column)
    n_words, parts = np.zeros(n, np.int64), []
    for lo, hi in row_chunks(offsets, _CHUNK):
        starts, ends, rows, hashes = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n_words[lo:hi] = np.bincount(rows, minlength=hi - lo)
        sequence, word = _indexed_runs(phrases.numbers(hashes), rows, phrases.shortest)
        if len(word):
            text = word[:-1]  # the last separator is added once for the shard
            parts.append((sequence[:-1], rows[text] + lo, starts[text] + offsets[lo] - offsets[lo + rows[text]], ends[text] + offsets[lo] - offsets[lo + rows[text]]))
    spans: list[list[dict]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    n_hit = np.zeros(n, np.int64)
    if parts:
        sequence, rows, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        place, which = _occurrences(phrases, FmIndex(np.append(sequence, 0), len(phrases.words)), sequence)
        cover = np.bincount(place, minlength=len(sequence) + 1) - np.bincount(place + phrases.lengths[which], minlength=len(sequence) + 1)
        hit = np.cumsum(cover)[: len(sequence)] > 0
        n_hit = np.bincount(rows[hit], minlength=n)
        first, last = hit.copy(), hit.copy()
        first[1:] &= ~hit[:-1]
        last[:-1] &= ~hit[1:]
        for row, x, y in zip(rows[first].tolist(), starts[first].tolist(), ends[last].tolist(), strict=True):
            spans[row].append({"start": x, "end": y})
        pairs = np.unique(rows[place] * len(phrases.names) + phrases.item[which])
        for row, w in zip((pairs // len(phrases.names)).tolist(), (pairs % len(phrases.names)).tolist(), strict=True):
            items[row].append(phrases.names[w])
    return n_words, n_hit, [sorted(set(x)) for x in items], spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(shared):
    def run(batches):
        for batch in batches:
            n_words, n_hit, items, spans = _hits(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return run


def _cut(shared):
    """Batches of documents without their spans."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            spans = _hits(shared.value, batch.column(at))[3]
            texts = {i: _without(batch.column(at)[i].as_py(), own) for i, own in enumerate(spans) if own}
            if texts:
                for name, value in (("text", lambda t: t), ("n_chars", len)):
                    if (k := batch.schema.get_field_index(name)) >= 0:
                        new = batch.column(k).to_pylist()
                        for i, text in texts.items():
                            new[i] = value(text)
                        batch = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
            yield batch

    return run


def _without(text: str, spans: list[dict]) -> str:
    data = text.encode()
    return b"".join(data[a:b] for a, b in zip([0, *(s["end"] for s in spans)], [*(s["start"] for s in spans), len(data)], strict=True)).decode()


_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_windows: int = 4 << 20) -> DataFrame:
    """Benchmark windows in documents: doc_id, n_words, n_hit, items (ids as strings, sorted), spans.

    Words are lower-cased runs of ASCII letters and digits and non-ASCII
    characters. A window is `window` words of an item in a row; an item of
    fewer words is one window. Every word inside an occurrence is hit; spans
    are merged byte ranges of the text in UTF-8.

    The windows go to all tasks as a broadcast, so they are counted first:
    beyond max_windows the items are dealt into several blocks, each in a pass
    of its own, and the blocks' results are merged by a row number that is
    written with the documents. The number of blocks changes no result. Null
    texts hold no words; items without words match nothing; items without an id
    count as one of the empty name. Every row of documents gives a row, also where ids are null
    or repeated. Empty tables on either side are fine. Other columns are left out.
    """
    docs, blocks = documents.select(F.col("doc_id").cast("long"), "text"), _blocks(benchmark, window, max_windows)
    if len(blocks) == 1:
        return docs.mapInArrow(_scan(_shared(blocks[0], window)), _SCHEMA)
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = [docs.select("row", "text").mapInArrow(_scan(_shared(b, window)), _SCHEMA) for b in blocks]
    return _merged(docs, reduce(DataFrame.unionByName, found))


def _blocks(benchmark: DataFrame, window: int, max_windows: int) -> list[DataFrame]:
    """The items in blocks of about max_windows windows each."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(F.greatest(count - window + 1, F.least(count, F.lit(1))))).first()[0] or 0
    n = -(-total // max_windows) or 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _shared(items: DataFrame, window: int):
    """The phrases of a block as a broadcast; its windows are counted, so its size is bounded."""
    return items.sparkSession.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in items.collect()], window))


def remove_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_windows: int = 4 << 20) -> DataFrame:
    """Documents without the bytes of their spans; n_chars, where present, follows the new text.

    Each row is searched and cut in its task, so null and repeated ids don't
    matter. With more than max_windows windows the spans of all blocks are
    found first and joined by a row number; the result is the same. Rows
    without spans come back as they are, in the same columns.
    """
    blocks = _blocks(benchmark, window, max_windows)
    if len(blocks) == 1:
        return documents.mapInArrow(_cut(_shared(blocks[0], window)), documents.schema)
    numbered = materialize(documents.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = find_contamination(numbered.select(F.col("__row").alias("doc_id"), "text"), benchmark, window, max_windows)
    return cut_spans(numbered, found.withColumnRenamed("doc_id", "__row"), "__row").select(*documents.columns)


def _merged(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per row number from the results of several blocks."""
    found = found.withColumnRenamed("doc_id", "row")
    grouped = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches):
        for batch in batches:
            out, hits = [], []
            for text, spans in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                starts, ends, _, _ = words(*text_bytes(pa.array([text], pa.string())))
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, np.searchsorted(starts, [s["start"] for s in spans]), 1)
                np.add.at(cover, np.searchsorted(ends, [s["end"] for s in spans], side="right"), -1)
                hit = np.cumsum(cover)[:-1] > 0
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                out.append([{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)])
                hits.append(int(hit.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), batch.column(2), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.join(grouped, "row").select("doc_id", "n_words", "items", "text", "spans").mapInArrow(run, _SCHEMA)


def cut_spans(documents: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with the bytes of their spans removed from text; n_chars, where present, follows the new text.

    Documents without spans are returned as they are. Ids must be distinct;
    remove_contamination() has no such condition.
    """
    hits = found.where(F.size("spans") > 0).select(id_col, F.col("spans").alias("__spans"))
    joined = documents.join(hits, id_col, "left")
    data = F.col("text").cast("binary")
    # The kept pieces lie between the end of one span and the start of the next.
    edges = F.transform(F.sequence(F.lit(0), F.size("__spans")), lambda i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("__spans.end"), i - 1)).alias("a"),
        F.coalesce(F.get(F.col("__spans.start"), i), F.octet_length("text").cast("long")).alias("b"),
    ))
    kept = F.array_join(F.transform(edges, lambda e: F.decode(F.substring(data, (e["a"] + 1).cast("int"), (e["b"] - e["a"]).cast("int")), "UTF-8")), "")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn("text", text)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*documents.columns)


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS k
  FROM (SELECT *, least(10, len(w)) AS n, unnest(range(greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)
), dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS k
  FROM (SELECT dw.*, n, unnest(range(len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win) AS sizes)
), hit AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, k)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op9_fm_index_decontaminate", OP9_SQL)
def op9_fm_index_decontaminate(spark, sf_dir):
    """Benchmark windows of ten words in all documents."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
