"""Phrase collocations from a prefix-free parse.

A text is a sequence of pieces (between punctuation and line ends) of words.
Wherever max_words - 1 consecutive words of a piece hash to a trigger, the text
is cut: a chunk runs from one trigger to the end of the next, so neighbours
overlap in a trigger's words and equal passages give equal chunks wherever they
stand. The distinct chunks are the dictionary, with their frequencies in the
parse. Phrases are counted once per distinct chunk and weighted; a phrase
belongs to the chunk in which it starts before the closing trigger, so overlaps
count once.

Counting takes two passes over the dictionary. The first counts hashes of
single words and pairs. The second counts words, pairs and longer phrases by
their bytes, leaving out those that hold a pair whose hash is too rare: a
phrase is no more frequent than its parts. The frequent hashes go to the tasks
as a bitmap of fixed size; where it fills up, fewer phrases are left out and
the counts stay exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm.common import BYTE_CODE, LOWER, bounded_batches, discard, materialize, mix64, query, range_hashes, row_chunks, text_bytes

_IDS = np.arange(256)
#: Blanks between words, and the characters that end a piece.
BLANK, BREAK = np.isin(_IDS, [0x20, 0x09]), np.isin(_IDS, [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
_OTHER_CODE = mix64(BYTE_CODE + np.uint64(0x632BE59BD9B4E019))
#: Bytes of text that are looked at together, and entries a task holds before it passes counts on.
PART_BYTES, HELD = 2 << 20, 2_000_000


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and pieces (numbers that differ between pieces) of all words."""
    brk = BREAK[data]
    inside = ~(brk | BLANK[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows, np.cumsum(brk)[starts] + rows


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given slices, end to end, and their n + 1 offsets."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return data[np.minimum(at, len(data) - 1)], offsets


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def parse_bytes(data: np.ndarray, offsets: np.ndarray, window: int, modulus: int):
    """Chunks of each row: bytes and offsets of the chunks, row, words owned, whether it ends its row, and where it starts in data.

    In a chunk, words are lower-cased, parted by one space in a piece and by a
    line feed between pieces.
    """
    starts, ends, rows, pieces = _tokens(data, offsets)
    n = len(starts)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), none, none, none.astype(bool), none
    plain, at = _gather(LOWER[data], starts, ends - starts + 1)
    joined = np.zeros(n, bool)  # to the next word of the same piece
    joined[:-1] = (pieces[1:] == pieces[:-1]) & (rows[1:] == rows[:-1])
    plain[at[1:] - 1] = np.where(joined, 0x20, 0x0A)
    cut = np.zeros(n, bool)
    if n >= window:
        whole = np.ones(n - window + 1, bool)
        for k in range(window - 1):
            whole &= joined[k : n - window + 1 + k]
        i = np.flatnonzero(whole)
        cut[i] = range_hashes(BYTE_CODE[plain], at[i], at[i + window] - 1) % np.uint64(modulus) == 0
    cut[np.flatnonzero(np.diff(rows, prepend=-1))] = True
    begin = np.flatnonzero(cut)
    after = np.append(begin[1:], n)
    final = np.append(rows[begin[1:]] != rows[begin[:-1]], True)
    stop = np.where(final, after, after + window)
    out, bounds = _gather(plain, at[begin], at[stop] - 1 - at[begin])
    return out, bounds, rows[begin], after - begin, final, starts[begin]


def _long_row(data: np.ndarray, window: int, modulus: int, target: int):
    """parse_bytes of one long row, a part at a time; a part ends where its last chunk starts, and the next begins there."""
    lo, size = 0, target
    while True:
        hi = min(len(data), lo + size)
        while hi < len(data) and not (BLANK[data[hi]] or BREAK[data[hi]]):  # whole words
            more = np.flatnonzero(BLANK[data[hi : hi + 4096]] | BREAK[data[hi : hi + 4096]])
            hi += int(more[0]) if len(more) else min(4096, len(data) - hi)
        out, bounds, rows, owned, final, where = parse_bytes(data[lo:hi], np.array([0, hi - lo]), window, modulus)
        if hi == len(data):
            yield out, bounds, rows, owned, final
            return
        if len(rows) > 1:
            yield out[: bounds[-2]], bounds[:-1], rows[:-1], owned[:-1], final[:-1]
            lo, size = lo + int(where[-1]), target
        else:
            size *= 2


def parse(documents: DataFrame, max_words: int = 3, modulus: int = 32, part_bytes: int = PART_BYTES) -> DataFrame:
    """The dictionary of the prefix-free parse: lang, chunk, n_words (owned), n (its frequency).

    Null texts are empty and give no chunk; a null lang counts as `und`. Rows
    that repeat count again. Other columns are not read. Long texts are parsed
    in parts with the same result.
    """
    window = max_words - 1
    bounded_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            langs = batch.column(0)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_chunks(offsets, part_bytes):
                part, ends = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                if len(part) > 2 * part_bytes:
                    found = _long_row(part, window, modulus, part_bytes)
                else:
                    found = [parse_bytes(part, ends, window, modulus)[:5]]
                for out, bounds, rows, owned, final in found:
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([langs.take(pa.array(rows + lo)), _strings(out, bounds), pa.array(owned, pa.int32()), pa.array(final)], names=["lang", "chunk", "n_words", "final"])

    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    chunks = rows.mapInArrow(run, "lang string, chunk string, n_words int, final boolean")
    return chunks.groupBy("lang", "chunk", "n_words", "final").agg(F.count(F.lit(1)).alias("n")).drop("final")


class _Grams:
    """The phrases that the chunks of a batch own, with hashes and weights."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.data, ends = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        self.starts, self.ends, self.rows, pieces = _tokens(self.data, ends)
        names = batch.column(0).slice(lo, hi - lo).dictionary_encode()
        self.langs, codes = names.dictionary.to_pylist(), names.indices.to_numpy()
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in self.langs], np.uint64)
        self.lang = codes[self.rows]
        self.salt = salts[self.lang]
        owned, n = (np.asarray(batch.column(i).slice(lo, hi - lo)).astype(np.int64) for i in (2, 3))
        m = len(self.starts)
        self.weight = n[self.rows]
        place = np.arange(m) - np.searchsorted(self.rows, self.rows)
        self.own = place < owned[self.rows]
        self.next = np.zeros(m, bool)
        self.next[:-1] = (pieces[1:] == pieces[:-1]) & (self.rows[1:] == self.rows[:-1])
        self.codes = BYTE_CODE[self.data]

    def of(self, words: int) -> np.ndarray:
        """Where phrases of so many words start, owned or not."""
        m = len(self.starts) - words + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        whole = np.ones(m, bool)
        for k in range(words - 1):
            whole &= self.next[k : m + k]
        return np.flatnonzero(whole)

    def hashes(self, at: np.ndarray, words: int) -> np.ndarray:
        """64-bit hashes of (lang, phrase)."""
        return mix64(range_hashes(self.codes, self.starts[at], self.ends[at + words - 1]) + self.salt[at])


def _parts(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column(1))
    for lo, hi in row_chunks(offsets, PART_BYTES):
        yield _Grams(batch, lo, hi, data, offsets)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def _frequent_hashes(dictionary: DataFrame, min_count: int) -> DataFrame:
    """Hashes of the words and pairs of words whose hash is found at least so often: h."""

    def run(batches):
        keys, sums, held = [], [], 0
        for batch in batches:
            for g in _parts(batch):
                for words in (1, 2):
                    at = g.of(words)
                    at = at[g.own[at]]
                    k, s = _sums(g.hashes(at, words), g.weight[at])
                    keys.append(k)
                    sums.append(s)
                    held += len(k)
                if held >= HELD:
                    k, s = _sums(np.concatenate(keys), np.concatenate(sums))
                    keys, sums, held = [k], [s], len(k)
                    if held >= HELD // 2:
                        yield from _counts(k, s)
                        keys, sums, held = [], [], 0
        if keys:
            yield from _counts(*_sums(np.concatenate(keys), np.concatenate(sums)))

    counted = dictionary.mapInArrow(run, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("h")


def _counts(keys: np.ndarray, sums: np.ndarray):
    for lo in range(0, len(keys), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 18)].view(np.int64)), pa.array(sums[lo : lo + (1 << 18)])], names=["h", "n"])


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits places, set where a hash ends in the place's number; its size doesn't depend on the table."""
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(place, 5).alias("word"), F.expr("shiftleft(1L, CAST((h & 31) AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got.column("word").to_numpy()] = got.column("set").to_numpy().astype(np.uint32)
    return out


def phrase_counts(dictionary: DataFrame, max_words: int = 3, min_count: int = 10, bits: int = 27) -> DataFrame:
    """All phrases of 1 to max_words words that occur at least min_count times in a language: lang, phrase, words, f; exact."""
    spark = dictionary.sparkSession
    known = spark.sparkContext.broadcast(_bitmap(_frequent_hashes(dictionary, min_count), bits))
    mask = np.uint64((1 << bits) - 1)

    def frequent(h: np.ndarray) -> np.ndarray:
        h = h & mask
        return (known.value[(h >> np.uint64(5)).astype(np.int64)] >> (h & np.uint64(31)).astype(np.uint32)) & 1 == 1

    def run(batches):
        for batch in batches:
            for g in _parts(batch):
                pair = np.zeros(len(g.starts) + 1, bool)
                for words in range(1, max_words + 1):
                    at = g.of(words)
                    if words == 2:
                        pair[at] = frequent(g.hashes(at, 2))
                    keep = g.own[at]
                    for k in range(words - 1):
                        keep &= pair[at + k]
                    at = at[keep]
                    h = g.hashes(at, words)
                    if words == 1:
                        at, h = at[keep := frequent(h)], h[keep]
                    if len(at):
                        yield _phrases(g, at, words, h)

    counted = dictionary.mapInArrow(run, "lang string, phrase string, words int, n long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)


def _phrases(g: _Grams, at: np.ndarray, words: int, h: np.ndarray) -> pa.RecordBatch:
    """One row per distinct phrase of a part; two hashes together tell phrases apart."""
    other = range_hashes(_OTHER_CODE[g.data], g.starts[at], g.ends[at + words - 1])
    order = np.lexsort((other, h))
    at, h, other = at[order], h[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (other[1:] != other[:-1])]))
    sums, at = np.add.reduceat(g.weight[at], first), at[first]
    out, bounds = _gather(g.data, g.starts[at], g.ends[at + words - 1] - g.starts[at])
    langs = pa.array(g.langs, pa.string()).take(pa.array(g.lang[at]))
    return pa.RecordBatch.from_arrays([langs, _strings(out, bounds), pa.array(np.full(len(at), words), pa.int32()), pa.array(sums)], names=["lang", "phrase", "words", "n"])


def collocations(documents: DataFrame, max_words: int = 3, min_count: int = 10, covered_percent: int = 50, top: int | None = 2000, modulus: int = 32, bits: int = 27) -> DataFrame:
    """Phrases whose words go together: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of its two parts at the cut with the
    lowest score floor(1000000 * a * a / (l * r)) (ties: the earliest cut), n
    the count of all words of the language. A phrase whose words lie inside a
    longer candidate with at least covered_percent of its count is dropped. Of
    each language the first `top` rows (None: all) by score descending, a
    descending, phrase ascending in byte order are returned, so ties don't
    depend on the order of rows. Counts below 10^15 are exact.

    Null texts and an empty table give no rows; a null lang is `und`.
    """
    dictionary = materialize(parse(documents, max_words, modulus), "collocation-chunks")
    counts = materialize(phrase_counts(dictionary, max_words, min_count, bits), "collocation-counts")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("n")).alias("n"))
    out = materialize(rank_phrases(counts, totals, max_words, covered_percent, top), "collocations")
    discard(dictionary)
    discard(counts)
    return out


def rank_phrases(counts: DataFrame, totals: DataFrame, max_words: int = 3, covered_percent: int = 50, top: int | None = 2000) -> DataFrame:
    """Scores and ranks of the phrases of counts (lang, phrase, words, f) under totals (lang, n); see collocations()."""
    words = F.split("phrase", " ")
    join = lambda lo, n: F.array_join(F.slice(words, lo, n), " ")
    cuts = None
    for size in range(2, max_words + 1):
        own = counts.where(F.col("words") == size)
        for k in range(1, size):
            rows = own.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"), join(1, k).alias("head"), join(k + 1, size - k).alias("tail"))
            cuts = rows if cuts is None else cuts.unionByName(rows)
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", (F.lit(1000000).cast("decimal(7,0)") * (big("a") * big("a")).cast("decimal(31,0)"))).withColumn("below", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("top div below"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = None
    for size in range(3, max_words + 1):
        own = counts.where(F.col("words") == size)
        for n in range(2, size):
            for lo in range(1, size - n + 2):
                rows = own.select("lang", join(lo, n).alias("phrase"), "f")
                inside = rows if inside is None else inside.unionByName(rows)
    if inside is not None:
        covers = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        best = best.join(covers, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer"), F.lit(0)) < covered_percent * F.col("a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p),
t AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM s WINDOW o AS (PARTITION BY id ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
g AS (
  SELECT lang, 1 AS words, x AS phrase FROM t
  UNION ALL SELECT lang, 2, x || ' ' || y FROM t WHERE y IS NOT NULL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM t WHERE z IS NOT NULL
), f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1
), k AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE words = 3
), sc AS (
  SELECT k.*, h.f AS l, t.f AS r, CAST((1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM k JOIN f h ON h.lang = k.lang AND h.phrase = k.head JOIN f t ON t.lang = k.lang AND t.phrase = k.tail
), b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
v AS (
  SELECT lang, phrase, max(longer) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a AS longer FROM c WHERE words = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE words = 3) GROUP BY ALL
), o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase WHERE 100 * coalesce(v.longer, 0) < 50 * a
)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n.n AS n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


@query("op13_prefix_free_collocations", OP13_SQL)
def op13_prefix_free_collocations(spark, sf_dir):
    """The first 2,000 phrases of 2 to 3 words of each language of all documents (null lang: `und`; null text: no words; ties by phrase)."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
