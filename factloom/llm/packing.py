"""Lexical retrieval packing of tokenised documents into fixed windows.

Documents are tokenised once and written. Document frequencies of all tokens
are summed over the corpus. The written documents are dealt by a MinHash of
their heaviest shared tokens, so that likely neighbours come together whatever
file they are in, and packed in index shards: each shard holds an inverted index of BM25 weights over its documents; a seed
opens a window, its best unused neighbours fill it, and the neighbour that is
cut at the window's end goes on as the next window's seed.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import LOWER, bounded_batches, materialize, mix64, query, row_chunks, text_bytes

TOKENIZER = "word_bpe_49k.json"
_CACHE_PIECES = 600_000
_CACHE_BYTES = 96 << 20
_CHUNK = 2 << 20


def _tokenizer(path: str):
    # Spark's tasks use the cores already; the library's own threads would only contend.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The letter for each byte in byte-level vocabularies: itself where printable, else the next letter after 255.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_BLANK, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_B = np.arange(256)
#: Letters are those of ASCII and of U+00C0 to U+017F in UTF-8; other bytes above ASCII are odd.
_KIND = np.select(
    [(_B == 32) | (_B == 10), (_B >= 48) & (_B <= 57), ((_B | 32) >= 97) & ((_B | 32) <= 122) | (_B >= 128) & (_B < 192) | (_B >= 0xC3) & (_B <= 0xC5), (_B > 32) & (_B < 127)],
    [_BLANK, _DIGIT, _LETTER, _MARK],
    _ODD,
).astype(np.uint8)
_CONTRACTED = np.isin(_B | 32, np.frombuffer(b"stmdrvl", np.uint8)) & (_B < 128)
#: Two bytes that are no such letter, or whose letter changes its length in lower case: the signs of times and division, U+0130.
_NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that the tokenizer never joins: their sizes, rows, oddness, and their bytes end to end.

    Words are cut at blanks and line ends. In a word of letters from U+0000 to
    U+017F, digits and ASCII marks, normalising changes nothing but case, and
    the tokenizer splits it into runs of letters, single digits and runs of
    marks, which come in lower-case ASCII. A word is odd, and stays whole, if it has any other byte, an
    apostrophe before a letter that may be contracted, or the start of a
    special token.
    """
    n = len(data)
    kind = _KIND[data]
    odd = kind == _ODD
    if n > 1:
        a, b = data[:-1], data[1:]
        odd[:-1] |= (a == 39) & _CONTRACTED[b] | (a == 60) & (b == 124)
        for lead, follow in _NO_LETTERS:
            odd[:-1] |= (a == lead) & (b == follow)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = kind != _BLANK
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    word, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    odds = np.append(0, np.cumsum(odd, dtype=np.int32))
    odd_word = odds[end] > odds[word]
    step = np.zeros(n + 1, np.int8)
    step[word[odd_word]] += 1
    step[end[odd_word]] -= 1
    whole = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    # Inside words that are not odd, a new kind or a digit starts a new piece.
    first[1:] |= inside[1:] & ~whole[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    starts = np.flatnonzero(first)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    packed = np.where(whole, data, LOWER[data])[inside]
    return np.diff(np.flatnonzero(first[inside]), append=len(packed)), rows, whole[starts], packed


class PieceIds:
    """Ids of pieces as bytes, in two generations: what is not asked for while the younger one fills is forgotten."""

    def __init__(self, path: str, size: int = _CACHE_PIECES) -> None:
        self.tokenizer, self.size = _tokenizer(path), size
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def get(self, keys: list[str], whole: list[bool]) -> list[bytes]:
        """Ids of each key: a piece in lower-case ASCII, or an odd word as it is."""
        young, old, tokens, odd = self.young, self.old, self.model.tokenize, []
        # The many short-lived tokens would start the collector again and again, which finds no cycles here.
        collecting = gc.isenabled()
        gc.disable()
        for key, as_it_is in zip(keys, whole, strict=True):
            if key in young:
                continue
            got = old.get(key)
            if got is None:
                if as_it_is:
                    odd.append(key)
                    continue
                found = [t.id for t in tokens(key if key.isascii() else key.lower().encode().decode("latin-1").translate(_BYTE_LETTERS))]
                got = struct.pack(f"<{len(found)}I", *found)
            young[key] = got
            self.held += len(key) + len(got)
        if collecting:
            gc.enable()
        if odd:
            for key, got in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                young[key] = np.array(got.ids, "<u4").tobytes()
                self.held += len(key) + len(young[key])
        out = [young[key] for key in keys]
        if len(young) > self.size or self.held > _CACHE_BYTES:
            self.young, self.old, self.held = {}, young, 0
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row's followed by end_id, and the n + 1 offsets of the rows in them."""
        n = len(offsets) - 1
        size, rows, odd, packed = pieces(data, offsets)
        if not len(size):
            return np.full(n, end_id, "<u4"), np.arange(n + 1)
        # A dictionary of Arrow finds the different pieces; an odd word's bytes never equal those of a piece that is not.
        edges = np.append(0, np.cumsum(size))
        words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(packed)]).dictionary_encode()
        which = words.indices.to_numpy()
        whole = np.zeros(len(words.dictionary), bool)
        whole[which[odd]] = True
        found = self.get(words.dictionary.to_numpy(zero_copy_only=False).tolist(), whole.tolist())
        count = np.array([len(x) for x in found], np.int64) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(count) - count
        n_ids = count[which]
        total = np.cumsum(n_ids)
        take = np.repeat(begin[which] - (total - n_ids), n_ids) + np.arange(total[-1])
        out = np.full(int(total[-1]) + n, end_id, "<u4")
        out[np.arange(total[-1]) + np.repeat(rows, n_ids)] = flat[take]
        by_row = np.bincount(rows, n_ids, n).astype(np.int64) + 1
        return out, np.append(0, np.cumsum(by_row))


_READY: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    """The tokenizer and its bounded memory of pieces, kept by the process for its next tasks."""
    if path not in _READY:
        _READY[path] = PieceIds(path)
    return _READY[path]


def tokenize(documents: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id long, ids binary (little-endian unsigned 32-bit ids of the whole text, then end_id), tokens int.

    Texts are cut into pieces that the tokenizer never joins; each different
    piece of a batch is looked up or tokenised once. Null texts count as empty
    and hold end_id alone. Repeated rows stay repeated; an empty table gives no
    rows.
    """

    def run(batches):
        known = piece_ids(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_chunks(offsets, _CHUNK):
                out, edges = known.ids(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end_id)
                ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, pa.array(np.diff(edges), pa.int32())], names=["doc_id", "ids", "tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, tokens int")


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number * 2^32 + id of the different ids of each row, in order, and how often each occurs in its row."""
    data, offsets = text_bytes(column)
    ids = data.view("<u4")
    pairs = np.sort((np.repeat(np.arange(len(column)), np.diff(offsets) // 4) << 32) | ids)
    new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[new], np.diff(np.append(new, len(pairs)))


def document_frequencies(tokenized: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each id occurs, and the number of documents. The vocabulary bounds what the driver gets."""

    def run(batches):
        counts, rows = np.zeros(0, np.int64), 0
        for batch in batches:
            pairs, _ = _distinct(batch.column(0))
            found = np.bincount(pairs & 0xFFFFFFFF)
            if len(found) > len(counts):
                counts, found = found, counts
            counts[: len(found)] += found
            rows += batch.num_rows
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], rows))], names=["id", "n"])

    found = tokenized.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ids, n = found["id"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    out = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    out[ids[ids >= 0]] = n[ids >= 0]
    return out, int(n[ids < 0].sum())


class Bm25Shard:
    """Inverted index of one shard's documents with BM25 weights from corpus-wide frequencies.

    A document asks with the query_terms of its own terms that weigh most, of those that another document of the shard has.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, average: float, k1: float = 1.2, b: float = 0.75, query_terms: int = 12) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        key = np.sort(np.concatenate(ids).astype(np.int64) * len(ids) + doc)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(new, len(key)))
        self.term, self.doc = np.divmod(key[new], len(ids))
        weight = idf[self.term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[self.doc] / average))
        self.weight = weight.astype(np.float32)
        self.first = np.searchsorted(self.term, np.arange(int(self.term[-1]) + 2))
        # A seed asks with its heaviest terms among those that another document of the shard has.
        shared = self.first[self.term + 1] - self.first[self.term] > 1
        pick = np.flatnonzero(shared)
        order = pick[np.lexsort((-self.weight[pick], self.doc[pick]))]
        start = np.searchsorted(self.doc[order], np.arange(len(ids) + 1))
        self.queries = [self.term[order[start[i] : min(start[i] + query_terms, start[i + 1])]] for i in range(len(ids))]
        self.n = len(ids)

    def neighbours(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that share query terms with the seed, and their scores."""
        spans = [slice(self.first[t], self.first[t + 1]) for t in self.queries[seed].tolist()]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        docs = np.concatenate([self.doc[s] for s in spans])
        scores = np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.flatnonzero(scores)
        return found, scores[found]


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, average: float, window: int):
    """Yield (document, start, length, sequence, offset) of each piece of one shard.

    The rest that does not fill a window is cut into windows of powers of two, which need no padding.
    """
    index = Bm25Shard(ids, idf, average)
    sizes = [len(x) for x in ids]
    used = np.zeros(len(ids), bool)
    left = sum(sizes)
    sequence, offset = 0, 0
    room = min(window, 1 << (left.bit_length() - 1)) if left else 0
    following = 0
    queue: list[int] = []
    while left:
        # The best unused neighbour of the window's seed, else the next unused document.
        doc = -1
        while queue:
            candidate = queue.pop()
            if not used[candidate]:
                doc = candidate
                break
        if doc < 0:
            while used[following]:
                following += 1
            doc = following
        used[doc] = True
        start = 0
        while start < sizes[doc]:
            take = min(room - offset, sizes[doc] - start)
            yield doc, start, take, sequence, offset
            opened = offset == 0
            start, offset, left = start + take, offset + take, left - take
            if offset == room:
                sequence, offset = sequence + 1, 0
                room = min(window, 1 << (left.bit_length() - 1)) if left else 0
            elif opened:
                # The window's seed; its best neighbours come last, of equal ones the first document.
                found, scores = index.neighbours(doc)
                queue = found[np.argsort(-scores, kind="stable")[::-1]].tolist()


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _lexical_keys(df: np.ndarray, idf: np.ndarray, average: float, kind: str, terms: int = 12, k1: float = 1.2, b: float = 0.75):
    """Rows with the two smallest hashes of each document's heaviest tokens that another document has; 0 without any. Ids are sent on as `kind`."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(text_bytes(batch.column(1))[1]) // 4
            found = np.zeros((2, batch.num_rows), np.int64)
            if sizes.sum():
                pairs, tf = _distinct(batch.column(1))
                row, term = pairs >> 32, pairs & 0xFFFFFFFF
                shared = df[term] > 1
                row, term, tf = row[shared], term[shared], tf[shared]
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / average))
                order = np.lexsort((-weight, row))  # terms are in order already
                row, term = row[order], term[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < terms
                row, hashes = row[top], (mix64((term[top].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).astype(np.int64)
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                for j in range(2):
                    found[j, row[place == j]] = hashes[place == j]
            data, offsets = text_bytes(batch.column(1))
            ids = data.view("<u4").astype(kind)
            sent = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets // 4 * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), sent, pa.array(found[0]), pa.array(found[1])], names=["doc_id", "ids", "key", "second"])

    return run


def pack(tokenized: DataFrame, window: int = 2048, shard_tokens: int = 1 << 20, shard_docs: int = 2048) -> DataFrame:
    """Pieces of all documents in windows of `window` tokens.

    tokenized: doc_id, ids, tokens as from tokenize(), already written. They
    are sorted by lexical keys over all partitions; many documents of one key
    are split by doc_id. An index shard is a run of a partition's documents, up
    to about shard_tokens tokens or shard_docs documents, and neighbours are
    looked for in it alone; sequence_id is the partition's number times 2^32 plus a count.
    Every token lies in exactly one piece. An empty table gives no rows.
    """
    df, n = document_frequencies(tokenized)
    average = (tokenized.agg(F.avg("tokens")).first()[0]) or 1.0
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    # Ids of a vocabulary that 16 bits hold are sent in 16 bits.
    kind = "<u2" if len(df) <= 1 << 16 else "<u4"

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        docs, ids, held, used = [], [], 0, 0

        def flush():
            nonlocal used
            rows = list(pack_shard(ids, idf, average, window))
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            crcs = np.array([zlib.crc32(ids[d][s : s + m]) for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)], np.int64)
            sizes = np.array([len(x) for x in ids], np.int64)
            columns = [np.array(docs, object)[doc], start, length, crcs, sizes[doc], base + used + sequence, offset]
            used += int(sequence[-1]) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                ids.append(np.frombuffer(x.as_buffer(), kind).astype("<u4"))
                held += len(ids[-1])
                if held >= shard_tokens or len(docs) >= shard_docs:
                    yield flush()
                    docs, ids, held = [], [], 0
        if docs:
            yield flush()

    keyed = tokenized.select("doc_id", "ids").mapInArrow(_lexical_keys(df, idf, average, kind), "doc_id long, ids binary, key long, second long")
    order = ("key", "second", "doc_id")
    near = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return near.select("doc_id", "ids").mapInArrow(run, _PIECES)


@query("op10_lexical_packing")
def op10_lexical_packing(spark, sf_dir):
    """All documents packed into windows of 2048 tokens beside their lexical neighbours."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(documents: DataFrame, window: int = 2048) -> DataFrame:
    """Tokenise, write and pack all documents."""
    bounded_batches(documents.sparkSession)
    return pack(materialize(tokenize(documents, tokenizer_path()), "tokens"), window)
