"""Language identification of words with a linear-chain conditional random field.

Every word has a label. Its emission potential sums learned weights of the
word itself (a hashed lexicon) and of its byte 3- and 4-grams; the word's
edges count as a byte of their own, so grams at an edge are affixes. Learned
transitions tie neighbouring words together. Forward-backward gives each
word's label probabilities also where the language changes inside a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import LOWER, WORD_BYTE, query, row_chunks, text_bytes, words

_BITS = 16
_SIZE = 1 << _BITS
_BLOCK = 128
_CHUNK = 1 << 20
_GRAM_CODE = np.where(WORD_BYTE, LOWER, 0).astype(np.uint32)


@dataclass
class Model:
    """Potentials of a chain over `labels`: word, 3-gram and 4-gram tables (size, labels) and transitions; all labels start alike."""

    labels: list[str]
    tables: np.ndarray
    transitions: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of the words; their lexicon feature; places, first index a word, and 3- and 4-gram features of their bytes."""
    starts, ends, rows, hashes = words(data, offsets)
    code = np.zeros(len(data) + 3, np.uint32)
    code[1 : len(data) + 1] = _GRAM_CODE[data]
    inside = np.flatnonzero(WORD_BYTE[data])
    # A row's first and last word have edges too, though the next row's bytes follow at once.
    left = code[inside]
    right, far = code[inside + 2], code[inside + 3]
    edge = np.zeros(len(data) + 2, bool)
    edge[offsets] = True
    left[edge[inside]] = 0
    right[edge[inside + 1]] = 0
    far[(right == 0) | edge[inside + 2]] = 0
    own = code[inside + 1]
    tri = (left * np.uint32(0x9E3779B1) + own * np.uint32(0x85EBCA6B)) ^ (right * np.uint32(0xC2B2AE35))
    four = (tri ^ (far * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1))) * np.uint32(0x9E3779B1)
    tri = tri * np.uint32(0x85EBCA6B)
    shift = np.uint32(32 - _BITS)
    size = ends - starts
    first = np.cumsum(size) - size
    return rows, (hashes >> np.uint64(64 - _BITS)).astype(np.int64), first, (tri >> shift).astype(np.int64), (four >> shift).astype(np.int64)


def emissions(model_tables: np.ndarray, lexicon: np.ndarray, first: np.ndarray, tri: np.ndarray, four: np.ndarray) -> np.ndarray:
    """Log potentials of the words' labels."""
    if not len(lexicon):
        return np.zeros((0, model_tables.shape[2]), np.float32)
    grams = model_tables[1][tri] + model_tables[2][four]
    return model_tables[0][lexicon] + np.add.reduceat(grams, first, axis=0)


def marginals(potentials: np.ndarray, rows: np.ndarray, n: int, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of all words of n rows by forward-backward.

    The expected counts of the labels of neighbours in one block are added to `pairs`.

    Rows are cut into blocks, and the blocks' transfer matrices are chained
    first, so the number of steps does not follow the longest row. Padding has
    flat potentials and, as transitions are probabilities, no weight backwards.
    """
    labels = potentials.shape[1]
    count = np.bincount(rows, minlength=n)
    blocks = -(-count // _BLOCK)
    total = int(blocks.sum())
    if not total:
        return np.zeros((0, labels), np.float32)
    first_block = np.cumsum(blocks) - blocks
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    at = (first_block[rows] * _BLOCK + inner)
    grid = np.ones((total * _BLOCK, labels), np.float32)
    grid[at] = np.exp(potentials - potentials.max(axis=1, keepdims=True))
    grid = grid.reshape(total, _BLOCK, labels)
    filled = np.zeros(total * _BLOCK, bool)
    filled[at] = True
    filled = filled.reshape(total, _BLOCK)
    step = transitions.astype(np.float32)
    transfer = np.broadcast_to(np.eye(labels, dtype=np.float32), (total, labels, labels)).copy()
    for t in range(_BLOCK):
        transfer = (transfer.reshape(-1, labels) @ step).reshape(total, labels, labels) * grid[:, t, None, :]
        if t % 8 == 7:
            transfer /= transfer.max(axis=(1, 2), keepdims=True)
    # Vectors that enter each block from the left and from the right.
    enter, leave = np.full((total, labels), 1.0 / labels, np.float32), np.ones((total, labels), np.float32)
    for k in range(1, int(blocks.max())):
        b = first_block[blocks > k] + k
        v = np.einsum("bi,bij->bj", enter[b - 1], transfer[b - 1])
        enter[b] = v / v.sum(axis=1, keepdims=True)
        b = first_block[blocks > k] + blocks[blocks > k] - 1 - k
        v = np.einsum("bij,bj->bi", transfer[b + 1], leave[b + 1])
        leave[b] = v / v.max(axis=1, keepdims=True)
    forward = np.empty_like(grid)
    v = enter
    for t in range(_BLOCK):
        v = (v @ step) * grid[:, t]
        v = v / v.sum(axis=1, keepdims=True)
        forward[:, t] = v
    v, back = leave, step.T.copy()
    for t in range(_BLOCK - 1, -1, -1):
        p = forward[:, t] * v
        if pairs is not None and t:
            both = (forward[:, t - 1, :, None] * step) * (grid[:, t] * v)[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True))[filled[:, t]].sum(axis=0)
        v = (v * grid[:, t]) @ back
        v = v / v.max(axis=1, keepdims=True)
        forward[:, t] = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-30)
    return forward.reshape(-1, labels)[at]


def _train(labels: list[str], batch_rows: int, epochs: int, rate: float, seed: int, run_words: int):
    """Stochastic gradient steps on one group of labelled texts; gives the group's weights."""
    width = len(labels)

    def run(table: pa.Table) -> pa.Table:
        rng = np.random.default_rng(seed)
        # The same texts in the same order, however they arrived.
        table = table.sort_by([("text", "ascending"), ("lang", "ascending")])
        texts, gold = table["text"].to_pylist(), np.array([labels.index(x) for x in table["lang"].to_pylist()])
        tables, moves = np.zeros((3, _SIZE, width), np.float32), np.eye(width) * 2
        squares, move_squares = np.full_like(tables, 1e-3), np.full_like(moves, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch_rows):
                pick = order[lo : lo + batch_rows]
                data, offsets = text_bytes(pa.array([texts[i] for i in pick], pa.string()))
                rows, lexicon, first, tri, four = features(data, offsets)
                if not len(rows):
                    continue
                # Code-switched sequences: runs of words of all texts, shuffled into chains of a block each.
                size = np.append(np.diff(first), len(tri) - first[-1])
                cut = np.flatnonzero((rng.random(len(rows)) < 1 / run_words) | np.append(True, rows[1:] != rows[:-1]))
                length = np.diff(np.append(cut, len(rows)))
                runs = rng.permutation(len(cut))
                n = length[runs]
                word = np.repeat(cut[runs], n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                truth = gold[pick][rows[word]]
                chain = np.arange(len(word)) // _BLOCK
                potentials = emissions(tables, lexicon, first, tri, four)[word]
                steps, expected = _rows_to_one(moves), np.zeros((width, width))
                wrong = -marginals(potentials, chain, int(chain[-1]) + 1, steps, expected)
                wrong[np.arange(len(word)), truth] += 1
                # Transitions follow the gradient as well: pairs that stand in the chains less those expected.
                joined = np.flatnonzero(chain[1:] == chain[:-1])
                pulled = -expected
                np.add.at(pulled, (truth[joined], truth[joined + 1]), 1)
                gradient = (pulled - steps * pulled.sum(axis=1, keepdims=True)) / batch_rows
                move_squares += gradient**2
                moves += rate * gradient / np.sqrt(move_squares)
                by_word = np.empty_like(wrong)
                by_word[word] = wrong
                by_byte = np.repeat(by_word, size, axis=0)
                for k, (index, g) in enumerate(((lexicon, by_word), (tri, by_byte), (four, by_byte))):
                    gradient = np.stack([np.bincount(index, g[:, j], _SIZE) for j in range(width)], axis=1) / batch_rows
                    squares[k] += gradient**2
                    tables[k] += rate * gradient / np.sqrt(squares[k])
        return pa.table({"tables": pa.array([tables.tobytes()], pa.binary()), "moves": pa.array([moves.tobytes()], pa.binary()), "task": table["task"].slice(0, 1)})

    return run


def _rows_to_one(moves: np.ndarray) -> np.ndarray:
    """Transition probabilities of a matrix of weights."""
    e = np.exp(moves - moves.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(documents: DataFrame, max_rows: int = 2400, tasks: int = 4, epochs: int = 2, run_words: int = 40) -> Model | None:
    """A chain learned from text and lang of at most max_rows labelled documents, the first by the hash of their id.

    The labelled texts are in one language each, so they are cut into runs of
    run_words words on average and shuffled into code-switched chains; how
    often labels change is taken from there. Emissions and transitions follow
    the gradient of the chains' likelihood. Documents are dealt to `tasks`
    groups by their id; the groups' weights are averaged in their order, so
    equal tables give equal models. Null texts, langs and ids are left out;
    without any labelled row there is no model.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows bounds what is broadcast.
    sample = known.join(F.broadcast(ids), "doc_id").select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(tasks)).cast("int").alias("task"))
    labels = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not labels:
        return None
    parts = sample.groupBy("task").applyInArrow(_train(labels, 32, epochs, 0.3, 7, run_words), "tables binary, moves binary, task int").collect()
    parts.sort(key=lambda p: p["task"])
    tables = np.mean([np.frombuffer(p["tables"], np.float32) for p in parts], axis=0).reshape(3, _SIZE, len(labels))
    moves = np.mean([np.frombuffer(p["moves"], np.float64) for p in parts], axis=0).reshape(len(labels), len(labels))
    return Model(labels, tables.astype(np.float32), _rows_to_one(moves))


def label_words(model: Model, texts: list[str]) -> list[list[str]]:
    """The likeliest label of each word of some texts, also where the language changes inside one."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    rows, lexicon, first, tri, four = features(data, offsets)
    best = marginals(emissions(model.tables, lexicon, first, tri, four), rows, len(texts), model.transitions).argmax(axis=1)
    return [[model.labels[i] for i in best[rows == r].tolist()] for r in range(len(texts))]


def _no_letters(text: str | None) -> bool:
    return not text or not any(c.isalpha() for c in text)


def identify(documents: DataFrame, model: Model | None, undetermined: str = "und") -> DataFrame:
    """Add lang_pred and score to every document; input columns of these names are replaced.

    lang_pred is the label with the largest share of the words' probabilities,
    score that share. Texts that are null or without letters get
    `undetermined` and score 0, as do all without a model.
    """
    from pyspark.sql import types as T

    documents = documents.drop("lang_pred", "score")
    names = documents.columns
    at = names.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            n = batch.num_rows
            pred, score = np.full(n, -1), np.zeros(n)
            for lo, hi in row_chunks(offsets, _CHUNK) if model else ():
                rows, lexicon, first, tri, four = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if len(rows):
                    p = marginals(emissions(model.tables, lexicon, first, tri, four), rows, hi - lo, model.transitions)
                    share = np.stack([np.bincount(rows, p[:, j], hi - lo) for j in range(len(model.labels))], axis=1)
                    total = share.sum(axis=1)
                    pred[lo:hi] = np.where(total > 0, share.argmax(axis=1), -1)
                    score[lo:hi] = np.minimum(1.0, share.max(axis=1) / np.maximum(total, 1e-30))
            # Only texts without ASCII letters need a closer look.
            letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
            seen = np.append(0, np.cumsum(letter))
            for i in np.flatnonzero(seen[offsets[1:]] == seen[offsets[:-1]]).tolist():
                if _no_letters(batch.column(at)[i].as_py()):
                    pred[i], score[i] = -1, 0.0
            labels = [*(model.labels if model else ()), undetermined]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([labels[i] for i in pred.tolist()], pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


@query("op6_crf_language")
def op6_crf_language(spark, sf_dir):
    """Language of all documents; one fold is never learned from."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(documents.where(~held_out))
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
