"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, turns look-alike letters into Latin ones and digits and
signs that stand for letters into letters. The lexicon (whole words, and stems
with which toxic words begin), its exception phrases and the calibration are
learned from labelled rows. The weights found in a text, but for those inside
exception phrases, are taken as a sum and as a share of the text's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import materialize, query, tidied

# Letters of other scripts that look like Latin ones, then digits and signs used for letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ｏ": "o", "ａ": "a", "ｅ": "e", "ｉ": "i",
}
_LETTER_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(_LOOKALIKES)
_WORD = re.compile(r"[^\W_]+")
_SIGNED = re.compile(r"(?<=[^\W\d_])[0134578@$!](?=[^\W_@$!])|(?<![^\W_])[0134578@$](?=[^\W\d_])")


def fold(text: str) -> str:
    """Lower case, Latin look-alikes, and letters for digits and signs that stand among letters."""
    text = text.lower().translate(_FOLD)
    return _SIGNED.sub(lambda m: _LETTER_SIGNS[m[0]], text)


@dataclass
class Lexicon:
    """Weights of whole words and of stems, phrases in which they are harmless, and the calibration."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-3.0, 2.0, 0.1)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        patterns: dict[str, list] = {}
        for kind, terms in (("word", self.words), ("stem", self.stems), ("exception", dict.fromkeys(self.exceptions, 0.0))):
            for term, weight in terms.items():
                patterns.setdefault(fold(term), []).append((kind, len(fold(term)), weight))
        for term, entries in patterns.items():
            out.add_word(term, entries)
        if patterns:
            out.make_automaton()
        return out if patterns else None


def weight_in(automaton, text: str) -> float:
    """The summed weight of the lexicon's terms in a folded text, without those inside an exception phrase."""
    if automaton is None or not text:
        return 0.0
    found, harmless, n = [], [], len(text)
    for end, entries in automaton.iter(text):
        for kind, size, weight in entries:
            start = end - size + 1
            if start and text[start - 1].isalnum():
                continue
            if kind != "stem" and end + 1 < n and text[end + 1].isalnum():
                continue
            if kind == "exception":
                harmless.append((start, end))
            else:
                found.append((start, end, weight))
    return sum(w for a, b, w in found if not any(x <= a and b <= y for x, y in harmless)) if harmless else sum(w for _, _, w in found)


def _inputs(automaton, text: str) -> tuple[float, float]:
    folded = fold(text)
    total = weight_in(automaton, folded)
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100.0 * total / (1 + folded.count(" ") + folded.count("\n")))


def score_text(lexicon: Lexicon, automaton, text: str) -> float:
    """Probability that the text is toxic."""
    a, b = _inputs(automaton, text)
    c = lexicon.coefficients
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * a + c[2] * b))))


STEM_SIZES = range(4, 8)


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return {f"w{w}" for w in words if 3 <= len(w) <= 24} | {f"s{w[:k]}" for w in words for k in STEM_SIZES if len(w) >= k}


def _count_terms(batches):
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(_terms(text or ""))
            (toxic if label else clean)["n"] += 1
    # Terms of clean rows alone can't enter the lexicon, but may be in another task's toxic rows.
    terms = list(toxic | clean)
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])


def _count_phrases(automaton):
    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text or "")
                if not weight_in(automaton, folded):
                    continue
                words = _WORD.findall(folded)
                hit = [i for i, w in enumerate(words) if weight_in(automaton, w)]
                own = {f"{words[i + d]} {words[i + d + 1]}" for i in hit for d in (-1, 0) if 0 <= i + d and i + d + 1 < len(words)}
                (toxic if label else clean).update(own)
        terms = list(clean)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    return run


def training_rows(documents: DataFrame, labels: DataFrame, max_rows: int = 16000) -> DataFrame:
    """text and toxic of at most max_rows labelled documents, the first by the hash of their id."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # max_rows bounds what is broadcast.
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", (F.col("toxic") > 0).alias("label"))


def learn(rows: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon, exception phrases and calibration from rows of (text, label boolean).

    A term enters with toxic odds of at least 8 times the base rate and a
    log-likelihood ratio of at least 2 ln m, where m terms are tried, so that
    chance alone lets in about one term whatever the number of rows. An exception is a
    phrase of two words around a term in five clean rows and in no toxic one. No
    further bound cuts either list; both are as small as the rows, which training_rows() bounds. Without toxic rows the
    lexicon is empty and the score is the base rate everywhere.
    """
    counted = rows.mapInArrow(tidied(_count_terms), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = materialize(counted.where("toxic >= 3 or term = 'n'"), "terms")
    n = counted.where("term = 'n'").first()
    n_toxic, n_clean = (n[1], n[2]) if n else (0, 0)
    base = n_toxic / max(1, n_toxic + n_clean)
    least_evidence = 2 * math.log(max(2, counted.where("toxic >= 3").count()))
    # A strong term is in few clean rows: at most 1/8 of the base odds. Its evidence is computed where its counts are.
    a, b = F.col("toxic"), F.col("clean")
    evidence = 2 * (a * F.log(a / ((a + b) * base)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - base)))).otherwise(0.0)) if 0 < base < 1 else F.lit(0.0)
    strong = counted.where((F.col("term") != "n") & (a >= 3) & (a * n_clean >= (b + 0.5) * 8 * n_toxic) & (evidence >= least_evidence))
    chosen = {r[0]: (math.log((r[1] + 0.5) / (n_toxic + 1)) - math.log((r[2] + 0.5) / (n_clean + 1)), r[1]) for r in strong.select("term", "toxic", "clean").collect()}
    words, stems = _reduced(chosen)
    lexicon = Lexicon(words, stems, list(exceptions))
    automaton = lexicon.automaton()
    if automaton is not None:
        phrases = rows.mapInArrow(tidied(_count_phrases(automaton)), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        lexicon.exceptions += sorted(r[0] for r in phrases.where("clean >= 5 and toxic = 0").select("term").collect())
    lexicon.coefficients = _calibrate(rows, lexicon, base)
    return lexicon


def _reduced(chosen: dict[str, tuple[float, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Drop terms that say the same: a stem that one word or one longer stem explains, and what a kept stem begins."""
    words = {t[1:]: x for t, x in chosen.items() if t[0] == "w"}
    stems = {t[1:]: x for t, x in chosen.items() if t[0] == "s"}
    explained = set()
    for stem, (_, n) in stems.items():
        if any(w.startswith(stem) and m >= 0.9 * n for w, (_, m) in words.items()) or any(s != stem and s.startswith(stem) and m >= 0.95 * n for s, (_, m) in stems.items()):
            explained.add(stem)
    kept: dict[str, float] = {}
    for stem in sorted(set(stems) - explained, key=lambda s: (len(s), s)):
        if not any(stem.startswith(s) for s in kept):
            kept[stem] = stems[stem][0]
    return {w: x[0] for w, x in words.items() if not any(w.startswith(s) for s in kept)}, kept


def _calibrate(rows: DataFrame, lexicon: Lexicon, base: float) -> tuple[float, float, float]:
    """Logistic regression of the label on the weight and on the weight by length, by Newton steps on the sample."""
    automaton = lexicon.automaton()

    def run(batches):
        for batch in batches:
            got = [_inputs(automaton, t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.float64()), batch.column(1)], names=["a", "b", "label"])

    # Texts without a hit are alike, so this is as small as the number of different inputs in the bounded sample.
    data = rows.mapInArrow(tidied(run), "a double, b double, label boolean").groupBy("a", "b").agg(F.count_if("label").alias("yes"), F.count("*").alias("n")).toPandas()
    if data.empty or not 0 < base < 1:
        return (math.log((base + 1e-3) / (1 - base + 1e-3)), 0.0, 0.0)
    x = np.column_stack([np.ones(len(data)), data["a"], data["b"]])
    n, yes = data["n"].to_numpy(float), data["yes"].to_numpy(float)
    c, ridge = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        gradient = x.T @ (yes - n * p) - ridge @ c
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, gradient)
        c = c + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in c)


def score(documents: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add `score_col` double (0 to 1) to every row; an input column of that name is replaced.

    Null and empty texts get the score of a text without any term. Repeated
    rows stay repeated; an empty table gives no rows.
    """
    documents = documents.drop(score_col)
    names = documents.columns
    at = names.index(text_col)

    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [score_text(lexicon, automaton, t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, score_col])

    from pyspark.sql import types as T

    return documents.mapInArrow(tidied(run), T.StructType([*documents.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out() -> Column:
    """The fold of documents whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def learned_from(spark, documents: DataFrame, sf_dir: str) -> Lexicon:
    """The lexicon that the given tables teach, without the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    return learn(training_rows(documents, labels))


@query("op8_lexicon_toxicity")
def op8_lexicon_toxicity(spark, sf_dir):
    """Toxicity of all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = learned_from(spark, documents, sf_dir)
    return score(documents, lexicon).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
