"""Phrase collocations against a count of all phrases by brute force."""

import random
import re
from collections import Counter

import numpy as np

from factloom.llm import collocations as C


def brute(rows, max_words=3, min_count=10, percent=50, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return rank(f, n, max_words, min_count, percent, top)


def rank(f, n, max_words, min_count, percent, top):
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out = []
    for (lang, w), a in found.items():
        score, k, left, right = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        covered = any(len(v) > len(w) and x == lang and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (x, v), b in found.items())
        if not covered:
            out.append((lang, " ".join(w), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen = Counter()
    ranked = []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


def texts(seed=5, n=120):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "É", "é", "x-y", "(the", "the", "of", "z" * 40, " ", "ab"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    out = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "! "]) for _ in range(rng.randint(0, 60)))
        out.append((text + (passage if k % 3 == 0 else ""), rng.choice(["en", "fr", None, ""])))
    return out + [(None, "en"), ("", None), ("... ,,", "xx"), ("Only ONE", "yy")] + [("New York is New York", "en")] * 12


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(t, x, 1) for t, x in rows], "text string, lang string, phrase int")
    got = [tuple(r) for r in C.collocations(df, modulus=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").orderBy("lang", "rank").collect()]
    assert got == brute(rows)
    got = [tuple(r) for r in C.collocations(df, max_words=4, min_count=5, modulus=5, bits=5, top=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").orderBy("lang", "rank").collect()]
    assert got == brute(rows, 4, 5, 50, 40)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_counts_past_64_bits(spark):
    f = {("en", ("p",)): 3 * 10**12, ("en", ("q",)): 2 * 10**12 + 1, ("en", ("r",)): 10**12 + 7, ("en", ("p", "q")): 10**12 + 3, ("en", ("q", "r")): 10**12 + 5, ("en", ("p", "q", "r")): 4 * 10**11}
    counts = spark.createDataFrame([(lang, " ".join(w), len(w), n) for (lang, w), n in f.items()], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    got = [tuple(r) for r in C.rank_phrases(counts, totals).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").orderBy("rank").collect()]
    assert got == rank(Counter(f), {"en": 10**14}, 3, 10, 50, 2000)


def test_long_texts_are_parsed_in_parts():
    rng = random.Random(3)
    cases = [" ".join(rng.choice(["aa", "bb", "c", "dd,", "e\n", "long" * 30]) for _ in range(4000)), "same " * 3000, "x" * 20000, " ," * 5000, "a"]
    for text in cases:
        data = np.frombuffer(text.encode(), np.uint8)
        whole = C.parse_bytes(data, np.array([0, len(data)]), 2, 7)
        want = [(bytes(whole[0][a:b]), int(n), bool(x)) for a, b, n, x in zip(whole[1][:-1], whole[1][1:], whole[3], whole[4], strict=True)]
        got = []
        for out, bounds, _, owned, final in C._long_row(data, 2, 7, 300):
            got += [(bytes(out[a:b]), int(n), bool(x)) for a, b, n, x in zip(bounds[:-1], bounds[1:], owned, final, strict=True)]
        assert got == want


def test_dictionary_counts_repeats_once(spark):
    text = " ".join(f"word{k}" for k in range(400))
    one = C.parse(spark.createDataFrame([(text, "en")], "text string, lang string"))
    many = C.parse(spark.createDataFrame([(text, "en")] * 50, "text string, lang string"))
    assert many.count() == one.count() > 3
    assert many.agg({"n": "max"}).first()[0] == 50
