"""Near-duplicate detection with DartMinHash signatures and banded joining.

A document is a weighted set: its shingles of five words, weighted by how
often they occur. Every unit of a shingle's weight receives darts at random
ranks, the same in every document (a Poisson process of rate 1). A dart below
the document's rank limit falls on one of `coordinates` places of the
signature, which keeps the earliest. Two signatures agree on a coordinate with
the probability of the sets' weighted Jaccard similarity. The limit is set so
that about k ln k darts fall on a document whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import discard, materialize, mix64, query, row_chunks, text_bytes, tidied, words

_CHUNK = 1 << 20
#: Places of the counts that order units by how common they are; any order gives the same links.
_SLOTS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_units(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit units of the weighted shingle sets: the j-th occurrence of a shingle is a unit of its own.

    A text of fewer than `size` words, but not none, has one shingle of them all.
    """
    _, _, rows, hashes = words(data, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    base, h = np.uint64(0xC2B2AE3D27D4EB4F), None
    full = max(0, len(rows) - size + 1)
    for j in range(size):
        part = hashes[j : j + full]
        h = part.copy() if h is None else h * base + part
    own = rows[:full] == rows[size - 1 : size - 1 + full] if full else np.zeros(0, bool)
    units, unit_rows = mix64(h[own]), rows[:full][own]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            on = counts[short] > j
            extra[on] = extra[on] * base + hashes[first[on] + j] + np.uint64(1)
        units, unit_rows = np.concatenate([units, mix64(extra)]), np.concatenate([unit_rows, short])
    # Number the occurrences of a shingle within its row.
    order = np.argsort(units ^ (unit_rows.astype(np.uint64) * _STEP), kind="stable")
    u, r = units[order], unit_rows[order]
    same = np.append(False, (u[1:] == u[:-1]) & (r[1:] == r[:-1]))
    if same.any():
        place = np.arange(len(u))
        nth = place - np.maximum.accumulate(np.where(same, 0, place))
        u = np.where(nth > 0, mix64(u + nth.astype(np.uint64) * _STEP), u)
    return r, u


def signatures(rows: np.ndarray, units: np.ndarray, n: int, coordinates: int) -> np.ndarray:
    """(n, coordinates) array of the earliest darts; rows without units keep the largest value everywhere."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * coordinates, empty, np.uint64)
    weight = np.bincount(rows, minlength=n)
    limit = coordinates * (np.log(coordinates) + 3) / np.maximum(weight, 1)
    open_rows = weight > 0
    while open_rows.any():
        on = open_rows[rows]
        row, unit, most = rows[on], units[on], limit[rows[on]]
        rank, nth = np.zeros(len(row)), 0
        while len(row):
            nth += 1
            dart = mix64(unit + np.uint64(nth) * _STEP)
            # Exponential gaps between ranks, from the dart's upper 53 bits.
            rank = rank - np.log1p(-(dart >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            near = rank < most
            row, unit, most, rank, dart = row[near], unit[near], most[near], rank[near], dart[near]
            place = mix64(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(coordinates)
            # Rank in the upper 32 bits, in steps far finer than the gaps, and the dart's own bits below.
            packed = (np.minimum(rank * 2.0**22, 2.0**32 - 2).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, row * coordinates + place.astype(np.int64), packed)
        grid = out.reshape(n, coordinates)
        open_rows = open_rows & (grid == empty).any(axis=1)
        limit = np.where(open_rows, limit * 2, limit)
    return out.reshape(n, coordinates)


def _sign(size: int, bands: int, band_rows: int):
    k = bands * band_rows

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            keys, signs, weights = [], [], []
            for lo, hi in row_chunks(offsets, _CHUNK):
                rows, units = shingle_units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                grid = signatures(rows, units, hi - lo, k)
                band = np.zeros((hi - lo, bands), np.uint64)
                for j in range(band_rows):
                    band = mix64(band * _STEP + grid[:, j::band_rows])
                band = mix64(band + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP)
                keys.append(band.view(np.int64))
                signs.append(mix64(grid).astype(np.uint32))
                weights.append(np.bincount(rows, minlength=hi - lo))
            if not keys:
                continue
            key, sign, weight = np.concatenate(keys), np.concatenate(signs), np.concatenate(weights)
            flat = pa.array(key.ravel())
            edges = pa.array(np.arange(len(key) + 1, dtype=np.int32) * bands)
            raw = sign.tobytes()
            step = 4 * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(edges, flat), pa.array([raw[i * step : (i + 1) * step] for i in range(len(key))], pa.binary()), pa.array(weight, pa.int64())],
                names=["doc_id", "bands", "signature", "weight"],
            )

    return run


def _agreement():
    """Share of equal coordinates of two signatures."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint32) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(axis=1) if len(a) else np.zeros(0))], names=["a", "b", "agreement"])

    return run


def _unit_sets(size: int):
    """Sorted unit hashes of each text, cut to 32 bits."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = []
            for lo, hi in row_chunks(offsets, _CHUNK):
                rows, units = shingle_units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                cut = units.astype(np.uint32)
                order = np.argsort((rows.astype(np.uint64) << np.uint64(32)) | cut, kind="stable")
                cut = cut[order].tobytes()
                edges = np.searchsorted(rows[order], np.arange(hi - lo + 1)) * 4
                out.extend(cut[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "units"])

    return run


def _similarity():
    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = np.sort(np.concatenate([a, b]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                out.append(shared / max(1, len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose unit sets have a similarity of at least `threshold`."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("units").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("units").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidied(_similarity()), "a long, b long, similarity double").where(F.col("similarity") >= threshold).select("a", "b")


def _slot_counts():
    """How many units of all texts fall on each slot."""

    def run(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += 0 if not len(x.as_buffer()) else np.bincount(np.frombuffer(x.as_buffer(), np.uint32) % _SLOTS, minlength=_SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])

    return run


def _prefixes(level: np.ndarray, threshold: float):
    """The rarest units of each text, one of which every similar text must have among its own rarest."""

    def run(batches):
        for batch in batches:
            keys, places, sizes = [], [], []
            for x in batch.column(1):
                units = np.frombuffer(x.as_buffer(), np.uint32)
                n = len(units)
                probe = n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0
                keys.append(units[np.lexsort((units, level[units % _SLOTS]))[:probe]])
                places.append(np.arange(len(keys[-1]), dtype=np.int32))
                sizes.append(n)
            count = np.array([len(k) for k in keys], np.int64)
            ids, n = batch.column(0).to_numpy(zero_copy_only=False), np.array(sizes, np.int32)
            key, place = (np.concatenate(v) if v else np.zeros(0, np.int32) for v in (keys, places))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.repeat(ids, count), pa.int64()), pa.array(np.repeat(n, count)), pa.array(place)], names=["key", "doc_id", "n", "place"])

    return run


def _may_be_similar(x: str, y: str, threshold: float):
    """Whether two texts can reach the threshold if the unit at x's and y's place is the first that they share."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place"))
    return most >= threshold / (1 + threshold) * (n + m) - 1e-6


def _rest_links(docs: DataFrame, rest: DataFrame, threshold: float, size: int, hot: int = 1000, leads: int = 16) -> DataFrame:
    """Links between texts of `rest` (doc_id, part) whose parts, the classes found so far, differ.

    The prefix filter is exact: in one order of all units, similar texts share
    a unit among the first of each. Rare units come first, so texts of a family
    meet where they share more than its passage. Stars in each unit's group, in
    turns with other leads, join most parts; the pairs of parts that are left
    are all compared. Units with the same texts count once. Groups of more than
    `hot` texts are split.
    """
    sets = docs.join(rest.select("doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidied(_unit_sets(size)), "doc_id long, units binary").dropDuplicates(["doc_id"])
    sets = materialize(sets, "rest-units")
    counts = sets.select("units").mapInArrow(_slot_counts(), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    level = np.zeros(_SLOTS, np.uint8)
    level[counts["slot"].to_numpy(np.int64)] = 6 * np.log2(counts["n"].to_numpy(float))
    entries = materialize(sets.mapInArrow(_prefixes(level, threshold), "key long, doc_id long, n int, place int"), "prefixes")

    def mixed(rows, parts):
        """Of the given entries, those of units that texts of several parts have, written with the parts; and such units."""
        own = rows.join(parts, "doc_id")
        members = (F.bit_xor(F.xxhash64("doc_id")).alias("mark"), F.sum(F.xxhash64("doc_id", F.lit(1)).cast("decimal(38,0)")).alias("sum"))
        groups = own.groupBy("key").agg(F.count("*").alias("texts"), F.min("part").alias("low"), F.max("part").alias("high"), F.min("place").alias("place"), *members)
        groups = groups.where(F.col("low") < F.col("high"))
        # Units that the same texts have, such as those of a passage, would give the same pairs again; the first of them is enough.
        firsts = groups.groupBy("texts", "mark", "sum").agg(F.min(F.struct("place", "key")).alias("first"))
        return materialize(own.join(firsts.select("first.key", "texts"), "key"), "mixed-units")

    def ordered(x, y):
        return F.least(f"{x}.doc_id", f"{y}.doc_id").alias("a"), F.greatest(f"{x}.doc_id", f"{y}.doc_id").alias("b")

    # A text that belongs to a class may be far from its lead. So each turn compares the texts of a unit with up to
    # `leads` others of it, drawn by a hash, which finds most such texts a partner with few comparisons. Where a turn
    # joins few more, the pairs of the parts left are compared in full: the turns change the work and not the classes.
    # Parts only grow together, so a unit that is left out of one turn stays out.
    parts, stars, turn = rest, None, 0
    first = left = parts.select("part").distinct().count()
    own = mixed(entries, parts)
    discard(entries)
    while True:
        drawn = F.xxhash64("doc_id", F.lit(turn))
        lead = own.groupBy("key", F.pmod(drawn, F.lit(leads)).alias("slot")).agg(F.min(F.struct(drawn.alias("by"), "doc_id", "n", "place", "part")).alias("lead")).select("key", "lead")
        near = own.alias("x").join(lead, "key").where((F.col("x.part") != F.col("lead.part")) & _may_be_similar("x", "lead", threshold))
        new = materialize(_verified(near.select(*ordered("x", "lead")).distinct(), sets, threshold), "rest-stars")
        stars = new if stars is None else stars.unionByName(new)
        if new.isEmpty():
            break
        # Whole parts are joined, so the graph has the parts as nodes.
        side = lambda name: parts.select(F.col("doc_id").alias(name), F.col("part").alias(f"{name}_part"))
        edges = new.join(side("a"), "a").join(side("b"), "b").select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct()
        labels = components(edges).select(F.col("rep").alias("part"), "class_id")
        parts = materialize(parts.join(labels, "part", "left").select("doc_id", F.coalesce("class_id", "part").alias("part")), "rest-parts")
        before, left, turn = left, parts.select("part").distinct().count(), turn + 1
        last, own = own, mixed(own.drop("part", "texts"), parts)
        discard(last)
        if before - left <= 0.05 * (first - left):
            break
    pieces = F.ceil(F.col("texts") / hot).cast("int")
    own_rows, own = own, own.withColumn("pieces", pieces)
    # The shorter text's share is shorter: more than it needs units in common with a text that is no shorter.
    short = own.where(F.col("place") <= F.col("n") - 2 * threshold / (1 + threshold) * F.col("n") + 1e-6)
    short = short.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    all_of = own.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
    x, y = short.alias("x"), all_of.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.piece") == F.col("y.piece"))
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    pairs = x.join(y, same & order & (F.col("x.part") != F.col("y.part")) & _may_be_similar("x", "y", threshold)).select(*ordered("x", "y")).distinct()
    found = materialize(_verified(pairs, sets, threshold), "rest-links")
    for done in (sets, own_rows):
        discard(done)
    return stars.unionByName(found)


def near_duplicates(documents: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 24, band_rows: int = 5, slack: float = 0.2, copy_parts: int = 64) -> DataFrame:
    """doc_id, class_id and n_links of every document.

    A class holds the documents that are linked, directly or in steps, by equal
    text or by a weighted Jaccard similarity of at least `threshold`; class_id
    is its smallest doc_id. n_links counts the verified links between a
    document's text and different texts.

    Copies are first put together by the digest of their text. In a bucket of
    equal band hashes each text is joined to the bucket's smallest and largest
    doc_id, so large groups give a row for each member. Pairs whose signatures
    agree on less than threshold - slack (more than five standard errors) are
    left; the others are verified on their whole shingle sets. Where other
    members of a bucket stay in several components, these members go to an
    exact join by their rarest shingles (_rest_links). n_links counts the links
    that were needed and verified, not all similar pairs of a class.

    Null texts have no copies and no links; texts without words are linked by
    equal text only. Repeated doc_ids count as one document. An empty table
    gives no rows. Other columns are left out.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.when(F.col("text").isNotNull(), F.sha2("text", 256))
    ids = docs.select("doc_id", digest.alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(copy_parts)).cast("int").alias("part"))
    ids = materialize(ids, "digests")
    # Each text has at most copy_parts rows here, and the joins go by text and part, so no text's copies meet in one task.
    parts = materialize(ids.where(F.col("digest").isNotNull()).groupBy("digest", "part").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "copies")
    first = parts.groupBy("digest").agg(F.min("low").alias("rep"), F.sum("n").alias("n")).where("n > 1").select("digest", "rep")
    first = parts.join(first, "digest").select("digest", "part", "rep")
    members = ids.join(first, ["digest", "part"], "left").groupBy("doc_id").agg(F.coalesce(F.min("rep"), F.col("doc_id")).alias("rep"))
    members = materialize(members, "members")
    for done in (ids, parts):
        discard(done)
    signed = materialize(docs.mapInArrow(tidied(_sign(size, bands, band_rows)), "doc_id long, bands array<long>, signature binary, weight long"), "signatures")
    distinct = members.where(F.col("doc_id") == F.col("rep")).select("doc_id")
    buckets = signed.where(F.col("weight") > 0).join(distinct, "doc_id").select("doc_id", F.explode("bands").alias("key"))
    leads = buckets.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where(F.col("low") < F.col("high"))
    pair = F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("doc_id").alias("b")), F.struct(F.col("doc_id").alias("a"), F.col("high").alias("b"))))
    stars = materialize(buckets.join(leads, "key"), "stars")
    pairs = stars.select(pair.alias("p")).select("p.a", "p.b").where(F.col("a") < F.col("b")).distinct()
    sign = signed.select("doc_id", "signature")
    compared = pairs.join(sign.select(F.col("doc_id").alias("a"), F.col("signature").alias("s")), "a").join(sign.select(F.col("doc_id").alias("b"), F.col("signature").alias("t")), "b")
    likely = compared.select("a", "b", "s", "t").mapInArrow(_agreement(), "a long, b long, agreement double").where(F.col("agreement") >= threshold - slack).select("a", "b").distinct()
    likely = materialize(likely, "candidates")
    discard(signed)
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # The join is the same at every size: the wanted ids grow with the documents.
    sets = docs.join(wanted.hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidied(_unit_sets(size)), "doc_id long, units binary").dropDuplicates(["doc_id"])
    sets = materialize(sets, "units")
    links = materialize(_verified(likely, sets, threshold), "links")
    for done in (likely, sets):
        discard(done)
    labels = components(links)
    # Leads are compared with all members, so a bucket is open where others of several components are in it.
    others = stars.where((F.col("n") > 3) & (F.col("doc_id") > F.col("low")) & (F.col("doc_id") < F.col("high")))
    others = others.join(labels.withColumnRenamed("rep", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("class_id", "doc_id").alias("part"))
    open_keys = others.groupBy("key").agg(F.min("part").alias("first"), F.max("part").alias("last")).where(F.col("first") < F.col("last")).select("key")
    rest = materialize(others.join(open_keys, "key", "left_semi").select("doc_id", "part").distinct(), "rest")
    discard(stars)
    if not rest.isEmpty():
        links = links.unionByName(_rest_links(docs, rest, threshold, size)).distinct()
        labels = components(links)
    n_links = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = members.join(labels, "rep", "left").join(n_links, "rep", "left")
    return out.select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(links: DataFrame) -> DataFrame:
    """rep and class_id (its component's smallest id) of every id that has a link: a, b long.

    Each round turns every node's neighbours and itself to the smallest of them
    (large star, then small star); the rounds end when no link changes.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = materialize(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, materialize(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("class_id")).unionByName(edges.select(F.col("v").alias("rep"), F.col("v").alias("class_id"))).distinct()
        before = now


@query("op2_dart_minhash_classes")
def op2_dart_minhash_classes(spark, sf_dir):
    """Near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
