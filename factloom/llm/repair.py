"""Conversation repair: the cheapest edits that give an ordinary order of roles.

Rows are kept (0), given another role (1), deleted (2) or preceded by an empty
turn (5) so that the initials of the roles read `(s?(ua)+)?`; a truncated row
that stays costs 5 more. Rows that are blank or repeat an earlier one must go.

A conversation is a DAG: its nodes are places between rows with the state of
that grammar, its edges the edits. Each edge has one integer as its weight. The
high digits are the cost. Below them every row has a slot of two digits for the
letters of its edits, as D < I < K < R; the slot's digits begin at its left end
and unused ones are zero. A slot's letters are a prefix-free code (an insertion
or not, then the row's own edit), so the integers are in the order of (cost,
audit string), and the smallest path weight alone decides both.

Rows are streamed in order, with a running SHA-256 of the repaired text in each
of the four states. After `block` rows the low digits of the states are replaced
by their rank, which keeps the order and bounds the integers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import bounded_batches, query

#: Edits in ASCII order as digits, and what they cost.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in DIGIT.items()}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a. What each may read next, and the role that an edit may add.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ADDS = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ENDS = (0, 3)
BITS = 3
RANK_BITS = 3


class _Path:
    """The best path to a state: its weight in the present block, the repaired text's digest, and the letters of earlier blocks."""

    __slots__ = ("weight", "text", "past")

    def __init__(self, weight, text, past):
        self.weight, self.text, self.past = weight, text, past


class Repair:
    """The smallest weights of one conversation, row by row."""

    def __init__(self, block: int = 128):
        self.block, self.slot = block, 0
        self.width = BITS * 2 * block
        self.unit = 1 << (self.width + RANK_BITS)
        self.paths = {0: _Path(0, hashlib.sha256(), None)}

    def _rest(self) -> None:
        """Begin a new block: letters go to the path's past, their order stays as a rank."""
        if self.slot == 0:
            return
        low = sorted({p.weight & (self.unit - 1) for p in self.paths.values()})
        rank = {x: i for i, x in enumerate(low)}
        for p in self.paths.values():
            digits = p.weight & ((1 << self.width) - 1)
            p.past = (p.past, digits >> (BITS * 2 * (self.block - self.slot)), self.slot)
            p.weight = (p.weight // self.unit) * self.unit + (rank[p.weight & (self.unit - 1)] << self.width)
        self.slot = 0

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """Take one row."""
        shift = BITS * 2 * (self.block - 1 - self.slot)
        edit = {x: (d << BITS) << shift for x, d in DIGIT.items()}
        insert = (DIGIT["I"] << BITS) << shift
        after_insert = {x: d << shift for x, d in DIGIT.items()}
        more = TRUNCATED * self.unit if truncated else 0
        best: dict[int, tuple] = {}

        def offer(state, weight, source, added):
            if state not in best or weight < best[state][0]:
                best[state] = (weight, source, added)

        for q, p in self.paths.items():
            offer(q, p.weight + DELETE * self.unit + edit["D"], q, ())
            if must_go:
                continue
            for state, weight, letters, added in ((q, p.weight, edit, ()), (ADDS[q][1], p.weight + INSERT * self.unit + insert, after_insert, ((ADDS[q][0], ""),))):
                to = NEXT[state].get(role[:1])
                if to is not None:
                    offer(to, weight + KEEP * self.unit + more + letters["K"], q, (*added, (role, text)))
                new, to = ADDS[state]
                offer(to, weight + REROLE * self.unit + more + letters["R"], q, (*added, (new, text)))
        paths = {}
        for state, (weight, source, added) in best.items():
            old = self.paths[source]
            digest, any_before = (old.text.copy() if added else old.text), source != 0
            for who, what in added:
                digest.update(f"{chr(10) if any_before else ''}{who}:{what}".encode())
                any_before = True
            paths[state] = _Path(weight, digest, old.past)
        self.paths, self.slot = paths, self.slot + 1
        if self.slot == self.block:
            self._rest()

    def gone(self, n: int) -> None:
        """Take n rows that must go."""
        if n <= 2 * self.block:
            for _ in range(n):
                self.row("", "", True, False)
            return
        self._rest()
        for p in self.paths.values():
            p.weight += n * DELETE * self.unit
            p.past = (p.past, None, n)

    def close(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the repaired text."""
        shift = BITS * 2 * (self.block - 1 - self.slot)
        two = (DIGIT["I"] << BITS | DIGIT["I"]) << shift
        one = (DIGIT["I"] << BITS) << shift
        best = None
        for q, p in self.paths.items():
            for weight, added in [(p.weight, "")] if q in ENDS else [(p.weight + INSERT * self.unit + one, "\nassistant:")] if q == 2 else [(p.weight + 2 * INSERT * self.unit + two, "\nuser:\nassistant:")]:
                if best is None or weight < best[0]:
                    best = (weight, p, added)
        weight, p, added = best
        cost = weight // self.unit
        letters = [_letters(weight & ((1 << self.width) - 1), self.block)]
        past = p.past
        while past is not None:
            past, digits, n = past
            letters.append("D" * n if digits is None else _letters(digits, n))
        text = p.text.copy()
        text.update(added.encode())
        return cost, "".join(reversed(letters)), text.hexdigest()


def _letters(digits: int, slots: int) -> str:
    octal = format(digits, "o").zfill(2 * slots)  # three bits a digit
    return octal.replace("0", "").translate(str.maketrans({str(d): x for x, d in DIGIT.items()}))


def damaged(conversations: DataFrame, every: int = 20) -> DataFrame:
    """conv_id, turn, role, text, n: rows after damage by crc32(`conv_id:turn`) % every; n is how often a row is there, 0 if it is dropped.

    0 drops the row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4
    makes its role user. Nulls count as one space, in roles, texts and the key.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % every
    role, text = part("role"), part("text")
    kept = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"), role.alias("role"), text.alias("text"))
    return kept.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def is_blank(text: Column) -> Column:
    """Whether a text has nothing but blanks."""
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def is_truncated(text: Column) -> Column:
    """Whether the last character that is no blank doesn't end a sentence."""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """Counts and repair of one conversation while its rows pass."""

    def __init__(self, conv_id, block):
        self.id, self.repair = conv_id, Repair(block)
        self.first = self.last = self.now = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def take(self, turn, role, text, n, blank, truncated, seen):
        if n == 0:
            return
        if turn is not None and turn != self.now:
            self.first = turn if self.first is None else self.first
            self.now, self.turns = turn, self.turns + 1
            self.last = turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in _LEGAL
        self.initial = initial
        self.illegal += (n - 1) * (initial + initial not in _LEGAL)
        if blank or seen:
            self.repair.gone(n)
            self.blank += n if blank else 0
            self.duplicate += 0 if blank else n
            return
        self.truncated += truncated
        self.repair.row(role, text, False, truncated)
        self.repair.gone(n - 1)
        self.duplicate += n - 1

    def close(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.close())


def repair(rows: DataFrame, block: int = 128) -> DataFrame:
    """Faults and cheapest repair of each conversation of rows (conv_id, turn, role, text, n) without nulls in role and text.

    Rows are taken by turn (nulls first), then role and text, so the order of
    input rows doesn't matter. Copies of a row meet as one row with a count.
    Which texts came at an earlier turn is found by partial aggregates; only
    such texts are joined back. Each conversation then passes through one task
    as a stream, as its digest has to; the task holds its letters, no texts. A
    conversation without rows (all n are 0) has zeros, an empty audit and the
    digest of an empty string. An empty table gives no rows; null conv_ids are
    one conversation; other columns are left out.
    """
    bounded_batches(rows.sparkSession)
    keys = ["conv_id", "turn", "role", "text"]
    counted = rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    code = F.unhex(F.sha2("text", 256))
    at = F.struct("turn")
    again = rows.where(F.col("n") > 0).groupBy("conv_id", "role", code.alias("code")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    again = again.where(F.col("first") < F.col("last")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "code", "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mine") == F.col("code"))
    marked = counted.withColumn("mine", code).join(again, same, "left")
    marked = marked.select(
        *keys,
        "n",
        is_blank(F.col("text")).alias("blank"),
        is_truncated(F.col("text")).alias("truncated"),
        F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)).alias("seen"),
    )

    def run(batches):
        out, now = [], None
        for batch in batches:
            for conv, turn, role, text, n, blank, truncated, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.id != conv:
                    if now is not None:
                        out.append(now.close())
                    now = _Conversation(conv, block)
                now.take(turn, role, text, n, blank, truncated, seen)
            if len(out) >= 1024:
                yield _rows(out)
                out = []
        if now is not None:
            out.append(now.close())
        yield _rows(out)

    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(run, _SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


OP12_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), bits AS (
  SELECT key, unnest(string_split(key, '')) AS ch, generate_subscripts(string_split(key, ''), 1) AS i FROM (SELECT DISTINCT key FROM c)
), crc(key, i, v) AS (
  SELECT DISTINCT key, 0, 4294967295::BIGINT FROM bits
  UNION ALL
  SELECT crc.key, crc.i + 1, list_reduce(list_prepend(xor(crc.v, ascii(bits.ch)::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
  FROM crc JOIN bits ON bits.key = crc.key AND bits.i = crc.i + 1
), kinds AS (SELECT key, xor(v, 4294967295) % 20 AS kind FROM crc WHERE i = len(key)),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(generate_series(1, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c JOIN kinds USING (key)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM d
), f AS (
  SELECT *, coalesce(lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] NOT IN ('su', 'ua', 'au'), false) AS odd FROM o
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (empty) AS blank,
    count(*) FILTER (seen AND NOT empty) AS duplicate, count(*) FILTER (cut AND NOT seen AND NOT empty) AS truncated,
    count(*) FILTER (odd) AS illegal, max(i) AS m FROM f GROUP BY conv_id
), edits AS (
  SELECT 'D' AS audit, 2 AS cost, q AS q, q AS q2, '' AS init, '' AS before, '' AS role FROM (VALUES (0), (1), (2), (3)) t(q)
  UNION ALL SELECT 'K', 0, q, q2, init, '', '' FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) t(q, q2, init)
  UNION ALL SELECT 'R', 1, q, q2, '', '', role FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) t(q, q2, role)
  UNION ALL SELECT 'IK', 5, q, q2, init, before, '' FROM (VALUES (0, 3, 'a', 'user:'), (1, 3, 'a', 'user:'), (2, 2, 'u', 'assistant:'), (3, 3, 'a', 'user:')) t(q, q2, init, before)
  UNION ALL SELECT 'IR', 6, q, q2, '', before, role FROM (VALUES (0, 3, 'assistant', 'user:'), (1, 3, 'assistant', 'user:'), (2, 2, 'user', 'assistant:'), (3, 3, 'assistant', 'user:')) t(q, q2, role, before)
), w AS (
  SELECT conv_id, i, role, text, (seen OR empty) AS gone, cut FROM f
), paths(conv_id, i, q, cost, audit, fixed) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '', '' FROM w
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, best.fixed FROM (
    SELECT p.conv_id, w.i, e.q2 AS q, min(struct_pack(
      cost := p.cost + e.cost + CASE WHEN e.audit <> 'D' AND w.cut THEN 5 ELSE 0 END,
      audit := p.audit || e.audit,
      fixed := p.fixed || CASE WHEN e.audit = 'D' THEN '' ELSE
        CASE WHEN p.q = 0 THEN '' ELSE chr(10) END || CASE WHEN e.before = '' THEN '' ELSE e.before || chr(10) END ||
        CASE WHEN e.role = '' THEN w.role ELSE e.role END || ':' || w.text END)) AS best
    FROM paths p JOIN w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1
      JOIN edits e ON e.q = p.q AND (e.audit = 'D' OR (NOT w.gone AND (e.init = '' OR e.init = w.role[1:1])))
    GROUP BY p.conv_id, w.i, e.q2)
), ends AS (
  SELECT p.conv_id, min(struct_pack(cost := cost + CASE q WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END,
    audit := audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    fixed := fixed || CASE q WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END)) AS best
  FROM paths p JOIN counts k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = k.m GROUP BY p.conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.fixed, '')) AS repaired_sha256
FROM ids LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@query("op12_integer_repair", OP12_SQL)
def op12_integer_repair(spark, sf_dir):
    """All conversations, damaged and repaired (null roles and texts: one space; rows of one turn by role and text; conversations that lose all rows stay)."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
