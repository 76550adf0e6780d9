"""Conversation repair against a search of all edits."""

import hashlib
import random
import re

import pytest

from factloom.llm import repair as R

LEGAL = re.compile("(s?(ua)+)?")


def brute(rows):
    """(cost, audit, repaired) over all edits with up to two insertions in each place; rows: (role, text, must_go, truncated)."""
    prefixes = {("", ()): (0, "")}  # (initials, repaired) -> best

    def put(out, key, value):
        if key not in out or value < out[key]:
            out[key] = value

    def with_inserts(states):
        for _ in range(2):
            for (initials, done), (cost, audit) in list(states.items()):
                for role in ("user", "assistant"):
                    put(states, (initials + role[0], (*done, f"{role}:")), (cost + 5, audit + "I"))
        return states

    for role, text, must_go, truncated in rows:
        out = {}
        for (initials, done), (cost, audit) in with_inserts(prefixes).items():
            put(out, (initials, done), (cost + 2, audit + "D"))
            if must_go:
                continue
            more = 5 * truncated
            put(out, (initials + (role[:1] or "?"), (*done, f"{role}:{text}")), (cost + more, audit + "K"))
            for new in ("user", "assistant"):
                put(out, (initials + new[0], (*done, f"{new}:{text}")), (cost + 1 + more, audit + "R"))
        # a prefix that no text can complete goes
        prefixes = {k: v for k, v in out.items() if re.fullmatch("(s?(ua)*u?)?", k[0])}
    best = min((cost, audit, "\n".join(done)) for (initials, done), (cost, audit) in with_inserts(prefixes).items() if LEGAL.fullmatch(initials))
    return best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_equals_search(block):
    rng = random.Random(block)
    for _ in range(120):
        rows = [(rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", " ", "u2"]), rng.choice(["x.", "y", "é\n"]), rng.random() < 0.2, rng.random() < 0.25) for _ in range(rng.randint(0, 5))]
        one = R.Repair(block)
        for row in rows:
            one.row(*row)
        assert one.close() == brute(rows), rows


def test_long_runs_and_blocks_agree():
    rng = random.Random(1)
    rows = [(rng.choice(["user", "assistant", "system"]), str(k), rng.random() < 0.1, rng.random() < 0.1) for k in range(900)]
    small, large = R.Repair(3), R.Repair(1000)
    for k, row in enumerate(rows):
        small.row(*row)
        large.row(*row)
        if k % 300 == 0:
            small.gone(50)
            for _ in range(50):
                large.row("", "", True, False)
    assert small.close() == large.close()


def test_rows_of_odd_kinds(spark):
    schema = "conv_id long, turn long, role string, text string, n long"
    rows = [
        (1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Yes.", 3), (1, 5, "user", " \t", 1), (1, 6, "user", "Hi.", 2), (1, None, "system", "S.", 1),
        (2, 0, "", "", 0), (2, 1, "", "", 0),
        (None, 3, "user", "Cut", 1), (None, 3, "assistant", "Ok!", 1),
        (3, 0, "assistant", "A.", 5000),
        (4, None, "user", "Q?", 1), (4, None, "assistant", "A.\n", 1),
    ]
    got = {r["conv_id"]: tuple(r)[1:] for r in R.repair(spark.createDataFrame(rows, schema)).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1] == (3, 1, 4, 0, 2 + 1 + 1, 2 * 5, "KKKDDDDD", digest("system:S.\nuser:Hi.\nassistant:Yes."))
    assert got[2] == (0, 0, 0, 0, 0, 0, "", digest(""))
    assert got[None][0] == 0 and got[None][3] == 1
    assert got[3] == (0, 0, 4999, 0, 4999, 2 * 5000, "D" * 5000, digest(""))
    assert got[4][:4] == (0, 0, 0, 0)
    assert R.repair(spark.createDataFrame([], schema)).collect() == []


def test_damage(spark):
    from zlib import crc32

    rows = [(c, t, r, x, "extra") for c in (None, 1, 2) for t in (None, *range(40)) for r, x in (("assistant", "One. Two!"), (None, None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    want = []
    for c, t, r, x, _ in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        want.append((c, t, "", "", 0) if kind == 0 else (c, t, "user" if kind == 4 else r, "" if kind == 1 else x.replace(".", "").replace("!", "") if kind == 2 else x, 2 if kind == 3 else 1))
    key = lambda r: repr(r)
    assert sorted(map(tuple, R.damaged(df).collect()), key=key) == sorted(want, key=key)
