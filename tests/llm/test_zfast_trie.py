import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pricelattice.llm import zfast_trie
from pricelattice.llm.zfast_trie import conversation_trie, fattest


def brute(rows):
    """The trie as a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        up = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), up, len(cs), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **more):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted(map(tuple, conversation_trie(frame.withColumns(more)).collect()), key=str)


def made(seed, n, texts, longest):
    rng, rows = random.Random(seed), []
    for c in range(n):
        c = rng.choice([c, c + 100, c + 5000])
        if any(r[0] == c for r in rows):
            continue
        if rows and rng.random() < 0.3:  # a copy, or the opening, of another one
            other = rng.choice(rows)[0]
            turns = [r[1:] for r in rows if r[0] == other]
            turns = turns[: rng.randrange(1, len(turns) + 1)] if rng.random() < 0.5 else turns
        else:
            turns = [(k, rng.choice(["user", "assistant", None]), rng.choice(texts)) for k in range(rng.randrange(1, longest))]
        rows += [(c, *t) for t in turns]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, texts, longest", [(1, 220, ["a", "b", ""], 9), (2, 120, ["same"], 40), (3, 300, list("abcdefgh"), 4)])
def test_as_brute_force(spark, monkeypatch, seed, n, texts, longest):
    monkeypatch.setattr(zfast_trie, "PIECE", 4)
    monkeypatch.setattr(zfast_trie, "IDS", 16)
    monkeypatch.setattr(zfast_trie, "SHARES", (4, 2, 1))
    rows = made(seed, n, texts, longest)
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, "user", "é"), (7, 2, "user", "b"), (7, 2, "user", "b"), (7, 1, "a", None), (107, 0, "user", "x" * 100_000),
            (3000, 0, "", ""), (3001, 5, "", ""), *[(9, k, "u", str(k % 7)) for k in range(1500)], *[(10, k, "u", str(k % 7)) for k in range(1499)]]
    assert got(spark, rows, conv=F.lit("clash"), d=F.lit(1)) == brute(rows)
    assert got(spark, [(None, 1, "a", "b")]) == [] and got(spark, []) == []


def test_conversations_without_turns(spark):
    ids = [c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6 > 0][:12]  # no base: the own first turn goes
    rows = [(c, 0, "user", f"t{c}") for c in ids]
    want = brute(rows)
    assert len(want) == 1 and want[0][3] == 12 and got(spark, rows) == want


def test_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 70)]
    for r in spark.createDataFrame(pairs, "a long, b long").withColumn("f", fattest("a", "b")).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)
