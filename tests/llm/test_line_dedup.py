import random
import re

from pricelattice.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, gone string, n int"


def brute(rows, t):
    """Delete every line covered by a run of t words or more that occurs earlier."""
    seqs = []
    for d, text in sorted(rows):
        raw = text.split("\n")
        idx = [i for i, x in enumerate(raw) if re.findall(r"[^\x20\x09-\x0D]+", x)]
        seqs.append((d, raw, idx, [raw[i].strip(" \t\n\x0b\f\r") for i in idx]))
    out = {}
    for n, (d, raw, idx, lines) in enumerate(seqs):
        dead = set()
        for i in range(len(lines)):
            best = 0
            for m in range(n + 1):
                other = seqs[m][3]
                for j in range(len(other) if m < n else i):
                    k = 0
                    while i + k < len(lines) and j + k < len(other) and lines[i + k] == other[j + k]:
                        k += 1
                    best = max(best, k)
            if sum(len(x.split()) for x in lines[i : i + best]) >= t:
                dead |= set(range(i, i + best))
        drop = set()
        for q in dead:
            drop |= set(range(idx[q], idx[q + 1] if q + 1 < len(idx) else len(raw)))
        out[d] = "\n".join(x for i, x in enumerate(raw) if i not in drop) if drop else "\n".join(raw)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a b c", "d", "e f", "g h i j k", "", "  ", "l m n o p q r", " d"]
    base = [[rng.choice(vocab) for _ in range(12)] for _ in range(4)]
    rows = []
    for d in range(60):
        x = list(rng.choice(base)) if rng.random() < 0.6 else [rng.choice(vocab) + f" {d}" for _ in range(5)]
        for _ in range(rng.randrange(4)):
            x.insert(rng.randrange(len(x) + 1), rng.choice(vocab) + f" {rng.randrange(9)}")
        rows.append((d, "\n".join(x)))
    for t in (4, 9, 20):
        got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=t).collect()
        assert {r.doc_id: r.text for r in got} == brute(rows, t)


def test_edges(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "x", 1), (2, long, "x", 1), (2, long, "x", 1), (3, None, None, None), (4, "", "x", 1), (None, long, "y", 2)]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_lines, r.n_deleted, r.n or 0) for r in got) == sorted(
        [(1, "", 1, 1, 1), (2, "", 1, 1, 1), (2, "", 1, 1, 1), (3, "", 0, 0, 0), (4, "", 1, 0, 1), (0, long, 1, 0, 2)]
    )
