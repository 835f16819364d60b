"""Line deduplication by a suffix array over line ids, DataFrame operations only.

A text is the sequence of its lines that hold a word. Distributed prefix doubling sorts all
suffixes of all sequences: round k knows each suffix's rank by its first 2**k lines, and the pair
(rank here, rank 2**k lines on) sorts by twice as many. A suffix whose rank nobody shares cannot
start a longer repeat and leaves, so each round is smaller than the one before.

A run counts as repeated if it has ``min_words`` words. The suffixes that agree on their first
lines as far as that are an interval of the suffix array with a longest common prefix of at least
``min_words`` words. Its members are named by the ranks of the two (overlapping) blocks of 2**a
lines that cover that prefix. The doubling stops at 2**a <= ``min_words``, since every line has a
word. The same holds read backwards from a last line. Every line of a maximal repeated run of
``min_words`` words or more lies in a shortest such run, forwards or backwards, so the union of the
later members of all intervals is the set of lines to delete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, free, stored

MIN_WORDS = 50
DOC = ["d", "th"]


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row per document (repeated rows once): its key and an array over its lines of two
    hashes (96 bits name a line, white space at its ends aside) and the number of words."""

    def line(x):
        bare = F.btrim(x, F.lit(SPACES))
        return F.struct(
            F.xxhash64(bare).alias("h1"),
            F.hash(bare).alias("h2"),
            F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).alias("nw"),
        )

    return (
        docs.where(F.col(text).isNotNull())
        .select(F.col(id_col).alias("d"), F.xxhash64(text).alias("th"), F.transform(F.split(text, "\n"), line).alias("l"))
        .dropDuplicates(DOC)
    )


def _sequences(lines: DataFrame, min_words: int) -> DataFrame:
    """A row per line with a word: ``seq`` (from 1), ``pos`` and ``upto`` (the lines of the text
    that go with it: itself and blank ones after it), its hashes, and the shortest run of
    ``min_words`` words that starts (``fwd`` lines) or ends (``bwd`` lines) here, if there is one."""
    doc = Window.partitionBy(*DOC)
    by_pos = doc.orderBy("pos")
    flat = (
        lines.select(*DOC, F.size("l").alias("n"), F.posexplode("l").alias("pos", "x"))
        .select(*DOC, "n", "pos", "x.h1", "x.h2", "x.nw")
        .where("nw > 0")
        .withColumn("seq", F.row_number().over(by_pos))
        .withColumn("upto", F.coalesce(F.lead("pos").over(by_pos), F.col("n")))
        .withColumn("cum", F.sum("nw").over(by_pos))
        .withColumn("prev", F.col("cum") - F.col("nw"))
    )
    ahead, behind = doc.orderBy("prev"), doc.orderBy("cum")
    t = min_words
    return (
        flat.withColumn("fwd", F.count("*").over(ahead.rangeBetween(0, t - 1)))
        .withColumn("reach", F.max("cum").over(ahead.rangeBetween(0, t - 1)))
        .withColumn("bwd", F.count("*").over(behind.rangeBetween(-(t - 1), 0)))
        .withColumn("back", F.min("prev").over(behind.rangeBetween(-(t - 1), 0)))
        .withColumn("fwd", F.when(F.col("reach") - F.col("prev") >= t, F.col("fwd")))
        .withColumn("bwd", F.when(F.col("cum") - F.col("back") >= t, F.col("bwd")))
        .select(*DOC, "seq", "pos", "upto", "h1", "h2", "fwd", "bwd")
    )


def _first_ranks(seqs: DataFrame) -> DataFrame:
    """Rank of each line that occurs twice or more: the number of such lines that sort before it.
    The running sum goes over 1,024 ranges of the hash first, then inside each range."""
    groups = seqs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("part", F.shiftright("h1", 54))
    parts = groups.groupBy("part").agg(F.sum("n").alias("s"))
    base = parts.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"))
    inside = Window.partitionBy("part").orderBy("h1", "h2")
    ranks = groups.join(F.broadcast(base), "part").select(  # 1,024 rows at most
        "h1", "h2", (F.col("base") + F.sum("n").over(inside) - F.col("n")).alias("r")
    )
    return seqs.join(ranks, ["h1", "h2"]).select(*DOC, "seq", "r")


def _doubled(ranks: DataFrame, k: int) -> DataFrame:
    """Ranks by 2**(k+1) lines from ranks by 2**k; suffixes that share theirs with none leave."""
    there = Window.partitionBy(*DOC).orderBy("seq").rangeBetween(2**k, 2**k)
    pairs = ranks.withColumn("r2", F.max("r").over(there)).where("r2 is not null")
    inside = Window.partitionBy("r").orderBy("r2")
    shared = (
        pairs.groupBy("r", "r2")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("r", "r2", (F.col("r") + F.sum("n").over(inside) - F.col("n")).alias("new"))
    )
    return pairs.join(shared, ["r", "r2"]).select(*DOC, "seq", F.col("new").alias("r"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(d, th, gone)``: for each document that loses lines, its id, the hash of its text, and the
    positions (from 0) of the lines that repeat a run of ``min_words`` words or more of a document
    with a smaller id, or from further up in the same one."""
    lines = stored(_lines(docs, id_col, text), "lines")
    seqs = _sequences(lines, min_words)
    level = stored(_first_ranks(seqs), "line-ranks")
    levels = [level.withColumn("a", F.lit(0))]
    k = 0
    while 2 ** (k + 1) <= min_words and not level.isEmpty():
        level = stored(_doubled(level, k), "line-ranks")
        k += 1
        levels.append(level.withColumn("a", F.lit(k)))
    ranks = reduce(DataFrame.unionByName, levels)

    starts = F.array(
        F.struct(F.col("seq").alias("s"), F.col("fwd").alias("m")),
        F.struct((F.col("seq") - F.col("bwd") + 1).cast("int").alias("s"), F.col("bwd").alias("m")),
    )
    runs = (
        seqs.select(*DOC, F.explode(F.array_distinct(starts)).alias("x"))
        .where("x.m is not null")
        .select(*DOC, F.col("x.s").alias("s"), F.col("x.m").cast("int").alias("m"))
        .distinct()
        .withColumn("a", F.floor(F.log2("m")).cast("int"))
        .withColumn("s2", (F.col("s") + F.col("m") - F.expr("shiftleft(1, a)")).cast("int"))
    )
    head = ranks.withColumnsRenamed({"seq": "s", "r": "ra"})
    tail = ranks.withColumnsRenamed({"seq": "s2", "r": "rb"})
    same_doc = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in DOC]
    named = (
        runs.alias("x")
        .join(head.alias("y"), [*same_doc, F.expr("x.a = y.a and x.s = y.s")])
        .select("x.*", "ra")
        .alias("x")
        .join(tail.alias("y"), [*same_doc, F.expr("x.a = y.a and x.s2 = y.s2")])
        .select("x.*", "rb")
    )
    at = F.struct("d", "th", "s")
    interval = ["m", "ra", "rb"]
    earliest = named.groupBy(*interval).agg(F.min(at).alias("least"), F.count("*").alias("n")).where("n > 1")
    later = named.join(earliest, interval).where(at != F.col("least"))
    covered = later.select(*DOC, F.explode(F.expr("sequence(s, s + m - 1)")).alias("seq")).distinct()
    return (
        covered.alias("x")
        .join(seqs.select(*DOC, "seq", "pos", "upto").alias("y"), [*same_doc, F.expr("x.seq = y.seq")])
        .select("y.*")
        .groupBy(*DOC)
        .agg(F.flatten(F.collect_list(F.expr("sequence(pos, upto - 1)"))).alias("gone"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, n_lines: str = "n_lines", n_deleted: str = "n_deleted"
) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, and with ``n_lines``
    and ``n_deleted`` (lines before, lines deleted) at the end.

    Which copy stays goes by the least id, then the hash of the text, then the place. White space
    at the ends of a line does not tell lines apart; lines without a word are no part of a run and
    go with the line before them. Repeated rows (same id and text) count as one and get the same
    result. A null text stays null with 0 lines; an empty one has one line. A null id sorts first.
    Columns of ``docs`` other than the two may have any name but those of the two added ones."""
    d, th, gone, own = (free(docs, c) for c in ("__d", "__th", "__gone", "__lines"))
    found = repeated_lines(docs, id_col, text, min_words).withColumnsRenamed({"d": d, "th": th, "gone": gone})
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(own), i)), "\n")
    joined = docs.join(
        found, [docs[id_col].eqNullSafe(F.col(d)), F.xxhash64(docs[text]) == F.col(th), docs[text].isNotNull()], "left"
    )
    return (
        joined.withColumn(own, lines)
        .withColumn(n_lines, F.greatest(F.size(own), F.lit(0)))
        .withColumn(n_deleted, F.coalesce(F.size(gone), F.lit(0)))
        .withColumn(n_deleted, F.greatest(n_deleted, F.lit(0)))
        .withColumn(text, F.when(F.col(n_deleted) > 0, kept).otherwise(F.col(text)))
        .drop(d, th, gone, own)
    )
