"""Prefix trie of conversations as a z-fast trie in tables.

A conversation is a sequence of turns; a prefix is known by its length and 128 bits of hash (the exclusive or of the hashes of its
turns with their places). Only branching places and ends of conversations are nodes: a row with the depths ``lo`` to ``hi`` that
its edge covers, the hash of its extent (the prefix of length ``hi``), and its handle, the prefix whose length is the
two-fattest number in (lo, hi].

Conversations are inserted in batches of growing size, the distinct sequences alone. A batch finds where it leaves the trie
by fat binary search: probe the handle of two-fattest length in (a, b], go on below the extent of the node that is
hit, above the probed length on a miss. The deepest hit and the child below it hold the place where the conversation leaves;
the length of what it shares with that edge is compared by hash. Edges are split there, and what is left of the batch,
grouped by prefix, makes the new nodes. At last the edges are expanded to a row for each prefix.

Every step is a join or a grouping by hash. Long conversations are numbered and hashed in pieces, so that none is one task's work."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

#: Turns of one piece of a running sum; ids of one piece of a list of ids.
PIECE, IDS = 1024, 1 << 16
#: Of the sequences, by hash, the first batch has one in 64, the second one in 8, the third the rest.
SHARES = (64, 8, 1)
NODE = "lo long, hi long, x1 long, x2 long, rep long, f long, f1 long, f2 long, y1 long, y2 long, p1 long, p2 long"


def numbered(rows: DataFrame) -> DataFrame:
    """``rows(conv, turn, mark, chars)`` with ``pos`` from 1 in order of turn (null first) and mark. Rows are dealt by ranges, counted
    inside a range, and shifted by the counts of the ranges before."""
    dealt = stored(rows.repartitionByRange("conv", "turn", "mark").withColumn("part", F.spark_partition_id()), "trie-dealt")
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "mark"))
    sizes = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("conv", "part", before.alias("before")).where("before > 0")
    out = dealt.withColumn("pos", inside).join(shift, ["conv", "part"], "left")
    return out.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "mark", "chars")


def rebuilt(conversations: DataFrame, group: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(conv)`` and the turns ``(conv, d, mark, chars)`` of rebuilt conversations: the first h turns of conversation c - c % group, then c's
    own after its first h; h is the CRC of c modulo ``shared``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    own = numbered(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", mark.alias("mark"), F.length(text).cast("long").alias("chars")))
    turns = stored(own, "trie-turns")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    convs = sizes.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), h.alias("h"))
    have = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = stored(convs.join(have, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "trie-plan")
    rest = turns.join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "mark", "chars")
    opening = turns.where(F.col("pos") < shared).withColumnRenamed("conv", "base")
    begun = opening.join(plan, "base").where("pos <= h").select("conv", F.col("pos").alias("d"), "mark", "chars")
    return plan.select("conv"), begun.unionByName(rest)


def paths(turns: DataFrame) -> DataFrame:
    """Per turn the hash ``k1, k2`` of the prefix that it ends, ``j1, j2`` of the one before, and the characters ``upto`` it."""
    own = stored(turns.select("conv", "d", *[F.xxhash64(F.lit(i), "d", "mark").alias(f"t{i}") for i in (1, 2)], "chars", F.expr("(d - 1) div " + str(PIECE)).alias("piece")), "trie-marks")
    order = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    inside = own.withColumns({**{f"k{i}": F.bit_xor(f"t{i}").over(order.partitionBy("conv", "piece")) for i in (1, 2)}, "upto": F.sum("chars").over(order.partitionBy("conv", "piece"))})
    pieces = own.groupBy("conv", "piece").agg(*[F.bit_xor(f"t{i}").alias(f"s{i}") for i in (1, 2)], F.sum("chars").alias("s3"))
    past = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.select("conv", "piece", F.bit_xor("s1").over(past).alias("s1"), F.bit_xor("s2").over(past).alias("s2"), F.sum("s3").over(past).alias("s3")).where("piece > 0")
    out = inside.join(shift, ["conv", "piece"], "left")
    k = {i: F.col(f"k{i}").bitwiseXOR(F.coalesce(f"s{i}", F.lit(0))) for i in (1, 2)}
    return out.select(
        "conv", "d", *[k[i].alias(f"k{i}") for i in (1, 2)], *[k[i].bitwiseXOR(F.col(f"t{i}")).alias(f"j{i}") for i in (1, 2)],
        "chars", (F.col("upto") + F.coalesce("s3", F.lit(0))).alias("upto"),
    )


def fattest(a: str, b: str) -> Column:
    """The number in (a, b] that is divided by the greatest power of two."""
    return F.expr(f"{b} & shiftleft(-1L, length(bin({a} ^ {b})) - 1)")


def _at(frame: DataFrame, path: DataFrame, conv: str, d: str, a: str, b: str) -> DataFrame:
    """``frame`` with the hash (a, b) of the prefix of length ``d`` of ``conv``: zero for length 0, null past the end."""
    own = path.select(F.col("conv").alias("__c"), F.col("d").alias("__d"), F.col("k1").alias("__1"), F.col("k2").alias("__2"))
    met = frame.join(own, (F.col(conv) == F.col("__c")) & (F.col(d) == F.col("__d")), "left")
    zero = lambda c: F.when(F.col(d) == 0, F.lit(0)).otherwise(F.col(c))
    return met.withColumns({a: zero("__1"), b: zero("__2")}).drop("__c", "__d", "__1", "__2")


def _completed(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """Nodes ``(lo, hi, x1, x2, rep)`` with their handle, their name (the prefix that leads into the edge) and their parent."""
    own = nodes.select("lo", "hi", "x1", "x2", "rep").withColumns({"f": fattest("lo", "hi"), "name": F.col("lo") + 1})
    own = _at(_at(_at(own, path, "rep", "f", "f1", "f2"), path, "rep", "name", "y1", "y2"), path, "rep", "lo", "p1", "p2")
    return own.select(*[c.split()[0] for c in NODE.split(", ")])


def located(batch: DataFrame, nodes: DataFrame, path: DataFrame, rounds: int) -> DataFrame:
    """Where each sequence ``(s, n)`` leaves the trie: ``m``, the length of what is there, and ``hi, x1, x2`` of the edge if it leaves
    inside or at the end of one (null if it leaves at a node where no edge begins as it goes on)."""
    handles = nodes.select(*[F.col(c).alias(f"h_{c}") for c in ("f", "f1", "f2", "hi", "x1", "x2", "rep")])
    state = batch.withColumns({"a": F.lit(0).cast("long"), "b": F.col("n"), **{f"u_{c}": F.lit(0).cast("long") for c in ("f", "hi", "x1", "x2", "rep")}})
    for _ in range(rounds):
        asked = _at(state.withColumn("f", F.when(F.col("a") < F.col("b"), fattest("a", "b"))), path, "s", "f", "k1", "k2")
        met = asked.join(handles, (F.col("f") == F.col("h_f")) & (F.col("k1") == F.col("h_f1")) & (F.col("k2") == F.col("h_f2")), "left")
        hit = F.col("h_f").isNotNull()
        last = {f"u_{c}": F.when(hit, F.col(f"h_{c}")).otherwise(F.col(f"u_{c}")) for c in ("f", "hi", "x1", "x2", "rep")}
        below, above = F.when(hit, F.col("h_hi")).otherwise(F.col("a")), F.when(F.col("f").isNull() | hit, F.col("b")).otherwise(F.col("f") - 1)
        state = met.select("s", "n", below.alias("a"), above.alias("b"), *[x.alias(c) for c, x in last.items()])
    full = _at(state, path, "s", "u_hi", "k1", "k2")
    full = full.withColumn("passed", F.coalesce((F.col("k1") == F.col("u_x1")) & (F.col("k2") == F.col("u_x2")), F.lit(False))).drop("k1", "k2")
    onward = _at(full.withColumn("next", F.when(F.col("passed"), F.col("u_hi") + 1)), path, "s", "next", "k1", "k2")
    names = nodes.select(*[F.col(c).alias(f"w_{c}") for c in ("lo", "y1", "y2", "hi", "x1", "x2", "rep")])
    child = onward.join(names, (F.col("u_hi") == F.col("w_lo")) & (F.col("k1") == F.col("w_y1")) & (F.col("k2") == F.col("w_y2")), "left")
    pick = lambda c: F.when(F.col("passed"), F.col(f"w_{c}")).otherwise(F.col(f"u_{c}"))
    edge = {c: pick(c) for c in ("hi", "x1", "x2", "rep")}
    known = F.when(F.col("passed"), F.col("u_hi") + F.col("w_hi").isNotNull().cast("long")).otherwise(F.col("u_f"))
    place = stored(child.select("s", "n", known.alias("m"), *[x.alias(c) for c, x in edge.items()]), "trie-place")
    # the rest of the edge, hash by hash: what agrees is a prefix of it
    mine = path.select(F.col("conv").alias("s"), "d", "k1", "k2")
    more = place.where("m < least(hi, n)").join(mine, "s").where("d > m and d <= hi")
    theirs = path.select(F.col("conv").alias("rep"), "d", "k1", "k2")
    same = more.select("s", "rep", "d", "k1", "k2").join(theirs, ["rep", "d", "k1", "k2"]).groupBy("s").agg(F.max("d").alias("far"))
    return place.join(same, "s", "left").select("s", "n", F.coalesce("far", "m").alias("m"), "hi", "x1", "x2")


def inserted(batch: DataFrame, nodes: DataFrame | None, path: DataFrame, rounds: int) -> DataFrame:
    """The nodes after a batch of sequences ``(s, n)``."""
    none = F.lit(None).cast("long")
    if nodes is None:
        exits = batch.withColumns({"m": F.lit(0).cast("long"), "hi": none, "x1": none, "x2": none})
    else:
        exits = stored(located(batch, nodes, path, rounds), "trie-exits")
    # what the trie lacks: one row a prefix
    tails = path.join(exits.select(F.col("s").alias("conv"), "n", "m"), "conv").where("d > m")
    found = tails.groupBy("d", "k1", "k2", "j1", "j2").agg(F.min("conv").alias("rep"), F.max((F.col("d") == F.col("n")).cast("int")).alias("ends"))
    groups = stored(found, "trie-groups")
    forks = groups.groupBy((F.col("d") - 1).alias("d"), F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(F.count("*").alias("kids"))
    stops = groups.join(forks, ["d", "k1", "k2"], "left").where("ends = 1 or kids > 1").select("d", "k1", "k2", "rep")
    marked = tails.join(stops, ["d", "k1", "k2"])
    above = F.lag("d").over(Window.partitionBy("conv").orderBy("d"))
    new = marked.withColumn("lo", F.coalesce(above, "m")).where("conv = rep").select("lo", F.col("d").alias("hi"), F.col("k1").alias("x1"), F.col("k2").alias("x2"), "rep")
    if nodes is None:
        return stored(_completed(new, path), "trie-nodes")
    key = ["hi", "x1", "x2"]
    cuts = exits.where("m < hi").groupBy(*key, "m").agg(F.min("s").alias("s"))
    cuts = _at(cuts, path, "s", "m", "c1", "c2").join(nodes.select(*key, "lo", "rep"), key)
    whole = nodes.join(cuts.select(*key).distinct(), key, "left_semi")
    parts = cuts.select(*key, "lo", "rep", F.col("m").alias("at"), "c1", "c2").unionByName(
        whole.select(*key, "lo", "rep", F.col("hi").alias("at"), F.col("x1").alias("c1"), F.col("x2").alias("c2"))
    )
    top = F.coalesce(F.lag("at").over(Window.partitionBy(*key).orderBy("at")), "lo")
    split = parts.select(top.alias("lo"), F.col("at").alias("hi"), F.col("c1").alias("x1"), F.col("c2").alias("x2"), "rep")
    kept = nodes.join(whole.select(*key), key, "left_anti").select(*[c.split()[0] for c in NODE.split(", ")])
    return stored(kept.unionByName(_completed(new.unionByName(split), path)), "trie-nodes")


def _ends_digest():
    """One digest a node of rows ``(hi, x1, x2, piece, ids)`` that come in order, kept as a running hash."""

    @lean
    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield _digests(out)
        if now is not None:
            yield _digests([(*now, digest.hexdigest())])

    return run


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["hi", "x1", "x2", "ends_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows)], names=names)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt``), as ``conversations(conv_id, turn, role, text)`` gives them:
    ``conv_id`` (the least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are in order of turn, null first; equal ones by the digest of role and text; repeated rows are turns of their own. A null role or
    text counts as empty. Rows without a conv_id are no conversation and are left out; other columns are ignored. Very long
    conversations, and any number of equal ones, are rows like others. Without conversations there is no node."""
    convs, turns = rebuilt(conversations)
    every = stored(paths(turns), "trie-paths")
    tip = every.groupBy("conv").agg(F.max("d").alias("n"), F.max_by(F.struct("k1", "k2", "upto"), "d").alias("t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ends = stored(convs.join(tip, "conv", "left").select("conv", zero("n").alias("n"), zero("t.k1").alias("e1"), zero("t.k2").alias("e2"), zero("t.upto").alias("total")), "trie-ends")
    seqs = stored(ends.groupBy("n", "e1", "e2").agg(F.min("conv").alias("s"), F.count("*").alias("copies"), F.first("total").alias("total")), "trie-sequences")
    path = stored(every.join(seqs.select(F.col("s").alias("conv")), "conv", "left_semi"), "trie-distinct")
    longest = seqs.agg(F.max("n")).first()[0]
    if longest is None:
        return convs.select(
            F.col("conv").alias("conv_id"), *[F.lit(0).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256")
        )  # no rows
    nodes, taken = None, F.lit(False)
    for share in SHARES:
        own = (F.pmod("e1", F.lit(share)) == 0) & ~taken
        nodes = inserted(seqs.where(own & (F.col("n") > 0)).select("s", "n"), nodes, path, int(longest).bit_length() + 1)
        taken = taken | (F.pmod("e1", F.lit(share)) == 0)
    return _described(nodes, path, seqs, ends)


def _described(nodes: DataFrame, path: DataFrame, seqs: DataFrame, ends: DataFrame) -> DataFrame:
    key = ["hi", "x1", "x2"]
    kids = nodes.groupBy(F.col("lo").alias("hi"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("kids"))
    tips = seqs.select("s", F.col("n").alias("hi"), F.col("e1").alias("x1"), F.col("e2").alias("x2"), "copies", "total")
    one = tips.join(kids.withColumn("inner", F.lit(1)), key, "left").select("s", "copies", "total", (F.col("inner").isNull()).cast("long").alias("leaf"))
    none = F.lit(0).cast("long")
    # which nodes each sequence goes through, the root included
    through = path.join(nodes.select("hi", "x1", "x2", "lo"), (path.d == nodes.hi) & (path.k1 == nodes.x1) & (path.k2 == nodes.x2))
    rooted = seqs.select("s", none.alias("lo"), none.alias("hi"), none.alias("x1"), none.alias("x2"))
    met = stored(through.select(F.col("conv").alias("s"), "lo", *key).unionByName(rooted), "trie-through")
    counted = met.join(one, "s").groupBy(*key).agg(
        F.min("lo").alias("lo"), F.min("s").alias("conv"), F.sum("copies").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("copies") * F.col("total")).alias("chars"),
    )
    known = stored(counted, "trie-counted")
    # a sequence owns the nodes whose least member it is, which lie below one place; saved = all members' characters less each node's once
    begins = known.groupBy(F.col("conv").alias("s")).agg(F.min("lo").alias("begin"))
    before = path.select(F.col("conv").alias("s"), F.col("d").alias("begin"), F.col("upto").alias("skipped"))
    owned = begins.join(before, ["s", "begin"], "left").join(one, "s").select("s", "total", (F.col("total") - F.coalesce("skipped", none)).alias("owned"))
    once = met.join(owned.select("s", "owned"), "s").groupBy(*key).agg(F.sum("owned").alias("once"))
    least = owned.select(F.col("s").alias("conv"), (F.col("owned") - F.col("total")).alias("less"))
    base = known.join(once, key).join(least, "conv").select("conv", *key, "n_convs", "n_leaves", (F.col("chars") - F.col("once") + F.col("less")).alias("saved"))
    pieces = ends.groupBy(F.col("n").alias("hi"), F.col("e1").alias("x1"), F.col("e2").alias("x2"), F.expr(f"conv div {IDS}").alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")  # IDS ids at most
    )
    digests = pieces.repartition(*key).sortWithinPartitions(*key, "piece").mapInArrow(_ends_digest(), "hi long, x1 long, x2 long, ends_sha256 string")
    full = stored(base.join(kids, key, "left").join(digests, key, "left"), "trie-base")
    empty, count = F.lit(hashlib.sha256(b"").hexdigest()), F.coalesce("kids", none)
    columns = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    root = full.where("hi = 0").select(
        F.col("conv").alias("conv_id"), none.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", count.alias("n_children"), "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    parents = full.select(F.col("hi").alias("lo"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv").alias("parent"))
    edges = nodes.select("lo", *key, "rep", "p1", "p2").join(full, key).join(parents, ["lo", "p1", "p2"])
    each = edges.withColumn("d", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))))
    walk = each.join(path.select(F.col("conv").alias("rep"), "d", (F.col("upto") - F.col("chars")).alias("past")), ["rep", "d"])
    last = F.col("d") == F.col("hi")
    below = walk.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("lo") + 1, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), "n_convs",
        F.when(last, count).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * F.col("past")).alias("saved_tokens"), F.when(last, F.coalesce("ends_sha256", empty)).otherwise(empty).alias("ends_sha256"),
    )
    return root.unionByName(below).select("conv_id", "depth", "parent_conv_id", *columns)
