"""Orders that no single task holds: trees as intervals, series by ranges, pages by a rank index, groups by their first member."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def tree_intervals(tree: DataFrame, max_depth: int = 64) -> DataFrame:
    """``(id, name, parent_id, depth, pre, last)`` of every node of ``tree(id, name, parent_id)``: ``pre`` counts nodes in pre-order
    from 0, siblings by name and id, and the subtree of a node is what has a ``pre`` from its own to its ``last``.

    Levels are joined from the roots down, sizes summed from the leaves up, places handed from the roots down: a join a level each. Nodes in a cycle
    and nodes without a known parent are left out. A tree deeper than ``max_depth`` raises."""
    level = tree.where("parent_id is null").select("id", "name", "parent_id", F.lit(0).alias("depth"))
    levels = []
    while not level.isEmpty():
        if len(levels) > max_depth:
            raise ValueError(f"the tree is deeper than {max_depth}")
        levels.append(kept(level, "tree-level"))
        up = levels[-1].select(F.col("id").alias("up"))
        level = tree.join(up, F.col("parent_id") == F.col("up")).select("id", "name", "parent_id", F.lit(len(levels)).alias("depth"))
    if not levels:
        return tree.where("false").select("id", "name", "parent_id", *[F.lit(0).cast(k).alias(c) for c, k in (("depth", "int"), ("pre", "long"), ("last", "long"))])
    sized, below = [], None
    for level in reversed(levels):
        if below is None:
            now = level.withColumn("size", F.lit(1).cast("long"))
        else:
            sums = below.groupBy(F.col("parent_id").alias("id")).agg(F.sum("size").alias("under"))
            now = level.join(sums, "id", "left").withColumn("size", 1 + F.coalesce("under", F.lit(0))).drop("under")
        below = kept(now, "tree-size")
        sized.insert(0, below)
    placed, above = [], None
    for level in sized:
        w = Window.partitionBy("parent_id").orderBy("name", "id").rowsBetween(Window.unboundedPreceding, -1)
        now = level.withColumn("pre", F.coalesce(F.sum("size").over(w), F.lit(0)))
        if above is not None:
            now = now.join(above.select(F.col("id").alias("parent_id"), (F.col("pre") + 1).alias("from")), "parent_id").withColumn("pre", F.col("pre") + F.col("from")).drop("from")
        above = kept(now, "tree-place")
        placed.append(above)
    whole = reduce(DataFrame.unionByName, placed)
    return whole.select("id", "name", "parent_id", "depth", "pre", (F.col("pre") + F.col("size") - 1).alias("last"))


def subtree(intervals: DataFrame, root) -> DataFrame:
    """The nodes of the subtree of ``root``, in pre-order; one range of ``pre``."""
    top = intervals.where(F.col("id") == root).select(F.col("pre").alias("__a"), F.col("last").alias("__b"))  # one row
    return intervals.join(F.broadcast(top), F.col("pre").between(F.col("__a"), F.col("__b"))).drop("__a", "__b").orderBy("pre")


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str = "nth") -> DataFrame:
    """``rows`` with their place, from 1, in their key's order. Rows are dealt by ranges of key and order, numbered inside a range,
    and shifted by the counts of the ranges before: a key of any size is spread over ranges, and no list of it is made."""
    dealt = kept(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "series-dealt")
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    # a key goes on from one range to the next only where it is a range's first one: of these alone sizes are counted, so that the shift has few rows
    going = dealt.groupBy("__part").agg(F.min(F.struct(*keys)).alias("__k")).select(*[F.col(f"__k.{k}").alias(f"__{k}") for k in keys]).distinct()
    held = dealt.join(F.broadcast(going), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi")
    sizes = held.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), before.alias("__before")).where("__before > 0")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out_rows = dealt.withColumn(out, inside).join(F.broadcast(shift), [*same, F.col("__part") == F.col("__p")], "left")
    return out_rows.withColumn(out, (F.col(out) + F.coalesce("__before", F.lit(0))).cast("long")).select(*rows.columns, out)


class RankIndex:
    """Rows by ranges of ``key`` (distinct and not null), with the number of rows of each range: a page reads the ranges that hold it,
    and the total is the sum of the numbers."""

    def __init__(self, rows: DataFrame, key: str, ranges: int | None = None):
        self.key = key
        dealt = rows.repartitionByRange(ranges, key) if ranges else rows.repartitionByRange(key)
        self.rows = kept(dealt.withColumn("__part", F.spark_partition_id()), "rank-index", "__part")
        self.counts = {r[0]: r[1] for r in self.rows.groupBy("__part").count().collect()}  # a number a range
        self.total = sum(self.counts.values())

    def ranges(self, offset: int, limit: int) -> tuple[list[int], int]:
        """The ranges that hold rows ``offset`` to ``offset + limit`` and the number of rows before them."""
        chosen, skipped, at = [], 0, 0
        for part in sorted(self.counts):
            n = self.counts[part]
            if at + n <= offset:
                skipped += n
            elif at < offset + limit:
                chosen.append(part)
            at += n
        return chosen, skipped

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows of a page in order, each with the ``total``; none past the end."""
        chosen, skipped = self.ranges(offset, limit)
        some = self.rows.where(F.col("__part").isin(chosen)).drop("__part")
        return some.orderBy(self.key).offset(max(0, offset - skipped)).limit(limit).withColumn("total", F.lit(self.total).cast("long"))


def _flat(up: DataFrame) -> DataFrame:
    """``up(a, up)`` with every pointer led on to its end: each step doubles the way."""
    while True:
        more = up.select(F.col("a").alias("m"), F.col("up").alias("further"))
        led = kept(up.join(more, F.col("up") == F.col("m"), "left").select("a", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "groups-jump")
        up = led.select("a", "up")
        if led.where("moved").isEmpty():
            return up


def first_of_group(links: DataFrame) -> DataFrame:
    """``(a, up)`` of ``links(a, b)``: every member of a group of linked values, but its least one, with the least one. Values are of any type
    that has an order (a struct of time and id, say). Links to itself, or with a null, do not count; chains and cycles are groups.

    Each round every value points to its least neighbour, if that is less; pointers are led on to their ends by pointer jumping, and the
    links between these ends go on, until none is left."""
    edges = kept(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "groups-links")
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("up")).where("up < a"), "groups-least")
        if least.isEmpty():
            return (edges.select("a", F.col("b").alias("up")) if found is None else found)
        up = _flat(least)
        end = up.select(F.col("a").alias("m"), F.col("up").alias("end"))
        led = edges.join(end, F.col("a") == F.col("m"), "left").select(F.coalesce("end", "a").alias("a"), "b")
        led = led.join(end, F.col("b") == F.col("m"), "left").select("a", F.coalesce("end", "b").alias("b"))
        edges = kept(led.where("a <> b").distinct(), "groups-links")
        if found is not None:
            found = found.join(end, F.col("up") == F.col("m"), "left").select("a", F.coalesce("end", "up").alias("up"))
        found = kept(up if found is None else found.unionByName(up), "groups-found")


def half_even(total: Column, parts: Column, places: int) -> Column:
    """The quotient of two decimals to ``places``, halves to even."""
    return F.bround(total / parts, places)
