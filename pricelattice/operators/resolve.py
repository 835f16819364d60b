"""Fuzzy joins: duplicates among names, stock items by brand and pack, catalog names."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.similarity import NameIndex, ratio
from ..functions.text import brand_key, normalise_name, normalise_pack, normalise_title


#: Names up to this length are found by single characters, longer ones by pairs of characters.
SHORT = 8


def _signatures(names: DataFrame, t: float) -> DataFrame:
    """``names(..., text)``, distinct, with ``len`` and a row for each token of its signature: ``q``, ``tok``.

    With LCS the longest common subsequence, a ratio of t means 2 LCS >= t (la + lb), and so a length lb of at least la t / (2 - t). Two such
    texts share LCS characters, and 3 LCS - la - lb - 1 pairs of neighbours: of the LCS - 1 steps from one common character to the next, each
    other character of either text spoils one at most. Tokens are numbered within a text, so that multisets compare as sets. Of sets that
    share k tokens the rarest (size - k + 1) of each meet; these are the signature."""
    own = names.columns
    sized = names.withColumn("len", F.length("text"))
    low = F.ceil(F.col("len") * t / (2 - t) - 1e-9)
    both = F.ceil((F.col("len") + low) * t / 2 - 1e-9)  # LCS with the shortest partner
    pairs_too = t >= 0.75  # else pairs of characters tell nothing
    reach = F.ceil(F.lit(SHORT) * (2 - t) / t + 1e-9) if pairs_too else F.lit(1 << 30)
    one = sized.where(F.col("len") <= reach).select(*own, "len", F.lit(1).alias("q"), (F.col("len") - both + 1).alias("most"), F.explode(F.filter(F.split("text", ""), lambda x: x != "")).alias("gram"))
    grams = F.transform(F.sequence(F.lit(1), F.col("len") - 1), lambda i: F.substring("text", i, F.lit(2)))
    two = sized.where(F.col("len") > SHORT).select(*own, "len", F.lit(2).alias("q"), (F.col("len") - (3 * both - F.col("len") - low - 1)).alias("most"), F.explode(grams).alias("gram"))
    counted = (one.unionByName(two) if pairs_too else one).groupBy(*own, "len", "q", "most", "gram").agg(F.count("*").alias("n"))
    tokens = counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*own, "len", "q", "most", F.concat_ws("\x01", "gram", "nth").alias("tok"))
    rarity = tokens.groupBy("q", "tok").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy(*own, "q").orderBy("df", "tok"))
    return tokens.join(rarity, ["q", "tok"]).withColumn("place", place).where("place <= most").select(*own, "len", "q", "tok")


def _meet(left: DataFrame, right: DataFrame, t: float, keys: list[str]) -> DataFrame:
    """Distinct pairs ``(keys, a, b)`` of texts whose signatures meet, with lengths that the ratio allows. A pair with a short text
    meets by characters alone, another one by pairs of characters alone."""
    a, b = (x.select(*[F.col(c).alias(f"{c}_{s}") for c in x.columns]) for x, s in ((left, "a"), (right, "b")))
    least, most = F.least("len_a", "len_b"), F.greatest("len_a", "len_b")
    kind = (F.col("q_a") == 1) == (least <= SHORT) if t >= 0.75 else F.lit(True)
    same = [F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b")) for k in keys]
    met = a.join(b, [*same, F.col("q_a") == F.col("q_b"), F.col("tok_a") == F.col("tok_b"), least >= most * (t / (2 - t)) - 1e-9, kind])
    return met.where(F.col("text_a") != F.col("text_b")).select(*[F.col(f"{k}_a").alias(k) for k in keys], F.col("text_a").alias("a"), F.col("text_b").alias("b")).distinct()


def similar_names(names: DataFrame, least: float = 80.0, seen: Observation | None = None) -> DataFrame:
    """Pairs ``(a, b, score)``, a < b, of distinct normalised names with a token-sort ratio of ``least`` or more. Candidates meet by
    their signatures; nothing is missed. ``seen`` observes the number of ``candidates`` that were scored."""
    own = names.select(normalise_name(F.col("name")).alias("n")).where("n <> ''").distinct()
    keyed = own.withColumn("text", F.array_join(F.array_sort(F.split("n", " ")), " "))
    marks = _signatures(keyed.select("text").distinct(), least / 100)
    unlike = _meet(marks, marks, least / 100, []).where("a < b")
    if seen is not None:
        unlike = unlike.observe(seen, F.count(F.lit(1)).alias("candidates"))
    scored = unlike.withColumn("score", ratio("a", "b")).where(F.col("score") >= least)
    left, right = keyed.select(F.col("text").alias("a"), F.col("n").alias("n_a")), keyed.select(F.col("text").alias("b"), F.col("n").alias("n_b"))
    far = scored.join(left, "a").join(right, "b").select("n_a", "n_b", "score")
    equal = left.join(right, (F.col("a") == F.col("b")) & (F.col("n_a") < F.col("n_b"))).select("n_a", "n_b", F.lit(100.0).alias("score"))
    return far.unionByName(equal).select(F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b"), F.round("score", 4).alias("score"))


def duplicate_products(products: DataFrame, least: float = 80.0) -> DataFrame:
    """Per product ``(product_id, name)`` its normalised ``name`` and ``n_links``, the number of other products whose name
    reaches a token-sort ratio of ``least``: those of an equal name, and those of the names that ``similar_names`` pairs it
    with. Links between names, with their scores, are in ``similar_names``. Products without a name have none."""
    own = products.select("product_id", normalise_name(F.col("name")).alias("name"))
    size = own.where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    pairs = similar_names(products.select("name"), least)
    both = pairs.select(F.col("a").alias("name"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("name"), F.col("a").alias("other")))
    others = both.join(size.withColumnsRenamed({"name": "other", "n": "m"}), "other").groupBy("name").agg(F.sum("m").alias("m"))
    links = size.join(others, "name", "left").select("name", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return own.join(links, "name", "left").select("product_id", "name", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def match_barcode(items: DataFrame, products: DataFrame) -> DataFrame:
    """The first product of each item's barcode ``(item_no, barcode)``; null for an unknown, empty or null one."""
    code = F.nullif(F.trim("barcode"), F.lit("")).alias("barcode")
    first = products.select("product_id", code).where("barcode is not null").groupBy("barcode").agg(F.min("product_id").alias("product_id"))
    return items.select("item_no", code).join(first, "barcode", "left").select("item_no", "product_id")


def _near_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs ``(brand, a, b, score)`` of distinct ``(brand, name)`` of both sides with equal brand (null is one) and a ratio of
    ``least`` or more. Equal names meet as they are, others by the signatures of ``similar_names``, inside their brand."""
    l, r = (x.where("name is not null").withColumnRenamed("name", "text") for x in (left, right))  # noqa: E741
    marks = _signatures(l.unionByName(r).distinct(), least / 100)
    side = lambda x: marks.join(x.select(F.col("brand").alias("k"), F.col("text").alias("x")), F.col("brand").eqNullSafe(F.col("k")) & (F.col("text") == F.col("x")), "left_semi")
    scored = _meet(side(l), side(r), least / 100, ["brand"]).withColumn("score", ratio("a", "b")).where(F.col("score") >= least)
    mine, theirs = l.select("brand", F.col("text").alias("a")), r.select(F.col("brand").alias("k"), F.col("text").alias("b"))
    equal = mine.join(theirs, F.col("brand").eqNullSafe(F.col("k")) & (F.col("a") == F.col("b"))).select("brand", "a", "b", F.lit(100.0).alias("score"))
    return scored.unionByName(equal)


def match_sku(items: DataFrame, products: DataFrame, least: float = 90.0, own_pack_first: bool = False) -> DataFrame:
    """The best product of each item ``(item_no, name, brand, pack_info)``: equal brand (null is one),
    packs that do not contradict, and a name ratio of ``least`` or more; else the first product of the
    same brand and pack, if the item has a brand and its pack a number. Unmatched items stay, with null.
    An item without a pack fits products of any pack. Of equal ratios the least id counts; with ``own_pack_first`` the least
    id of those without a pack, where there are some.

    Both sides are reduced to distinct (brand, pack, name); names are compared inside their brand alone."""
    key = [brand_key(F.col("brand")).alias("brand"), normalise_pack(F.col("pack_info")).alias("pack"), normalise_name(F.col("name")).alias("name")]
    named = lambda frame, x: frame.select(*[F.col(c).alias(f"{x}_{c}") for c in frame.columns])
    same = lambda x, y, *cols: [F.col(f"{x}_{c}").eqNullSafe(F.col(f"{y}_{c}")) for c in cols]
    own = named(items.select("item_no", *key), "i")
    i = own.select("i_brand", "i_pack", "i_name").distinct()
    p = products.select("product_id", *key).groupBy("brand", "pack", "name").agg(F.min("product_id").alias("product_id"))
    left = i.select(F.col("i_brand").alias("brand"), F.col("i_name").alias("name")).distinct()
    pairs = named(_near_names(left, p.select("brand", "name").distinct(), least), "n")
    wanted = i.join(pairs, [*same("i", "n", "brand"), F.col("i_name") == F.col("n_a")])
    cols = ["i_brand", "i_pack", "i_name", "n_score", "p_other_pack", "p_product_id"]
    one_pack = wanted.join(named(p.withColumn("other_pack", F.lit(False)), "p"), [*same("n", "p", "brand"), F.col("i_pack") == F.col("p_pack"), F.col("n_b") == F.col("p_name")])
    other = F.col("pack").isNotNull() if own_pack_first else F.lit(False)
    all_packs = named(p.groupBy("brand", "name", other.alias("other_pack")).agg(F.min("product_id").alias("product_id")), "p")
    any_pack = wanted.where("i_pack is null").join(all_packs, [*same("n", "p", "brand"), F.col("n_b") == F.col("p_name")])
    by_name = named(
        one_pack.select(*cols).unionByName(any_pack.select(*cols))
        .groupBy("i_brand", "i_pack", "i_name")
        .agg(F.min_by("p_product_id", F.struct(-F.col("n_score"), "p_other_pack", "p_product_id")).alias("i_product_id"))
        .toDF("brand", "pack", "name", "product_id"),
        "m",
    )
    first = p.where(F.col("brand").isNotNull() & F.col("pack").rlike(r"\d")).groupBy("brand", "pack").agg(F.min("product_id").alias("product_id"))
    found = own.join(by_name, same("i", "m", "brand", "pack", "name"), "left").join(named(first, "f"), same("i", "f", "brand", "pack"), "left")
    by = F.when(F.col("m_product_id").isNotNull(), "name").when(F.col("f_product_id").isNotNull(), "brand and pack")
    return found.select(F.col("i_item_no").alias("item_no"), F.coalesce("m_product_id", "f_product_id").alias("product_id"), by.alias("matched_by"))


#: Catalog names that one pass holds in every task; a larger catalog takes several passes.
SLICE = 10_000


def match_catalog(titles: DataFrame, catalog: DataFrame, least: float = 88.0, top: int = 5, slice_size: int = SLICE) -> DataFrame:
    """The ``top`` catalog names ``(ordinal, name)`` of each distinct title by token-set ratio, least ordinal on
    ties; ``matched`` marks a best one of ``least`` or more. A one-word name does not match three words or more
    that lack it. ``n_scored`` is the number of names that were compared in full.

    A pass sends about ``slice_size`` names to every task as an index (``NameIndex``), which bounds each name's ratio from above and
    compares in full only names whose bound reaches the ``top`` best ones so far. Passes are as many as the catalog needs; a title keeps
    its ``top`` names of each."""
    own = catalog.select("ordinal", normalise_title(F.col("name")).alias("cat"), F.col("name").alias("catalog_name"))
    passes = max(1, math.ceil(own.count() / slice_size))
    t = titles.select(normalise_title(F.col("title")).alias("title")).where("title <> ''").distinct()
    found = None
    for k in range(passes):
        names = own.where(F.pmod(F.xxhash64("ordinal", "cat"), F.lit(passes)) == k).collect()  # about slice_size
        some = t.mapInPandas(_best_names([tuple(r) for r in names], top), "title string, ordinal long, cat string, catalog_name string, score double, n_scored long")
        found = some if found is None else found.unionByName(some)
    w = Window.partitionBy("title")
    ranked = found.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "ordinal", "cat"))).withColumn("n_scored", F.sum(F.when(F.col("n_scored") > 0, F.col("n_scored"))).over(w))
    words = F.split("title", " ")
    lone = ~F.col("cat").contains(" ") & (F.size(F.array_distinct(words)) >= 3) & ~F.array_contains(words, F.col("cat"))
    best = (F.col("place") == 1) & (F.col("score") >= least) & ~lone
    return ranked.where(F.col("place") <= top).select("title", "place", "catalog_name", F.round("score", 4).alias("score"), best.alias("matched"), F.coalesce("n_scored", F.lit(0)).cast("long").alias("n_scored"))


def _best_names(names: list[tuple[int, str, str]], top: int):
    def run(frames):
        index = NameIndex(names)
        for frame in frames:
            rows = []
            for title in frame["title"]:
                best, scored = index.best(title, top)
                rows += [(title, *names[k], score, scored if j == 0 else 0) for j, (k, score) in enumerate(best)]
            yield pd.DataFrame(rows, columns=["title", "ordinal", "cat", "catalog_name", "score", "n_scored"])

    return run


def catalog_hits(titles: DataFrame, catalog: DataFrame, decisions: DataFrame | None = None, least: float = 88.0) -> DataFrame:
    """Each distinct ``title`` with the catalog entry that it is: ``catalog_name``, ``category`` and ``found_by``: ``score``, or ``decision`` where no
    score decides and ``decisions(raw_title, catalog_match, brand, pack_info, additional_info)`` names an entry of the title's top five; its other columns are
    handed on as ``decided_*``. Of several decisions on a title the least one by name counts. A title without an entry has nulls."""
    own = titles.select("title").where(F.trim("title") != "").distinct().withColumn("norm", normalise_title(F.col("title")))
    ranked = match_catalog(own.select("title"), catalog, least).withColumnRenamed("title", "norm")
    entry = catalog.groupBy(F.col("name").alias("catalog_name")).agg(F.min_by("category", "ordinal").alias("category"))
    extra = ["brand", "pack_info", "additional_info"]
    sure = ranked.where("matched").select("norm", F.col("catalog_name").alias("sure"))
    out = own.join(sure, "norm", "left")
    if decisions is None:
        out = out.withColumns({"told": F.lit(None).cast("string"), **{f"decided_{c}": F.lit(None).cast("string") for c in extra}})
    else:
        answers = decisions.select(F.col("raw_title").alias("title"), F.trim("catalog_match").alias("answer"), *extra).withColumn("norm", normalise_title(F.col("title")))
        offered = ranked.select("norm", F.col("catalog_name").alias("told"))
        valid = answers.join(offered, (answers.norm == offered.norm) & (F.col("answer") == F.col("told"))).drop("norm")
        one = valid.groupBy("title").agg(F.min(F.struct("told", *extra)).alias("x")).select("title", "x.told", *[F.col(f"x.{c}").alias(f"decided_{c}") for c in extra])
        out = out.join(one, "title", "left")
    told = F.when(F.col("sure").isNull(), F.col("told"))
    by = F.when(F.col("sure").isNotNull(), "score").when(told.isNotNull(), "decision")
    named = out.select("title", F.coalesce("sure", told).alias("catalog_name"), by.alias("found_by"), *[F.when(by == "decision", F.col(f"decided_{c}")).alias(f"decided_{c}") for c in extra])
    return named.join(entry, "catalog_name", "left")
