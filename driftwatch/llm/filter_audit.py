"""Filter interaction audit: what five filters remove, in every order, from counts of failure masks.

Native expressions set a bit for each filter that a text fails; rows with equal texts meet by the text's SHA-256 and learn
the smallest doc_id among them. Each part then has 32 cells (a mask's documents, good and toxic ones), and all 120 orders
are read off the cells: the texts are scanned once, however many orders there are. DataFrame functions only.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.common import WHITE

#: Letters of the filters; the k-th has the bit 1 << k.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Limits of the filters: words, percent of different words, percent of capitals, and the marks that D looks for.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
#: Tasks over which the rows without an id are spread where labels are joined.
SPREAD = 1024


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails. A null text is empty: it fails A alone."""
    words = F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike(MARKS))
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Documents, and those labelled good and toxic, by part and failure mask: at most 32 rows a part.

    Repeated rows count as often as they stand; rows of one id don't make each other duplicates. A row without an id is no
    duplicate, makes none and has no label. An id with several labels is good, or toxic, if any of them says so.
    Before anything is shuffled by text, equal rows become one with their count, so groups of copies of any size are small;
    no text is shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_mask(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    counted = rows.groupBy("digest", "part", "mask", "id").agg(F.count("*").alias("n"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad")
    )
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SPREAD))).otherwise(0)
    labelled = counted.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0).cast("bigint")), ["id", "spread"], "left")
    kinds = ["digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad")]
    # of a kind of rows with one text: how many, how many have an id, the smallest id and how many have that
    groups = labelled.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    # a text's rows are now as many as its parts and labels at most, whatever its copies
    least = F.min("first.id").over(Window.partitionBy("digest"))
    copies = groups.withColumn("copies", F.col("named") - F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    both = F.inline(F.array(F.struct(F.col("mask").alias("cell"), (F.col("n") - F.col("copies")).alias("docs")), F.struct((F.col("mask") + DUPLICATE).alias("cell"), F.col("copies").alias("docs"))))
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("docs")).otherwise(0))
    return copies.select("part", "good", "bad", both).groupBy("part", F.col("cell").alias("mask")).agg(F.sum("docs").alias("docs"), of("good").alias("good"), of("bad").alias("toxic"))


def orders_of(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the parts' cells.

    What a filter does at a step depends on the set of filters before it alone: 80 pairs of a filter and a set are summed
    for each part, and the 600 steps of all orders look theirs up.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))  # 32 at most
    pairs = F.array(*(F.struct(F.lit(1 << k).alias("bit"), F.lit(before).alias("before")) for k in range(5) for before in range(32) if not before >> k & 1))
    at = parts.select("part", "cells", F.inline(pairs))

    def total(value: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + F.when(where(c["mask"]), c[value]).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails, gone = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    # of 120 orders, a filter is the first among the k that a document fails in 120 / k
    share = F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + F.when(fails(c["mask"]), c["docs"] * F.lit(120).cast("bigint") / F.bit_count(c["mask"])).otherwise(0).cast("bigint"))
    effects = at.select(
        "part", "bit", "before", total("docs", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), total("docs", here).alias("removed"),
        total("docs", lambda m: fails(m) & gone(m)).alias("redundant"), total("docs", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )
    steps: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(5)):
        for k, f in enumerate(order):
            steps.setdefault((1 << f, sum(1 << x for x in order[:k])), []).append(("".join(FILTERS[x] for x in order), k + 1))
    spark = cells.sparkSession
    table = spark.createDataFrame([(*pair, name, k) for pair, places in steps.items() for name, k in places], "bit int, before int, filter_order string, step int")
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return effects.join(F.broadcast(table), ["bit", "before"]).select("part", "filter_order", "step", *counts)  # 600 rows


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each step of each order of the filters A to E keeps and removes, by part; zeros included.

    A: under 200 words. B: fewer than half the words are different. C: over two percent of the characters are capitals A-Z.
    D: one of #$%&*| occurs. E: the text is that of a smaller id, wherever in the table. A null text is empty, a null part
    the empty one; an empty table gives no rows. Columns of other names are ignored.
    """
    return orders_of(mask_cells(docs, labels, id_col, text_col, part_col))
