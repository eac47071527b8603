"""Search of stored scans over an index of trigrams.

Postings are lists of ids for each trigram of a scan's text, note and flags, cut by block of
ids, so a trigram that every scan has makes many short lists instead of one long one. A list
is made by the task that has the block, which keeps only the low bits of its ids. Lists are
stored in buckets of the trigram, and a batch of new scans adds files without touching old ones. Texts are stored in a folder per block, so a search reads the blocks that hold
candidates and verifies those with the very pattern of a search without an index.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.operators.history import filter_risk, search_scans
from baitwatch.operators.trigram_lists import block_lists
from baitwatch.plans.session import work_folder
from baitwatch.registry import HISTORY_PAGE

GRAM = 3
#: Ids that differ in their last bits only are in one block.
BLOCK_BITS = 12
#: Trigrams of a query that are looked up, the rarest ones.
LOOKED_UP = 6
#: Buckets of the postings table.
BUCKETS = 16


def block_of(key: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(key, bits)


def postings(scans: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``gram, block, base, places, n`` of scans with their ``block``; a place is what is left
    of an id when ``base``, the first id of its block, is taken off.

    Text, note and flags are indexed one by one, as a search looks at them one by one.
    Null parts have no trigrams. Lists are made where the rows are, so no row per trigram and
    scan is ever moved; scans of a block should lie together, or it has more lists.
    """
    parts = (F.col("email_text"), F.col("note"), F.array_join("flags", "\n"))
    rows = scans.select("id", "block", *[p.cast("binary").alias(f"part{i}") for i, p in enumerate(parts)])
    # Places of up to 15 bits are never negative as short numbers.
    kind = "smallint" if bits < 16 else "int"
    return rows.mapInArrow(lambda batches: block_lists(batches, bits),
                           f"gram string, block long, base long, places array<{kind}>, n int")


def add_to_index(
    scans: DataFrame, name: str, path: str, bits: int = BLOCK_BITS, buckets: int = BUCKETS
) -> None:
    """Adds a batch of scans to the tables ``name_postings`` and ``name_scans`` below ``path``.

    Scans that are stored are left out, so a batch that runs again changes nothing; only ids in
    the blocks of the batch are compared, and texts only meet them if one is stored already.
    Postings are written first: a run that fails between the two leaves ids without a scan,
    which no search returns. Both are written from one copy, moved to its blocks once.
    """
    spark = scans.sparkSession
    rows = scans.withColumn("block", block_of(F.col("id"), bits))
    low, high, blocks = rows.agg(F.min("block"), F.max("block"), F.countDistinct("block")).first()
    if spark.catalog.tableExists(f"{name}_scans"):
        if low is None:
            return
        known = spark.table(f"{name}_scans").filter(F.col("block").between(low, high))
        again = rows.select("block", "id").join(known.select("block", "id"), ["block", "id"], "left_semi")
        if not again.isEmpty():
            rows = rows.join(again, ["block", "id"], "left_anti").select(*rows.columns)
    # With two partitions a block few hold several.
    placed = rows.repartition(max(1, 2 * blocks), "block").sortWithinPartitions("block", "id")
    placed = placed.persist(StorageLevel.DISK_ONLY)
    lists = postings(placed, bits).repartition(buckets, "gram")
    lists.write.bucketBy(buckets, "gram").sortBy("gram").option(
        "path", f"{path}/postings").mode("append").saveAsTable(f"{name}_postings")
    placed.write.partitionBy("block").option(
        "path", f"{path}/scans").mode("append").saveAsTable(f"{name}_scans")
    placed.unpersist()


def query_grams(query: str, literal: bool = False) -> list[str]:
    """Trigrams that every match holds: those of the parts between wildcards."""
    lower = query.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    parts = [lower] if literal else lower.replace("_", "%").split("%")
    return sorted({p[i:i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def candidates(index: DataFrame, grams: list[str]) -> DataFrame:
    """``id, block`` of the scans that hold all of the rarest ``LOOKED_UP`` trigrams.

    What is counted and compared is as long as the query. Lists are intersected block by block,
    the rarest trigram first, so each step only meets blocks the step before left.
    """
    listed = index.filter(F.col("gram").isin(grams))
    counts = {r.gram: r.n for r in listed.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP]

    def lists(gram: str) -> DataFrame:
        # Batches may have added to one block, each with ids of its own.
        own = index.filter(F.col("gram") == gram).groupBy("block", "base")
        return own.agg(F.flatten(F.collect_list("places")).alias("places"))

    left = lists(rarest[0])
    for gram in rarest[1:]:
        other = lists(gram).select("block", F.col("places").alias("more"))
        left = left.join(other, "block").select(
            "block", "base", F.array_intersect("places", "more").alias("places")).filter(
            F.size("places") > 0)
    found = left.select("block", "base", F.explode("places").alias("place"))
    return found.select((F.col("base") + F.col("place")).alias("id"), "block")


def indexed_search(
    spark: SparkSession, name: str, query: str | None, literal: bool = False
) -> DataFrame:
    """The scans ``search_scans`` finds, by way of the index.

    A query without a trigram, such as one of two letters, reads every scan. Candidates are
    written first, so Spark knows their size when it chooses the join; where it broadcasts
    them, their blocks are the only folders that are read.
    """
    scans = spark.table(f"{name}_scans")
    query = (query or "").strip()
    grams = query_grams(query, literal)
    if not grams:
        return search_scans(scans, query, literal).drop("block")
    folder = work_folder(spark, "candidates")
    candidates(spark.table(f"{name}_postings"), grams).write.parquet(folder)
    few = spark.read.schema("id long, block long").parquet(folder)
    low, high = few.agg(F.min("block"), F.max("block")).first()
    if low is None:
        return scans.drop("block").filter(F.lit(False))
    # Spark prunes folders by the other side of a join only where that side has a filter.
    within = F.col("block").between(low, high)
    some = scans.filter(within).join(few.filter(within), ["block", "id"], "left_semi")
    return search_scans(some, query, literal).drop("block")


def indexed_page(
    spark: SparkSession, name: str, query: str, level: str | None = None, n: int = HISTORY_PAGE,
    literal: bool = False,
) -> DataFrame:
    """``history_page`` for a search, by way of the index."""
    found = filter_risk(indexed_search(spark, name, query, literal), level)
    return found.orderBy(F.desc("id")).limit(n)
