"""Shards of near equal size by sampled splitters.

Records are ordered by a hash of the text, the id and a row number. A size-weighted sample of
the hashes gives the splitters of many small ranges; the exact size of each range is summed,
and those that are overfull, as a large group of copies makes them, are subdivided by a
second sample over the whole order. Whole ranges in order then make up the shards, so the
sizes are known exactly and no sampling error reaches them. Everything after the first pass
works on a narrow table without texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from baitwatch.llm.common import table, written

SHARDS = 8
#: Ranges of the first sample for each shard, and sampled keys for each of its splitters.
RANGES, SAMPLES = 128, 8
#: A range is overfull from so many times its fair share on.
OVERFULL = 2.0
#: A shard may miss its fair share by this part of it to keep a group of copies whole.
TOLERANCE = 0.01
_MASK = (1 << 52) - 1
#: Keys drawn of the second sample at most: what the driver holds is bounded by it.
MAX_KEYS = 100_000


def _uniform(*columns: str, seed: int) -> Column:
    """A number from 0 up to 1 that the row alone decides."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(_MASK)) / F.lit(float(_MASK + 1))


def _search(keys: list[tuple], columns: list[str]) -> Column:
    """How many of the sorted keys are not above the row's key, by binary search."""
    if not keys:
        return F.lit(0)
    fields = ", ".join(f"f{i} bigint" for i in range(len(columns)))
    text = ",".join("{" + ",".join(f'"f{i}":{v}' for i, v in enumerate(k)) + "}" for k in keys)
    array = F.from_json(F.lit(f"[{text}]"), f"array<struct<{fields}>>")
    own = F.struct(*(F.col(c).alias(f"f{i}") for i, c in enumerate(columns)))
    steps = F.sequence(F.lit(1), F.lit(len(keys).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(keys)).alias("high"))

    def step(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        above = F.get(array, middle) > own
        return F.struct(
            F.when((low < high) & ~above, middle + 1).otherwise(low).alias("low"),
            F.when((low < high) & above, middle).otherwise(high).alias("high"))

    return F.aggregate(steps, start, step)["low"]


def _splitters(rows: DataFrame, columns: list[str], ranges: int, total: int, seed: int) -> list:
    """Quantile boundaries of a sample in which a row's chance is in proportion to its size."""
    draws = min(ranges * SAMPLES, MAX_KEYS)
    chance = F.col("size") * F.lit(draws / max(total, 1))
    drawn = rows.filter(_uniform("hash", "doc_id", "row", seed=seed) < chance)
    keys = sorted(tuple(r) for r in drawn.select(*columns).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The law is ``bytes``: shards differ by about one part in a hundred, or by the largest
    record where that is more. Equal texts stay together unless that would break the law. A null text has
    size 1 and checksum 0 and sorts with empty ones, a null id sorts first, and repeated
    rows get slots of their own. Other columns are ignored; an empty table gives no row.
    """
    own = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[key].cast("long").alias("id"), F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        (F.octet_length(own) + 1).cast("long").alias("size"),
        F.crc32(own.cast("binary")).alias("text_crc32"), F.xxhash64(own).alias("hash"),
        F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0

    first = _splitters(rows, ["hash"], shards * RANGES, total, 31)
    ranged = rows.withColumn("range", _search(first, ["hash"]))
    share = total / (shards * RANGES)
    sizes = {r["range"]: r["size"] for r in
             ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()}
    overfull = [r for r, size in sizes.items() if size > OVERFULL * share]
    full_key = ["hash", "doc_id", "row"]
    crowded = ranged.filter(F.col("range").isin(overfull)) if overfull else ranged.filter("false")
    inside = sum(sizes[r] for r in overfull)
    second = _splitters(crowded, full_key, int(inside / share) + 1, inside, 37) if overfull else []
    ranged = ranged.withColumn("part", F.when(F.col("range").isin(overfull),
                               _search(second, full_key)).otherwise(0) if overfull else F.lit(0))
    ranged = written(ranged, "ranges")

    edges = ranged.groupBy("range", "part").agg(
        F.sum("size").alias("size"), F.count("*").alias("rows"),
        F.min("hash").alias("low"), F.max("hash").alias("high")).orderBy("range", "part").collect()
    placed = _place(edges, shards, total)
    schema = "range int, part int, shard int, first long"
    starts = docs.sparkSession.createDataFrame(placed, schema)
    order = W.partitionBy("range", "part").orderBy(*full_key)
    slots = ranged.withColumn("turn", F.row_number().over(order) - 1).join(starts, ["range", "part"])
    return slots.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("turn")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _place(edges: list, shards: int, total: int) -> list[tuple]:
    """Shard and first slot of each range: boundaries next to the quantiles, between groups
    where one is near enough."""
    passed, bounds = [], []
    size = 0
    for i, edge in enumerate(edges):
        passed.append((size, i == 0 or edges[i - 1]["high"] != edge["low"]))
        size += edge["size"]
    for k in range(1, shards):
        target = total * k / shards
        whole = [p for p, between in passed if between]
        best = min((abs(p - target), p) for p, _ in passed)[1] if passed else 0
        near = min((abs(p - target), p) for p in whole)[1] if whole else 0
        fits = abs(near - target) <= max(abs(best - target), TOLERANCE / 2 * total / shards)
        bounds.append(near if fits else best)
    placed, slots = [], [0] * shards
    for (at, _), edge in zip(passed, edges):
        number = sum(at >= b for b in bounds)
        placed.append((edge["range"], edge["part"], number, slots[number]))
        slots[number] += edge["rows"]
    return placed


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
