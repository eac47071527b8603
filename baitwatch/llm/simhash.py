"""Near-duplicates by SimHash, joined on a grid of segment bit counts.

A fingerprint is mapped to the bit counts of its segments, 32 of two bits each: with wider ones
unlike fingerprints would share cells, in numbers that grow with the square of the table. Two fingerprints never differ in
fewer bits than the Manhattan distance of their counts, and two points of a grid within
distance two have a point between them that is at most one step from either. So all points
put themselves into the cells around them, and fingerprints that share no cell are no
candidates. The candidates are verified on the finest grid, with segments of one bit: there
the distance is the Hamming distance itself, every cell holds at most 65 fingerprints, and
any two of a cell differ in two bits at most. So neither step compares pairs, and a group of
any size costs a fixed number of rows per distinct fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import map_batches, slices, table, written
from baitwatch.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 64
#: Hashes whose bits are counted at a time.
_BLOCK = 255 * 32


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text as a signed 64-bit number; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at:at + _BLOCK]
        block = np.concatenate([block, np.zeros(-len(block) % 255, np.uint64)])
        bits = np.unpackbits(block.astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` for every row."""

    def hash_texts(batch: pa.RecordBatch):
        keys, digests, texts = (c.to_pylist() for c in batch.columns)
        for part in slices(texts):
            yield {"doc_id": [keys[i] for i in part], "text_hash": [digests[i] for i in part],
                   "fp": [fingerprint(texts[i]) for i in part]}

    rows = docs.select(docs[key].cast("long").alias("doc_id"),
                       F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    return map_batches(rows, ["doc_id", "text_hash", "text"], hash_texts,
                       "doc_id long, text_hash long, fp long")


def _counts(fp: Column) -> Column:
    """Bit counts of the 32 segments of two bits, each in its own two bits."""
    high = F.shiftrightunsigned(fp, 1)
    lows = F.lit(0x5555555555555555)
    both, either = fp.bitwiseAND(high).bitwiseAND(lows), fp.bitwiseXOR(high).bitwiseAND(lows)
    return F.shiftleft(both, 1).bitwiseOR(either)


def _cells(counts: Column) -> Column:
    """The point and those one step away: a count moves between 0 and 1 or between 1 and 2."""
    cells = [counts]
    for i in range(0, BITS, 2):
        own = F.shiftrightunsigned(counts, i).bitwiseAND(F.lit(3))
        upper = 3 << i if i < BITS - 2 else -(1 << i)
        cells.append(F.when(own < 2, counts.bitwiseXOR(F.lit(1 << i))))
        cells.append(F.when(own > 0, counts.bitwiseXOR(F.lit(upper))))
    return F.explode(F.array_compact(F.array(*cells)))


def _flips(fp: Column) -> Column:
    """The fingerprint and the 64 that differ from it in one bit."""
    masks = [F.lit(1 << i if i < BITS - 1 else -(1 << i)) for i in range(BITS)]
    return F.explode(F.array(fp, *(fp.bitwiseXOR(m) for m in masks)))


def links(prints: DataFrame) -> DataFrame:
    """``a, b`` that join all of ``prints(fp)``, without repeats, at two or fewer bits."""
    placed = prints.select("fp", _counts(F.col("fp")).alias("n")).select(
        "fp", _cells(F.col("n")).alias("cell"))
    shared = placed.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    candidates = placed.join(shared.filter("a <> b").select("cell"), "cell", "left_semi")
    candidates = written(candidates.select("fp").distinct(), "candidates")
    exact = candidates.select("fp", _flips(F.col("fp")).alias("cell"))
    met = exact.groupBy("cell").agg(F.array_sort(F.collect_set("fp")).alias("fps"))
    met = met.filter(F.size("fps") > 1)
    return met.select(F.col("fps")[0].alias("a"), F.explode(F.expr("slice(fps, 2, 64)")).alias("b"))


def classes(prints: DataFrame) -> DataFrame:
    """``fp, root, component_id`` of the fingerprints in ``prints(doc_id, fp)``."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Texts without words, null ones included, share the fingerprint zero. Copies share a
    fingerprint and cost the join one row; rows without an id count in no smallest id. Other
    columns are ignored, and an empty table gives no row.
    """
    prints = written(fingerprints(docs, key, text), "prints")
    found = prints.join(classes(prints).select("fp", "component_id"), "fp")
    hexadecimal = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class with all its columns: the smallest id, of equal ids the smallest
    text hash; of rows that are equal in both one stays. A class without ids keeps one row.

    Null texts and texts without words are one class. Texts of any length are hashed whole,
    columns keep their names and places even where names repeat, and an empty table stays
    empty.
    """
    prints = written(fingerprints(docs, key, text), "prints")
    return keep_least(docs, prints.join(classes(prints).select("fp", "root"), "fp"), key, text)


def keep_least(docs: DataFrame, joined: DataFrame, key: str, text: str) -> DataFrame:
    """The row ``keep_one_of_each`` keeps of each root in ``joined(doc_id, text_hash, root)``."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = joined.groupBy("root").agg(F.min(order).alias("o")).select(
        F.col("o.doc_id").alias("_key"), F.col("o.text_hash").alias("_hash"))
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own = rows[f"c{names.index(key)}"].cast("long")
    rows = rows.withColumns({"_own": own, "_digest": F.xxhash64(f"c{names.index(text)}")})
    rows = rows.join(kept, rows._own.eqNullSafe(kept._key) & (rows._digest == kept._hash),
                     "left_semi")
    rows = rows.dropDuplicates(["_own", "_digest"]).drop("_own", "_digest")
    return rows.toDF(*names)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
