"""Exact top-k inner products by reading sorted lists, without random access.

All vectors are dealt to blocks of bounded size. A block has one sorted list per dimension, and
a query reads a list from the end that suits the sign of its own entry. What it has read of a
vector, and the last value read of every list for the rest, bound the vector's score from
above and below; so much is read that all but a few vectors of the block cannot be among the
best, and the scores of those few are resolved. The lists of a block are read once for many
queries together: their bounds are products of one matrix, with entries that were not read
replaced by a bound, and the queries.

Each query first searches the block it lies in. The score that its k-th best vector has there
is what vectors of all other blocks have to beat, so these are read less deeply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitwatch.llm.common import _arrow_schema, table, written

K, EVERY, SCALE = 5, 50, 256
#: Vectors in a block, and queries that read its lists together.
BLOCK, TOGETHER = 4_096, 512
#: Queries that one task searches in one block.
PART = 65_536
#: A query stops reading where so many vectors are left, besides those it asks for.
RESOLVE = 27
#: Parts of the lists that are read before bounds are looked at.
DEPTHS = (0.25, 0.5, 0.7, 0.85, 1)
_EXACT = 2.0**52
_LONG = (-(1 << 63), (1 << 63) - 1)
_ENDS = (-(2.0**63), 2.0**63)
_FOUND = "ask long, query_id long, vec_id long, score long"
_NO_ID = _LONG[1]


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` of the rows whose vector is there and has finite entries only."""
    own = vectors[vector]
    entry = F.transform(own, lambda c: c.cast("double"))
    sound = own.isNotNull() & F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(sound).select(vectors[key].cast("long").alias("vec_id"),
                                        entry.alias("x"))
    return rows.withColumn("x", F.transform("x", lambda c: F.floor(c * float(scale))))


class SortedLists:
    """A block of integer vectors with one ascending list per dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.ids, self.rows = x, ids, rows
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, 0).astype(np.float64)
        self.largest = float(np.abs(self.values).max(initial=0))

    def search(self, queries: np.ndarray, own: np.ndarray, bar: np.ndarray, bar_id: np.ndarray,
               k: int) -> Iterator[tuple[int, int, int]]:
        """``query, vector, score`` of the ``k`` best of the block for each query that beat its
        bar, a score and the id up to which it is beaten by a tie; a row of its own is left out."""
        n, dims = self.x.shape
        weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1)
        weights = weights.astype(np.float64)
        # Beyond 2 ** 52 sums of products are rounded; bounds then keep a distance.
        slack = np.abs(weights).sum(1) * self.largest
        slack = np.where(slack < _EXACT, 0.0, slack * dims * 2.0**-50)
        seen = np.zeros((n, 2 * dims), bool)
        known = np.zeros((n, 2 * dims))
        left, done = np.arange(len(queries)), 0
        for depth in sorted({max(1, round(n * d)) for d in DEPTHS}):
            for half, part in ((0, slice(n - depth, n - done)), (dims, slice(done, depth))):
                np.put_along_axis(seen[:, half:half + dims], self.order[part], True, 0)
                np.put_along_axis(known[:, half:half + dims], self.order[part],
                                  self.values[part], 0)
            done = depth
            reached = np.concatenate([self.values[n - depth], self.values[depth - 1]])
            ends = np.concatenate([self.values[0], self.values[-1]])
            turned = weights[left].T
            away = self.rows[:, None] == own[left]
            # Scores outside a long are ties.
            high = np.clip(np.where(seen, known, reached) @ turned + slack[left], *_ENDS)
            high[away] = -np.inf
            floor = bar[left]
            if n > k:
                low = np.clip(np.where(seen, known, ends) @ turned - slack[left], *_ENDS)
                low[away] = -np.inf
                floor = np.maximum(floor, np.partition(low, n - k, axis=0)[n - k])
            alive = (high >= floor) & ~away
            alive &= (high > bar[left]) | (self.ids[:, None] <= bar_id[left])
            stop = (alive.sum(0) <= k + RESOLVE) | (depth == n)
            for at in np.flatnonzero(stop):
                yield from self._resolved(int(left[at]), queries[left[at]], alive[:, at], k)
            left = left[~stop]
            if not len(left):
                return

    def _resolved(self, query: int, weights: np.ndarray, alive: np.ndarray, k: int):
        places = np.flatnonzero(alive)
        if self.largest * float(np.abs(weights.astype(np.float64)).sum()) < _EXACT:
            scores = self.x[places] @ weights
        else:
            scores = self.x[places].astype(object) @ weights.astype(object)
            scores = np.array([min(max(s, _LONG[0]), _LONG[1]) for s in scores], np.int64)
        best = np.lexsort((self.ids[places], -scores.astype(np.float64)))
        if len(best) > k:
            # Floats only sort; equal ones are told apart by their integers.
            last = float(scores[best[k - 1]])
            best = [b for b in best if float(scores[b]) >= last]
            best = sorted(best, key=lambda b: (-int(scores[b]), int(self.ids[places[b]])))[:k]
        for b in best:
            yield query, int(places[b]), int(scores[b])


def _found(lists: DataFrame, asked: DataFrame, blocks: int, parts: int, dims: int,
           k: int) -> DataFrame:
    """The best vectors of the block of each row of ``asked``, an answer per query and block."""
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    nothing = F.lit(None).cast("long")
    rows = lists.select("block", part.alias("part"), F.lit(0).alias("kind"), "row", "vec_id", "x",
                        nothing.alias("bar"), nothing.alias("bar_id"))
    rows = rows.unionByName(asked.select(
        "block", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("kind"), "row", "vec_id", "x", "bar", "bar_id"))
    # More partitions than blocks, so that few of them get two.
    rows = rows.repartition(min(4 * blocks * parts, 10_000), "block", "part")
    rows = rows.sortWithinPartitions("block", "part", "kind")
    types = _arrow_schema(_FOUND)

    def answer(held: SortedLists, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, TOGETHER):
            own = batch.slice(at, TOGETHER)
            queries = _matrix(own, dims)
            bar = own["bar"].cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
            ids = own["bar_id"].fill_null(_NO_ID).to_numpy()
            found = list(held.search(queries, own["row"].to_numpy(), bar, ids, k))
            if found:
                asks, places, scores = zip(*found)
                names = [None if i == _NO_ID else i for i in held.ids[list(places)].tolist()]
                yield pa.RecordBatch.from_pydict({
                    "ask": own["row"].take(pa.array(asks)),
                    "query_id": own["vec_id"].take(pa.array(asks)),
                    "vec_id": names, "score": scores}, schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gathered, held = None, [], None
        for batch in batches:
            marks = np.stack([batch[c].to_numpy() for c in ("block", "part", "kind")], 1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for start, end in zip([0, *edges], [*edges, len(marks)]):
                *at, kind = marks[start].tolist() if len(marks) else (None, 0)
                if at != key:
                    key, gathered, held = at, [], None
                own = batch.slice(int(start), int(end - start))
                if kind == 0:
                    gathered.append(own)
                elif gathered:
                    if held is None:
                        held = SortedLists(
                            np.concatenate([_matrix(b, dims) for b in gathered]),
                            np.concatenate([b["vec_id"].fill_null(_NO_ID).to_numpy()
                                            for b in gathered]),
                            np.concatenate([b["row"].to_numpy() for b in gathered]))
                    yield from answer(held, own)

    return rows.mapInArrow(run, _FOUND)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest(vectors: DataFrame, asks: Column, k: int = K, key: str = "vec_id",
            vector: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows for each row that ``asks``.

    ``asks`` is a condition on ``vec_id``. A score is the inner product of the entries times
    ``scale``, rounded down; ties go to the smaller id, and rows without an id come last and
    ask nothing. Rows whose vector is null or holds null or non-finite entries take
    no part; missing entries of shorter vectors count as zero. A repeated row is another row, so
    it can answer its twin. Entries and scores outside a long become the nearest long. An empty table gives
    no row; other columns are ignored.
    """
    rows = integer_vectors(vectors, key, vector, scale)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    blocks, dims = max(1, -(-n // block)), max(1, dims or 0)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))
    rows = rows.select("row", "vec_id", F.concat("x", zeros).alias("x"),
                       F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    queries = rows.filter(asks)
    nothing = F.lit(None).cast("long")
    home = _found(rows, queries.withColumns({"bar": nothing, "bar_id": nothing}), blocks, 1, dims, k)
    home = written(home, "home_block")

    bars = home.groupBy("ask").agg(F.count("*").alias("found"), F.min("score").alias("bar"))
    bars = bars.filter(F.col("found") >= k)
    last = home.join(bars.select("ask", "bar"), "ask").filter("score = bar")
    last = last.groupBy("ask").agg(F.first("bar").alias("bar"), F.max(
        F.coalesce("vec_id", F.lit(_NO_ID))).alias("bar_id"))
    others = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(blocks - 1)), F.array("block")))
    asked = queries.join(last, queries.row == last.ask, "left").select(
        "row", "vec_id", "x", "bar", "bar_id", others.alias("block"))
    parts = max(1, -(-queries.count() // PART))
    found = home.unionByName(_found(rows, asked, blocks, parts, dims, k))

    order = Window.partitionBy("ask").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER
             AS rank FROM scored)
WHERE rank <= {K}
"""
