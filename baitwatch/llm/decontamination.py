"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search.

Words are runs of letters and digits in lower case, shingles are five of them. A window that
shares no shingle with an item has similarity zero, so windows are only formed around shared
shingles, each as long as an item that has the shingle. Their fingerprints of 128 bits are
looked up by blocks: with one block more than the radius, two fingerprints within it agree in
some block, so none within it is missed. What is found is verified by the exact weighted
Jaccard similarity of the shingles.

At a similarity of 0.8 between 17 and 20 of the 128 bits differ, with a deviation of 4; the
radius of 39 is five deviations above that. Of 100,000 simulated windows at exactly 0.8 at most
one lies outside it, for items of 9 to 180 shingles.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import filter_batches, map_batches, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 39
BITS = 128
#: Bytes of item texts in a block; documents are searched once per block of items.
ITEM_BYTES = 16_000_000
#: Windows fingerprinted at a time, items compared with them, and pairs of both.
_STARTS, _ITEMS, _PAIRS = 2_048, 2_048, 65_536
_COUNTED = 256
LEAKS = "doc_id long, item_id long, similarity double, first_word long, n_words long"
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], length: int = SHINGLE) -> list[tuple[str, ...]]:
    """All shingles with repeats; of fewer words the whole sequence, of none nothing."""
    size = min(length, len(words))
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)] if size else []


def similarity(one: Counter, other: Counter) -> float:
    """Weighted Jaccard similarity, a shingle weighing as often as it occurs."""
    both = (one & other).total()
    either = one.total() + other.total() - both
    return both / either if either else 0.0


def _votes(found: list[tuple[str, ...]]) -> np.ndarray:
    """A row of 128 votes of +1 and -1 for each shingle."""
    from xxhash import xxh3_128_digest

    data = b"".join(xxh3_128_digest("\0".join(s).encode()) for s in found)
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, BITS)
    return bits.astype(np.int32) * 2 - 1


class ItemIndex:
    """Items of a bounded block of the benchmark, by shingle and by fingerprint block.

    Words are numbers here, 0 those that no item has, and all that is kept per word or item
    lies in arrays.
    """

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS,
                 threshold: float = SIMILARITY):
        self.radius, self.threshold = radius, threshold
        self.edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.vocabulary: dict[str, int] = {}
        self.keys: list[int] = []
        self.words: list[np.ndarray] = []
        prints = []
        for key, text in items:
            words = words_of(text)
            if words:
                self.keys.append(key)
                self.words.append(np.array([
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
                prints.append(_fingerprints(_votes(shingles(words)).sum(0)[None]))
        self.prints = np.concatenate([np.zeros((0, BITS), np.uint8), *prints])
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.of_size = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        self.blocks = self._blocks(self.prints)
        self.known = {int(n): self._sizes_by_shingle(int(n))
                      for n in np.unique(np.minimum(sizes, SHINGLE))}
        self.counts: dict[int, Counter] = {}

    def _sizes_by_shingle(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted numbers of the shingles of ``n`` words, and the item sizes of each of them."""
        own = [w for w in self.words if min(len(w), SHINGLE) == n]
        numbers = np.concatenate([_rolling(_windows(w)) for w in own])
        sizes = np.repeat([len(w) for w in own], [len(w) - n + 1 for w in own])
        pairs = np.unique(np.rec.fromarrays([numbers, sizes], names="number,words"))
        distinct, first = np.unique(pairs.number, return_index=True)
        return distinct, np.append(first, len(pairs)), np.ascontiguousarray(pairs.words)

    def _blocks(self, prints: np.ndarray) -> np.ndarray:
        """A number for the bits of each block of each fingerprint."""
        parts = [prints[:, a:b] @ (np.uint64(1) << np.arange(b - a, dtype=np.uint64))
                 for a, b in zip(self.edges, self.edges[1:])]
        least = np.uint8 if np.diff(self.edges).max() <= 8 else np.uint64
        return np.stack(parts, 1).astype(least)

    def near(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """``window, item`` of the items of a size within the radius of each fingerprint.

        With one block more than the radius such two agree in a block, so only pairs that do are
        compared.
        """
        items = self.of_size[size]
        for at in range(0, len(items), _ITEMS):
            some = items[at:at + _ITEMS]
            agree = np.zeros((len(prints), len(some)), bool)
            for ours, theirs in zip(self._blocks(prints).T, self.blocks[some].T):
                agree |= ours[:, None] == theirs
            windows, places = np.nonzero(agree)
            for low in range(0, len(windows), _PAIRS):
                w, p = windows[low:low + _PAIRS], some[places[low:low + _PAIRS]]
                close = (prints[w] != self.prints[p]).sum(1) <= self.radius
                yield from zip(w[close].tolist(), p[close].tolist())

    def counted(self, item: int) -> Counter:
        """The shingles of an item; those of a few hundred items are kept."""
        if item not in self.counts:
            if len(self.counts) >= _COUNTED:
                self.counts.clear()
            self.counts[item] = Counter(map(tuple, _windows(self.words[item]).tolist()))
        return self.counts[item]

    def starts(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item size the ranges of window starts that hold a shared shingle."""
        ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, (numbers, edges, sizes) in self.known.items():
            if len(ids) < n:
                continue
            seen = np.lib.stride_tricks.sliding_window_view(ids, n)
            places = np.flatnonzero(seen.all(1))
            keys = _rolling(seen[places])
            near = np.searchsorted(numbers, keys).clip(max=len(numbers) - 1)
            found = numbers[near] == keys
            for p, k in zip(places[found].tolist(), near[found].tolist()):
                for size in sizes[edges[k]:edges[k + 1]].tolist():
                    last = max(0, len(ids) - size)
                    low, high = max(0, min(p + n - size, last)), min(p, last)
                    own = ranges[size]
                    if own and low <= own[-1][1] + 1:
                        own[-1] = (min(low, own[-1][0]), max(high, own[-1][1]))
                    else:
                        own.append((low, high))
        return ranges

    def search(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """Items found in a text: place of the item to similarity, first word and words."""
        words = words_of(text)
        ids = np.array([*map(self.vocabulary.get, words, repeat(0))], np.int32)
        found: dict[int, tuple[float, int, int]] = {}
        for size, ranges in self.starts(ids).items():
            for low, high in ranges:
                for at in range(low, high + 1, _STARTS):
                    self._search(words, ids, size, at, min(high, at + _STARTS - 1), found)
        return found

    def _search(self, words, ids, size: int, low: int, high: int, found: dict) -> None:
        own = words[low:high + size]
        length = min(SHINGLE, size)
        parts = shingles(own, length)
        width = max(1, min(size, len(own)) - length + 1)
        sums = np.concatenate([np.zeros((1, BITS), np.int32), _votes(parts).cumsum(0)])
        prints = _fingerprints(sums[width:] - sums[:-width])
        for i, item in self.near(size, prints):
            start = low + i
            window = _windows(ids[start:start + min(size, len(own))], length)
            score = similarity(Counter(map(tuple, window.tolist())), self.counted(item))
            if score >= self.threshold and score > found.get(item, (0.0,))[0]:
                found[item] = (score, start, min(size, len(own)))


def _windows(ids: np.ndarray, length: int = SHINGLE) -> np.ndarray:
    """The shingles of some words as rows of numbers."""
    return np.lib.stride_tricks.sliding_window_view(ids, min(length, len(ids)))


def _fingerprints(votes: np.ndarray) -> np.ndarray:
    return (votes > 0).astype(np.uint8)


def _rolling(ids: np.ndarray) -> np.ndarray:
    """A number for each row of ids; where rows only share the number, windows are compared in vain."""
    key = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        key = key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64)
    return key


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text",
                block_bytes: int = ITEM_BYTES) -> Iterator[ItemIndex]:
    """Indexes over all items, each over a block of about ``block_bytes`` of text at most.

    A hash deals items out to as many blocks as their total size asks for, so what is sent
    to the executors at a time has a bound whatever the size of the benchmark.
    """
    rows = items.select(items[key].cast("long").alias("key"), items[text].alias("text"))
    rows = rows.filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for block in range(blocks):
        own = F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == block
        yield ItemIndex(sorted(((r.key, r.text) for r in rows.filter(own).collect()),
                               key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
          block_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words`` of every item in every row.

    An item is reported once per row at its most similar window, the first of equal ones;
    items that share an id are reported each, and repeated rows repeat their leaks. Null and
    empty texts and items without a word match nothing; other columns are ignored. Without
    items or documents there is no row. Nothing is shuffled.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for index in item_blocks(items, block_bytes=block_bytes):
        found = found.unionByName(_search_block(rows, index))
    return found


def _search_block(rows: DataFrame, index: ItemIndex) -> DataFrame:
    def search(batch: pa.RecordBatch):
        hits = []
        for key, text in zip(*(c.to_pylist() for c in batch.columns)):
            for item, (score, first, n) in sorted(index.search(text).items()):
                hits.append((key, index.keys[item], score, first, n))
        columns = list(map(list, zip(*hits))) if hits else [[] for _ in range(5)]
        yield dict(zip(("doc_id", "item_id", "similarity", "first_word", "n_words"), columns))

    return map_batches(rows, ["doc_id", "text"], search, LEAKS)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text",
                      block_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows with all their columns in which no item is found.

    Null and empty texts hold none and stay, texts of any length are searched whole, repeated
    rows are judged alike; items without a word are found nowhere, and an empty table stays empty.
    """
    for index in item_blocks(items, block_bytes=block_bytes):
        docs = filter_batches(docs, text, _clean(index))
    return docs


def _clean(index: ItemIndex):
    return lambda texts: [not index.search(text) for text in texts]


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
