"""Lists of places by trigram, made inside a task from the texts of one block of ids."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Sent to executors with its code, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters, and texts, that are sorted together; a block with more has several lists of a trigram.
RUN_CHARS = 6_000_000
RUN_TEXTS = 1 << 14


def block_lists(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """``gram, block, base, places, n`` of batches of ``id, block`` and parts of a text as bytes.

    Rows of a block that follow each other are taken together, as far as a run goes.
    """
    ids, parts, held, size = [], [], None, 0
    for batch in batches:
        own, blocks, *texts = (c.to_pylist() for c in batch.columns)
        for key, block, *text in zip(own, blocks, *texts):
            if ids and (block != held or size >= RUN_CHARS or len(ids) >= RUN_TEXTS):
                yield from _lists(ids, parts, held, bits)
                ids, parts, size = [], [], 0
            held = block
            ids.append(key)
            parts.append([str(t, "utf-8", "replace") for t in text if t is not None])
            size += sum(map(len, parts[-1]))
    if ids:
        yield from _lists(ids, parts, held, bits)


def _lists(ids: list, parts: list, block: int, bits: int) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(p) for some in parts for p in some], np.int64)
    if not (lengths > 2).any():
        return
    joined = "".join(p for some in parts for p in some)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    seen = np.zeros(sys.maxunicode + 1, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    n, texts = len(letters), len(ids)
    if n ** 3 * texts >= 1 << 63:  # one text always fits
        half = texts // 2
        yield from _lists(ids[:half], parts[:half], block, bits)
        yield from _lists(ids[half:], parts[half:], block, bits)
        return
    rank = (np.cumsum(seen) - 1)[codes]
    # No trigram begins at the last two characters of a part.
    begins = np.ones(len(codes), bool)
    ends = np.cumsum(lengths)
    begins[ends[lengths > 0] - 1] = False
    begins[ends[lengths > 1] - 2] = False
    begins = begins[:-2]
    grams = rank[:-2] * n
    grams += rank[1:-1]
    grams *= n
    grams += rank[2:]
    grams = grams[begins]
    grams *= texts
    of_part = np.repeat(np.arange(texts), [len(some) for some in parts])
    grams += np.repeat(of_part, np.maximum(lengths - 2, 0))
    grams.sort()
    grams = grams[np.append(True, grams[1:] != grams[:-1])]

    gram, text = np.divmod(grams, texts)
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    gram = gram[first]
    word = np.stack([gram // (n * n), gram // n % n, gram % n], axis=1)
    spelt = letters[word].astype(np.uint32).tobytes().decode("utf-32-le")
    base = block << bits
    places = (np.array(ids, np.int64) - base).astype(np.int16 if bits < 16 else np.int32)
    bounds = np.append(first, len(text)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([
        pa.array([spelt[i:i + 3] for i in range(0, len(spelt), 3)], pa.string()),
        pa.array(np.full(len(gram), block, np.int64)),
        pa.array(np.full(len(gram), base, np.int64)),
        pa.ListArray.from_arrays(pa.array(bounds), pa.array(places[text])),
        pa.array(np.diff(bounds)),
    ], names=["gram", "block", "base", "places", "n"])
