"""Quality of documents: base rules, and lines labelled by a conditional random field.

A linear-chain CRF with two labels scores the lines of a text by features of each line and
by which label follows which; the Viterbi path marks content and boilerplate, and the share
of words in content lines decides whether a document stays. Its weights are learned from
documents with a quality label. Those don't say which lines of a bad document are bad, so
lines start with the label that their features suggest and are relabelled by the model.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import map_batches, sample_by_hash, slices, table

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
MIN_CONTENT = 0.5
#: At most so many labelled rows are learned from, by at most so many lines of each.
SAMPLE_ROWS, SAMPLE_LINES, SAMPLE_RUN = 2_500, 32, 8
ROUNDS, STEPS, RATE, DECAY = 3, 50, 0.1, 1e-4
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, content_share double"
)
CONTENT, BOILERPLATE = 0, 1
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that the text holds twice or more.

    Places of equal pairs, then of equal fours and eights get equal numbers, so windows are
    compared exactly without being built.
    """
    if len(words) <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    same = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    step = 1
    while step < WINDOW:
        pairs = same[:-step] * (int(same.max()) + 1) + same[step:]
        same, counts = np.unique(pairs, return_inverse=True, return_counts=True)[1:]
        if len(counts) == len(pairs):
            return 0
        step *= 2
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.nonzero(counts[same] > 1)[0]
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int(np.count_nonzero(edges[:-1].cumsum()))


def base_stats(text: str, lines: list[str]) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    full = [line for line in lines if line.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        len(full) - len(set(full)), repeated_words(words),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def _level(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value >= b for b in bounds)


#: Bounds between the levels of each feature of a line.
_BOUNDS = {
    "words": (2, 4, 9, 21), "symbols per word": (0.01, 0.2, 0.6), "marks per word": (0.05, 0.5),
    "upper case letters": (0.15, 0.5), "digits": (0.02, 0.2), "distinct words": (0.3, 0.6, 0.9),
    "bytes per word": (3.5, 5, 8, 12), "repeated line": (1,), "sentence end": (1,),
}
_OFFSETS = dict(zip(_BOUNDS, np.cumsum([0, *(len(b) + 1 for b in _BOUNDS.values())]).tolist()))
N_FEATURES = sum(len(b) + 1 for b in _BOUNDS.values())


def line_features(line: str, repeated: bool) -> tuple[int, ...]:
    """One feature of each kind; the line has a word."""
    data = line.encode()
    words = data.split()
    n, size = len(words), len(data)

    def without(chars: bytes) -> int:
        return size - len(data.translate(None, chars))

    values = (
        n, without(SYMBOLS.encode()) / n, without(b"!?") / n,
        without(_UPPER) / max(1, without(_LETTERS)), without(_DIGITS) / size,
        len(set(words)) / n, sum(map(len, words)) / n, repeated, data.rstrip()[-1:] in b".!?:",
    )
    return tuple(offset + _level(value, bounds) for value, offset, bounds in
                 zip(values, _OFFSETS.values(), _BOUNDS.values()))


def text_lines(lines: list[str]) -> tuple[list[tuple[int, ...]], list[int]]:
    """Features and numbers of words of the lines that have a word."""
    features, sizes, seen = [], [], set()
    for line in lines:
        n = len(line.encode().split())
        if n:
            features.append(line_features(line, line in seen))
            sizes.append(n)
            seen.add(line)
    return features, sizes


class LineCrf:
    """Weights towards boilerplate per feature, and of a label after a label."""

    def __init__(self):
        self.weights = np.zeros(N_FEATURES)
        self.follows = np.zeros((2, 2))
        self.cache: dict[tuple[int, ...], float] = {}

    def emission(self, features: tuple[int, ...]) -> float:
        if features not in self.cache:
            self.cache[features] = float(self.weights[list(features)].sum())
        return self.cache[features]

    def decode(self, lines: list[tuple[int, ...]]) -> list[int]:
        """The most likely labels; of equal ones content is preferred."""
        (cc, cb), (bc, bb) = self.follows.tolist()
        back: list[tuple[int, int]] = []
        content = boilerplate = 0.0
        for i, features in enumerate(lines):
            own = self.emission(features)
            if not i:
                boilerplate = own
                continue
            stay, turn = content + cc, boilerplate + bc
            start, keep = content + cb, boilerplate + bb
            back.append((int(turn > stay), int(keep >= start)))
            content, boilerplate = max(stay, turn), max(start, keep) + own
        if not lines:
            return []
        labels = [int(boilerplate > content)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def train(self, texts: list[list[tuple[int, ...]]], good: list[bool]) -> None:
        """Labels lines of good texts content, the others by the model, and fits it anew."""
        labels = self._first_labels(texts, good)
        for _ in range(ROUNDS):
            self._fit(texts, labels)
            for i, text in enumerate(texts):
                if not good[i] and text:
                    own = self.decode(text)
                    if BOILERPLATE not in own:
                        own[max(range(len(text)), key=lambda j: self.emission(text[j]))] = BOILERPLATE
                    labels[i] = own

    def _first_labels(self, texts, good) -> list[list[int]]:
        counts = {True: Counter(), False: Counter()}
        for text, fine in zip(texts, good):
            counts[fine].update(f for line in text for f in line)
        n = {fine: max(1, sum(len(t) for t, g in zip(texts, good) if g == fine)) for fine in counts}
        odds = [math.log((counts[False][f] + 1) / (n[False] + 2))
                - math.log((counts[True][f] + 1) / (n[True] + 2)) for f in range(N_FEATURES)]
        return [[int(not fine and sum(odds[f] for f in line) > 0) for line in text]
                for text, fine in zip(texts, good)]

    def _fit(self, texts, labels) -> None:
        """Adam on the likelihood of all label chains together, by forward and backward sums."""
        rows = [(t, own) for t, own in zip(texts, labels) if t]
        length = max((len(t) for t, _ in rows), default=0)
        if not length:
            return
        active = np.zeros((len(rows), length, len(_BOUNDS)), np.int64)
        mask = np.zeros((len(rows), length), bool)
        marked = np.zeros((len(rows), length), np.int64)
        for i, (text, own) in enumerate(rows):
            active[i, :len(text)], marked[i, :len(text)] = text, own
            mask[i, :len(text)] = True
        after = mask[:, 1:]
        seen = np.bincount(active[mask].ravel(), np.repeat(marked[mask], len(_BOUNDS)), N_FEATURES)
        turns = np.zeros((2, 2))
        np.add.at(turns, (marked[:, :-1][after], marked[:, 1:][after]), 1)
        params = np.concatenate([self.weights, self.follows.ravel()])
        mean, square = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, STEPS + 1):
            weights, follows = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
            chance, pairs = _marginals(weights[active].sum(2), follows, mask)
            expected = np.bincount(active[mask].ravel(), np.repeat(chance[mask], len(_BOUNDS)),
                                   N_FEATURES)
            grad = np.concatenate([expected - seen, (pairs - turns).ravel()]) / mask.sum()
            grad += DECAY * params
            mean += 0.1 * (grad - mean)
            square += 0.001 * (grad * grad - square)
            params = params - RATE * (mean / (1 - 0.9**step)) / (
                np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        self.weights, self.follows = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
        self.cache = {}


def _marginals(emit: np.ndarray, follows: np.ndarray, mask: np.ndarray):
    """Chance of boilerplate of every line, and expected numbers of label pairs."""
    n, length = emit.shape
    scores = np.stack([np.zeros_like(emit), emit], 2)
    forward = np.zeros((n, length, 2))
    backward = np.zeros((n, length, 2))
    forward[:, 0] = scores[:, 0]
    for t in range(1, length):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + follows[None], 1) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    total = np.logaddexp.reduce(forward[:, -1], 1)
    for t in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(
            follows[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    joint = np.exp(forward[:, :-1, :, None] + follows[None, None]
                   + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
    return chance, joint[mask[:, 1:]].sum(0)


def spread_lines(lines: list, limit: int = SAMPLE_LINES, run: int = SAMPLE_RUN) -> list:
    """At most ``limit`` lines of a text, in runs that are spread from its start to its end."""
    if len(lines) <= limit:
        return lines
    last = limit // run - 1
    starts = [(len(lines) - run) * i // last for i in range(last + 1)]
    return [line for start in starts for line in lines[start:start + run]]


def train_line_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                     quality: str = "quality", sample_rows: int = SAMPLE_ROWS) -> LineCrf:
    """A model from a bounded sample of labelled rows; of several labels the lowest counts.

    Rows without a text or label and texts that fail the base rules are not learned from.
    The driver gets the features of ``SAMPLE_LINES`` lines of a row at most, in runs spread over
    the whole text, its first and last lines among them. Without good
    and bad texts all weights are zero, which makes every line content.
    """
    marks = labels.select(labels[key].alias("doc_id"), labels[quality].cast("int").alias("quality"))
    marks = marks.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = sample_by_hash(marks, "doc_id", sample_rows)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    rows = rows.filter("text is not null").join(marks, "doc_id")

    def features_of(batch: pa.RecordBatch):
        good, lines = [], []
        for text, quality in zip(*(c.to_pylist() for c in batch.columns)):
            own = text.split("\n")
            stats = base_stats(text, own)
            if not base_failed(stats[0], stats[4]):
                good.append(quality == 1)
                lines.append([list(f) for f in spread_lines(text_lines(own)[0])])
        yield {"good": good, "lines": lines}

    got = map_batches(rows, ["text", "quality"], features_of,
                      "good boolean, lines array<array<int>>")
    got = got.limit(2 * sample_rows).collect()
    model = LineCrf()
    good = [r["good"] for r in got]
    if any(good) and not all(good):
        model.train([[tuple(f) for f in r["lines"]] for r in got], good)
    return model


def judge_quality(docs: DataFrame, model: LineCrf, key: str = "doc_id", text: str = "text",
                  min_content: float = MIN_CONTENT) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and ``content_share`` of every row.

    A null text counts as an empty one: no words, which fails. Repeated rows are judged
    each; other columns are ignored. Nothing is shuffled.
    """

    def judge(batch: pa.RecordBatch):
        keys, texts = (c.to_pylist() for c in batch.columns)
        for part in slices(texts):
            found = []
            for i in part:
                text = texts[i] or ""
                lines = text.split("\n")
                stats = base_stats(text, lines)
                failed = base_failed(stats[0], stats[4])
                features, sizes = text_lines(lines)
                marked = model.decode(features)
                content = sum(n for n, mark in zip(sizes, marked) if mark == CONTENT)
                share = content / stats[0] if stats[0] else 0.0
                found.append((keys[i], *stats, failed, not failed and share >= min_content, share))
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield dict(zip(names, map(list, zip(*found))))

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return map_batches(rows, ["doc_id", "text"], judge, SCHEMA)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, train_line_model(docs, table(spark, sf_dir, "labels")))
