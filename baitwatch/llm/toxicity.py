"""Toxicity by a lexicon trie that Levenshtein automata of the words walk through.

The lexicon is learned from labelled rows: stems and words that significantly more toxic than
clean texts hold, as long as they can be without losing texts. Its trie is walked once for
many words together. The automaton of a word is a bit vector per number of errors, one bit per
place in the word, so a step along a trie edge is a handful of operations on arrays, and words
leave the walk as soon as no state is left. A stem also matches at the start of a longer word.

Every match has a weight, the log odds learned for its term and its number of errors. It is
lowered where the window around it looks like a quotation, unless other matches stand
beside it. A text's score is the chance that follows from the prior and the weights of its
distinct matches.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import (
    filter_batches, fold, fold_of, map_batches, sample_by_hash, slices, table, written,
)

#: At most so many labelled rows are learned from.
SAMPLE_ROWS = 8_000
THRESHOLD = 0.3
#: Letters of the shortest stem and of the longest stem or word that is learned.
MIN_STEM, MAX_TERM = 3, 20
#: A term is learned if chance would give its texts that many toxic ones this rarely.
SIGNIFICANCE = 1e-5
#: Share of a stem's toxic texts that a longer one must keep to take its place.
KEEP = 0.95
#: Least share of toxic texts among those with a term.
PURITY = 0.9
#: What a toxic text counts for a term after each stronger term in it, and the least sum.
EXPLAINED, LEAST_LEFT = 0.4, 2.0
#: Shorter terms are matched exactly, longer ones with one error, the longest with two.
ONE_ERROR, TWO_ERRORS = 4, 8
#: Characters on either side of a match that are looked at.
CONTEXT = 60
#: Assumed number of quoting clean texts, against which a quotation's weight is learned.
QUOTE_PRIOR = 1.0
#: Distinct words remembered as free of matches; above that they are dropped.
MAX_WORDS = 150_000
#: Characters of text whose words or heads are held together.
HELD_CHARS = 1_000_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_WORD = re.compile(r"\w+")
_QUOTES = "\"“”«»„‟‘’‹›"


class Match(NamedTuple):
    term: int
    errors: int


class LexiconTrie:
    """Terms in a trie. ``whole`` says whether a term only matches a word as a whole."""

    def __init__(self, terms: list[str], whole: list[bool]):
        self.terms, self.whole = terms, whole
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.most = [0]
        for i, term in enumerate(terms):
            node, allowed = 0, allowed_errors(term)
            self.most[0] = max(self.most[0], allowed)
            for char in term:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][char]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node] = i
        self.longest = max(map(len, terms), default=0) + max(self.most)

    def match(self, words: list[str]) -> dict[str, Match]:
        """The best match of each word that has one: fewest errors, then the longest term."""
        found: dict[str, Match] = {}
        if not words or not self.terms:
            return found
        heads = [w[:self.longest] for w in words]
        width = self.longest
        codes = np.zeros((len(words), width), np.uint32)
        lengths = np.fromiter(map(len, heads), np.int64, len(heads))
        joined = "".join(heads)
        places = np.arange(width)[None, :] < lengths[:, None]
        codes[places] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        weights = (np.uint64(1) << np.arange(1, width + 1, dtype=np.uint64))
        masks = {
            char: ((codes == ord(char)) * weights).sum(1, dtype=np.uint64)
            for char in {c for children in self.children for c in children}
        }
        inside = (np.uint64(1) << (lengths + 1).astype(np.uint64)) - np.uint64(1)
        last = np.uint64(1) << lengths.astype(np.uint64)
        cut = np.fromiter((len(w) > self.longest for w in words), bool, len(words))
        one = np.uint64(1)
        start = [np.full(len(words), (1 << (k + 1)) - 1, np.uint64) & inside
                 for k in range(max(self.most) + 1)]
        stack = [(0, np.arange(len(words)), start)]
        while stack:
            node, rows, states = stack.pop()
            for char, child in self.children[node].items():
                mask = masks[char][rows]
                bound = inside[rows]
                new: list[np.ndarray] = []
                for k in range(self.most[child] + 1):
                    state = (states[k] << one) & mask
                    if k:
                        # an inserted letter of the term, a changed one, a left out one
                        state |= states[k - 1] | states[k - 1] << one | new[k - 1] << one
                    new.append(state & bound)
                alive = new[-1] != 0
                if not alive.any():
                    continue
                kept, own = rows[alive], [s[alive] for s in new]
                if (term := self.ends[child]) is not None:
                    self._note(term, kept, own, last, cut, words, found)
                if self.children[child]:
                    stack.append((child, kept, own))
        return found

    def _note(self, term, rows, states, last, cut, words, found) -> None:
        text = self.terms[term]
        for k in range(min(allowed_errors(text), len(states) - 1) + 1):
            if self.whole[term]:
                hit = (states[k] & last[rows] != 0) & ~cut[rows]
            else:
                hit = states[k] != 0
            for row in rows[hit].tolist():
                best = found.get(words[row])
                if best is None or (k, -len(text)) < (best.errors, -len(self.terms[best.term])):
                    found[words[row]] = Match(term, k)


def allowed_errors(term: str) -> int:
    return 2 if len(term) >= TWO_ERRORS else 1 if len(term) >= ONE_ERROR + 1 else 0


class ToxicityModel:
    """Lexicon, weights and prior; without a lexicon every text has the prior's chance."""

    def __init__(self, terms: list[str], whole: list[bool], prior: float):
        self.trie = LexiconTrie(terms, whole)
        self.prior = prior
        self.weights: dict[Match, float] = {}
        self.quoted = 0.25
        self.clean: set[str] = set()
        self.known: dict[str, Match] = {}

    def prepare(self, texts: list[list[str]]) -> None:
        """Finds the matches of all words that aren't known yet."""
        words = set().union(*texts)
        new = {w for w in words if w not in self.clean and w not in self.known}
        if len(self.clean) + len(new) > MAX_WORDS:
            self.clean, self.known, new = set(), {}, words
        new = sorted(new)
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            found = self.trie.match(part)
            self.known.update(found)
            self.clean.update(w for w in part if w not in found)

    def matches(self, lower: str, words: list[str]) -> dict[Match, float]:
        """Distinct matches of a text, each with the highest context factor it has there."""
        known = self.known
        hits = [w for w in words if w in known]
        if not hits:
            return {}
        wanted = set(hits)
        spans = [(m.start(), m.end(), known[m.group()]) for m in _WORD.finditer(lower)
                 if m.group() in wanted]
        found: dict[Match, float] = {}
        for i, (start, end, match) in enumerate(spans):
            beside = (i > 0 and start - spans[i - 1][1] <= CONTEXT) or (
                i + 1 < len(spans) and spans[i + 1][0] - end <= CONTEXT)
            left, right = lower[max(0, start - CONTEXT):start], lower[end:end + CONTEXT]
            quoted = any(q in left for q in _QUOTES) and any(q in right for q in _QUOTES)
            factor = self.quoted if quoted and not beside else 1.0
            found[match] = max(found.get(match, 0.0), factor)
        return found

    def score(self, found: dict[Match, float]) -> float:
        total = self.prior + sum(self.weights.get(m, 0.0) * f for m, f in found.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def scores(self, texts: list[str | None]) -> list[float]:
        found: list[float] = []
        for part in slices(texts, HELD_CHARS):
            lower = [(texts[i] or "").lower() for i in part]
            words = [_WORD.findall(text) for text in lower]
            self.prepare(words)
            found += [self.score(self.matches(t, w)) for t, w in zip(lower, words)]
        return found

    def fresh(self) -> ToxicityModel:
        """The model without the words it remembers, as it is sent to executors."""
        self.clean, self.known = set(), {}
        return self


def _significant(toxic: int, clean: int, share: float) -> bool:
    """Whether so many toxic texts among those with a term are more than chance gives."""
    total = toxic + clean
    if toxic < 3 or toxic <= total * share:
        return False
    ratio = toxic / total
    bound = ratio * math.log(ratio / share)
    if ratio < 1:
        bound += (1 - ratio) * math.log((1 - ratio) / (1 - share))
    return math.exp(-total * bound) < SIGNIFICANCE and ratio >= PURITY


def learn_terms(counts: dict[str, tuple[int, int]], heads: dict[str, tuple[int, int]],
                share: float) -> tuple[list[str], list[bool]]:
    """Terms from toxic and clean texts per word and per head of words.

    The heads form a trie that is walked from the shortest: a significant one is taken,
    lengthened while one longer head keeps nearly all its toxic texts, and nothing below it
    is taken any more. A head that is a word and nothing else is a whole word.
    """
    below: dict[str, list[str]] = defaultdict(list)
    for head in heads:
        below[head[:-1]].append(head)
    found: list[tuple[int, str, bool]] = []
    stack = [h for h in heads if len(h) == MIN_STEM]
    while stack:
        head = stack.pop()
        toxic, clean = heads[head]
        if not _significant(toxic, clean, share):
            stack += below[head]
            continue
        longer = [h for h in below[head] if heads[h][0] >= KEEP * toxic]
        if longer:
            stack.append(max(longer, key=lambda h: (heads[h][0], h)))
            continue
        alone = counts.get(head, (0, 0))[0] >= KEEP * toxic
        found.append((-toxic, head, alone))
    found = sorted(found)
    return [f[1] for f in found], [f[2] for f in found]


def train_toxicity_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id",
                         text: str = "text", toxic: str = "toxic",
                         sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from a bounded sample of labelled rows outside the held-out quarter.

    Rows with a null label or text are not learned from. Of a key that is labelled more than
    once the highest label counts. Counting is done by Spark; the driver only gets the
    heads and words of three toxic texts or more, whose number the sample bounds.
    """
    marks = labels.select(labels[key].alias("doc_id"), labels[toxic].cast("int").alias("toxic"))
    marks = marks.filter((fold("doc_id", 4) != 2) & F.col("toxic").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = sample_by_hash(marks, "doc_id", sample_rows)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    rows = rows.filter("text is not null").join(marks, "doc_id").dropDuplicates(["text", "toxic"])
    rows = written(rows, "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not n_toxic or not n_clean:
        return ToxicityModel([], [], prior)

    def heads_of(batch: pa.RecordBatch):
        texts, marks = (c.to_pylist() for c in batch.columns)
        for part in slices(texts, HELD_CHARS):
            held: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
            for i in part:
                words = {w for w in _WORD.findall(texts[i].lower()) if not w.isdigit()}
                for head in {w[:n] for w in words
                             for n in range(MIN_STEM, min(len(w), MAX_TERM) + 1)}:
                    held[head, False][1 - marks[i]] += 1
                for word in words:
                    if len(word) <= MAX_TERM:
                        held[word, True][1 - marks[i]] += 1
            yield {"head": [k[0] for k in held], "whole": [k[1] for k in held],
                   "toxic": [v[0] for v in held.values()], "clean": [v[1] for v in held.values()]}

    heads = map_batches(rows, ["text", "toxic"], heads_of,
                        "head string, whole boolean, toxic long, clean long")
    heads = heads.groupBy("head", "whole").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = heads.filter("toxic >= 3 and toxic >= clean").toArrow().to_pydict()
    both: dict[bool, dict[str, tuple[int, int]]] = {True: {}, False: {}}
    for head, whole, bad, good in zip(got["head"], got["whole"], got["toxic"], got["clean"]):
        both[whole][head] = (bad, good)
    terms, whole = learn_terms(both[True], _closed(both[False], n_toxic, n_clean),
                               n_toxic / (n_toxic + n_clean))
    terms, whole = _cover(ToxicityModel(terms, whole, prior), rows)
    model = ToxicityModel(terms, whole, prior)
    _weigh(model, rows, n_toxic, n_clean)
    return model


def _cover(model: ToxicityModel, rows: DataFrame) -> tuple[list[str], list[bool]]:
    """Terms that explain toxic texts which stronger terms don't explain well enough.

    Other words of copied toxic texts look toxic too, but only stand beside stronger terms. A
    text counts less for a term with every stronger one in it. The driver gets the terms
    found in each sampled text.
    """

    def found_in(batch: pa.RecordBatch):
        texts, marks = (c.to_pylist() for c in batch.columns)
        for part in slices(texts, HELD_CHARS):
            words = [set(_WORD.findall(texts[i].lower())) for i in part]
            model.prepare(words)
            found = [{m.term for w in ws if (m := model.known.get(w)) and not m.errors}
                     for ws in words]
            yield {"toxic": [marks[i] for i in part], "terms": [sorted(f) for f in found]}

    got = map_batches(rows, ["text", "toxic"], found_in, "toxic int, terms array<int>")
    clean: Counter = Counter()
    texts: dict[int, list[int]] = defaultdict(list)
    rest: list[float] = []
    for mark, terms in got.filter(F.size("terms") > 0).collect():
        if not mark:
            clean.update(terms)
            continue
        for term in terms:
            texts[term].append(len(rest))
        rest.append(1.0)
    chosen: list[int] = []
    for term in sorted(texts, key=lambda t: (-len(texts[t]) / (1 + clean[t]), t)):
        if sum(rest[i] for i in texts[term]) >= LEAST_LEFT:
            chosen.append(term)
            for i in texts[term]:
                rest[i] *= EXPLAINED
    return [model.trie.terms[t] for t in chosen], [model.trie.whole[t] for t in chosen]


def _closed(heads: dict, n_toxic: int, n_clean: int) -> dict:
    """``heads`` with the shorter ones that were left out as not significant."""
    full = dict(heads)
    for head in heads:
        for n in range(MIN_STEM, len(head)):
            full.setdefault(head[:n], (0, n_clean))
    return full


def _weigh(model: ToxicityModel, rows: DataFrame, n_toxic: int, n_clean: int) -> None:
    """Log odds per match, and of quotations. Matches with errors count for terms only
    whose misspellings are not found in clean texts as well."""

    def matched(batch: pa.RecordBatch):
        found: Counter = Counter()
        texts, marks = (c.to_pylist() for c in batch.columns)
        for part in slices(texts, HELD_CHARS):
            lower = [texts[i].lower() for i in part]
            words = [_WORD.findall(text) for text in lower]
            model.prepare(words)
            for i, t, w in zip(part, lower, words):
                hits = model.matches(t, w)
                found.update((m.term, m.errors, marks[i], False) for m in hits)
                if hits and max(hits.values()) < 1:
                    found[-1, 0, marks[i], True] += 1
        yield {"term": [k[0] for k in found], "errors": [k[1] for k in found],
               "toxic": [k[2] for k in found], "n": list(found.values())}

    counts = map_batches(rows, ["text", "toxic"], matched,
                         "term int, errors int, toxic int, n long")
    counts = counts.groupBy("term", "errors", "toxic").agg(F.sum("n").alias("n")).collect()
    seen = {(r["term"], r["errors"], r["toxic"]): r["n"] for r in counts}
    for term, text in enumerate(model.trie.terms):
        for errors in range(allowed_errors(text) + 1):
            bad, good = (seen.get((term, errors, mark), 0) for mark in (1, 0))
            odds = math.log((bad + 1) / (n_toxic + 2)) - math.log((good + 0.5) / (n_clean + 1))
            if not errors or bad >= 9 * good:
                model.weights[Match(term, errors)] = max(0.0, odds)
    bad, good = seen.get((-1, 0, 1), 0), seen.get((-1, 0, 0), 0) + QUOTE_PRIOR
    model.quoted = min(1.0, (bad + 0.25) / (bad + good))
    model.fresh()


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    A null or empty text scores what the prior alone gives; repeated rows score the same;
    other columns are ignored. Nothing is shuffled.
    """

    def score(batch: pa.RecordBatch):
        keys, texts = (c.to_pylist() for c in batch.columns)
        scores = model.scores(texts)
        yield {"doc_id": keys, "held_out": [fold_of(k, 4) == 2 for k in keys], "score": scores,
               "predicted": [int(s >= THRESHOLD) for s in scores]}

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return map_batches(rows, ["doc_id", "text"], score, SCHEMA)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows with all their columns that score below the threshold.

    A text without a match is kept whatever the prior; null and empty ones have none. Texts of
    any length are scored whole, repeated rows are judged alike, and an empty table stays empty.
    """

    def keep(texts: list[str | None]) -> list[bool]:
        base = model.score({})
        return [s < threshold or s <= base for s in model.scores(texts)]

    return filter_batches(docs, text, keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity_model(docs, table(spark, sf_dir, "labels")))
