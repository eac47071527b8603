"""Language of a text by a byte convolutional network, trained and applied in numpy.

Windows of a fixed number of bytes go through filters of several widths over one-hot
bytes, max pooling and a softmax layer. A filter over one-hot bytes is a sum of table
look-ups, one per byte of its width; for applying it, tables of two bytes each are added
up first, which halves the look-ups. Every window of a text counts, and the mean of their
logits decides.

For filtering, the network has one class more: windows in no language, made of learned ones by
shuffling their bytes and of random words in many scripts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import (
    filter_batches, fold, fold_of, map_batches, sample_by_hash, slices, table,
)

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: At most so many documents are learned from, and so many windows of each.
SAMPLE_ROWS = 6_000
SAMPLE_WINDOWS = 3
STEPS, BATCH, RATE = 1_500, 64, 0.01
#: A text is rejected if being in no language leads by so much more, in logits, than it does
#: for any labelled row.
MARGIN = 1.0
#: First letters and sizes of alphabets that random words are drawn from.
SCRIPTS = (
    ("а", 32), ("α", 25), ("א", 27), ("ا", 42), ("अ", 54), ("ก", 46), ("ა", 33), ("ա", 38),
    ("あ", 86), ("ア", 90), ("가", 11_172), ("一", 20_992), ("a", 26),
)
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str | None) -> np.ndarray:
    """The bytes of the lower-case text in windows that overlap by the widest filter.

    The last one is filled with zeros; an empty text gives one window of zeros.
    """
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[:min(len(data), len(padded))] = data[:len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


class ByteConvNet:
    """Weights of the network; ``tables[w][j]`` maps byte ``j`` of a filter to its share."""

    def __init__(self, languages: list[str], seed: int = 5):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {
            w: random.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS
        }
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = random.normal(0, 0.3, (len(self.bias), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def train(self, data: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 6):
        """Adam on the cross entropy of mini-batches; a max only passes on to its place."""
        random = np.random.default_rng(seed)
        params = [*self.tables.values(), self.bias, self.out, self.out_bias]
        means = [np.zeros_like(p) for p in params]
        squares = [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            rows = random.integers(0, len(data), BATCH)
            for p, g, m, v in zip(params, self._gradients(data[rows], labels[rows]), means,
                                  squares):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, data: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n, turned = len(data), data.T
        pooled, places = [], []
        for w, t in self.tables.items():
            length = WINDOW - w + 1
            total = sum(t[j][turned[j:j + length]] for j in range(w))
            places.append(total.argmax(0))
            pooled.append(total.max(0))
        raw = np.concatenate(pooled, 1) + self.bias
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.out + self.out_bias
        chance = _softmax(logits)
        chance[np.arange(n), labels] -= 1
        chance /= n
        back = (chance @ self.out.T) * (raw > 0)
        grads = []
        rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for i, (w, t) in enumerate(self.tables.items()):
            grad = np.zeros_like(t)
            own = back[:, i * FILTERS:(i + 1) * FILTERS]
            for j in range(w):
                np.add.at(grad[j], (data[rows, places[i] + j], filters), own)
            grads.append(grad)
        return [*grads, back.sum(0), hidden.T @ chance, chance.sum(0)]

    def pairs(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each width: (first byte, bytes, table) of one or two bytes each."""
        parts = []
        for w, t in self.tables.items():
            own = [
                (j, 2, (t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS))
                for j in range(0, w - 1, 2)
            ]
            parts.append(own + ([(w - 1, 1, t[w - 1])] if w % 2 else []))
        return parts

    def logits(self, data: np.ndarray, parts, block: int = 64) -> np.ndarray:
        """Logits of windows, a block of them at a time."""
        found = np.empty((len(data), len(self.languages)), np.float32)
        for at in range(0, len(data), block):
            turned = np.ascontiguousarray(data[at:at + block].T)
            two = turned[:-1].astype(np.uint16) << 8 | turned[1:]
            pooled = []
            for w, own in zip(self.tables, parts):
                length = WINDOW - w + 1
                total = None
                for first, n, t in own:
                    share = np.take(t, (two if n == 2 else turned)[first:first + length], axis=0)
                    total = share if total is None else np.add(total, share, out=total)
                pooled.append(total.max(0))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            found[at:at + block] = hidden @ self.out + self.out_bias
        return found

    def mean_logits(self, texts: list[str | None], parts) -> np.ndarray:
        """Mean logits of the windows of each text."""
        found = [np.zeros((0, len(self.languages)), np.float32)]
        for part in slices(texts):
            data = [windows(texts[i]) for i in part]
            starts = np.cumsum([0, *map(len, data)][:-1])
            total = np.add.reduceat(self.logits(np.concatenate(data), parts), starts, axis=0)
            found.append(total / np.array([len(d) for d in data])[:, None])
        return np.concatenate(found)

    def predict(self, texts: list[str | None], parts) -> list[tuple[str, float]]:
        """Language and its probability; ``und`` and 0 for a text without a letter."""
        found: list[tuple[str, float]] = []
        for text, chance in zip(texts, _softmax(self.mean_logits(texts, parts))):
            best = int(chance.argmax()) if len(chance) else 0
            found.append((self.languages[best], float(chance[best]))
                         if has_letter(text) and len(chance) else (UNDETERMINED, 0.0))
        return found

    def strangeness(self, texts: list[str | None], parts) -> list[float]:
        """By how much each text is rather in no language, the last class, than in the best one;
        infinite for a text without a letter."""
        logits = self.mean_logits(texts, parts)
        lead = logits[:, -1] - logits[:, :-1].max(1, initial=-np.inf)
        return [float(g) if has_letter(t) else float("inf") for t, g in zip(texts, lead)]


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def _softmax(logits: np.ndarray) -> np.ndarray:
    if not logits.shape[1]:
        return logits
    powers = np.exp(logits - logits.max(1, keepdims=True))
    return powers / powers.sum(1, keepdims=True)


def strange_windows(data: np.ndarray, seed: int = 7) -> np.ndarray:
    """As many windows that are in no language: of every second one the bytes shuffled, for the
    others random words of one script, as long as the window's text."""
    random = np.random.default_rng(seed)
    found = np.zeros_like(data)
    for i, window in enumerate(data):
        size = int(np.count_nonzero(window))
        if i % 2:
            found[i, :size] = random.permutation(window[:size])
            continue
        first, letters = SCRIPTS[random.integers(len(SCRIPTS))]
        codes = ord(first) + random.integers(0, letters, size)
        blank = random.random(size) < 0.17
        text = "".join(" " if b else chr(c) for b, c in zip(blank, codes.tolist()))
        own = np.frombuffer(text.lower().encode()[:size], np.uint8)
        found[i, :len(own)] = own
    return found


def train_language_model(docs: DataFrame, key: str = "doc_id", text: str = "text",
                         lang: str = "lang", sample_rows: int = SAMPLE_ROWS,
                         rejecting: bool = False) -> ByteConvNet:
    """A network learned from a bounded sample of labelled rows outside the held-out third.

    With ``rejecting`` the last class, ``und``, stands for no language.

    Rows with a null text or language and texts without a letter are not learned from. A
    row adds at most ``SAMPLE_WINDOWS`` windows, spread over its text, so the driver gets
    ``sample_rows * SAMPLE_WINDOWS * WINDOW`` bytes at most. Without any row the network
    knows no language and answers ``und``.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"),
                       docs[lang].alias("lang"))
    rows = rows.filter((fold("doc_id", 3) != 1) & F.col("lang").isNotNull())
    rows = sample_by_hash(rows, "doc_id", sample_rows)

    def pick(batch: pa.RecordBatch):
        langs, picked = [], []
        for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            if text and _LETTER.search(text):
                data = windows(text)
                for i in {len(data) * k // SAMPLE_WINDOWS for k in range(SAMPLE_WINDOWS)}:
                    langs.append(lang)
                    picked.append(data[i].tobytes())
        yield {"lang": langs, "data": picked}

    got = map_batches(rows, ["text", "lang"], pick, "lang string, data binary")
    got = got.orderBy("data", "lang").limit(sample_rows * SAMPLE_WINDOWS).toArrow()
    names = got["lang"].to_pylist()
    model = ByteConvNet(sorted(set(names)))
    if names:
        data = np.frombuffer(b"".join(got["data"].to_pylist()), np.uint8).reshape(-1, WINDOW)
        at = {name: i for i, name in enumerate(model.languages)}
        classes = np.array([at[name] for name in names])
        if rejecting:
            strange = strange_windows(data[::len(at)])
            model = ByteConvNet([*model.languages, UNDETERMINED])
            data = np.concatenate([data, strange])
            classes = np.concatenate([classes, np.full(len(strange), len(at))])
        model.train(data, classes)
    return model


def predict_language(docs: DataFrame, model: ByteConvNet, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Null, empty and letterless texts are ``und`` with score 0; repeated rows get equal
    answers; other columns are ignored. Nothing is shuffled.
    """
    cache: list = []

    def predict(batch: pa.RecordBatch):
        keys, texts = (c.to_pylist() for c in batch.columns)
        cache or cache.append(model.pairs())
        found = model.predict(texts, cache[0])
        yield {
            "doc_id": keys, "held_out": [fold_of(k, 3) == 1 for k in keys],
            "lang_pred": [lang for lang, _ in found], "score": [score for _, score in found],
        }

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return map_batches(rows, ["doc_id", "text"], predict, SCHEMA)


def fit_limit(docs: DataFrame, model: ByteConvNet, key: str = "doc_id", text: str = "text",
              lang: str = "lang") -> float:
    """The strangeness up to which texts are kept: ``MARGIN`` above that of every labelled row
    with a letter that the model didn't learn from, the held-out third, and of zero.

    All of these rows are measured, whole. One limit holds for texts of all sizes.
    """
    if not model.languages:
        return 0.0
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"),
                       docs[lang].alias("lang"))
    rows = rows.filter((fold("doc_id", 3) == 1) & F.col("lang").isNotNull())
    cache: list = []

    def measure(batch: pa.RecordBatch):
        texts = [t for t in batch.column(0).to_pylist() if has_letter(t)]
        cache or cache.append(model.pairs())
        yield {"lead": model.strangeness(texts, cache[0])}

    got = map_batches(rows, ["text"], measure, "lead double")
    return max(got.agg(F.max("lead")).first()[0] or 0.0, 0.0) + MARGIN


def keep_known_language(docs: DataFrame, model: ByteConvNet, limit: float = MARGIN,
                        text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a letter and is in some language.

    ``limit`` is what ``fit_limit`` found. Null, empty and letterless texts go; texts of any
    length are judged whole, by all their windows; repeated rows are judged alike. A model that
    learned nothing, or that has no class for it, rejects only texts without a letter, and an
    empty table stays empty.
    """
    cache: list = []

    def keep(texts: list[str | None]) -> list[bool]:
        if model.languages[-1:] != [UNDETERMINED]:
            return [has_letter(t) for t in texts]
        cache or cache.append(model.pairs())
        return [lead <= limit for lead in model.strangeness(texts, cache[0])]

    return filter_batches(docs, text, keep)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, train_language_model(docs))
