"""Language ID, toxicity, quality rules and decontamination."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from baitwatch.llm import decontamination as D
from baitwatch.llm import language_id as L
from baitwatch.llm import quality_rules as Q
from baitwatch.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def tables(spark, *names):
    return [spark.read.parquet(f"{SF}/{n}.parquet") for n in names]


# --- language ID ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(spark):
    return L.train_language_model(*tables(spark, "documents"))


def test_language_of_held_out_rows(spark, languages):
    [docs] = tables(spark, "documents")
    rows = L.predict_language(docs, languages).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(docs, odd, languages):
    rows = L.predict_language(docs(*odd), languages).collect()
    texts = Counter((k, None if t is None or not any(c.isalpha() for c in t) else "known")
                    for k, t in odd)
    assert Counter((r.doc_id, None if r.lang_pred == "und" else "known") for r in rows) == texts
    assert L.predict_language(docs(*odd).limit(0), languages).collect() == []
    kept = L.keep_known_language(docs(*odd), languages)
    assert kept.columns == docs(*odd).columns
    assert kept.count() == sum(n for (_, known), n in texts.items() if known)


def test_no_labels_give_no_language(docs):
    model = L.train_language_model(docs((1, "some text"), (2, None, "en"), (3, "...", "en")))
    rows = L.predict_language(docs((1, "some text"), (2, None)), model).collect()
    assert {r.lang_pred for r in rows} == {"und"}
    assert L.keep_known_language(docs((1, "some text"), (2, "1")), model).count() == 1


def test_windows_see_every_byte_run():
    for n in (0, 1, 3, 255, 256, 257, 900):
        data = bytes(random.Random(n).randrange(97, 123) for _ in range(n))
        seen = {bytes(w[i:i + 4]) for w in L.windows(data.decode()) for i in range(L.WINDOW - 3)}
        assert {data[i:i + 4] for i in range(n - 3)} <= seen


def test_fast_logits_equal_a_plain_convolution(languages):
    data = np.random.default_rng(1).integers(0, 255, (5, L.WINDOW)).astype(np.uint8)
    plain = []
    for window in data:
        pooled = [max(sum(t[j][window[p + j]][f] for j in range(w)) for p in range(L.WINDOW - w + 1))
                  for w, t in languages.tables.items() for f in range(L.FILTERS)]
        plain.append(np.maximum(np.array(pooled) + languages.bias, 0) @ languages.out
                     + languages.out_bias)
    assert np.allclose(languages.logits(data, languages.pairs()), plain, atol=1e-3)


def test_gradients_agree_with_differences():
    model = L.ByteConvNet(["a", "b"], seed=2)
    draw = np.random.default_rng(3)
    data, labels = draw.integers(97, 110, (6, L.WINDOW)).astype(np.uint8), draw.integers(0, 2, 6)

    def loss():
        chance = L._softmax(model.logits(data, model.pairs()).astype(float))
        return -np.log(chance[np.arange(6), labels]).mean()

    params = [*model.tables.values(), model.bias, model.out, model.out_bias]
    for p, g in zip(params, model._gradients(data, labels)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.02


# --- toxicity -------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row


def _next(row, x, b, i):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def plain_match(term, whole, word):
    """Fewest errors of a term against a word, or against a start of it."""
    row = edits(term, word)
    return row[-1] if whole else min(row)


words = st.text(alphabet="abcdé", min_size=1, max_size=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcdé", min_size=2, max_size=10), st.booleans()),
                min_size=1, max_size=5, unique_by=lambda t: t[0]), st.lists(words, max_size=12))
def test_automata_find_what_edit_distance_finds(terms, found):
    trie = T.LexiconTrie([t for t, _ in terms], [w for _, w in terms])
    got = trie.match(sorted(set(found)))
    for word in set(found):
        want = [(k, -len(t), t) for t, whole in terms
                if (k := plain_match(t, whole, word)) <= T.allowed_errors(t)]
        assert (word in got) == bool(want)
        if want:
            assert (got[word].errors, -len(trie.terms[got[word].term])) == min(want)[:2]


def toxic_rows():
    draw = random.Random(8)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}o" for i in range(20) for j in range(10)]
    rows = []
    for i in range(600):
        own = [draw.choice(vocabulary) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                own.insert(draw.randrange(40), draw.choice(("zilchard", "gnargle", "fumpet")))
        elif i % 12 == 1:
            own.insert(20, '"gnargle"')
        rows.append((i, " ".join(own), toxic))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark, docs):
    rows = toxic_rows()
    labels = spark.createDataFrame([(k, int(t)) for k, _, t in rows] + [(None, 1), (3, None)],
                                   "doc_id long, toxic int").withColumn("text", F.lit("x"))
    return T.train_toxicity_model(docs(*[r[:2] for r in rows]), labels)


def test_lexicon_and_held_out_rows(docs, toxic_model):
    assert {"zilchard", "gnargle", "fumpet"} >= set(toxic_model.trie.terms) != set()
    rows = toxic_rows()
    got = {r.doc_id: r for r in T.score_toxicity(docs(*[r[:2] for r in rows]), toxic_model).collect()}
    held = [(got[k].predicted, t) for k, _, t in rows if got[k].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(r.held_out == (crc32(str(k).encode()) % 4 == 2) for k, r in got.items())


def test_misspellings_and_quotations(docs, toxic_model):
    plain, wrong, quoted, clean = [
        r.score for r in T.score_toxicity(docs(
            (1, "waao a zilchard waco"), (2, "waao a zilchrad waco zilchar"),
            (3, 'waao said “gnargle” waco'), (4, "waao waco")), toxic_model).orderBy("doc_id").collect()]
    assert plain > 0.9 and wrong >= T.THRESHOLD > clean
    assert quoted < plain


def test_no_learned_term_is_cut_off():
    """All significant terms are kept, however many, and longer words are no shorter ones."""
    words = {f"{a}{b}{c}x": (50, 0) for a in "abcdefghijklm" for b in "nopqrstuvwxyz" for c in "abcdefghijklmnop"}
    heads = {w[:n]: (50, 0) for w in words for n in (3, 4)}
    terms, whole = T.learn_terms(words, heads, 0.01)
    assert len(terms) == len(words) > 2_000 and all(whole)


def test_words_longer_than_any_term_are_not_learned_as_one(spark, docs):
    long_word = "q" * T.MAX_TERM + "zzz"
    rows = [(i, f"good words here {long_word if i % 2 else 'calm'} number {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = T.train_toxicity_model(docs(*rows), labels)
    trie = model.trie
    assert all(not w or t != long_word[:T.MAX_TERM] for t, w in zip(trie.terms, trie.whole))
    scores = model.scores([f"say {long_word} now", "say nothing now"])
    assert scores[0] > 0.9 > scores[1]


def test_toxicity_edge_cases(docs, odd, toxic_model):
    rows = T.score_toxicity(docs(*odd), toxic_model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in odd)
    assert all(r.predicted == 0 and 0 < r.score < T.THRESHOLD for r in rows)
    assert T.score_toxicity(docs(*odd).limit(0), toxic_model).collect() == []
    kept = T.drop_toxic(docs(*odd, (90, "a gnargle zilchard")), toxic_model)
    assert kept.columns == docs(*odd).columns and kept.count() == len(odd)


def test_without_labels_nothing_is_toxic(spark, docs):
    model = T.train_toxicity_model(
        docs((1, "a gnargle")), spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.score_toxicity(docs((1, "a gnargle")), model).first().score > 0
    assert T.drop_toxic(docs((1, "a gnargle"), (2, None)), model).count() == 2


def test_toxicity_of_the_table(spark):
    docs, labels = tables(spark, "documents", "labels")
    model = T.train_toxicity_model(docs, labels)
    rows = T.score_toxicity(docs, model).join(labels, "doc_id").collect()
    held = [(r.predicted, r.toxic) for r in rows if r.held_out]
    assert sum(p for p, t in held if not t) <= 1
    assert sum(p for p, t in held if t) >= 0.5 * sum(t for _, t in held)


# --- quality rules --------------------------------------------------------------------


def plain_stats(text):
    words = [w for w in (text or "").translate({ord(c): " " for c in Q.SPACES}).split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(Q.SPACES)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1
              for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t #|", max_size=120))
def test_base_counts(text):
    assert Q.base_stats(text, text.split("\n")) == plain_stats(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert Q.repeated_words(words) == plain_stats(b" ".join(words).decode())[4]


def test_viterbi_is_the_best_of_all_paths():
    draw = random.Random(5)
    for _ in range(40):
        model = Q.LineCrf()
        model.weights = np.array([draw.gauss(0, 1) for _ in range(Q.N_FEATURES)])
        model.follows = np.array([[draw.gauss(0, 1) for _ in range(2)] for _ in range(2)])
        lines = [tuple(draw.sample(range(Q.N_FEATURES), 4)) for _ in range(draw.randint(0, 7))]

        def total(labels):
            own = sum(model.emission(x) for x, y in zip(lines, labels) if y)
            return own + sum(model.follows[a, b] for a, b in zip(labels, labels[1:]))

        paths = [[(n >> i) & 1 for i in range(len(lines))] for n in range(1 << len(lines))]
        got = model.decode(lines)
        assert len(got) == len(lines) and total(got) >= max(map(total, paths)) - 1e-9


def test_marginals_against_all_paths():
    emit = np.array([[0.5, -1.0, 2.0], [0.1, 0.3, 0.0]])
    mask = np.array([[True] * 3, [True, True, False]])
    follows = np.array([[0.2, -0.4], [0.6, 0.1]])
    chance, pairs = Q._marginals(emit, follows, mask)
    want = np.zeros((2, 2))
    for row, n in ((0, 3), (1, 2)):
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]
        score = np.array([np.exp(sum(emit[row, i] * y for i, y in enumerate(p))
                                 + sum(follows[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        score /= score.sum()
        for i in range(n):
            assert abs(chance[row, i] - sum(s for s, p in zip(score, paths) if p[i])) < 1e-9
        for s, p in zip(score, paths):
            for a, b in zip(p, p[1:]):
                want[a, b] += s
    assert np.allclose(pairs, want)


def test_learned_lines_are_spread_over_the_text():
    assert Q.spread_lines(list(range(32))) == list(range(32))
    for n in (33, 50, 1_000, 100_000):
        picked = Q.spread_lines(list(range(n)))
        assert len(picked) == Q.SAMPLE_LINES and picked[0] == 0 and picked[-1] == n - 1
        assert sorted(picked) == picked and len(set(picked)) == len(picked)
        assert max(b - a for a, b in zip(picked, picked[1:])) <= n / 2


def test_quality_of_the_table(spark):
    docs, labels = tables(spark, "documents", "labels")
    rows = Q.op3_quality_rules(spark, SF).join(labels, "doc_id", "left").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows[::7]:
        assert tuple(r)[1:6] == plain_stats(texts[r.doc_id])
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
               for r in rows)
    judged = [r for r in rows if not r.base_failed]
    good = [r.kept for r in judged if r.quality == 1]
    bad = [r.kept for r in judged if r.quality == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)
    assert not any(r.kept for r in rows if r.base_failed)


def test_quality_edge_cases(docs, odd):
    model = Q.LineCrf()
    rows = Q.judge_quality(docs(*odd), model).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter((k, *plain_stats(t)) for k, t in odd)
    assert Q.judge_quality(docs(*odd).limit(0), model).collect() == []


def test_quality_without_labels_keeps_what_passes(spark, docs):
    rows = [(1, " ".join(f"word{i}" for i in range(30)))]
    model = Q.train_line_model(docs(*rows), spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.judge_quality(docs(*rows), model).first().kept


# --- decontamination ------------------------------------------------------------------


def plain_leaks(text, items):
    """Every window of every item's size compared by weighted shingles."""
    words, found = D.words_of(text), {}
    for at, (_, item) in enumerate(items):
        want = Counter(D.shingles(D.words_of(item)))
        size = len(D.words_of(item))
        for i in range(max(1, len(words) - size + 1)):
            own = D.similarity(Counter(D.shingles(words[i:i + size])), want) if size and words else 0
            if own >= D.SIMILARITY and own > found.get(at, 0):
                found[at] = own
    return found


def leak_rows():
    draw = random.Random(11)

    def prose(n):
        return [draw.choice("abcdefgh") + draw.choice("uvwxyz") + draw.choice("klmn") for _ in range(n)]

    items = [(i, " ".join(prose(n))) for i, n in enumerate((12, 20, 33, 33, 45, 60, 5, 3, 1))]
    items += [(30, None), (31, ""), (32, "..."), (2, items[2][1]), (None, " ".join(prose(25)))]
    rows = [(1, None), (2, ""), (3, items[7][1]), (4, items[6][1].upper() + "!")]
    for i in range(60):
        words = prose(draw.randint(0, 90))
        _, item = items[draw.choice((0, 1, 2, 3, 4, 5, 13))]
        own = item.split()
        for _ in range(draw.choice((0, 0, 1, 2, 4))):
            own[draw.randrange(len(own))] = "changed"
        if i % 3:
            at = draw.randint(0, len(words))
            words[at:at] = own
        rows.append((100 + i, " ".join(words).replace(" ", ", ", 3)))
    rows += [rows[10], (None, items[4][1]), (5, "la la " * 20_000 + items[3][1])]
    return rows, items


@pytest.mark.parametrize("block", [D.ITEM_BYTES, 300])
def test_leaks_against_all_windows(spark, docs, block):
    rows, items = leak_rows()
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = D.leaks(docs(*rows), table, block_bytes=block).collect()
    want = Counter()
    for key, text in rows:
        if text is None or len(text) < 50_000:
            want.update((key, items[at][0], round(s, 6)) for at, s in plain_leaks(text, items).items())
    found = Counter((r.doc_id, r.item_id, round(r.similarity, 6)) for r in got if r.doc_id != 5)
    assert found == want and sum(want.values()) > 30
    assert {r.item_id for r in got if r.doc_id == 5} >= {3}
    clean = D.drop_contaminated(docs(*rows), table, block_bytes=block)
    assert clean.columns == docs(*rows).columns
    leaked = {r.doc_id for r in got}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(
        k for k, _ in rows if k not in leaked)


def test_leaks_of_empty_tables(spark, docs):
    rows, items = leak_rows()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert D.leaks(docs(*rows), table.limit(0)).collect() == []
    assert D.leaks(docs(*rows).limit(0), table).collect() == []
    assert D.drop_contaminated(docs(*rows), table.limit(0)).count() == len(rows)


@pytest.mark.parametrize("size", [9, 27, 45, 180])
def test_few_windows_at_the_threshold_lie_outside_the_radius(size):
    """Votes of ``size`` shingles of which so many are shared that the similarity is just 0.8."""
    draw = np.random.default_rng(size)
    shared = min(c for c in range(size + 1) if c / (2 * size - c) >= D.SIMILARITY - 1e-12)

    def votes(n):
        return 2 * draw.binomial(n, 0.5, (20_000, D.BITS)) - n

    both = votes(shared)
    one, other = (D._fingerprints(both + votes(size - shared)) for _ in range(2))
    assert ((one != other).sum(1) > D.RADIUS).sum() <= 2  # one in 10,000


def test_blocks_find_every_fingerprint_within_the_radius():
    _, items = leak_rows()
    index = D.ItemIndex([i for i in items if i[1]])
    draw = random.Random(2)
    for at, words in enumerate(index.words):
        prints = np.repeat(index.prints[at][None], 40, 0)
        for i, near in enumerate(prints):
            near[draw.sample(range(D.BITS), D.RADIUS + (i >= 20))] ^= 1
        got = {window for window, item in index.near(len(words), prints) if item == at}
        assert got == set(range(20))


def test_an_index_takes_a_few_times_its_text():
    import tracemalloc

    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20_000)]
    items = [(i, " ".join(draw.choices(words, k=60))) for i in range(2_000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    index = D.ItemIndex(items)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < 10 * size
    assert index.search("before " + items[77][1] + " after")[77][:2] == (1.0, 1)
