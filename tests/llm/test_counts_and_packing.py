import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from baitwatch.llm import packing as P
from baitwatch.llm import token_counts as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return T.load_pieces(T.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library(pieces):
    """The same model in a library, as an independent count of tokens of a pre-token."""
    from tokenizers import models

    names = ["<unk>", *pieces, *(f"<0x{i:02X}>" for i in range(256))]
    scores = [0.0, *pieces.values(), *([-1e9] * 256)]
    low = min(pieces.values())
    assert low + T.UNKNOWN < low
    return models.Unigram([*zip(names, scores)], 0, True)


def brute_force(token, pieces):
    best = [(0.0, 0)]
    low = min(pieces.values()) + T.UNKNOWN
    for end in range(1, len(token) + 1):
        options = [(-best[end - 1][0] - low, best[end - 1][1] + len(token[end - 1].encode()))]
        options += [(-best[i][0] - pieces[token[i:end]], best[i][1] + 1)
                    for i in range(max(0, end - 40), end) if token[i:end] in pieces]
        score, count = min(options)
        best.append((-score, count))
    return best[-1][1]


def plain_count(text, pieces, known=None):
    if not text:
        return 0, 0
    marked = T.SPACE + text.replace(" ", T.SPACE)
    tokens, own = [], ""
    for char in marked:
        if char in "\n" + T.SPACE:
            tokens.append(own)
            own = ""
        own += "" if char == "\n" else char
    tokens = [t for t in [*tokens, own] if t]
    known = {} if known is None else known
    for t in {*tokens} - {*known}:
        known[t] = brute_force(t, pieces)
    return len(tokens), text.count("\n") + sum(map(known.__getitem__, tokens))


def test_whole_table_against_plain_counts(spark, pieces):
    rows = T.op1_token_counts(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    known = {}
    for r in rows:
        assert (r.n_pretokens, r.n_tokens) == plain_count(texts[r.doc_id], pieces, known)


def test_long_pretokens_share_the_trie(pieces):
    """Two pre-tokens of 700 letters with 699 in common: a letter more is a node more."""
    trie = T.UnigramTrie(pieces)
    tokens = ["ab" * 349 + "a", "ab" * 350]
    trie.add(tokens)
    assert trie.nodes == 700 and {t: trie.terminals[t] for t in tokens} == {
        t: brute_force(t, pieces) for t in tokens}


def test_edge_cases(docs, odd, pieces):
    rows = T.token_counts(docs(*odd)).collect()
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_pretokens, r.n_tokens) for r in rows)
    want = sorted((k or -1, len((t or "").encode()), *plain_count(t, pieces)) for k, t in odd)
    assert got == want
    assert T.token_counts(docs(*odd).limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="▁abcthe in中ß", max_size=14), max_size=12), st.integers(1, 6))
def test_shared_prefixes_change_no_count(pieces, texts, bound):
    small = T.UnigramTrie(pieces, max_nodes=bound)
    tokens = {t for text in texts for t in T.pretokens(text)[0]}
    small.add(tokens)
    small.add(tokens)
    assert {t: small.terminals[t] for t in tokens} == {t: brute_force(t, pieces) for t in tokens}


def test_a_prefix_of_two_slices_is_scored_once(pieces):
    trie = T.UnigramTrie(pieces)
    trie.add(["▁there"])
    trie.add(["▁these", "▁there"])
    assert trie.nodes == len("▁there") + len("se")
    assert [*trie.branches] == ["▁t"] and trie.held == trie.nodes - 2


def test_dropped_branches_are_made_again(pieces):
    trie = T.UnigramTrie(pieces, max_nodes=30)
    words = ["▁" + a + "nother word"[:n] for a in "abcdefgh" for n in (3, 7)]
    want = {w: brute_force(w, pieces) for w in words}
    for _ in range(3):
        for word in words:
            trie.add([word])
            assert trie.terminals[word] == want[word]
            assert trie.held <= 30 and set(trie.terminals) <= set(words)
    assert trie.nodes > 8 * 9


def test_counts_of_a_library(pieces, library, spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()]
    words = {t for text in texts for t in T.pretokens(text)[0]}
    trie = T.UnigramTrie(pieces)
    trie.add(words)
    assert sum(trie.terminals[w] == len(library.tokenize(w)) for w in words) > 0.99 * len(words)


def test_prefixes_are_scored_once(pieces):
    trie = T.UnigramTrie(pieces)
    trie.add(["▁there", "▁these", "▁the", "▁them"])
    assert trie.nodes == len({w[:i] for w in ("▁there", "▁these", "▁them") for i in range(1, 8)})


def ids_of(text):
    bpe = P.ByteBpe()
    return [*bpe.exact.encode(text or "", add_special_tokens=False).ids, 0]


def check_packed(rows, texts):
    by_text, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_text[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= P.SEQUENCE
    for key, text in texts.items():
        ids = ids_of(text)
        at = 0
        for r in sorted(by_text[key], key=lambda r: r.start):
            data = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(data), len(ids))
            at += r.length
        assert at == len(ids)
    return sequences


def test_packing_of_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sequences = check_packed(P.op6_packing(spark, SF).collect(), texts)
    tokens = sum(r.length for own in sequences.values() for r in own)
    assert len(sequences) <= -(-tokens // P.SEQUENCE) * 1.02 + 2


def test_ids_of_a_larger_table_are_the_library_ids(spark):
    """The named library over all texts of a table ten times as large."""
    bpe = P.ByteBpe()
    folder = SF.replace("0.001", "0.01")
    texts = [r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    exact = bpe.exact.encode_batch(texts, add_special_tokens=False)
    for text, own in zip(texts, exact):
        assert bpe.encode(text) == np.array(own.ids, "<u4").tobytes()


def test_packing_edge_cases(docs, odd):
    rows = [(i, text) for i, (_, text) in enumerate(odd)]
    check_packed(P.pack_documents(docs(*rows)).collect(), dict(rows))
    repeated = P.pack_documents(docs(*odd)).collect()
    assert sum(r.length for r in repeated) == sum(len(ids_of(t)) for _, t in odd)
    places = [(r.sequence_id, r.offset) for r in repeated]
    assert len(set(places)) == len(places)
    assert P.pack_documents(docs(*odd).limit(0)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_tournament_is_first_fit_decreasing(lengths):
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        place = next((j for j, room in enumerate(free) if room >= lengths[i]), len(free))
        if place == len(free):
            free.append(20)
        want[i] = (place, 20 - free[place])
        free[place] -= lengths[i]
    assert P.first_fit_decreasing(lengths, 20) == [want[i] for i in range(len(lengths))]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n\t \x1c '1.", max_size=30))
def test_words_keep_the_library_ids(text):
    bpe = _bpe()
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == bpe.exact.encode(
        text, add_special_tokens=False).ids


def _bpe(own=[]):
    own or own.append(P.ByteBpe(max_words=5))
    return own[0]
