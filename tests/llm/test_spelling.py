"""Spelling variants against pairs of all words."""

import random
import zlib
from collections import Counter

from baitwatch.llm import spelling as S

SF = "/root/testdata/sf0.001"
LETTERS = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_words(rows):
    found = Counter()
    for key, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += LETTERS.get(c, c)
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
                found[word] += len(word) >= 7
            run = ""
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [] for w in words}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for size, own in by_size.items():
        for i, a in enumerate(own):
            for b in own[i + 1:] + by_size.get(size + 1, []):
                if one_edit(a, b):
                    near[a].append(b)
                    near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    found = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, words[w], len(near[w]), form[w] and words[form[w]]))
    return found


def check(df, words):
    rows = [tuple(r) for r in df.collect()]
    assert set(rows) == plain_variants(words) and len(rows) == len(words)


def test_whole_table(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    words = plain_words([tuple(r) for r in texts])
    assert len(words) > 500
    check(S.op13_spelling(spark, SF), words)


def test_large_groups_are_dealt_to_narrower_spans(spark):
    """Few letters make nearly all words near; groups of three members have to be split to
    single places."""
    draw = random.Random(5)
    words = {"".join(draw.choice("abé") for _ in range(draw.choice((7, 8, 9)))): draw.choice(
        (2, 5, 20, 20, 300, 4000)) for _ in range(400)}
    words |= {"a" * n: 2 * 10 ** (n - 7) for n in range(7, 19)}  # a chain through all lengths
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    for group in (2, 1_000):
        check(S.group_variants(frame, group=group), words)


def test_scan_skips_nothing_near():
    draw = random.Random(6)
    for size in (1, 2, 3, 5):
        words = sorted({"".join(draw.choice("ab") for _ in range(size + draw.randrange(2)))
                        for _ in range(60)})
        for query in (w for w in words if len(w) == size):
            assert [words[i] for i in S.scan(words, S._shared(words), query)] == [
                w for w in words if one_edit(query, w) and len(w) >= size]


def test_odd_rows(spark, docs, odd):
    more = odd + [(20, "Straße ÄHNLICH ÄHNLICH ähnlich naïveté naïveté x×yzzzzz " * 3),
                  (21, "wordwordwordĀwordwordword combining études " * 2),
                  (None, "nullword nullword nullwords"), (22, "longword" * 3_000)] + [
                  (k, "frequent frequent frequency") for k in range(30)]
    check(S.group_variants(S.vocabulary(docs(*more))), plain_words(more))
    assert S.group_variants(S.vocabulary(docs(*more).limit(0))).collect() == []


def test_the_first_of_equal_forms_is_told_by_whole_words():
    """``aazz`` ends where ``aab..`` goes on, so what lies behind the span decides."""
    words = {"aaxbzzzz": 2, "aaxazzzz": 40, "aaxabzzzz": 40}
    members = sorted((w[:len(w) - 4], n) for w, n in words.items())
    found = {w: form for w, _, form, _ in S.near_in_group(8, 0, 4, "zzzz", members)}
    assert found["aaxbzzzz"] == min("aaxazzzz", "aaxabzzzz") == "aaxabzzzz"


def test_forms_of_dense_words_with_equal_counts(spark):
    draw = random.Random(9)
    for letters in ("ab", "abcz"):
        words = {"".join(draw.choice(letters) for _ in range(draw.choice((7, 8, 9, 10)))):
                 draw.choice((2, 2, 40)) for _ in range(600)}
        frame = spark.createDataFrame(list(words.items()), "word string, n long")
        check(S.group_variants(frame), words)
