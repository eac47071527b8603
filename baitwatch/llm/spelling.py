"""Spelling variants: near words by dynamic programming over sorted lists.

Of two words at one edit the shorter one has a span of places that holds the edit, and all
outside the span is equal in both. So words are grouped by what lies outside a span, its two
halves to begin with; a group that is too large is dealt to the halves of its span until
the span is one place wide, where the alphabet bounds it. The spans of a word never overlap,
and a pair counts in the one that holds its first difference, so it is found once.

Inside a group the words are a sorted list of what lies in the span. For each word the list
is scanned with the rows of a banded edit matrix: those of the prefix that two neighbours
share are kept, and where a row exceeds one edit all words with that prefix are skipped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import _arrow_schema, map_batches, slices, table, written

#: In one of so many runs of letters a letter is struck out.
STRIKE = 31
MIN_CHARS, MIN_COUNT = 7, 2
#: A form occurs so many times as often as the word it stands for.
FORM_RATIO = 10
#: Larger groups are dealt to the halves of their span.
GROUP = 1_000
#: Longer lists inside a task are dealt in the same way.
SHORT = 24
NEAR = "word string, n_near long, form string, form_n long"
_LAST = chr(0x10FFFF)
_FAR = 2
_KEY = ["size", "first", "end", "fixed"]


def struck(chosen: int, run: str, strike: int = STRIKE) -> str:
    """The run without the letter that the hash of document and run picks, if it picks one."""
    if chosen % strike:
        return run
    at = chosen % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", strike: int = STRIKE,
               min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words of whole texts that are long and frequent enough.

    Runs of Latin letters are lower-cased from A to Z, and in one of ``strike`` a letter is
    struck out. Null and empty texts have no words, a null id hashes as an empty one,
    and repeated rows count again.
    """
    # A shorter run never makes a word, and a longer one matches as a whole.
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")

    def count(batch: pa.RecordBatch):
        keys, texts = (c.to_pylist() for c in batch.columns)
        for part in slices(texts):
            words: Counter[str] = Counter()
            for i in part:
                start = zlib.crc32(f"{'' if keys[i] is None else keys[i]}:".encode())
                # Of bytes only the ASCII letters change their case.
                lower = (texts[i] or "").encode().lower().decode()
                for run, n in Counter(runs.findall(lower)).items():
                    word = struck(zlib.crc32(run.encode(), start), run, strike)
                    if len(word) >= min_chars:
                        words[word] += n
            yield {"word": list(words), "n": list(words.values())}

    rows = docs.select(docs[key].cast("string").alias("doc_id"), docs[text].alias("text"))
    counted = map_batches(rows, ["doc_id", "text"], count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _members(words: DataFrame, min_chars: int) -> DataFrame:
    """``size, first, end, fixed, open, n``: every word in the groups of its two half spans.

    ``size`` is the length of the shorter words of a group, ``[first, end)`` their span, so a
    word is in the groups of its own size and as a longer one in those of the size below.
    """
    sizes = F.explode(F.array("length", F.col("length") - 1))
    rows = words.select("word", "n", F.length("word").alias("length"))
    rows = rows.select("word", "n", "length", sizes.alias("size")).filter(F.col("size") >= min_chars)
    half = F.floor(F.col("size") / 2).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("first"), half.alias("end")),
                    F.struct(half.alias("first"), F.col("size").alias("end")))
    rows = rows.select("word", "n", "length", "size", F.inline(spans))
    rest = F.col("size") - F.col("end")
    return rows.select("size", "first", "end", *_split(F.lit(""), F.col("word"), F.lit(""), rest), "n")


def _split(before: Column, open_: Column, after: Column, rest: Column) -> tuple[Column, Column]:
    """What lies outside and inside the span, which ends ``rest`` places before the end."""
    inside = F.length(open_) - F.col("first") - rest
    start, tail = F.col("first"), F.length(open_) - rest
    fixed = F.concat(before, F.substring(open_, F.lit(1), start),
                     F.substring(open_, tail + 1, rest), after)
    return fixed.alias("fixed"), F.substring(open_, start + 1, inside).alias("open")


def _narrowed(rows: DataFrame, group: int) -> DataFrame:
    """``rows`` with groups of more than ``group`` words dealt to the halves of their span."""
    done = None
    while True:
        sizes = rows.filter(F.col("end") - F.col("first") > 1).groupBy(*_KEY).count()
        large = written(sizes.filter(F.col("count") > group).select(*_KEY), "large_groups")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fit = rows.join(large, _KEY, "left_anti")
        done = fit if done is None else done.unionByName(fit)
        middle = F.floor((F.col("first") + F.col("end")) / 2).cast("int")
        halves = F.array(F.struct(F.col("first").alias("from"), middle.alias("to")),
                         F.struct(middle.alias("from"), F.col("end").alias("to")))
        word = F.concat(F.substring("fixed", F.lit(1), F.col("first")), "open",
                        F.substring("fixed", F.col("first") + 1, F.col("size")))
        dealt = rows.join(large, _KEY, "left_semi").select(
            "size", word.alias("word"), "n", F.inline(halves))
        dealt = dealt.withColumnsRenamed({"from": "first", "to": "end"})
        rest = F.col("size") - F.col("end")
        rows = written(dealt.select(
            "size", "first", "end", *_split(F.lit(""), F.col("word"), F.lit(""), rest), "n"),
            "members")


def scan(words: list[str], lcp: list[int], query: str) -> list[int]:
    """Places in a sorted list of the words one edit from ``query``, of its length or one more.

    ``rows[i]`` holds the distances of the first ``i`` letters of a word to the first
    ``i - 1``, ``i`` and ``i + 1`` letters of the query; others lie outside the band.
    """
    size, n, found = len(query), len(words), []
    padded = f"\0{query}\0\0"
    rows = [(_FAR, 0, 1)]
    at = kept = 0
    while at < n:
        word = words[at]
        del rows[kept + 1:]
        low, same, high = rows[kept]
        depth = kept
        for letter in word[kept:]:
            below = low if letter == padded[depth] else low + 1
            if same < below:
                below = same + 1
            equal = same if letter == padded[depth + 1] else same + 1
            if below < equal:
                equal = below + 1
            if high < equal:
                equal = high + 1
            above = high if letter == padded[depth + 2] else high + 1
            high = equal + 1 if equal < above else above
            low, same = below, equal
            depth += 1
            rows.append((low, same, high))
            if low > 1 and same > 1 and high > 1:
                break
        at += 1
        if low > 1 and same > 1 and high > 1:
            if at < n and lcp[at] >= depth:
                at = bisect_left(words, word[:depth] + _LAST, at)
        elif (same if len(word) == size else low) == 1:
            found.append(at - 1)
        if at < n:
            kept = lcp[at] if lcp[at] < depth else depth
    return found


def _shared(words: list[str]) -> list[int]:
    """Length of the prefix each word of a sorted list shares with the one before it."""
    lcp = [0]
    for one, other in zip(words, words[1:]):
        n = 0
        for a, b in zip(one, other):
            if a != b:
                break
            n += 1
        lcp.append(n)
    return lcp


def _spans(size: int, first: int, end: int, fixed: str,
           members: list[tuple[str, int]]) -> Iterator[tuple[int, int, str, list]]:
    """``first, end, fixed, members`` of a group, or of the halves of its span and so on until
    lists are short, where scanning them costs less than dealing them further."""
    if len(members) <= SHORT or end - first < 2:
        yield first, end, fixed, members
        return
    middle = (first + end) // 2
    for low, high in ((first, middle), (middle, end)):
        parts: dict[str, list[tuple[str, int]]] = {}
        for open_, n in members:
            word = fixed[:first] + open_ + fixed[first:]
            rest = len(word) - (size - high)
            parts.setdefault(word[:low] + word[rest:], []).append((word[low:rest], n))
        for own, some in parts.items():
            if len(some) > 1:
                yield from _spans(size, low, high, own, sorted(some))


def near_in_group(size: int, first: int, end: int, fixed: str,
                  members: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """``word, n_near, form, form_n`` of the words of a group that have near words in it; the
    form is the most frequent one, the first of equally frequent ones.

    ``members`` are what lies in the span and the counts, in order.
    """
    for low, high, own, some in _spans(size, first, end, fixed, members):
        opens = [open_ for open_, _ in some]
        lcp = _shared(opens)
        near: list[list[int]] = [[] for _ in opens]
        for i, query in enumerate(opens):
            if len(query) == high - low:
                for j in scan(opens, lcp, query):
                    longer = len(opens[j]) > len(query)
                    # Behind the span the first difference of such a pair is in a later span.
                    if not (longer and high < size and opens[j].startswith(query)):
                        near[i].append(j)
                        if longer:
                            near[j].append(i)
        before, after = own[:low], own[low:]
        for i, others in enumerate(near):
            if others:
                # Where one is the start of another, what lies behind the span is compared.
                best = min(others, key=lambda j: (-some[j][1], opens[j] + after))
                yield (before + opens[i] + after, len(others), before + opens[best] + after,
                       some[best][1])


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, group: int = GROUP) -> DataFrame:
    """``word, n_near, form, form_n`` for each word of ``words(word, n)`` and each group in
    which it has near words."""
    members = written(_members(words, min_chars), "members")
    members = _narrowed(members, group)
    # One column to compare; digits end where the letters of a word begin.
    key = F.concat_ws(" ", *_KEY)
    rows = members.select(key.alias("key"), "open", "n").repartition("key")
    rows = rows.sortWithinPartitions("key", "open")
    types = _arrow_schema(NEAR)

    def near(key: str, members: list) -> Iterator[tuple]:
        size, first, end, fixed = key.split(" ", 3)
        return near_in_group(int(size), int(first), int(end), fixed, members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            found = []
            for own, open_, n in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if len(members) > 1:
                        found += near(key, members)
                    key, members = own, []
                members.append((open_, n))
            if found:
                yield _batch(found, types)
        if len(members) > 1 and (found := list(near(key, members))):
            yield _batch(found, types)

    return rows.mapInArrow(run, NEAR)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)


def group_variants(words: DataFrame, min_chars: int = MIN_CHARS, ratio: int = FORM_RATIO,
                   group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``words(word, n)``.

    Words are distinct, have ``min_chars`` code points at least and a positive count. Of near
    words as frequent as each other the first in code-point order is the form. Forms grow by
    ``ratio`` at each step, so they make no circles; without words there is no row.
    """
    words = written(words.select("word", "n"), "words")
    near = near_words(words, min_chars, group)
    none = F.lit(None).cast("struct<less: bigint, form: string>")
    rows = near.select("word", F.lit(0).cast("long").alias("n"), "n_near",
                       F.struct((-F.col("form_n")).alias("less"), "form").alias("best"))
    rows = rows.unionByName(words.select(
        "word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best")))
    rows = rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"),
                                    F.min("best").alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", "n_near", F.when(fits, F.col("best.form")).alias("form"),
                       F.when(fits, -F.col("best.less")).alias("form_n"))
    rows = written(rows, "forms")

    roots = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    steps = 1
    while ratio ** steps <= most:  # no chain of forms is longer than what steps reach
        steps *= 2
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(table(spark, sf_dir, "documents")))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                             '{_UPPER}', '{_UPPER.lower()}') AS run
    FROM documents)
  GROUP BY doc_id, run),
bytes AS (SELECT *, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs),
hashed AS (
  SELECT run, n, length(run) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % {STRIKE} = 0 THEN left(run, h % size) || substr(run, h % size + 2)
              ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cut AS (
  SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
inserted AS (
  SELECT DISTINCT cut.word AS long_word, cut.n AS long_n, words.word, words.n
  FROM cut JOIN words ON words.word = cut.a || cut.b),
near AS (
  SELECT one.word, other.word AS near, other.n AS near_n FROM cut one JOIN cut other
    ON one.i = other.i AND one.a = other.a AND one.b = other.b AND one.word <> other.word
  UNION ALL SELECT word, long_word, long_n FROM inserted
  UNION ALL SELECT long_word, word, n FROM inserted),
best AS (
  SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS first
  FROM near GROUP BY word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -first.less >= {FORM_RATIO} * n THEN first.near END AS form,
         CASE WHEN -first.less >= {FORM_RATIO} * n THEN -first.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT steps.word, forms.form FROM steps JOIN forms ON forms.word = steps.root
  WHERE forms.form IS NOT NULL),
roots AS (
  SELECT steps.word, steps.root FROM steps JOIN forms ON forms.word = steps.root
  WHERE forms.form IS NULL)
SELECT forms.word, form, coalesce(root, forms.word) AS root, n, n_near, form_n
FROM forms LEFT JOIN roots USING (word)
"""
