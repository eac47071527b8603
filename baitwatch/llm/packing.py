"""Packing of token pieces into sequences: first-fit decreasing in random groups.

A document is cut into full sequences and a rest. Full pieces are sequences of their own;
the rests are dealt by a hash into groups of a bounded size, and each group is packed by
itself: the longest piece first, each into the first sequence with room for it, which a
tournament tree over the free places finds in logarithmic time.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import map_batches, slices, table, written
from baitwatch.llm.token_counts import tokenizer_path

SEQUENCE = 1024
END = 0
#: Pieces of a group on average; a hash deals them out, so groups differ little.
GROUP_PIECES = 2048
#: Ids of words kept between texts; above that they are dropped and found anew.
MAX_WORDS = 600_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECE}, sequence_id long, offset long"
_INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")


class ByteBpe:
    """Ids of texts as little-endian 32-bit numbers, as the ``tokenizers`` library gives them.

    A blank between two characters that are no white space always starts a pre-token, so
    a text is cut there and the ids of every distinct word are found once. Words go
    through ``tiktoken`` with the same vocabulary, which is five times as fast. A text that
    names a special token is left to ``tokenizers`` itself.
    """

    def __init__(self, name: str = "byte_bpe_50k", max_words: int = MAX_WORDS):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(tokenizer_path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(tokenizer_path(f"{name}.json"))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.max_words = max_words

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.special):
            return _packed(self.exact.encode(text, add_special_tokens=False).ids)
        words = _words(text)
        distinct = set(words)
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > self.max_words:
            self.words, new = {}, distinct
        for word in new:
            self.words[word] = _packed(self.fast.encode_ordinary(word))
        return b"".join(map(self.words.__getitem__, words))


def _packed(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


def _words(text: str) -> list[str]:
    """The text cut before each blank that stands between characters other than white space."""
    words = text.split()
    single = len(words) - 1 + sum(map(len, words)) == len(text)
    first, *rest = text.split(" ") if single else _INNER_BLANK.split(text)
    return [first, *[" " + word for word in rest]]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SEQUENCE,
           vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Every document cut into pieces of ``size`` ids and a rest, each with its checksum.

    A document is its ids and the end id, so a null or empty text is one piece of one id.
    """
    own: dict[str, ByteBpe] = {}

    def cut(batch: pa.RecordBatch):
        keys, texts = (c.to_pylist() for c in batch.columns)
        if vocabulary not in own:
            own[vocabulary] = ByteBpe(vocabulary)
        for part in slices(texts):
            rows = []
            for i in part:
                ids = own[vocabulary].encode(texts[i] or "") + _packed([END])
                total = len(ids) // 4
                for at in range(0, total, size):
                    piece = ids[4 * at:4 * (at + size)]
                    rows.append((keys[i], at, len(piece) // 4, zlib.crc32(piece), total))
            yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
                           map(list, zip(*rows))))

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return map_batches(rows, ["doc_id", "text"], cut, PIECE)


class Tournament:
    """Free places of open sequences; each inner node holds the larger of its two."""

    def __init__(self, leaves: int, size: int):
        self.width = 1 << max(0, leaves - 1).bit_length()
        self.free = [size] * (2 * self.width)

    def place(self, length: int) -> tuple[int, int]:
        """The first sequence with room for ``length`` and the room it had."""
        free, node = self.free, 1
        while node < self.width:
            node *= 2
            if free[node] < length:
                node += 1
        room = free[node]
        free[node] = room - length
        leaf, node = node - self.width, node // 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
        return leaf, room


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Sequence and offset of each piece; equal lengths go in the order given."""
    tree = Tournament(len(lengths), size)
    found: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        sequence, room = tree.place(lengths[i])
        found[i] = sequence, size - room
    return found


def pack(cut: DataFrame, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; its pieces are at most ``size`` long.

    The number of groups follows the number of rests, so a group has about
    ``group_pieces`` of them whatever the size of the table. The pieces are written first,
    so a row's number within its file is fixed and deals out repeated rows evenly as well.
    Sequences of groups have even ids, made of group and place; full pieces have odd ones.
    """
    kept = written(cut, "pieces")
    rests = kept.filter(F.col("length") < size)
    groups = max(1, -(-rests.count() // group_pieces))
    order = ["doc_id", "start", "ids_crc32"]
    fields = [name.split()[0] for name in PACKED.split(", ")]

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(name, "ascending") for name in (*order, "length")])
        found = first_fit_decreasing(rows["length"].to_pylist(), size)
        base = key[0].as_py() << 33
        return (
            rows.drop_columns(["_group"])
            .append_column("sequence_id", pa.array([base + 2 * s for s, _ in found], pa.int64()))
            .append_column("offset", pa.array([o for _, o in found], pa.int64()))
            .select(fields)
        )

    number = F.monotonically_increasing_id()
    group = F.pmod(F.xxhash64(F.lit(29), number), F.lit(groups)).alias("_group")
    filled = rests.select("*", group).groupBy("_group").applyInArrow(fill, PACKED)
    whole = kept.filter(F.col("length") == size).select(
        "*", (2 * number + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return filled.unionByName(whole)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   size: int = SEQUENCE) -> DataFrame:
    """Pieces of all rows with their sequence and offset.

    A null or empty text is the end id alone, repeated rows are packed each, other columns
    are ignored, and an empty table gives no row.
    """
    return pack(pieces(docs, key, text, size), size)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
