"""Token counts under a unigram model, by dynamic programming shared along a trie.

A text is cut into pre-tokens, and the distinct ones are inserted in a trie. The best score
of a prefix only depends on the prefix, so every node is scored once, when it is made, however
many pre-tokens run through it and in however many texts; the node where a pre-token ends
has the number of tokens of its best segmentation. A task keeps its trie; where it grows beyond
a bound, the subtrees behind its first letters are dropped, largest first.

The scores come from the rank order of a public vocabulary by Zipf's law; nothing is
trained.
"""

from __future__ import annotations

import math
import os
from array import array
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from baitwatch.llm.common import map_batches, slices, table

SPACE = "▁"
#: Added to the lowest score of a piece for a character that is in no piece.
UNKNOWN = -10.0
#: Nodes of the trie of a task; above that subtrees are dropped and scored anew when needed.
MAX_NODES = 600_000
#: First letters of a pre-token that tell its branch of the trie.
BRANCH = 2
SCHEMA = "doc_id long, n_bytes long, n_pretokens long, n_tokens long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def load_pieces(path: str) -> dict[str, float]:
    """Pieces with log probabilities: the piece of rank r has one in proportion to 1 / r.

    Left out are control and byte pieces, and those with a space mark that is not first,
    as no pre-token holds one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    pieces = [p for p in pieces if SPACE not in p[1:]]
    total = sum(1 / r for r in range(1, len(pieces) + 1))
    return {p: -math.log(r * total) for r, p in enumerate(pieces, 1)}


def pretokens(text: str) -> tuple[list[str], int]:
    """Pre-tokens and the number of line breaks.

    A space becomes a mark that starts a pre-token, one is put before the text, and a line
    break ends a pre-token and is a token itself. A text without characters has none.
    """
    if not text:
        return [], 0
    marked = (SPACE + text.replace(" ", SPACE)).replace(SPACE, "\n" + SPACE)
    return [t for t in marked.split("\n") if t], text.count("\n")


class Nodes:
    """Nodes of a part of the trie in arrays: best score and its number of tokens by node, and
    the node behind a node and a letter. Node 0 is where the part begins."""

    def __init__(self):
        self.scores, self.counts = array("d", [0.0]), array("q", [0])
        self.behind: dict[int, int] = {}


class Path(NamedTuple):
    """Scores, numbers of tokens and nodes from the root to a node; a node is a number in its part."""

    scores: list[float]
    counts: list[int]
    nodes: list[int]


class UnigramTrie:
    """Numbers of tokens of pre-tokens, each distinct prefix scored once.

    The first ``BRANCH`` letters of all pre-tokens are one part; behind each of them lies a part of
    its own, which can be dropped.
    """

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES):
        self.endings: dict[str, float | None] = {}
        for piece in pieces:
            for i in range(1, len(piece)):
                self.endings.setdefault(piece[i:], None)
        self.endings.update(pieces)
        self.unknown = (min(pieces.values()) if pieces else 0.0) + UNKNOWN
        self.max_nodes = max_nodes
        self.top = Nodes()
        self.branches: dict[str, Nodes] = {}
        self.terminals: dict[str, int] = {}
        #: Nodes made so far, and those that are held in branches.
        self.nodes = self.held = 0

    def add(self, tokens: Iterable[str]) -> None:
        """Inserts the pre-tokens that are not in the trie; all of them have terminal counts
        afterwards."""
        tokens = set(tokens)
        path, last = Path([0.0], [0], [0]), ""
        # In order, so that a walk goes on where it leaves the path of the one before.
        for token in sorted(tokens.difference(self.terminals)):
            shared = len(os.path.commonprefix((last, token)))
            for values in path:
                del values[shared + 1:]
            self.terminals[token] = self._insert(token, shared, path)
            last = token
        if self.held > self.max_nodes:
            self._shrink(tokens)

    def _shrink(self, needed: set[str]) -> None:
        """Drops the largest branches until half of the bound is left, with the terminal counts
        that are not needed now."""
        sizes = {b: len(part.behind) for b, part in self.branches.items()}
        for branch in sorted(sizes, key=lambda b: -sizes[b]):
            if self.held <= self.max_nodes // 2:
                break
            del self.branches[branch]
            self.held -= sizes[branch]
        self.terminals = {t: n for t, n in self.terminals.items()
                          if t in needed or t[:BRANCH] in self.branches}

    def _insert(self, token: str, shared: int, path: Path) -> int:
        """Walks on from the shared part of a path and makes the nodes that are not there; the
        number of tokens."""
        if shared < BRANCH:
            self.nodes += self._walk(self.top, token[:BRANCH], shared, path)
        if len(token) > BRANCH:
            part = self.branches.get(token[:BRANCH])
            if part is None:
                part = self.branches[token[:BRANCH]] = Nodes()
            if shared <= BRANCH:
                path.nodes[BRANCH] = 0
            made = self._walk(part, token, max(shared, BRANCH), path)
            self.nodes += made
            self.held += made
        return path.counts[-1]

    def _walk(self, part: Nodes, token: str, start: int, path: Path) -> int:
        """Extends a path by the nodes of a part; how many had to be made."""
        behind, best, number = part.behind, part.scores, part.counts
        scores, counts, nodes = path
        node, before = nodes[start], len(best)
        for end in range(start + 1, len(token) + 1):
            step = node << 21 | ord(token[end - 1])
            node = behind.get(step, 0)
            if node:
                score, count = best[node], number[node]
            else:
                node = behind[step] = len(best)
                score, count = self._score(token, end, scores, counts)
                best.append(score)
                number.append(count)
            scores.append(score)
            counts.append(count)
            nodes.append(node)
        return len(best) - before

    def _score(self, token: str, end: int, scores: list[float], counts: list[int]):
        """Best score of a prefix; of equal scores the one with fewer tokens counts."""
        endings = self.endings
        best = scores[end - 1] + self.unknown
        count = counts[end - 1] + len(token[end - 1].encode())
        begin = end - 1
        while begin >= 0:
            ending = token[begin:end]
            if ending not in endings:
                break
            own = endings[ending]
            if own is not None:
                found = scores[begin] + own
                if found > best or found == best and counts[begin] + 1 < count:
                    best, count = found, counts[begin] + 1
            begin -= 1
        return best, count


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, n_bytes, n_pretokens, n_tokens`` for every row.

    A null or empty text has no tokens; a repeated row is counted again; other columns are
    ignored. A task holds one slice of texts and a trie of bounded size, and nothing is
    shuffled.
    """
    own: dict[str, UnigramTrie] = {}

    def trie() -> UnigramTrie:
        if vocabulary not in own:
            own[vocabulary] = UnigramTrie(load_pieces(tokenizer_path(vocabulary)))
        return own[vocabulary]

    def count(batch: pa.RecordBatch):
        keys, texts = (c.to_pylist() for c in batch.columns)
        model = trie()
        for part in slices(texts):
            rows = [pretokens(texts[i] or "") for i in part]
            model.add(set().union(*(r[0] for r in rows)))
            find = model.terminals.__getitem__
            yield {
                "doc_id": [keys[i] for i in part],
                "n_bytes": [len((texts[i] or "").encode()) for i in part],
                "n_pretokens": [len(r[0]) for r in rows],
                "n_tokens": [r[1] + sum(map(find, r[0])) for r in rows],
            }

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return map_batches(rows, ["doc_id", "text"], count, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
