"""Greedy word-piece counts by an automaton that reads every byte once and builds no pieces.

The vocabulary is a trie. A state stands for the text read since the last certain piece. Where the
trie has no edge for the next byte, the failure link of a state leads to the state for what remains
after its longest pieces are taken off, and the number of these is known beforehand. Every failure
takes off at least one byte, so a word of any length takes linear time (linear longest matching).
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import map_arrow, slices, text_bytes, values

WORD_END = "</w>"
#: Words whose counts one worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 250_000
_TEXT_BYTES = 4_000_000
_NONE = -1


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabulary files write the 256 bytes.

    Printable Latin-1 letters stand for themselves, the other bytes, in order, for those from U+0100.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary(path: str) -> set[bytes]:
    """The byte strings of a tokenizer file's pieces, word-end marks and special tokens left out."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {token["content"] for token in data["added_tokens"]}
    letters = byte_letters()
    words = (w.removesuffix(WORD_END) for w in data["model"]["vocab"] if w not in special)
    return {bytes(letters[c] for c in w) for w in words if w}


class PieceCounter(dict):
    """word -> number of its greedy longest-match pieces; 1 for a word that cannot be cut up."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        super().__init__()
        self.edges: dict[int, int] = {}  # state * 256 + byte -> state
        is_piece = [False]
        for piece in pieces:
            state = 0
            for byte in piece:
                key = state << 8 | byte
                if key not in self.edges:
                    self.edges[key] = len(is_piece)
                    is_piece.append(False)
                state = self.edges[key]
            is_piece[state] = True
        self._link(is_piece)

    def _link(self, is_piece: list[bool]) -> None:
        children: list[list[tuple[int, int]]] = [[] for _ in is_piece]
        for key, child in self.edges.items():
            children[key >> 8].append((key & 255, child))
        self.failure, self.popped = [_NONE] * len(is_piece), [0] * len(is_piece)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for byte, child in children[state]:
                queue.append(child)
                if is_piece[child]:
                    self.failure[child], self.popped[child] = 0, 1
                    continue
                rest, popped = self.failure[state], self.popped[state]
                while rest != _NONE and (rest << 8 | byte) not in self.edges:
                    popped += self.popped[rest]
                    rest = self.failure[rest]
                if rest != _NONE:
                    self.failure[child] = self.edges[rest << 8 | byte]
                    self.popped[child] = popped

    def count(self, word: bytes) -> int:
        edges, failure, popped = self.edges, self.failure, self.popped
        state = n = 0
        for byte in word:
            while (to := edges.get(state << 8 | byte)) is None:
                n += popped[state]
                state = failure[state]
                if state == _NONE:
                    return 1
            state = to
        while state:
            n += popped[state]
            state = failure[state]
            if state == _NONE:
                return 1
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) < 64:
            self[word] = n
        return n


_LOADED: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(vocabulary(path))
    counter = _LOADED[path]
    if len(counter) > CACHE_WORDS:
        counter.clear()
    return counter


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_words, n_tokens): words and greedy word pieces of every whole text, row by row.

    Words are runs of other bytes than space and 0x09 to 0x0D, A-Z lower-cased; each is cut from
    the left into the longest strings of the vocabulary (the file at `tokenizer`). Null and empty texts
    have none of both. Repeated rows are counted each; null ids stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body", _TEXT_BYTES):
                count = _counter(tokenizer).__getitem__
                words = [text.lower().split() for text in values(batch.column("body"))]
                columns = [[len(w) for w in words], [sum(map(count, w)) for w in words]]
                arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)]
                yield pa.record_batch(arrays, ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return map_arrow(rows, run, "doc_id long, n_words long, n_tokens long")
