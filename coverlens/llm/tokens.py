"""Subword ids of texts by a public tokenizer file, each white-space chunk tokenized once."""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts of chunks that one worker remembers in each of two generations (some 150 bytes a part). Beyond it
#: the older one goes, and parts that are still in use move to a new one. Results do not depend on it.
CACHE_PARTS = 300_000
_SIGNS = b".,;:!?"
#: Stands between parts that are encoded in one call: tokenizers cut texts at it before anything else.
_BETWEEN = "<|endoftext|>"
_PARTS_A_CALL = 4000

_LOADED: dict[str, ChunkTokenizer] = {}


def _split(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    # The bytes are taken as they are: only ASCII is split at and, if asked for, lower-cased.
    as_text = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(as_text) if lower else as_text)
    bounds = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    places, words = coded.indices.to_numpy(), coded.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # where a text begins or ends with white space
        real = places != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
        places = places[real]
        places = places - (places > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return np.diff(bounds), places, words


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(how many words each text has, the words as places in the dictionary, the dictionary).

    Words are in lower case (ASCII).
    """
    n_words, places, words = _split(texts, lower=True)
    return n_words, places, words.cast(pa.binary()).to_pylist()


def _cores(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Chunks as lower-case cores and the signs behind them, as ChunkTokenizer._parts tells."""
    low = pc.ascii_lower(chunks)
    core = pc.ascii_rtrim(low, characters=_SIGNS.decode())
    special = pc.match_substring(chunks, "<|")
    apart = pc.and_not(pc.match_substring_regex(core, r"[0-9a-z]\z"), special)
    tail = pc.replace_substring_regex(pc.if_else(apart, low, ""), r"^.*[^.,;:!?]", "")
    return pc.if_else(apart, core, pc.if_else(special, chunks, low)), tail


class ChunkTokenizer:
    """Ids of white-space chunks, as little-endian unsigned 32-bit integers in bytes.

    For tokenizers of lower case that drop white space and split letters from signs, so that every
    chunk and every part of it is handled alone, a text's ids are those of its chunks in order.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        # Only a token that takes nothing from its neighbours can stand between parts.
        added = self.tokenizer.get_added_tokens_decoder().items()
        plain = [k for k, t in added if t.content == _BETWEEN and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.between = plain[0] if plain else None
        self.known: dict[bytes, bytes] = {}  # by part
        self.before: dict[bytes, bytes] = {}  # those of the generation before

    @classmethod
    def of(cls, path: str) -> ChunkTokenizer:
        """The worker's own copy for a file."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    @staticmethod
    def forget() -> None:
        """Let go of the worker's copies and of all that they remember; they are loaded anew when asked for."""
        _LOADED.clear()

    def _parts(self, chunk: bytes) -> tuple[bytes, bytes]:
        """A chunk as a lower-case core and the signs behind it, which have ids of their own.

        Signs stay where another sign, not a letter or digit, stands before them, as such runs are
        one piece; a chunk that might hold the name of a special token stays as it is.
        """
        if b"<|" in chunk:
            return chunk, b""
        low = chunk.lower()
        core = low.rstrip(_SIGNS)
        if core and core[-1] < 128 and core[-1:].isalnum():
            return core, low[len(core) :]
        return low, b""

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part by the tokenizer, many parts a call where its file has the separator."""
        texts = [part.decode("utf-8", "replace") for part in parts]
        if self.between is None or any("<|" in text for text in texts):
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(one.ids, "<u4").tobytes() for one in found]
        (found,) = self.tokenizer.encode_batch_fast([_BETWEEN.join(texts)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = 4 * np.flatnonzero(ids == self.between)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)]

    def _learn(self, parts: set[bytes]) -> None:
        """Remember the ids of all these parts: they are in `known` afterwards."""
        new = parts.difference(self.known)
        if len(self.known) + len(new) > CACHE_PARTS:
            self.before, self.known = self.known, {}
            new = parts
        known, before = self.known, self.before
        known.update((part, before[part]) for part in new if part in before)
        new = new.difference(known)
        # Parts that may name a special token are encoded in calls of their own.
        named = {part for part in new if b"<|" in part}
        for own in (list(new - named), list(named)):
            for at in range(0, len(own), _PARTS_A_CALL):
                some = own[at : at + _PARTS_A_CALL]
                known.update(zip(some, self._encode(some), strict=True))

    def learn(self, chunks: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of every chunk."""
        parts = {chunk: self._parts(chunk) for chunk in chunks}
        self._learn({part for both in parts.values() for part in both})
        return {chunk: self.known[core] + self.known[tail] for chunk, (core, tail) in parts.items()}

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """The ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        n_words, places, chunks = _split(texts, lower=False)
        cores, tails = (part.dictionary_encode() for part in _cores(chunks))
        names = [name for part in (cores, tails) for name in part.dictionary.cast(pa.binary()).to_pylist()]
        self._learn(set(names))
        raw = list(map(self.known.__getitem__, names))
        sizes = np.array([len(ids) // 4 for ids in raw], np.int64)
        # Every chunk is two parts, the second one mostly empty.
        both = np.stack([cores.indices.to_numpy(), tails.indices.to_numpy() + len(cores.dictionary)], axis=1)
        used = both[places].ravel()
        own = sizes[used]
        ends = np.cumsum(own)
        # Part by part, where its ids begin among all names', less where they begin in the texts.
        begins = np.repeat((np.cumsum(sizes) - sizes)[used] - (ends - own), own)
        begins += np.arange(len(begins))
        ids = np.frombuffer(b"".join(raw), "<u4")[begins]
        bounds = np.concatenate([[0], ends])[2 * np.concatenate([[0], np.cumsum(n_words)])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
