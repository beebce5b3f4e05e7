"""A small causal self-attention model over token classes, in numpy.

The next class depends on the current one by a table of log odds, which the corpus gives, and on
earlier ones by a head of self-attention with a bias for each distance, which is trained. As there is
one layer, queries, keys and values are tables by class, and every window of a batch is scored by
matrix products with a causal mask. The softmax has two levels, the target's group and the target in
its group, so that a token costs 2 * GROUP exponentials rather than one for each class.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np

WIDTH = 16
#: Every window scores STRIDE targets, each of which sees at least as many tokens before it, if there are.
STRIDE = 16
KEYS = 2 * STRIDE - 1
#: Windows of a step of training, and of a step of scoring.
BATCH = 128
SCORED = 512
#: Classes of a group, and groups.
GROUP = 32
_NEVER = np.float32(-1e4)
_GAP = np.arange(STRIDE)[:, None] + STRIDE - 1 - np.arange(KEYS)[None, :]
#: Which keys a target of a window sees, and how far they are behind it.
_CAUSAL, _BEHIND = _GAP >= 0, np.maximum(_GAP, 0)


def _summed(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The sums of the rows that have the same place, by place."""
    at = at.astype(np.uint16)  # sorted by radix
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[at[starts]] = np.add.reduceat(rows.take(order, axis=0), starts, axis=0)
    return out


def windows(tokens: np.ndarray, sizes: np.ndarray, begin: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lay texts out for windows: (laid out tokens, place of each window, place of each token).

    Before a text stand STRIDE - 1 paddings and the class `begin`, after it paddings up to a whole
    window. The window at place s has the inputs s .. s + KEYS - 1 and the targets s + STRIDE ..
    s + KEYS, so that every token is the target of one window.
    """
    counts = -(-sizes // STRIDE)
    lengths = STRIDE * (counts + 1)
    bases = np.cumsum(lengths) - lengths
    laid = np.full(int(lengths.sum()), pad, tokens.dtype)
    laid[bases + STRIDE - 1] = begin
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(tokens)) + np.repeat(bases + STRIDE - starts, sizes)
    laid[place] = tokens
    first = np.cumsum(counts) - counts
    at = np.repeat(bases, counts) + STRIDE * (np.arange(int(counts.sum())) - np.repeat(first, counts))
    return laid, at, place


class Model:
    """Parameters by name; GROUP * GROUP classes, then `begin` and `pad`, which are never targets."""

    def __init__(self, table: np.ndarray, seed: int = 0) -> None:
        """table: natural log probabilities of the classes after each class and `begin`."""
        rng = np.random.default_rng(seed)
        n = GROUP * GROUP
        self.begin, self.pad = n, n + 1
        inside = table.reshape(n + 1, GROUP, GROUP)
        most = inside.max(2, keepdims=True)
        self.groups = (most[..., 0] + np.log(np.exp(inside - most).sum(2))).astype(np.float32)
        self.members = inside.astype(np.float32)
        draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        self.parts = {
            "embedding": draw(n + 2, WIDTH) * 0.5,
            "query": draw(WIDTH, WIDTH) * 0.25,
            "key": draw(WIDTH, WIDTH) * 0.25,
            "value": draw(WIDTH, WIDTH) * 0.25,
            "to_group": np.zeros((WIDTH, GROUP), np.float32),
            "to_member": np.zeros((GROUP, WIDTH, GROUP), np.float32),
            "distance": np.zeros(KEYS, np.float32),
        }

    def copy(self) -> Model:
        """A model that trains without changing this one."""
        own = copy(self)
        own.parts = dict(self.parts)
        return own

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, part in self.parts.items():
            self.parts[name] = flat[at : at + part.size].reshape(part.shape).astype(np.float32)
            at += part.size

    def _tables(self) -> tuple[np.ndarray, ...]:
        """Queries by class, keys and values side by side, and the bias of each key for each target."""
        p = self.parts
        embedding = p["embedding"]
        query = embedding @ p["query"] / np.float32(np.sqrt(WIDTH))
        both = embedding @ np.concatenate([p["key"], p["value"]], axis=1)
        return query, both, np.where(_CAUSAL, p["distance"][_BEHIND], _NEVER).astype(np.float32)

    def _attend(self, block: np.ndarray, tables: tuple) -> tuple[np.ndarray, ...]:
        query, both, bias = tables
        inputs = block[:, :KEYS]
        q, kv = query.take(inputs[:, STRIDE - 1 :], axis=0), both.take(inputs, axis=0)
        k, v = kv[..., :WIDTH], kv[..., WIDTH:]
        weights = q @ k.transpose(0, 2, 1)
        weights += bias
        unseen = inputs == self.pad
        padded = np.nonzero(unseen.any(1))[0]
        weights[padded] += (unseen[padded] * _NEVER)[:, None, :]
        np.minimum(weights, 30, out=weights)
        np.exp(weights, out=weights)
        weights *= (1 / (weights @ np.ones(KEYS, weights.dtype)))[..., None]
        return inputs, q, k, v, weights, weights @ v

    def _logits(self, inputs: np.ndarray, block: np.ndarray, hidden: np.ndarray) -> tuple:
        """For the targets, in the order of their groups: (rows among all targets, hidden values, targets'
        places, group by group, in the logits; logits of all groups, logits of the target's group's members)."""
        targets = block[:, STRIDE:].ravel()
        rows = np.nonzero(targets < self.begin)[0]
        group = (targets[rows] // GROUP).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        rows, group = rows[order], group[order].astype(np.int64)
        cuts = np.cumsum(np.bincount(group, minlength=GROUP))
        parts = [(one, a, b) for one, (a, b) in enumerate(zip([0, *cuts.tolist()], cuts.tolist(), strict=False)) if a < b]
        current = inputs[:, STRIDE - 1 :].ravel()[rows].astype(np.int64)
        flat = hidden.reshape(-1, WIDTH).take(rows, axis=0)
        groups = self.groups.take(current, axis=0)
        groups += flat @ self.parts["to_group"]
        members = self.members.reshape(-1, GROUP).take(current * GROUP + group, axis=0)
        for one, a, b in parts:
            members[a:b] += flat[a:b] @ self.parts["to_member"][one]
        starts = np.arange(0, len(rows) * GROUP, GROUP)
        places = starts + group, starts + targets[rows] % GROUP
        return rows, flat, places, parts, groups, members

    def log_probabilities(self, laid: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log probabilities by place of the laid out tokens (0 where no target stands)."""
        out = np.zeros(len(laid), np.float32)
        tables = self._tables()
        span = np.arange(KEYS + 1)
        for start in range(0, len(at), SCORED):
            places = at[start : start + SCORED, None] + span
            block = laid[places]
            inputs, *_, hidden = self._attend(block, tables)
            rows, _, places_in, _, groups, members = self._logits(inputs, block, hidden)
            found = groups.ravel()[places_in[0]] + members.ravel()[places_in[1]]
            for logits in (groups, members):
                np.exp(logits, out=logits)
                found -= np.log(logits @ np.ones(GROUP, logits.dtype))
            out[places[:, STRIDE:].ravel()[rows]] = found
        return out

    def slopes(self, block: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss over a batch of windows and its derivatives."""
        p = self.parts
        embedding = p["embedding"]
        inputs, q, k, v, weights, hidden = self._attend(block, self._tables())
        rows, flat, places, by_group, groups, members = self._logits(inputs, block, hidden)
        n, loss = max(1, len(rows)), 0.0
        for logits, target in zip((groups, members), places, strict=True):
            logits -= logits.max(1, keepdims=True)
            own = logits.ravel()[target].sum()
            np.exp(logits, out=logits)
            total = logits @ np.ones(GROUP, logits.dtype)
            loss += float(np.log(total).sum() - own) / n
            logits *= (1 / (total * n))[:, None]
            logits.ravel()[target] -= logits.dtype.type(1 / n)
        to_flat = groups @ p["to_group"].T
        to_member = np.zeros_like(p["to_member"])
        for one, a, b in by_group:
            to_flat[a:b] += members[a:b] @ p["to_member"][one].T
            to_member[one] = flat[a:b].T @ members[a:b]
        back = np.zeros((hidden.shape[0] * STRIDE, WIDTH), hidden.dtype)
        back[rows] = to_flat
        back = back.reshape(hidden.shape)
        to_scores = back @ v.transpose(0, 2, 1)
        # The mean slope over the keys, by their weights, is that along the hidden values.
        to_scores -= np.einsum("bqw,bqw->bq", back, hidden)[..., None]
        to_scores *= weights
        to_q = (to_scores @ k).reshape(-1, WIDTH) / np.float32(np.sqrt(WIDTH))
        # q is scaled already; so are the slopes of k.
        to_kv = np.concatenate([to_scores.transpose(0, 2, 1) @ q, weights.transpose(0, 2, 1) @ back], axis=2)
        # As queries, keys and values are tables by class, slopes are summed by class first.
        to_q = _summed(to_q, inputs[:, STRIDE - 1 :].ravel(), len(embedding))
        to_kv = _summed(to_kv.reshape(-1, 2 * WIDTH), inputs.ravel(), len(embedding))
        to_k, to_v = to_kv[:, :WIDTH], to_kv[:, WIDTH:]
        distance = np.bincount(_BEHIND[_CAUSAL], to_scores.sum(0)[_CAUSAL], KEYS).astype(np.float32)
        return loss, {
            "embedding": to_q @ p["query"].T + to_k @ p["key"].T + to_v @ p["value"].T,
            "query": embedding.T @ to_q,
            "key": embedding.T @ to_k,
            "value": embedding.T @ to_v,
            "to_group": flat.T @ groups,
            "to_member": to_member,
            "distance": distance,
        }

    def train(self, blocks: Iterator[np.ndarray], rate: float) -> int:
        """One pass over batches of windows (Adam); the number of windows."""
        flat = self.flat()
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        seen = step = 0
        for block in blocks:
            step += 1
            seen += len(block)
            slopes = self.slopes(block)[1]
            slope = np.concatenate([slopes[name].ravel() for name in self.parts])
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            mean, square = first / (1 - 0.9**step), second / (1 - 0.99**step)
            flat -= rate * mean / (np.sqrt(square) + 1e-7)
            self.load(flat)
        return seen
