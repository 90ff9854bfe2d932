"""Bits under several hashed contexts, mixed in the logistic domain: the numpy half of the language model.

A text is a stream of words, and each word a stream of binary decisions.  A frequent word has a rank: the number of
bits of its rank takes five decisions, the bits themselves the rest, so frequent words take few.  Rank 0 says that the
word is spelled instead: its bytes and a closing blank, eight decisions each.  ``WordMixer`` predicts the decisions on ranks
in the context of the words before, ``Mixer`` those on bytes in the context of the bytes before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from taleframe.llm.shingles import mix

CLOSE = 0x20
REACH = 5
#: (bytes of context, whether the class of the text so far belongs to the context)
CONTEXTS = ((1, False), (2, False), (3, False), (4, False), (5, False), (2, True), (4, True))
#: Slots of a table of bytes, and of one of words.
SLOT_BITS, NEAR_BITS = 18, 20
SLOTS, NEAR_SLOTS = 1 << SLOT_BITS, 1 << NEAR_BITS
#: Levels of evidence: bits of the number of events, at most.
LEVELS = 12
_PRIOR = 0.4
_CELLS, _SPAN = 33, 8.0


def word_events(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Events of all words in order, and where each word's events start."""
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    starts = np.cumsum(np.r_[0, sizes[:-1]]) if len(words) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    event = data.copy()
    for k in range(1, REACH + 1):
        before = np.zeros(len(data), dtype=np.int64)
        before[k:] = data[:-k]
        before[place < k] = 0
        event |= before << (8 * k)
    return event, starts


def _hash(context: np.ndarray, which: int, cls: np.ndarray | int) -> np.ndarray:
    """A 32-bit hash of the context that predictor ``which`` sees."""
    size, by_class = CONTEXTS[which]
    seen = (context & ((1 << (8 * size)) - 1)).astype(np.uint64)
    salt = np.uint64(which + 1) << np.uint64(48)
    if by_class:
        salt = salt + (np.asarray(cls, dtype=np.uint64) << np.uint64(56))
    return (mix(seen ^ salt) >> np.uint64(32)).astype(np.uint32)


def _slot(h: np.ndarray, node: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    x = (h ^ (node.astype(np.uint32) * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B)
    return (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)


def _decisions(event: np.ndarray):
    """(bit number, node reached so far, bit) for the eight decisions of the byte."""
    byte = event & 255
    for b in range(8):
        yield b, (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1


def _distinct(event: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of event and class (of 16 at most), and how often each comes."""
    key, n = np.unique(event << 4 | cls, return_counts=True)
    return key >> 4, key & 15, n


def add_slots(tables: np.ndarray, event: np.ndarray, counts: np.ndarray) -> None:
    """Add events to the zeros and ones of their slots, for each predictor; ``counts`` has a column per class."""
    at, cls = np.nonzero(counts)
    if not len(at):
        return
    times = counts[at, cls]
    event, cls, n = _distinct(np.repeat(event[at], times), np.repeat(cls, times))
    first = np.flatnonzero(np.r_[True, event[1:] != event[:-1]])
    whole = event[first], 0, np.add.reduceat(n, first).astype(np.float32)
    apart = event, cls, n.astype(np.float32)
    for which, (_, by_class) in enumerate(CONTEXTS):
        event, cls, n = apart if by_class else whole
        h, flat = _hash(event >> 8, which, cls), tables[which].reshape(-1)
        for _, node, bit in _decisions(event):
            np.add.at(flat, (_slot(h, node).astype(np.intp) << 1) | bit, n)


def _stretch(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretched guess, level of evidence) of float32 counts; the level is the number of bits of their sum."""
    level = ((n0 + n1 + np.float32(1)).view(np.int32) >> 23) - 127
    return np.log((n1 + np.float32(_PRIOR)) / (n0 + np.float32(_PRIOR))), np.minimum(level, LEVELS - 1)


def _cell(z: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(z, -_SPAN, _SPAN) + np.float32(_SPAN)) * np.float32((_CELLS - 1) / (2 * _SPAN))).astype(np.intp)


def _start_cells(steps: int) -> np.ndarray:
    p = _squash(np.linspace(-_SPAN, _SPAN, _CELLS))
    return 20.0 * np.stack([1 - p, p], axis=1)[None].repeat(steps, axis=0)


def _bits_of(z: np.ndarray, refined: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Natural logs that a decision costs: the mixed logit and what came after it before, in equal parts."""
    z = np.clip((z + refined.take(_cell(z))) * np.float32(0.5), -16, 16)
    z *= np.float32(1) - np.float32(2) * bit.astype(np.float32)
    return np.log(1 + np.exp(z))


def _step(weights: np.ndarray, squares: np.ndarray, inputs: list, z: np.ndarray, ones: np.ndarray, share: np.ndarray | np.float32, rate: float) -> None:
    """Move the weights of one decision against the mean error of a batch, of which each item is a ``share``."""
    wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - ones) * share
    for i, (st, level) in enumerate(inputs):
        g = np.bincount(level, weights=wrong * st, minlength=64).reshape(4, 16).sum(axis=0)[:LEVELS]
        squares[i] += g * g
        weights[i] -= rate * g / np.sqrt(squares[i])


def _packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Stretched guesses whose four lowest bits hold the level of evidence, so both are taken at once."""
    st, level = _stretch(n0, n1)
    return ((st.view(np.int32) & np.int32(~15)) | level).view(np.float32)


def _level(guess: np.ndarray, lane: np.ndarray | int = 0) -> np.ndarray:
    return (guess.view(np.int32) & np.int32(15) | lane).astype(np.intp)


def _lanes(n: int) -> np.ndarray:
    """To add to levels: neighbours count in bins of their own, as most have one level and would wait for each other."""
    return (np.arange(n, dtype=np.int32) & np.int32(3)) << np.int32(4)


def _by_lane(weights: np.ndarray) -> np.ndarray:
    """float32 weights (predictor, level, step) as (predictor, step, lane and level)."""
    out = np.zeros((weights.shape[0], weights.shape[2], 4, 16), dtype=np.float32)
    out[..., :LEVELS] = weights.transpose(0, 2, 1)[:, :, None]
    return out.reshape(*out.shape[:2], 64)


def _left_out(table: np.ndarray) -> np.ndarray:
    """At 2 * slot + bit, the packed guess of a slot without one event of that bit."""
    less = np.maximum(table - np.float32(1), 0)
    return np.stack([_packed(less[..., 0], table[..., 1]), _packed(table[..., 0], less[..., 1])], axis=-1).reshape(-1)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Mixer:
    """Weights of each predictor by its evidence and the decision, and a refinement table over the mixed logit."""

    weights: np.ndarray = field(default_factory=lambda: np.full((len(CONTEXTS), LEVELS, 8), 0.3))
    squares: np.ndarray = field(default_factory=lambda: np.full((len(CONTEXTS), LEVELS, 8), 1e-4))
    cells: np.ndarray = field(default_factory=lambda: _start_cells(8))

    def learn(self, tables: np.ndarray, event: np.ndarray, cls: np.ndarray, rate: float) -> None:
        """One online step over a batch of events, each left out of its own counts; what came after each logit is refined."""
        self.learn_from(self.left_out(tables), event, cls, rate)

    def learn_from(self, guesses: list[np.ndarray], event: np.ndarray, cls: np.ndarray, rate: float) -> None:
        """``learn``, with the guesses that ``left_out`` makes of the tables once for many batches."""
        event, cls, n = _distinct(event, cls)  # equal events move the weights as one
        weights, lane, share = _by_lane(self.weights), _lanes(len(event)), (n / n.sum()).astype(np.float32)
        hashes = [_hash(event >> 8, i, cls) for i in range(len(CONTEXTS))]
        for b, node, bit in _decisions(event):
            ones, z, inputs = bit.astype(np.float32), np.zeros(len(event), dtype=np.float32), []
            for i, h in enumerate(hashes):
                st = guesses[i].take((_slot(h, node).astype(np.intp) << 1) | bit)
                level = _level(st, lane)
                z += weights[i, b].take(level) * st
                inputs.append((st, level))
            self.cells[b] += np.bincount(2 * _cell(z) + bit, weights=n, minlength=2 * _CELLS).reshape(_CELLS, 2)
            _step(self.weights[:, :, b], self.squares[:, :, b], inputs, z, ones, share, rate)

    @staticmethod
    def left_out(tables: np.ndarray) -> list[np.ndarray]:
        return [_left_out(t) for t in tables]

    @staticmethod
    def packed(tables: np.ndarray) -> list[np.ndarray]:
        return [_packed(t[:, 0], t[:, 1]) for t in tables]

    def bits(self, tables: np.ndarray, event: np.ndarray, classes: int) -> np.ndarray:
        """Cost of each event in bits, a column per class."""
        return self.bits_from(self.packed(tables), event, classes)

    def bits_from(self, guesses: list[np.ndarray], event: np.ndarray, classes: int) -> np.ndarray:
        """``bits``, with the guesses that ``packed`` makes of the tables once for many batches."""
        refined, weights = np.log(self.cells[:, :, 1] / self.cells[:, :, 0]).astype(np.float32), self.weights.astype(np.float32)
        cost = np.zeros((len(event), classes))
        shared = [i for i, (_, by_class) in enumerate(CONTEXTS) if not by_class]
        own = [i for i, (_, by_class) in enumerate(CONTEXTS) if by_class]
        hashes = {i: _hash(event >> 8, i, 0) for i in shared}
        by_class = {(i, k): _hash(event >> 8, i, k) for i in own for k in range(classes)}

        def guess(i: int, h: np.ndarray, node: np.ndarray, b: int) -> np.ndarray:
            st = guesses[i].take(_slot(h, node))
            return weights[i, :, b].take(_level(st)) * st

        for b, node, bit in _decisions(event):
            base = sum(guess(i, hashes[i], node, b) for i in shared)
            for k in range(classes):
                z = base + sum(guess(i, by_class[i, k], node, b) for i in own)
                cost[:, k] += _bits_of(z, refined[b], bit)
        return cost / np.log(2)


# --- words by rank --------------------------------------------------------------------------------------

LENGTH_BITS, RANK_BITS = 5, 18
#: Ranks go from 1 to HEAD; 0 is for words that are spelled.
HEAD = (1 << RANK_BITS) - 1
NODES, STEPS = (1 << LENGTH_BITS) + (1 << RANK_BITS), LENGTH_BITS + RANK_BITS - 1
#: Before the first word of a text.
START = HEAD + 1
#: Contexts of the words before: the last one, the last two.
NEAR = 2


def rank_decisions(rank: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray, np.ndarray]]:
    """(step, which of the words, node reached so far, bit) for the decisions on ranks."""
    size = np.frexp(rank.astype(np.float32))[1]  # bits of the rank, 0 for rank 0
    for j in range(LENGTH_BITS):
        yield j, slice(None), (1 << j) | (size >> (LENGTH_BITS - j)), (size >> (LENGTH_BITS - 1 - j)) & 1
    which = np.flatnonzero(size >= 2)
    r, n, i = rank[which].astype(np.int32), size[which], 0
    while len(which):
        node = (1 << LENGTH_BITS) + (1 << (n - 1)) + (r >> (n - 1 - i))
        yield LENGTH_BITS + i, which, node, (r >> (n - 2 - i)) & 1
        i += 1
        more = n >= i + 2
        which, r, n = which[more], r[more], n[more]


def longest_first(rank: np.ndarray) -> np.ndarray:
    """An order of words in which those that take a step come before those that do not."""
    return np.argsort(31 - np.frexp(rank.astype(np.float32))[1].astype(np.uint8), kind="stable")


def ordered_decisions(rank: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``rank_decisions`` of words that come longest first: (step, how many of them take it, node, bit)."""
    size = np.frexp(rank.astype(np.float32))[1]
    for j in range(LENGTH_BITS):
        yield j, len(rank), (1 << j) | (size >> (LENGTH_BITS - j)), (size >> (LENGTH_BITS - 1 - j)) & 1
    taking = np.cumsum(np.bincount(size, minlength=2)[::-1])[::-1]  # words of at least so many bits
    rank = rank.astype(np.int32)
    first = (1 << LENGTH_BITS) + (1 << np.maximum(size - 1, 0))
    for i, m in enumerate(taking[2:].tolist()):
        rest = rank[:m] >> (size[:m] - (i + 2))
        yield LENGTH_BITS + i, m, first[:m] + (rest >> 1), rest & 1


def node_counts(by_rank: np.ndarray) -> np.ndarray:
    """Zeros and ones at each node, for counts of ranks."""
    out = np.zeros(2 * NODES)
    for _, which, node, bit in rank_decisions(np.arange(len(by_rank))):
        out += np.bincount(2 * node + bit, weights=by_rank[which], minlength=2 * NODES)
    return out.reshape(NODES, 2).astype(np.float32)


def near_hashes(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last word, and of the last two."""
    a = (one.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    return [a, (a ^ (a >> np.uint32(15))) * np.uint32(0x85EBCA6B) + (two.astype(np.uint32) + np.uint32(1)) * np.uint32(0xC2B2AE35)]


def add_near(tables: np.ndarray, rank: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    order = longest_first(rank)
    rank, hashes = rank[order], near_hashes(one[order], two[order])
    flat = [t.reshape(-1) for t in tables]
    for _, m, node, bit in ordered_decisions(rank):
        for k, h in enumerate(hashes):
            np.add.at(flat[k], (_slot(h[:m], node, NEAR_BITS).astype(np.intp) << 1) | bit, np.float32(1))


@dataclass
class WordMixer:
    """Mixes four predictors of a decision: its counts in all texts, in texts of the class so far, after the last word, after the last two.

    A predictor's weight is chosen by the step and by how much evidence it has; a refinement table corrects the mixed logit.
    """

    weights: np.ndarray = field(default_factory=lambda: np.full((2 + NEAR, LEVELS, STEPS), 0.3))
    squares: np.ndarray = field(default_factory=lambda: np.full((2 + NEAR, LEVELS, STEPS), 1e-4))
    cells: np.ndarray = field(default_factory=lambda: _start_cells(STEPS))

    @staticmethod
    def left_out(common: np.ndarray, by_class: np.ndarray, near: np.ndarray) -> tuple:
        """Packed guesses without an event of each bit; of a class, also those with all events, which words counted under another class see."""
        whole, less = _packed(by_class[..., 0], by_class[..., 1]), _left_out(by_class).reshape(*by_class.shape)
        return _left_out(common), np.concatenate([whole[..., None], less], axis=-1).reshape(-1), [_left_out(n) for n in near]

    def learn(self, guesses: tuple, rank, one, two, cls, own, rate: float) -> None:
        """One online step over a batch of words, each left out of its own counts; ``own`` is the class it was counted under."""
        order = longest_first(rank)
        rank, cls, hashes, weights = rank[order], cls[order], near_hashes(one[order], two[order]), _by_lane(self.weights)
        common, by_class, near = guesses
        lane, offset, mine = _lanes(len(rank)), cls * (3 * NODES), (cls == own[order]).astype(np.int32)
        for j, m, node, bit in ordered_decisions(rank):
            ones, z, inputs = bit.astype(np.float32), np.zeros(m, dtype=np.float32), []
            for i in range(2 + NEAR):
                if i == 0:
                    st = common.take(2 * node + bit)
                elif i == 1:
                    st = by_class.take(offset[:m] + 3 * node + mine[:m] * (1 + bit))
                else:
                    st = near[i - 2].take((_slot(hashes[i - 2][:m], node, NEAR_BITS).astype(np.intp) << 1) | bit)
                level = _level(st, lane[:m])
                z += weights[i, j].take(level) * st
                inputs.append((st, level))
            self.cells[j] += np.bincount(2 * _cell(z) + bit, minlength=2 * _CELLS).reshape(_CELLS, 2)
            _step(self.weights[:, :, j], self.squares[:, :, j], inputs, z, ones, np.float32(1 / m), rate)

    def prepared(self, common: np.ndarray, by_class: np.ndarray, near: np.ndarray) -> tuple:
        """Weighted guesses of the nodes (in all texts and in the class, added up) by class; packed guesses of the hashed contexts."""
        step = np.zeros(NODES, dtype=np.int64)  # a node belongs to one step
        for j, _, node, _ in rank_decisions(np.arange(HEAD + 1)):
            step[node] = j
        fixed = []
        for i, counts in ((0, common[None]), (1, by_class)):
            st, level = _stretch(counts[:, :, 0], counts[:, :, 1])
            fixed.append((self.weights[i][level, step[None]] * st).astype(np.float32))
        hashed = [_packed(n[:, 0], n[:, 1]) for n in near]
        refined = np.log(self.cells[:, :, 1] / self.cells[:, :, 0]).astype(np.float32)
        return (fixed[0] + fixed[1]).reshape(-1), hashed, self.weights.astype(np.float32), refined

    def cost(self, prepared: tuple, rank, one, two, cls) -> np.ndarray:
        """Bits of each word's decisions."""
        fixed, hashed, weights, refined = prepared
        order = longest_first(rank)
        hashes, out, offset = near_hashes(one[order], two[order]), np.zeros(len(rank), dtype=np.float32), cls[order] * NODES
        for j, m, node, bit in ordered_decisions(rank[order]):
            z = fixed.take(offset[:m] + node)
            for k, guesses in enumerate(hashed):
                st = guesses.take(_slot(hashes[k][:m], node, NEAR_BITS))
                z += weights[2 + k, :, j].take(_level(st)) * st
            out[:m] += _bits_of(z, refined[j], bit)
        back = np.empty_like(out)
        back[order] = out
        return back / np.float32(np.log(2))
