"""Word shingles of texts as 64-bit hashes, in numpy over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BATCH_BYTES = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _A)
_places = [mix(np.arange(1 << 10, dtype=np.uint64) + _C) | np.uint64(1)]


def _place(n: int) -> np.ndarray:
    """A random odd factor for each place of a word, for words of up to n bytes."""
    if len(_places[0]) < n:
        _places[0] = mix(np.arange(2 * n, dtype=np.uint64) + _C) | np.uint64(1)
    return _places[0]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and for each text the number of words before it (one more at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    space = _SPACE[data]
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    bounds = np.searchsorted(first, begins)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), bounds
    at = np.flatnonzero(~space)
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    sizes = ends - first
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    values = _BYTE[data[at]] * _place(int(sizes.max()))[place]
    return mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64)), bounds


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles; a text with fewer words is one shingle, one without words none."""
    hashes, bounds = word_hashes(texts)
    joined = hashes.copy()
    n = len(hashes)
    for k in range(1, words):
        joined[: max(n - k, 0)] = mix(joined[: max(n - k, 0)] * _A + hashes[k:])
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= words:
            yield np.unique(joined[a : z - words + 1])
        elif z > a:
            h = hashes[a : a + 1]
            for k in range(a + 1, z):
                h = mix(h * _A + hashes[k : k + 1])
            yield mix(h + _B)
        else:
            yield joined[:0]


def slices(batches, rows: int = 512):
    """Record batches in smaller ones, so that few texts are held twice."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.slice(a, rows)


def batches_of(texts: list[str | None], most: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, lower-cased texts) in turns of about ``most`` bytes; a null is empty."""
    first, part, held = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t.encode("utf-8", "replace").lower() if t else b"")
        held += len(part[-1])
        if held >= most:
            yield first, part
            first, part, held = i + 1, [], 0
    if part:
        yield first, part
