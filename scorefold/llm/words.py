"""Word and shingle hashes of batches of texts in numpy, shared by operators whose tasks run Python.

Words are runs of bytes that aren't ASCII white space. All words of a batch are hashed at once: a
polynomial hash modulo 2**64 of table values is summed along the bytes, and differences of the sums
give every word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once; a longer text makes a batch of its own.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTORS[1]))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and of each word in order: start, end, hash and index of its text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.cumsum([0] + [len(b) + 1 for b in raw])[:-1]
    space = _SPACE[buffer]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edges[::2], edges[1::2]  # the buffer ends with a space
    up, down = _power_table(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_VALUES[buffer] * up[: len(buffer)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return buffer, start, end, hashes, np.searchsorted(begins, start, "right") - 1


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in order."""
    return word_spans(texts)[3:]


def joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    last = len(hashes) - width + 1
    out = hashes[:last] * np.uint64(_FACTORS[0])
    for j in range(1, width):
        out = mix(out) + hashes[j : last + j] * np.uint64(_FACTORS[j])
    return mix(out + np.uint64(width))


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, index of its text), sorted by text and hash; repeats are kept.

    A text of fewer than ``width`` words has one shingle of all its words, one without words none.
    """
    hashes, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(counts)
    parts, owners = [], []
    if len(hashes) >= width:
        inside = owner[: len(owner) - width + 1] == owner[width - 1 :]
        parts.append(joined(hashes, width)[inside])
        owners.append(owner[: len(owner) - width + 1][inside])
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        parts.append(joined(hashes[ends[i] - counts[i] : ends[i]], counts[i]))
        owners.append(np.full(1, i))
    if not parts:
        return hashes[:0], owner[:0]
    found, owner = np.concatenate(parts), np.concatenate(owners)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for run in np.split(found, cuts):
        run.sort()  # each run is a view
    order = np.argsort(owner[np.concatenate([[0], cuts])], kind="stable") if len(owner) else cuts
    if len(order) and np.any(np.diff(order) < 0):
        runs, lengths = np.split(found, cuts), np.split(owner, cuts)
        found, owner = np.concatenate([runs[i] for i in order]), np.concatenate([lengths[i] for i in order])
    return found, owner


def chunks(texts: list[str]) -> Iterator[slice]:
    """Slices of ``texts`` of about CHUNK characters each."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield slice(first, i)
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield slice(first, len(texts))
