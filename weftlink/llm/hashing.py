"""Hashes of every word or byte window of a batch of texts, in whole-array steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on together up to this many bytes, longer ones alone.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        steps = np.full(max(n, CHUNK_BYTES) + 1, _BASE)
        back = np.full(len(steps), _INVERSE)
        steps[0] = back[0] = 1
        _POWERS[:] = [np.cumprod(steps), np.cumprod(back)]
    return _POWERS[0], _POWERS[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which any substring's hash follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds): runs of texts of about ``chunk_bytes``, one zero byte after each text.

    Text i of a run is bytes[bounds[i] : bounds[i + 1] - 1].
    """
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1)
        lengths = np.diff(offsets[at : end + 1])
        bounds = np.zeros(end - at + 1, np.int64)
        np.cumsum(lengths + 1, out=bounds[1:])
        out = np.zeros(bounds[-1], np.uint8)
        here = np.ones(len(out), bool)
        here[bounds[1:] - 1] = False
        out[here] = data[offsets[at] : offsets[end]]
        yield at, out, bounds
        at = end


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's word shingles, sorted; text i has [out[i], out[i + 1]).

    A-Z is lower-cased; words stand between white space. A text of fewer words
    has its whole sequence as its one shingle, a text without words none.
    """
    data = data.copy()
    data[(data >= 65) & (data <= 90)] |= 32
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    blank[bounds[1:] - 1] = True
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = substring_hash(prefix_sums(data), start, end)
    first = np.searchsorted(start, bounds)  # words of text i: [first[i], first[i + 1])
    n = np.diff(first)
    factor = np.uint64(0xD6E8FEB86659FD93)

    def joined(at: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(at), np.uint64(length))
        for k in range(length):
            h = h * factor + word[at + k]
        return mix(h)

    text = np.repeat(np.arange(len(n)), n)
    full = np.flatnonzero(np.arange(len(word)) + words <= first[1:][text]) if len(word) else np.zeros(0, np.int64)
    found, owner = [joined(full, words)], [text[full]]
    for length in range(1, words):
        few = np.flatnonzero(n == length)
        found.append(joined(first[few], length))
        owner.append(few)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    found, owner = found[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(n) + 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        found[a:b].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    owner = owner[fresh]
    return found[fresh], np.searchsorted(owner, np.arange(len(n) + 1))
