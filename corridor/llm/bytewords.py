"""Words of whole texts at byte level, in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased; a word is identified by a 64-bit hash of its bytes (the expected
number of colliding pairs among V distinct words is V^2 / 2^65).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from corridor.llm.shared import ragged

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters and digits of ASCII and every byte of a longer code point.
_CONTENT = np.zeros(256, bool)
_CONTENT[48:58] = _CONTENT[65:91] = _CONTENT[97:123] = _CONTENT[128:] = True

#: The same for bytes.translate: lower case, what is no space, what a word without signs keeps, and signs.
_LOWERED, _INSIDE, _KEPT = _LOWER.tobytes(), (~_SPACE).tobytes(), (_CONTENT | _SPACE).tobytes()
_SIGNS = np.flatnonzero(~(_CONTENT | _SPACE)).astype(np.uint8).tobytes()

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a run of texts: hash, byte span in ``data``, and word offsets by text."""

    data: np.ndarray
    text_offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    if offs is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes hashed at once, whose powers are made once.
_BLOCK = 1 << 15
_POWERS = _powers(_BASE, _BLOCK)
_INVERSE = _powers(_BASE_INVERSE, _BLOCK + 1)


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each range, from prefix sums of a polynomial mod 2^64."""
    return cut_hashes(data, starts, ends, (0,))[0]


def cut_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: tuple[int, ...], least: int = 0) -> list[np.ndarray]:
    """The same of data[start:end - n] for each n in ``cuts``; zero where that has fewer than ``least`` bytes."""
    out = [np.zeros(len(starts), np.uint64) for _ in cuts]
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, origin + _BLOCK, side="right")))
        part = data[origin : int(ends[to - 1])].astype(np.uint64) + np.uint64(1)
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(part * (_POWERS[:n] if n <= _BLOCK else _powers(_BASE, n)), dtype=np.uint64, out=sums[1:])
        s, e = starts[at:to] - origin, ends[at:to] - origin
        inverse = (_INVERSE if n <= _BLOCK else _powers(_BASE_INVERSE, n + 1))[s]
        before, length = sums[s], (e - s).astype(np.uint64)
        for h, cut in zip(out, cuts, strict=True):
            if cut:
                some = np.flatnonzero(e - s >= cut + least)
                h[at + some] = mix((sums[e[some] - cut] - before[some]) * inverse[some] + (length[some] - np.uint64(cut)))
            else:
                h[at:to] = mix((sums[e] - before) * inverse + length)
        at = to
    return out


def words(texts: pa.Array, content_only: bool = False) -> Words:
    """Words of each text. ``content_only``: other ASCII signs are left out of the words' hashes."""
    if content_only:
        return content_words(texts)[0]
    data, text_offsets = text_bytes(texts)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[text_offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    offsets = np.searchsorted(starts, text_offsets)
    return Words(data, text_offsets, starts, ends, hashes_of(data, starts, ends), offsets)


def content_words(texts: pa.Array, cuts: tuple[int, ...] = (), least: int = 0) -> tuple[Words, list[np.ndarray]]:
    """Words hashed without other ASCII signs than letters and digits, and the hashes of their spans in the text less their last bytes (zero if fewer than ``least`` are left).

    Signs neither belong to a word nor end it; starts and ends still point into the text.
    """
    data, text_offsets = text_bytes(texts)
    raw = data.tobytes()
    data = np.frombuffer(raw.translate(_LOWERED), np.uint8)
    small = np.frombuffer(raw.translate(_LOWERED, _SIGNS), np.uint8)
    w = np.frombuffer(raw.translate(_INSIDE, _SIGNS), bool)
    place = np.flatnonzero(np.frombuffer(raw.translate(_KEPT), bool))
    small_offsets = np.searchsorted(place, text_offsets)
    first = np.zeros(len(small) + 1, bool)
    first[small_offsets] = True
    before = np.concatenate([[False], w[:-1]]) if len(small) else w
    after = np.concatenate([w[1:], [False]]) if len(small) else w
    starts = np.flatnonzero(w & (~before | first[:-1]))
    ends = np.flatnonzero(w & (~after | first[1:])) + 1
    hashes, *short = cut_hashes(small, starts, ends, (0, *cuts), least)
    out = Words(data, text_offsets, place[starts], place[ends - 1] + 1, hashes, np.searchsorted(starts, small_offsets))
    if cuts:
        # signs inside a word count when its last bytes are cut
        some = np.flatnonzero(out.ends - out.starts != ends - starts)
        length = (out.ends - out.starts)[some]
        to = np.cumsum(length)
        for h, exact in zip(short, cut_hashes(data[ragged(out.starts[some], length)], to - length, to, cuts, least), strict=True):
            h[some] = exact
    return out, short


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``size``-word shingles in order, and offsets by text.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    counts = np.diff(w.offsets)
    n_out = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(n_out)])
    h = w.hashes
    if len(h) == 0:
        return np.zeros(0, np.uint64), offsets
    with np.errstate(over="ignore"):
        n = len(h)
        roll = np.zeros(n, np.uint64)
        for k in range(size):
            factor = np.uint64(pow(0xD6E8FEB86659FD93, size - k, 1 << 64))
            part = h[k:] * factor
            roll[: len(part)] += part
        full = mix(roll)
        out = np.zeros(int(offsets[-1]), np.uint64)
        long = counts >= size
        to = ragged(offsets[:-1][long], n_out[long])
        out[to] = full[ragged(w.offsets[:-1][long], n_out[long])]
        for i in np.flatnonzero(~long & (counts > 0)):
            acc = 0x51_7C_C1_B7_27_22_0A_95 + int(counts[i])
            for x in h[w.offsets[i] : w.offsets[i + 1]].tolist():
                acc = (acc * 0xD6E8FEB86659FD93 + x) & _MASK
            out[offsets[i]] = mix(np.array([acc], np.uint64))[0]
    return out, offsets
