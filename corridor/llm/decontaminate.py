"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are runs of non-space signs, A-Z lower-cased, without ASCII punctuation. An item of m
words is compared with the windows of m words of every document (a document of fewer words is
one window), both as multisets of ``size``-word shingles (the whole sequence, if m < size); they
match at weighted Jaccard similarity (sum of minima over sum of maxima of counts) ``num / den``
or more.

* Windows: a window can only match if enough of its shingles occur in the benchmark (the share
  of both sizes that the similarity asks for); and moving a matching window to its first such
  shingle never lowers its similarity. So exactly the windows that start at such a shingle, end
  the text or are the whole of it are fingerprinted; no other window could pass the exact check.
* Fingerprints are 64-bit SimHashes, the signs of sums over the window's shingles, taken from
  prefix sums.
* Search: items of one length are indexed by the eight bytes of their fingerprints. Two
  fingerprints within ``radius`` bits agree up to ``radius // 8`` bits in at least one byte, so
  looking up every byte value in that reach finds all of them. The radius follows from
  ``miss``, the chance to lose a pair that lies exactly at the similarity.
* Every candidate is verified exactly.

The benchmark is processed in blocks of ``ITEMS`` items, so what a task holds of it is bounded.

Defined results: null and empty texts and items without words match nothing; repeated rows are
reported each; an empty table on either side gives an empty result; other columns are ignored;
texts are whole, of any length. Items without an id are in no report, but ``clean`` drops the
documents that match them. Equal items with different ids are reported each; of several
windows of a document that match an item the most similar is given, the earliest of equals.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corridor.llm.bytewords import Words, mix, words
from corridor.llm.shared import ragged, slices, texts_of, workspace

#: Benchmark items in one pass over the documents.
ITEMS = 20_000
_BLOCKS = 8
_FACTOR = 0xD6E8FEB86659FD93
RESULT = "doc_id long, item_id long, similarity double, distance int, n_windows int, start long, end long"


def radius_for(num: int, den: int, miss: float) -> int:
    """Bits within which fingerprints of a pair at the similarity stay, but for the chance ``miss``."""
    shared = 2 * num / (num + den)  # of the shingles of two multisets of one size; the cosine is no lower for unequal sizes
    p = math.acos(shared) / math.pi
    total, r = (1 - p) ** 64, 0
    while 1 - total > miss:
        r += 1
        total += math.comb(64, r) * p**r * (1 - p) ** (64 - r)
    return r


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on (the last positions are meaningless)."""
    roll = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        part = hashes[k:] * np.uint64(pow(_FACTOR, size - k, 1 << 64))
        roll[: len(part)] += part
    return mix(roll)


def _signs(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    bits = np.unpackbits(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums >= 0, axis=1).view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


class _Lengths:
    """The items of one length, their fingerprints and the multi-index over them."""

    def __init__(self, m: int, size: int, items: list[tuple[int, np.ndarray]], radius: int):
        self.m, self.size = m, min(size, m)
        self.k = m - self.size + 1
        self.ids = [i for i, _ in items]
        grams = [_grams(h, self.size)[: self.k] for _, h in items]
        self.counts = [Counter(g.tolist()) for g in grams]
        self.prints = np.concatenate([_packed(_signs(g).sum(axis=0, keepdims=True)) for g in grams])
        reach = np.arange(256)
        near = np.bitwise_count((reach[:, None] ^ reach[None, :]).astype(np.uint8)) <= radius // _BLOCKS
        self.tables = []
        for b in range(_BLOCKS):
            value = (self.prints >> np.uint64(8 * b)).astype(np.uint8)
            hits = near[:, value]  # looked-up value x item
            lengths = hits.sum(axis=1)
            self.tables.append((np.cumsum(lengths) - lengths, lengths, np.nonzero(hits)[1]))

    def candidates(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        found = []
        for b, (starts, lengths, members) in enumerate(self.tables):
            value = (prints >> np.uint64(8 * b)).astype(np.uint8)
            item = members[ragged(starts[value], lengths[value])]
            found.append(np.repeat(np.arange(len(prints)), lengths[value]) * len(self.ids) + item)
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(self.ids), pair % len(self.ids)
        distance = np.bitwise_count(prints[window] ^ self.prints[item])
        near = distance <= radius
        return window[near], item[near], distance[near]


class Index:
    """A block of benchmark items, ready to be sent to tasks."""

    def __init__(self, ids: list[int], texts: list[str | None], size: int, num: int, den: int, miss: float):
        self.size, self.num, self.den = size, num, den
        self.radius = radius_for(num, den, miss)
        w = words(pa.array([t or "" for t in texts], pa.string()), content_only=True)
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, i in enumerate(ids):
            h = w.hashes[w.offsets[k] : w.offsets[k + 1]]
            if len(h) and i is not None:
                by.setdefault(len(h), []).append((i, h))
        self.lengths = [_Lengths(m, size, items, self.radius) for m, items in sorted(by.items())]
        self.known = {n: np.unique(np.concatenate([np.fromiter(c.keys(), np.uint64) for x in self.lengths if x.size == n for c in x.counts])) for n in {x.size for x in self.lengths}}

    def search(self, w: Words) -> Iterator[tuple[int, int, float, int, int, int, int]]:
        """(text, item id, similarity, distance, matching windows, first word, last word) of every match."""
        ends = w.offsets[1:]
        for size, known in self.known.items():
            grams = _grams(w.hashes, size)
            place = np.searchsorted(known, grams)
            place[place == len(known)] = 0
            hit = known[place] == grams
            owner = np.searchsorted(ends, np.flatnonzero(hit), side="right")
            at = np.flatnonzero(hit)
            inside = at + size <= ends[owner]  # a shingle of one text
            at, owner = at[inside], owner[inside]
            if not len(at):
                continue
            seen = np.zeros(len(grams) + 1, np.int32)
            seen[at + 1] = 1
            seen = np.cumsum(seen)
            for x in self.lengths:
                if x.size == size:
                    yield from self._matches(x, grams, seen, at, owner, w)

    def _matches(self, x: _Lengths, grams: np.ndarray, seen: np.ndarray, at: np.ndarray, owner: np.ndarray, w: Words) -> Iterator[tuple]:
        begin, end = w.offsets[:-1][owner], w.offsets[1:][owner]
        start = np.maximum(np.minimum(at, end - x.m), begin)
        k = np.minimum(x.m, end - begin) - x.size + 1  # shingles of the window: fewer if the text is shorter than the item
        enough = (seen[start + k] - seen[start]) * (self.num + self.den) >= self.num * (x.k + k)
        start, first = np.unique(start[enough], return_index=True)
        owner, k = owner[enough][first], k[enough][first]
        for lo in range(0, len(start), 20_000):
            s, o, n = start[lo : lo + 20_000], owner[lo : lo + 20_000], k[lo : lo + 20_000]
            # prefix sums over the stretches that the windows cover
            fresh = np.concatenate([[True], s[1:] > (s + n)[:-1]])
            group = np.cumsum(fresh) - 1
            first_at, last_at = s[fresh], (s + n)[np.concatenate([fresh[1:], [True]])]
            sizes = last_at - first_at
            sums = np.zeros((int(sizes.sum()) + 1, 64), np.int32)
            np.cumsum(_signs(grams[ragged(first_at, sizes)]), axis=0, out=sums[1:])
            begin = (np.cumsum(sizes) - sizes)[group] + s - first_at[group]
            window, item, distance = x.candidates(_packed(sums[begin + n] - sums[begin]), self.radius)
            best: dict[tuple[int, int], list] = {}
            for a, i, d in zip(window.tolist(), item.tolist(), distance.tolist(), strict=True):
                sim = similarity(Counter(grams[s[a] : s[a] + n[a]].tolist()), x.counts[i])
                if sim * self.den >= self.num - 1e-9:
                    got = best.setdefault((int(o[a]), i), [-1.0, 0, 0, 0, 0])
                    got[2] += 1
                    if sim > got[0]:
                        got[0], got[1], got[3], got[4] = sim, d, int(s[a]), int(s[a] + n[a]) + x.size - 2
            for (text, i), (sim, d, times, first, last) in best.items():
                yield text, x.ids[i], sim, d, times, first, last


def _blocks(benchmark: DataFrame, size: int, num: int, den: int, miss: float, named: bool = True) -> Iterator[Index]:
    """``named``: by their ids, without the items that have none; else all items, numbered."""
    n = benchmark.count()
    parts = max(1, math.ceil(n / ITEMS))
    for k in range(parts):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        yield Index([r.item_id if named else at for at, r in enumerate(rows)], [r.text for r in rows], size, num, den, miss)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, num: int = 80, den: int = 100, miss: float = 1e-4) -> DataFrame:
    """(doc_id, item_id, similarity, distance, n_windows, start, end): every document and item that match.

    ``start`` and ``end`` are the code points of the best window in the document's text.
    """
    spark = docs.sparkSession
    workspace(spark, "decontaminate")

    def over(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts, ids = texts_of(batch), batch.column("doc_id").cast(pa.int64())
                w = words(texts, content_only=True)
                best: dict[tuple[int, int], tuple] = {}
                for text, item, sim, d, n, first, last in sent.value.search(w):
                    old = best.get((text, item))
                    if old is not None:
                        n += old[4]
                    best[text, item] = (text, item, sim, d, n, first, last) if old is None or sim > old[2] else (*old[:4], n, *old[5:])
                rows = sorted(best.values())
                if rows:
                    chars = [_characters(w, r[0], r[5], r[6]) for r in rows]
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int32()),
                        pa.array([a for a, _ in chars], pa.int64()), pa.array([b for _, b in chars], pa.int64())],
                        names=["doc_id", "item_id", "similarity", "distance", "n_windows", "start", "end"])

        return docs.select("doc_id", "text").mapInArrow(scan, RESULT)

    return reduce(DataFrame.union, [over(i) for i in _blocks(benchmark, size, num, den, miss)])


def _characters(w: Words, text: int, first: int, last: int) -> tuple[int, int]:
    """Code points of the words first..last within their text."""
    data = w.data[w.text_offsets[text] : w.ends[last]]
    lead = (data & 0xC0) != 0x80
    return int(lead[: w.starts[first] - w.text_offsets[text]].sum()), int(lead.sum())


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 5, num: int = 80, den: int = 100, miss: float = 1e-4) -> DataFrame:
    """The documents, all columns, that match no benchmark item; one pass per block of items, no shuffle."""
    spark = docs.sparkSession
    workspace(spark, "decontaminate")

    def without(docs: DataFrame, index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                bad = {m[0] for m in sent.value.search(words(texts_of(batch), content_only=True))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        return docs.mapInArrow(scan, docs.schema)

    return reduce(without, _blocks(benchmark, size, num, den, miss, named=False), docs)
