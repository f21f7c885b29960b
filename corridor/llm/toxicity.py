"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

* Terms are words (A-Z lower-cased, without ASCII punctuation) and words without their last
  2 to 4 bytes, so that inflected forms of a stem meet. Vectors are tf-idf over all terms of the
  labelled examples, with document frequencies counted over the whole table; terms that no
  example holds have no dimension.
* The labelled examples are a bounded sample, at most about ``max_examples`` of each label. They are
  indexed twice: as whole texts, and as passages of ``PASSAGE`` words, of which up to ``GIVEN`` of a text
  that hold a term marking label 1, and one other of each text of label 0, enter. In passages a stem is one
  term whatever ending it lost. A term marks label 1 if chance doesn't explain in how many
  examples of that label it occurs; a place that texts copied from each other counts once.
* An index keeps postings for most terms and, for the ``HEAD`` most frequent, blocks of ``BLOCK`` similar
  examples with each term's largest weight in the block. A query adds up the postings, which
  bounds its cosine with every block from above; blocks that may hold one of the k nearest are
  scored in single precision, the others skipped. What may be among the k nearest by the bound on
  the rounding error is scored again in double precision: the k nearest are those of a full scan.
* Postings carry no weights: a term that occurs once in an example weighs its idf times a factor of the
  example; what terms that occur more often weigh beyond that is added by a second, shorter list.
* Neighbours vote with a power of their cosine, each label weighted by the rows its sample stands
  for, together with a prior of one vote at cosine ``PRIOR_COSINE``. Among whole texts, terms that mark
  label 1 weigh ``MARK`` times as much in the vote (not in the search). A text with passages that
  hold a marking term is scored by the ``STRONGEST`` of them and by its whole where that speaks for
  label 1, so that clean text around them doesn't drown them; any other text by its whole. Votes become probabilities by isotonic bins fitted on
  the examples themselves, each without its own votes.
* The evidence of a score is its nearest examples with their labels and cosines, and those of the
  strongest passage.

The index is built in one task from the bounded sample, lies as a table in the shared folder, and
is read once by each worker; nothing of it passes the driver.

Defined results: null and empty texts, and texts without a term of the examples, have no neighbours and
get the share of label 1 among labelled texts of that kind; ties between neighbours go to the
smaller example; an id with several labels counts as toxic if any of them is, an id with several
texts teaches by the smallest of them; repeated rows
are scored each; an empty table gives an empty result; without labelled rows of both labels
every score is the share of label 1 (0 without any); other columns are ignored; whole texts
count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, functions as F

from corridor.llm.binary_ids import filesystem
from corridor.llm.bytewords import content_words, mix, words
from corridor.llm.langid import training_row
from corridor.llm.shared import kept_in_worker, ragged, slices, texts_of, workspace, written

#: Terms whose products are taken by blocks (fewer where there are very many examples), of whole texts and of the short
#: passages; examples of a block, queries at once, and postings added up at once.
HEAD = 1024
PASSAGE_HEAD = 32
HEAD_CELLS = 8 << 20
BLOCK = 32
BATCH = 128
POSTINGS = 1 << 14
#: Words of a passage; a text is cut into passages from its first word on.
PASSAGE = 16
#: Marked passages that an example gives to the index (all are scored).
GIVEN = 4
#: Passages of a label-0 example that enter besides those with a marking term.
OTHERS = 1
#: Passages of a text whose votes make its score.
STRONGEST = 3
NEIGHBOURS = 15
PRIOR_COSINE = 0.1
#: Weight of a term that marks label 1, in the vote, and the power of the cosine.
MARK = 12.0
PASSAGE_MARK = 2.0
POWER = 4
#: Bytes cut off a word's end to get a stem, and the least bytes of a stem.
ENDINGS = (2, 3, 4)
STEM = 3
#: Share of label 1 among the texts that hold a term, for the term to mark it.
PRECISION = 0.5
#: Terms expected to mark label 1 by chance alone.
CHANCE = 0.05
BINS = 40


def _placed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each term occurrence, number of its word in the text, term hash, hash of its bytes alone): words and their stems.

    A term is a word, or a stem with the number of bytes cut off; by its bytes alone a stem is the
    same whatever was cut off.
    """
    w, short = content_words(texts, ENDINGS, STEM)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.offsets))
    at = np.arange(len(owner)) - w.offsets[owner] if len(owner) else owner
    out_owner, out_at, out, plain = [owner], [at], [w.hashes], [w.hashes]
    length = w.ends - w.starts
    for n, h in zip(ENDINGS, short, strict=True):
        long = np.flatnonzero(length >= n + STEM)
        h = h[long]
        out_owner.append(owner[long])
        out_at.append(at[long])
        out.append(h ^ np.uint64(0xA5A5A5A5_00000000 + n))
        plain.append(h)
    return np.concatenate(out_owner), np.concatenate(out_at), np.concatenate(out), np.concatenate(plain)


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text of each term occurrence, term hash)."""
    owner, _, term, _ = _placed(texts)
    return owner, term


def _apart(texts: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, hash of the words before and after) of each term occurrence; equal ones of a text once. ``plain``: by bytes alone."""
    w = words(texts, content_only=True)
    owner, at, *both = _placed(texts)
    term = both[plain]
    h = np.concatenate([[np.uint64(1)], w.hashes, [np.uint64(2)]])  # word k of all texts is h[k + 1]
    k = w.offsets[owner] + at
    around = mix(h[k] * np.uint64(3) + h[k + 2]) if len(k) else np.zeros(0, np.uint64)
    once = np.unique(mix(term) ^ around ^ mix(owner.astype(np.uint64)), return_index=True)[1]
    return owner[once], term[once], around[once]


@dataclass
class Places:
    """Where terms lie in a sorted vocabulary, by their leading bits; hashes spread evenly, so a few steps from there suffice."""

    vocabulary: np.ndarray
    shift: int = 64
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def __post_init__(self) -> None:
        bits = min(24, max(1, len(self.vocabulary).bit_length() + 1))
        self.shift = 64 - bits
        self.first = np.searchsorted(self.vocabulary, np.arange(1 << bits, dtype=np.uint64) << np.uint64(self.shift)).astype(np.int32)

    def known(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the vocabulary, whether it is there) of each term."""
        if not len(self.vocabulary) or not len(term):
            return np.zeros(len(term), np.int64), np.zeros(len(term), bool)
        last = len(self.vocabulary) - 1
        place = self.first.take((term >> np.uint64(self.shift)).view(np.int64), mode="clip").astype(np.int64)
        there = self.vocabulary.take(place, mode="clip")
        lower = np.flatnonzero(there < term)
        while len(lower):
            lower = lower[place[lower] < last]
            at = place[lower] + 1
            place[lower], there[lower] = at, self.vocabulary[at]
            lower = lower[there[lower] < term[lower]]
        return np.minimum(place, last), there == term


def _distinct(key: np.ndarray) -> np.ndarray:
    """Distinct keys in order."""
    key = np.sort(key)
    return key[_new(key)]


def _new(key: np.ndarray) -> np.ndarray:
    """Where a sorted key isn't the one before."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return new


def _pairs(owner: np.ndarray, place: np.ndarray, rows: int, size: int) -> np.ndarray:
    """owner * size + place, sorted; in 32 bits where these suffice."""
    kind = np.uint32 if rows * size < 1 << 32 else np.int64
    key = owner.astype(kind)
    key *= kind(size)
    key += place.astype(kind)
    key.sort()
    return key


def _counted(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) and how often each occurs."""
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    first = np.ones(len(term), bool)
    first[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], term[at], np.diff(np.concatenate([at, [len(term)]]))


@dataclass
class Vectors:
    """Sparse unit vectors by row."""

    offsets: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def of(self, rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, weights, offsets) of some rows."""
        starts, ends = self.offsets[rows], self.offsets[np.array(rows, np.int64) + 1]
        at = ragged(starts, ends - starts)
        return self.terms[at], self.weights[at], np.concatenate([[0], np.cumsum(ends - starts)])


def _select(owner: np.ndarray, term: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The terms that mark label 1, by signed likelihood ratio, in sorted order."""
    n1, n0 = float(weight[toxic].sum()), float(weight[~toxic].sum())
    values, inverse = np.unique(term, return_inverse=True)
    rows = np.bincount(inverse)
    k1 = np.bincount(inverse, (weight * toxic)[owner])
    k0 = np.bincount(inverse, (weight * ~toxic)[owner])
    p1, p0 = (k1 + 0.5) / (n1 + 1), (k0 + 0.5) / (n0 + 1)
    gain = k1 * np.log(p1 / p0) + (n1 - k1) * np.log((1 - np.minimum(p1, 1 - 1e-9)) / (1 - np.minimum(p0, 1 - 1e-9)))
    # at least three texts, most of those with the term toxic, and a gain that chance would give to CHANCE of all terms tried
    good = np.flatnonzero((rows >= 3) & (p1 * n1 >= PRECISION * (p1 * n1 + p0 * n0)) & (gain > np.log((len(values) + 1.0) / CHANCE)))
    return values[good]


@dataclass
class Index:
    """Labelled examples as a block-max inverted index."""

    vocabulary: np.ndarray
    idf: np.ndarray
    marks: np.ndarray  # whether a term marks label 1
    ids: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    prior: float
    empty: float
    starts: np.ndarray  # term: first posting
    example: np.ndarray
    value: np.ndarray
    marked: np.ndarray  # example: square of its length in marking terms
    edges: np.ndarray | None = None
    chances: np.ndarray | None = None
    # made from the postings, not stored
    slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # term: row of the blocks, or -1
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # examples as they lie in blocks
    head: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # frequent term x example in order, rounded
    highest: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # frequent term x block: largest weight, rounded
    by_example: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # example in order x frequent term
    places: Places = field(default_factory=lambda: Places(np.zeros(0, np.uint64)))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # example: place in order
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))  # example in order: least weight of a term by idf
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))  # posting: place of its example in order
    more_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # term: its first posting of a weight above the least
    several: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # whether a term has any of those
    more_column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    more: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by how much of the least
    mark_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # term: number among the marking ones, or -1
    own_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # example: its first marking term
    own_marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    own_values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # 0, 1, 2, ..., as far as it was needed
    frequent: int = HEAD
    mark: float = MARK
    skipped: int = 0
    scored: int = 0
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the examples, each without its own

    def prepared(self) -> Index:
        """Lay the frequent terms out in blocks of similar examples."""
        n = len(self.ids)
        self.places = Places(self.vocabulary)
        held = np.diff(self.starts)
        frequent = np.argsort(-held, kind="stable")[: min(self.frequent, HEAD_CELLS // max(1, n))]
        frequent = frequent[held[frequent] > 0]
        self.slot = np.full(len(self.vocabulary), -1, np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        head = np.zeros((len(frequent), n))
        for k, t in enumerate(frequent.tolist()):
            at = slice(self.starts[t], self.starts[t + 1])
            head[k, self.example[at]] = self.value[at]
        self.order = _alike(head)
        self.head = head[:, self.order].astype(np.float32)
        self.by_example = np.ascontiguousarray(head[:, self.order].T)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.place = place
        # most terms occur once in an example: their weights differ by the idf alone
        term = np.repeat(np.arange(len(held), dtype=np.int32), held)
        per_idf = self.value / self.idf[term]
        self.least = np.full(n, np.inf)
        np.minimum.at(self.least, self.example, per_idf)
        more = per_idf / self.least[self.example] - 1
        several = np.flatnonzero(more > 1e-9)
        self.least = np.where(np.isfinite(self.least), self.least, 0.0)[self.order]
        self.column = place.astype(np.min_scalar_type(n))[self.example]
        self.more_starts = np.searchsorted(several, self.starts)
        self.several = np.diff(self.more_starts) > 0
        self.more_column, self.more = self.column[several], more[several]
        self.mark_of = np.where(self.marks, np.cumsum(self.marks) - 1, -1).astype(np.int32)
        own = np.flatnonzero(self.marks[term])
        own = own[np.argsort(self.example[own], kind="stable")]
        self.own_starts = np.searchsorted(self.example[own], np.arange(n + 1))
        self.own_marks, self.own_values = self.mark_of[term[own]], self.value[own]
        first = np.arange(0, n, BLOCK)
        self.highest = np.maximum.reduceat(self.head, first, axis=1) if n and len(frequent) else np.zeros((len(frequent), len(first)), np.float32)
        return self

    def weighted(self, owner: np.ndarray, term: np.ndarray, rows: int) -> Vectors:
        """Unit vectors of ``rows`` texts or passages from their term occurrences."""
        place, hit = self.places.known(term)
        size = max(1, len(self.vocabulary))
        key = _pairs(owner[hit], place[hit], rows, size)
        first = np.flatnonzero(_new(key))
        n = np.diff(first, append=len(key))
        key = key[first]
        owner = key // key.dtype.type(size)
        term = (key - owner * key.dtype.type(size)).astype(np.int64)
        value = (1 + np.log(n)) * self.idf[term]
        norm = np.sqrt(np.bincount(owner, value * value, minlength=rows))
        return Vectors(np.searchsorted(owner, np.arange(rows + 1)), term, value / norm[owner] if len(owner) else value)

    def vectors(self, texts: pa.Array) -> Vectors:
        return self.weighted(*_terms(texts), len(texts))

    def _products(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sum of products with every example over the given terms."""
        return self._sums([(terms, values)])[0][np.argsort(self.order)]

    def _counting(self, n: int) -> np.ndarray:
        """0, 1, ... n - 1, kept between queries."""
        if len(self.count) < n:
            self.count = np.arange(max(n, 2 * POSTINGS))
        return self.count[:n]

    def _sums(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Sum of products of each query with every example, as they lie in blocks."""
        terms, values = (np.concatenate([q[k] for q in queries]) for k in range(2))
        return self._added(terms, values, np.cumsum([0, *(len(t) for t, _ in queries)]))

    def _added(self, terms: np.ndarray, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The same of queries that lie one after the other."""
        out = np.zeros((len(cuts) - 1, len(self.ids)))
        values = values * self.idf[terms]
        self._add(out, self.starts, self.column, None, terms, values, cuts)
        some = np.flatnonzero(self.several[terms])
        self._add(out, self.more_starts, self.more_column, self.more, terms[some], values[some], np.searchsorted(some, cuts))
        out *= self.least
        return out

    def _add(self, out: np.ndarray, starts: np.ndarray, column: np.ndarray, factor: np.ndarray | None, terms: np.ndarray, values: np.ndarray, cuts: np.ndarray) -> None:
        """Add the values, times the postings' factors, to the terms' columns; ``POSTINGS`` (or one query's) at a time."""
        m, n = out.shape
        lengths = starts[terms + 1] - starts[terms]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        before = ends[cuts]
        moved = starts[terms] - ends[:-1]
        at = 0
        while at < m:
            to = max(at + 1, int(np.searchsorted(before, before[at] + POSTINGS, side="right")) - 1)
            own = slice(cuts[at], cuts[to])
            postings = np.repeat(moved[own] + before[at], lengths[own])
            postings += self._counting(len(postings))
            value = np.repeat(values[own], lengths[own])
            if factor is not None:
                value *= factor.take(postings, mode="clip")
            cell = column.take(postings, mode="clip")
            if to - at > 1:
                cell = np.repeat(np.arange(to - at) * n, np.diff(before[at : to + 1])) + cell
            out[at:to] += np.bincount(cell, value, minlength=(to - at) * n).reshape(to - at, n)
            at = to

    def _nearest(self, terms: np.ndarray, values: np.ndarray, cuts: np.ndarray, k: int, without: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first neighbour of each query, examples, cosines): the k nearest, the nearest first, without some examples.

        Cosines are first taken in single precision with a bound on the error. What may be among the k
        nearest gets its cosine in double precision; blocks that can't hold any are skipped.
        """
        n, m = len(self.ids), len(cuts) - 1
        row, slot = np.repeat(np.arange(m), np.diff(cuts)), self.slot[terms]
        frequent = slot >= 0
        exact = np.zeros((m, len(self.head)))
        exact[row[frequent], slot[frequent]] = values[frequent]
        dense = exact.astype(np.float32)
        other = np.concatenate([[0], np.cumsum(~frequent)])[cuts]
        rest = self._added(terms[~frequent], values[~frequent], other)
        for i, examples in enumerate(without):
            if len(examples):
                rest[i, self.place[examples]] = -np.inf
        # at most so much a cosine in single precision is off: rounding of both factors, the sum and the result
        off = ((np.bincount(row[frequent], minlength=m) + 8) * 2.0**-22).astype(np.float32)[:, None]
        first = np.arange(0, n, BLOCK)
        rough = rest.astype(np.float32)
        bound = dense @ self.highest + np.maximum.reduceat(rough, first, axis=1) + off
        total = np.full((m, n), -np.inf, np.float32)
        to_do = np.ones(len(first), bool)

        def score(blocks: np.ndarray) -> None:
            """Runs of blocks that lie side by side are one product."""
            if not len(blocks):
                return
            ends = np.flatnonzero(np.diff(blocks, append=blocks[-1:] + 2) > 1)
            for a, b in zip(np.concatenate([[0], ends[:-1] + 1]), ends, strict=True):
                run = slice(first[blocks[a]], min(first[blocks[b]] + BLOCK, n))
                np.matmul(dense, self.head[:, run], out=total[:, run])
                total[:, run] += rough[:, run]
            to_do[blocks] = False

        # the best blocks of each query give the cosine to beat
        ahead = min(len(first), k // BLOCK + 2)
        near = np.argpartition(-bound, ahead - 1, axis=1)[:, :ahead]
        score(np.unique(near))
        at = np.minimum(first[near][:, :, None] + np.arange(BLOCK), n - 1).reshape(m, -1)
        own = np.take_along_axis(total, at, axis=1)
        own[(first[near][:, :, None] + np.arange(BLOCK) >= n).reshape(m, -1)] = -np.inf
        beat = np.maximum(0, np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k, None]) if own.shape[1] >= k else np.zeros((m, 1), np.float32)
        score(np.flatnonzero(to_do & (bound >= beat - off).any(axis=0)))
        self.skipped += int(to_do.sum())
        self.scored += int((~to_do).sum())
        # examples that can be among the k nearest: those as good as the k-th, less what both may be off; the best of k blocks are k
        if len(first) >= k:
            beat = np.maximum(beat, np.partition(np.maximum.reduceat(total, first, axis=1), len(first) - k, axis=1)[:, len(first) - k, None])
        found = np.flatnonzero(total > np.maximum(0, beat - 2 * off))
        row, place = found // n, found % n
        good = total.ravel()[found]
        order = np.lexsort((-good, row))
        counts = np.bincount(row, minlength=m)
        starts = np.cumsum(counts) - counts
        kth = np.full(m, -np.inf, np.float32)
        kth[counts >= k] = good[order[starts[counts >= k] + k - 1]]
        some = good >= (kth[:, None] - 2 * off)[row, 0]
        row, place = row[some], place[some]
        cosine = rest[row, place]
        starts = np.searchsorted(row, np.arange(m + 1)).tolist()
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            # summed example by example, so that a cosine doesn't depend on the batch
            cosine[a:b] += np.einsum("ij,j->i", self.by_example[place[a:b]], exact[i])
        some = cosine > 0
        row, example, cosine = row[some], self.order[place[some]], cosine[some]
        order = np.lexsort((example, -np.round(cosine, 12), row))
        row, example, cosine = row[order], example[order], cosine[order]
        starts = np.searchsorted(row, np.arange(m + 1))
        best = np.arange(len(row)) - starts[row] < k
        return np.searchsorted(row[best], np.arange(m + 1)), example[best], cosine[best]

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k nearest examples with a cosine above zero, the nearest first; exact."""
        return self._nearest(terms, values, np.array([0, len(terms)]), k, [np.array([without] if without >= 0 else [], np.int64)])[1:]

    def batches(self, v: Vectors, rows: list[int], without: dict[int, np.ndarray] | None = None) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, first neighbour of each, example, cosine, cosine in the vote) by batches of rows; ``without``: examples left out, by row."""
        if not len(self.ids):
            return
        # rows that begin with the same frequent terms go together: their blocks are the same
        rows = sorted(rows, key=lambda i: (-v.weights[v.offsets[i] : v.offsets[i + 1]].max(initial=0.0), i)) if len(rows) <= BATCH else self._together(v, rows)
        none = np.zeros(0, np.int64)
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            terms, values, cuts = v.of(some)
            starts, example, cosine = self._nearest(terms, values, cuts, NEIGHBOURS, [without.get(i, none) for i in some] if without else [])
            yield some, starts, example, cosine, self._weighted(terms, values, cuts, starts, example, cosine)

    def each_nearest(self, v: Vectors, rows: list[int], without: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, example, cosine, cosine in the vote) of the nearest of each row."""
        for some, starts, example, cosine, weighted in self.batches(v, rows, without):
            for i, a, b in zip(some, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield i, example[a:b], cosine[a:b], weighted[a:b]

    def each_vote(self, v: Vectors, rows: list[int], without: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        """(row, vote, example, cosine) of each row that has neighbours."""
        for some, starts, example, cosine, weighted in self.batches(v, rows, without):
            votes = self._votes(np.repeat(np.arange(len(some)), np.diff(starts)), example, weighted, len(some)).tolist()
            for i, vote, a, b in zip(some, votes, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b > a:
                    yield i, vote, example[a:b], cosine[a:b]

    def _together(self, v: Vectors, rows: list[int]) -> list[int]:
        """The rows in the order of the block that each may be nearest to."""
        nearest = []
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            terms, values, cuts = v.of(some)
            row, slot = np.repeat(np.arange(len(some)), np.diff(cuts)), self.slot[terms]
            dense = np.zeros((len(some), len(self.head)), np.float32)
            dense[row[slot >= 0], slot[slot >= 0]] = values[slot >= 0]
            nearest += np.argmax(dense @ self.highest, axis=1).tolist() if self.highest.size else [0] * len(some)
        return [i for _, i in sorted(zip(nearest, rows, strict=True))]

    def _weighted(self, terms: np.ndarray, values: np.ndarray, cuts: np.ndarray, starts: np.ndarray, example: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """The cosines found, with marking terms at ``MARK`` times their weight."""
        more = self.mark**2 - 1
        m = len(cuts) - 1
        own = np.zeros((m, max(1, int(self.marks.sum()))))
        at = self.mark_of[terms]
        own[np.repeat(np.arange(m), np.diff(cuts))[at >= 0], at[at >= 0]] = values[at >= 0]
        row = np.repeat(np.arange(m), np.diff(starts))
        lengths = self.own_starts[example + 1] - self.own_starts[example]
        at, pair = ragged(self.own_starts[example], lengths), np.repeat(np.arange(len(example)), lengths)
        common = np.bincount(pair, own[row[pair], self.own_marks[at]] * self.own_values[at], minlength=len(example))
        lengths = (1 + more * (own**2).sum(axis=1)[row]) * (1 + more * self.marked[example])
        return (cosine + more * common) / np.sqrt(lengths)

    def _votes(self, row: np.ndarray, example: np.ndarray, cosine: np.ndarray, rows: int) -> np.ndarray:
        """The vote of each row's neighbours."""
        w = cosine**POWER * self.weight[example]
        own = PRIOR_COSINE**POWER
        return (np.bincount(row, w * self.label[example], minlength=rows) + own * self.prior) / (np.bincount(row, w, minlength=rows) + own)

    def vote(self, example: np.ndarray, cosine: np.ndarray) -> float:
        return float(self._votes(np.zeros(len(example), np.int64), example, cosine, 1)[0])

    def chance(self, vote: float) -> float:
        return vote if self.chances is None else float(np.interp(vote, self.edges, self.chances))

    def named(self, example: np.ndarray, cosine: np.ndarray) -> list[tuple[int, int, float]]:
        some = example[:5]
        return [(i, int(t), round(c, 12)) for i, t, c in zip(self.ids[some].tolist(), self.label[some].tolist(), cosine[:5].tolist(), strict=True)]


def _alike(head: np.ndarray, groups: int = 16, rounds: int = 3) -> np.ndarray:
    """An order of the columns in which similar ones lie together: a few rounds of grouping by the nearest centre."""
    n = head.shape[1]
    if not head.size:
        return np.arange(n)
    centre = head[:, np.linspace(0, n - 1, min(groups, n)).astype(int)]
    for _ in range(rounds):
        near = centre.T @ head
        own = near.argmax(axis=0)
        centre = np.stack([head[:, own == g].mean(axis=1) if (own == g).any() else centre[:, g] for g in range(centre.shape[1])], axis=1)
        centre /= np.maximum(np.linalg.norm(centre, axis=0), 1e-12)
    return np.lexsort((-near.max(axis=0), own))


def _among(few: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Where a term is one of a few (sorted): most are told apart by their leading bits."""
    leading = np.zeros(1 << 16, bool)
    leading[few >> np.uint64(48)] = True
    some = np.flatnonzero(leading[term >> np.uint64(48)])
    if not len(some):
        return some
    place = np.minimum(np.searchsorted(few, term[some]), len(few) - 1)
    return some[few[place] == term[some]]


def _windows(marking: np.ndarray, owner: np.ndarray, at: np.ndarray, term: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages as (text, number of the passage in it) and their term occurrences as (passage, term).

    Those with one of the ``marking`` terms (sorted); or those given as ``chosen`` (text * 2**32 + number, sorted).
    """
    if chosen is None:
        some = _among(marking, term)
        chosen = _distinct((owner[some].astype(np.int64) << 32) + at[some] // PASSAGE)
    if not len(chosen):
        return chosen, chosen, np.zeros(0, np.int64), term[:0]
    # only texts with a chosen passage are looked into
    has = np.zeros(int(max(owner.max(), chosen[-1] >> 32)) + 1, bool)
    has[chosen >> 32] = True
    some = np.flatnonzero(has[owner])
    key = (owner[some].astype(np.int64) << 32) + at[some] // PASSAGE
    place = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
    inside = chosen[place] == key
    return chosen >> 32, chosen & 0xFFFFFFFF, place[inside], term[some[inside]]


@dataclass
class Scorer:
    """The two indexes; a text with marked passages is scored by the strongest, any other by its whole."""

    whole: Index
    passages: Index

    def passage_votes(self, texts: pa.Array, terms: tuple, without: dict[int, np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """text -> (votes of its strongest marked passages, the nearest examples of the strongest, their cosines)."""
        owner, number, passage, term = _windows(self.passages.vocabulary[self.passages.marks], terms[0], terms[1], terms[3])
        if not len(owner):
            return {}
        found: dict[int, list[tuple[float, int, np.ndarray, np.ndarray]]] = {}
        v = self.passages.weighted(passage, term, len(owner))
        rows = np.flatnonzero(np.diff(v.offsets)).tolist()
        left = {i: without.get(int(owner[i]), np.zeros(0, np.int64)) for i in rows} if without else None
        # equal passages are searched once
        equal: dict = {}
        for i in rows:
            a, b = v.offsets[i], v.offsets[i + 1]
            equal.setdefault((v.terms[a:b].tobytes(), v.weights[a:b].tobytes(), int(owner[i]) if without else -1), []).append(i)
        copies = {same[0]: same for same in equal.values()}
        for first, vote, example, cosine in self.passages.each_vote(v, list(copies), left):
            for i in copies[first]:
                found.setdefault(int(owner[i]), []).append((vote, int(number[i]), example, cosine))
        best = {}
        for text, votes in found.items():
            votes.sort(key=lambda x: (-x[0], x[1]))
            strongest = [v for v, *_ in votes[:STRONGEST]]
            best[text] = (np.array(strongest + [0.5] * (STRONGEST - len(strongest))), votes[0][2], votes[0][3])
        return best

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, list, list]:
        """Score, evidence and passage evidence (example id, label, cosine) of each text."""
        whole = self.whole
        score = np.full(len(texts), whole.empty)
        evidence, passage = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        terms = _placed(texts)
        v = whole.weighted(terms[0], terms[2], len(texts))
        first: dict[bytes, int] = {}
        same = {i: first.setdefault(v.terms[a:b].tobytes() + v.weights[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(v.offsets[:-1], v.offsets[1:], strict=True)) if b > a}
        votes = np.full(len(texts), np.nan)
        for i, vote, example, cosine in whole.each_vote(v, list(first.values())):
            votes[i], score[i], evidence[i] = vote, whole.chance(vote), whole.named(example, cosine)
        for i, j in same.items():
            votes[i], score[i], evidence[i] = votes[j], score[j], evidence[j]
        for i, (strongest, example, cosine) in self.passage_votes(texts, terms).items():
            score[i] = self.passages.chance(float(_evidence(strongest[None], votes[i : i + 1])[0])) if self.passages.chances is not None else self.passages.prior
            passage[i] = self.passages.named(example, cosine)
        return score, evidence, passage


def _evidence(votes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """One number for the passages' votes of each text, strongest first, and the vote on its whole (NaN: none).

    The log odds of the strongest, and what the others and the whole add in favour: clean passages
    around a toxic one take nothing away.
    """
    def odds(v: np.ndarray) -> np.ndarray:
        v = np.clip(v, 1e-4, 1 - 1e-4)
        return np.log(v / (1 - v))

    o = odds(votes)
    return np.minimum(o[:, 0], 0) + np.maximum(o, 0).sum(axis=1) + np.maximum(odds(np.where(np.isnan(whole), 0.5, whole)), 0)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, chances): pooled adjacent violators over at most BINS bins of the votes."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    groups = [[float((w[g] * y[g]).sum()), float(w[g].sum()), float((w[g] * x[g]).sum() / w[g].sum())] for g in np.array_split(np.arange(len(x)), min(BINS, len(x))) if len(g)]
    pooled: list[list[float]] = []
    for g in groups:
        pooled.append(g)
        while len(pooled) > 1 and pooled[-2][0] / pooled[-2][1] >= pooled[-1][0] / pooled[-1][1]:
            a, b = pooled.pop(-2), pooled.pop(-1)
            pooled.append([a[0] + b[0], a[1] + b[1], (a[2] * a[1] + b[2] * b[1]) / (a[1] + b[1])])
    votes = np.array([g[2] for g in pooled])
    return votes, np.array([g[0] / g[1] for g in pooled])


def _built(ids: np.ndarray, v: Vectors, label: np.ndarray, weight: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, marks: np.ndarray, frequent: int = HEAD) -> Index:
    """The index of examples given as vectors."""
    prior = float(weight[label].sum() / weight.sum()) if len(label) else 0.0
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(v.offsets))
    order = np.argsort(v.terms, kind="stable")
    held = np.bincount(v.terms, minlength=len(vocabulary)) if len(v.terms) else np.zeros(len(vocabulary), np.int64)
    own = marks[v.terms]
    return Index(vocabulary, idf, marks, ids, label, weight, prior, prior, np.concatenate([[0], np.cumsum(held)]).astype(np.int64), owner[order],
                 v.weights[order], np.bincount(owner[own], v.weights[own] ** 2, minlength=len(ids)), frequent=frequent).prepared()


def _index(ids: np.ndarray, texts: pa.Array, label: np.ndarray, weight: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, marks: np.ndarray | None = None) -> Index:
    """The index of whole texts, with its votes calibrated on the texts, each without its own vote."""
    marks = np.zeros(len(vocabulary), bool) if marks is None else marks
    none = Vectors(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    index = _built(ids[:0], none, label[:0], weight[:0], vocabulary, idf, marks)
    if not len(ids) or not len(vocabulary):
        index.prior = index.empty = float(weight[label].sum() / weight.sum()) if len(label) else 0.0
        return index
    parts = [index.vectors(texts.slice(at, 500)) for at in range(0, len(texts), 500)]
    sizes = np.concatenate([np.diff(p.offsets) for p in parts])
    v = Vectors(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([p.terms for p in parts]), np.concatenate([p.weights for p in parts]))
    index = _built(ids, v, label, weight, vocabulary, idf, marks)
    votes = np.full(len(ids), np.nan)
    rows = np.flatnonzero(sizes).tolist()
    for i, vote, *_ in index.each_vote(v, rows, {i: np.array([i]) for i in rows}):
        votes[i] = vote
    known, index.votes = ~np.isnan(votes), votes
    if known.any():
        index.edges, index.chances = _isotonic(votes[known], label[known].astype(float), weight[known])
    if (~known).any():
        index.empty = float((weight * label)[~known].sum() / weight[~known].sum())
    return index


def _chosen(marking: np.ndarray, texts: pa.Array, label: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text of each passage, passage of each term occurrence, term) by runs of texts.

    The passages that hold a marking term, and ``OTHERS`` of each text of label 0.
    """
    for at in range(0, len(texts), 500):
        owner, place, _, term = _placed(texts.slice(at, 500))
        marked = _windows(marking, owner, place, term)
        held = np.zeros(min(500, len(texts) - at), np.int64)
        np.maximum.at(held, owner, place // PASSAGE + 1)
        clean = np.flatnonzero(~label[at : at + 500] & (held > 0))
        picks = [(clean.astype(np.int64) << 32) + (held[clean] * (2 * k + 1)) // (2 * OTHERS) for k in range(OTHERS)]
        # of a text's marked passages, some spread over it
        first = np.searchsorted(marked[0], marked[0])
        n = np.searchsorted(marked[0], marked[0], side="right") - first
        rank = np.arange(len(first)) - first
        given = (rank * GIVEN) // np.maximum(n, 1) != ((rank - 1) * GIVEN) // np.maximum(n, 1)
        chosen = np.unique(np.concatenate([((marked[0] << 32) + marked[1])[given | (n <= GIVEN)], *picks]))
        text, _, passage, term = _windows(marking, owner, place, term, chosen)
        yield at, text, passage, term


def _passage_index(whole: Index, ids: np.ndarray, texts: pa.Array, label: np.ndarray, weight: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, marks: np.ndarray) -> Index:
    """The index of passages, with the strongest votes of the examples calibrated, each without its own passages."""
    index = _built(ids[:0], Vectors(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)), label[:0], weight[:0], vocabulary, idf, marks)
    owners, passages, terms, rows = [], [], [], 0
    for at, text, passage, term in _chosen(vocabulary[marks], texts, label):
        owners.append(text + at)
        passages.append(passage + rows)
        terms.append(term)
        rows += len(text)
    if not rows:
        return index
    owner = np.concatenate(owners)
    v = index.weighted(np.concatenate(passages), np.concatenate(terms), rows)
    index = _built(ids[owner], v, label[owner], weight[owner], vocabulary, idf, marks, PASSAGE_HEAD)
    starts = np.searchsorted(owner, np.arange(len(ids) + 1))
    index.mark = PASSAGE_MARK
    scorer, votes = Scorer(whole, index), np.full((len(ids), STRONGEST), np.nan)
    for at in range(0, len(texts), 500):
        part = texts.slice(at, 500)
        without = {i: np.arange(starts[at + i], starts[at + i + 1]) for i in range(len(part))}
        for i, (strongest, _, _) in scorer.passage_votes(part, _placed(part), without).items():
            votes[at + i] = strongest
    known = ~np.isnan(votes[:, 0])
    if known.any():
        index.edges, index.chances = _isotonic(_evidence(votes[known], whole.votes[known]), label[known].astype(float), weight[known])
    # the whole text decides where no passage is marked: calibrated on examples of that kind
    rest = ~known & ~np.isnan(whole.votes)
    if rest.any():
        whole.edges, whole.chances = _isotonic(whole.votes[rest], label[rest].astype(float), weight[rest])
    return index


# ---- tables in the shared folder ------------------------------------------------

INDEXES = ("whole", "passages")
STORED = "name string, part int, data binary"
_PART = 4 << 20
_KINDS = {"vocabulary": "<u8", "idf": "<f8", "marks": "?", "ids": "<i8", "label": "?", "weight": "<f8", "starts": "<i8", "example": "<i4", "value": "<f8", "marked": "<f8",
          "edges": "<f8", "chances": "<f8", "scalars": "<f8"}


def _stored(arrays: dict[str, np.ndarray]) -> pa.Table:
    """Arrays as rows of at most ``_PART`` bytes."""
    rows = []
    for name, a in arrays.items():
        data = a.astype(_KINDS[name.rsplit(".", 1)[-1]]).tobytes()
        rows += [(name, k, data[at : at + _PART]) for k, at in enumerate(range(0, max(1, len(data)), _PART))]
    return pa.table({"name": [r[0] for r in rows], "part": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _read(folder: str) -> dict[str, np.ndarray]:
    """The arrays of a stored table, nothing of an empty one."""
    fs, path = filesystem(folder)
    rows = sorted((r["name"], r["part"], r["data"]) for b in pads.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=True).to_batches() for r in b.to_pylist())
    out: dict[str, list[bytes]] = {}
    for name, _, data in rows:
        out.setdefault(name, []).append(data)
    return {n: np.frombuffer(b"".join(d), _KINDS[n.rsplit(".", 1)[-1]]) for n, d in out.items()}


_FIELDS = ("vocabulary", "idf", "marks", "ids", "label", "weight", "starts", "example", "value", "marked")


def _arrays(scorer: Scorer) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for name, index in (("whole", scorer.whole), ("passages", scorer.passages)):
        out |= {f"{name}.{k}": getattr(index, k) for k in _FIELDS} | {f"{name}.scalars": np.array([index.prior, index.empty])}
        out |= {f"{name}.{k}": getattr(index, k) for k in ("edges", "chances") if getattr(index, k) is not None}
    return out


def _scorer(a: dict[str, np.ndarray]) -> Scorer:
    def index(name: str, frequent: int) -> Index:
        prior, empty = a[f"{name}.scalars"].tolist()
        fields = {k: a[f"{name}.{k}"] for k in _FIELDS}
        return Index(prior=prior, empty=empty, edges=a.get(f"{name}.edges"), chances=a.get(f"{name}.chances"), frequent=frequent, **fields).prepared()

    scorer = Scorer(index("whole", HEAD), index("passages", PASSAGE_HEAD))
    scorer.passages.mark = PASSAGE_MARK
    return scorer


def _nothing() -> Scorer:
    empty = np.zeros(0)
    index = _index(empty.astype(np.int64), pa.array([], pa.string()), empty.astype(bool), empty, empty.astype(np.uint64), empty)
    return Scorer(index, index)


def loaded(folder: str) -> Scorer:
    """The indexes of a folder; a worker keeps the last it has read."""
    kept = kept_in_worker("toxicity", dict)
    if folder not in kept:
        kept.clear()
        arrays = _read(folder)
        kept[folder] = _scorer(arrays) if arrays else _nothing()
    return kept[folder]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 1500) -> str:
    """The folder of the indexes of labelled examples; document frequencies of their terms are counted over all ``docs``."""
    spark = docs.sparkSession
    base = workspace(spark, "toxicity")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = {r.toxic: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, max_examples / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, max_examples / max(1, n.get(0, 0)))))
    chosen = marks.where(draw < share)
    # the ids are few (a bounded number of examples), their texts follow them to one place
    examples = written(docs.select("doc_id", "text").join(F.broadcast(chosen) if sum(n.values()) else chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), f"{base}/examples")
    # a sampled row stands for so many rows of its label
    stands = {k: max(1.0, v / max_examples) for k, v in n.items()}

    def sample(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")])).combine_chunks()
        texts = pc.fill_null(table.column("text"), "").combine_chunks()
        label = table.column("toxic").to_numpy() == 1
        return table.column("doc_id").to_numpy(), texts, label, np.where(label, stands.get(1, 1.0), stands.get(0, 1.0))

    def select(table: pa.Table) -> pa.Table:
        _, texts, label, weight = sample(table)

        def terms_of(plain: bool) -> tuple[np.ndarray, np.ndarray]:
            parts = [_apart(texts.slice(at, 500), plain) for at in range(0, len(texts), 500)]
            owner, term, around = (np.concatenate([p[k] + (500 * i if k == 0 else 0) for i, p in enumerate(parts)]) for k in range(3))
            vocabulary = np.unique(term)
            # a passage that texts have copied from each other counts once
            first = np.sort(np.unique(mix(term) ^ around, return_index=True)[1])
            owner, term, _ = _counted(owner[first], term[first])
            return vocabulary, _select(owner, term, label, weight)

        vocabulary, marking = terms_of(False)
        out = {"whole.vocabulary": vocabulary, "whole.marks": np.isin(vocabulary, marking)}
        marking = terms_of(True)[1]
        held = [np.unique(term) for *_, term in _chosen(marking, texts, label)]
        vocabulary = np.unique(np.concatenate([marking, *held]))
        return _stored(out | {"passages.vocabulary": vocabulary, "passages.marks": np.isin(vocabulary, marking)})

    grouped = examples.withColumn("one", F.lit(0)).groupBy("one")
    written(grouped.applyInArrow(select, STORED), f"{base}/terms")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = _read(f"{base}/terms")
        known = [Places(stored.get(f"{k}.vocabulary", np.zeros(0, np.uint64))) for k in INDEXES]
        df, rows = [np.zeros(len(p.vocabulary), np.int64) for p in known], 0
        for batch in slices(batches, limit=2 << 20):
            rows += batch.num_rows
            owner, _, *spaces = _placed(texts_of(batch))
            for places, term, n in zip(known, spaces, df, strict=True):
                if len(n):
                    place, hit = places.known(term)
                    key = _pairs(owner[hit], place[hit], batch.num_rows, len(n))
                    n += np.bincount(key[_new(key)] % key.dtype.type(len(n)), minlength=len(n))
        for space, n in enumerate(df):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"space": pa.array(np.full(len(some) + 1, space), pa.int32()), "term": pa.array(np.concatenate([[-1], some]), pa.int32()), "n": pa.array(np.concatenate([[rows], n[some]]), pa.int64())})

    counted = docs.select("text").mapInArrow(frequencies, "space int, term int, n long")
    written(counted.groupBy("space", "term").agg(F.sum("n").alias("n")), f"{base}/frequencies")

    def build(table: pa.Table) -> pa.Table:
        terms = _read(f"{base}/terms")
        fs, path = filesystem(f"{base}/frequencies")
        counted = pads.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=True).to_table(columns=["space", "term", "n"])
        spaces = []
        for space, name in enumerate(INDEXES):
            own = counted.filter(pc.equal(counted.column("space"), space))
            df = np.zeros(len(terms[f"{name}.vocabulary"]) + 1)
            df[own.column("term").to_numpy()] = own.column("n").to_numpy()  # -1, the last: all rows
            spaces.append((terms[f"{name}.vocabulary"], np.log((df[-1] + 1) / (df[:-1] + 1)) + 1, terms[f"{name}.marks"]))
        own = sample(table)
        whole = _index(*own, *spaces[0])
        return _stored(_arrays(Scorer(whole, _passage_index(whole, *own, *spaces[1]))))

    written(grouped.applyInArrow(build, STORED), f"{base}/index")
    return f"{base}/index"


def score(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, score, evidence, passage) of every document, by the indexes in ``folder``."""
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def listed(found: list) -> pa.Array:
        return pa.array([[{"doc_id": i, "toxic": t, "cosine": c} for i, t, c in e] for e in found], near)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = loaded(folder)
        for batch in slices(batches, limit=2 << 20):
            scores, evidence, passage = scorer.scores(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), listed(evidence), listed(passage)], names=["doc_id", "score", "evidence", "passage"])

    one = "array<struct<doc_id: long, toxic: int, cosine: double>>"
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, score double, evidence {one}, passage {one}")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_examples: int = 1500) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, passage): learned from the rows that aren't held out, scored for all."""
    found = score(docs, fit(docs, labels.where(training_row()), max_examples))
    return found.select("doc_id", (~F.coalesce(training_row(), F.lit(True))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "passage")
