"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood by scaled forward recursion.

Tokens are words (maximal runs of other signs than space and 0x09-0x0D, A-Z lower-cased) and one
end per text. A latent state emits a word class, and the class its word:

* every word that makes up at least 1 / ``CLASSES`` of the training tokens is a class of its
  own, so there are at most ``CLASSES`` of these whatever the corpus; the other words share
  ``SHARED`` classes by hash, and words never seen in training are one class;
* P(word | class) = (c + 0.5) / (count + 0.5 * types of the class), P(class | state) is learned and
  smoothed alike. With one state the model is exactly the smoothed unigram model ``base_score``.

Steps:

1. One scan turns texts into chunks: local word indices, the chunk's distinct words (64-bit
   hashes) and their training counts.
2. Counts meet by hash bucket, one row per chunk and bucket, and go back to the chunks; every
   chunk is rewritten as class numbers. This table in the shared folder is all that later steps
   read.
3. Baum-Welch: ``warm_rounds`` and then ``rounds`` passes, each over all training documents,
   whose expected counts are summed by class across partitions. No pass reads a sample.
   For these passes a text is a sequence per ``SEGMENT`` tokens.
4. Scoring runs the scaled forward recursion over every whole text.

Defined results: null and empty texts are the end token alone; rows with a null id are learned
from; repeated rows count each; without training rows every score is that of unseen words; an
empty table gives an empty result; other columns are ignored; texts are whole, of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corridor.llm.bytewords import words
from corridor.llm.shared import slices, texts_of, workspace, written

CLASSES = 1 << 17
SHARED = 256
SEGMENT = 512
#: Tokens in one batch of the forward-backward recursion, and bytes of text in a chunk.
BATCH = 200_000
CHUNK = 8 << 20
#: Distinct words of all chunks that meet in one task.
BUCKET = 1_000_000
#: The end token stands beside the words' hashes.
END = np.uint64(0xE0E0_0000_0000_0E0D)

_CHUNK = "chunk long, ids binary, null binary, held binary, offsets binary, tokens binary, words binary, counts binary, n_words long, n_train long"
_ENCODED = "chunk long, ids binary, null binary, held binary, offsets binary, classes binary, known binary, base binary, within binary"


def _chunks(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """A row per slice of documents, texts as indices into the slice's distinct words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, limit=CHUNK):
            ids = batch.column("doc_id").cast(pa.int64())
            held = np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in ids.to_pylist()], bool)
            w = words(texts_of(batch))
            n = np.diff(w.offsets)
            flat = np.insert(w.hashes, w.offsets[1:], END)
            offsets = w.offsets + np.arange(len(w.offsets))
            distinct, index = np.unique(flat, return_inverse=True)
            train = np.bincount(index, np.repeat(~held, n + 1), minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([task << 32 | k]), "ids": [ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], "null": [ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes()],
                "held": [held.astype("u1").tobytes()], "offsets": [offsets.astype("<i8").tobytes()], "tokens": [index.astype("<u4").tobytes()],
                "words": [distinct.tobytes()], "counts": [train.tobytes()], "n_words": pa.array([len(distinct)]), "n_train": pa.array([int(train.sum())])},
                schema=pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "null", "held", "offsets", "tokens", "words", "counts")), ("n_words", pa.int64()), ("n_train", pa.int64())]))
            k += 1

    return docs.select("doc_id", "text").mapInArrow(scan, _CHUNK)


def _merged(chunks: DataFrame, n_words: int, n_train: int) -> DataFrame:
    """Training counts of the words: a row per chunk and bucket, and one per bucket (chunk -1) for its totals."""
    buckets = max(1, -(-n_words // BUCKET))
    frequent = max(1, -(-n_train // CLASSES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, w, c in zip(b.column("chunk").to_pylist(), b.column("words").to_pylist(), b.column("counts").to_pylist(), strict=True):
                w, c = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                mine = w % np.uint64(buckets)
                for k in np.unique(mine).tolist():
                    at = mine == k
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "words": [w[at].tobytes()], "counts": [c[at].tobytes()]},
                                                     schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]))

    def merge(t: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]
        distinct, index = np.unique(np.concatenate(blocks), return_inverse=True)
        c = np.bincount(index, np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()])).astype(np.int64)
        cuts = np.cumsum([len(b) for b in blocks])[:-1]
        back = [x.tobytes() for x in np.split(c[index], cuts)]
        own = (c >= frequent) & (c > 0)
        rare = distinct[(c > 0) & ~own] % np.uint64(SHARED)
        none = [None] * len(back)
        return pa.table({
            "chunk": pa.array([*t.column("chunk").to_pylist(), -1], pa.int64()), "bucket": pa.array([*t.column("bucket").to_pylist(), t.column("bucket")[0].as_py()], pa.int64()),
            "counts": pa.array([*back, b""], pa.binary()), "types": pa.array([0] * len(back) + [int((c > 0).sum())], pa.int64()),
            "own": pa.array([*none, distinct[own].view(np.int64).tolist()], pa.list_(pa.int64())), "own_counts": pa.array([*none, c[own].tolist()], pa.list_(pa.int64())),
            "shared_counts": pa.array([*none, np.bincount(rare.astype(np.int64), c[(c > 0) & ~own], minlength=SHARED).astype(np.int64).tolist()], pa.list_(pa.int64())),
            "shared_types": pa.array([*none, np.bincount(rare.astype(np.int64), minlength=SHARED).tolist()], pa.list_(pa.int64()))})

    dealt = chunks.select("chunk", "words", "counts").mapInArrow(deal, "bucket long, chunk long, words binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(
        merge, "chunk long, bucket long, counts binary, types long, own array<long>, own_counts array<long>, shared_counts array<long>, shared_types array<long>")


@dataclass
class Vocabulary:
    """Classes of words: the frequent words' own, then the shared ones, then the unseen words'."""

    words: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray  # by class
    types: np.ndarray
    tokens: int
    buckets: int

    @property
    def distinct(self) -> int:
        return int(self.types.sum()) - 1

    def encode(self, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Class of each word, given its training count."""
        place = np.searchsorted(self.words, w)
        place[place == len(self.words)] = 0
        own = self.words[place] == w if len(self.words) else np.zeros(len(w), bool)
        return np.where(own, place, np.where(c > 0, len(self.words) + (w % np.uint64(SHARED)).astype(np.int64), len(self.counts) - 1))


def _vocabulary(merged: DataFrame, n_train: int, buckets: int) -> Vocabulary:
    totals = merged.where("chunk = -1")
    pairs = totals.select(F.explode(F.arrays_zip("own", "own_counts")).alias("x")).select("x.*").collect()  # at most CLASSES rows
    pairs.sort(key=lambda r: r.own & (1 << 64) - 1)
    shared = totals.select(F.posexplode(F.arrays_zip("shared_counts", "shared_types")).alias("class", "x")).groupBy("class").agg(
        F.sum("x.shared_counts").alias("c"), F.sum("x.shared_types").alias("t")).collect()
    own = np.array([r.own_counts for r in pairs], np.int64)
    c, t = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in shared:
        c[r["class"]], t[r["class"]] = r.c, r.t
    return Vocabulary(np.array([r.own for r in pairs], np.int64).view(np.uint64), np.concatenate([own, c, [0]]), np.concatenate([np.ones(len(own), np.int64), t, [1]]), n_train, buckets)


def _encoded(chunks: DataFrame, merged: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The chunks as class numbers, with what doesn't depend on the states summed by text."""
    sent = chunks.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        v, one = sent.value, {c: left.column(c)[0].as_py() for c in left.column_names}
        w = np.frombuffer(one["words"], np.uint64)
        c = np.zeros(len(w), np.int64)
        mine = w % np.uint64(v.buckets)
        for bucket, counts in zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True):
            c[mine == bucket] = np.frombuffer(counts, np.int64)
        classes = v.encode(w, c)
        base = np.log10((c + 0.5) / (v.tokens + 0.5 * (v.distinct + 1)))
        within = np.log10((c + 0.5) / (v.counts[classes] + 0.5 * v.types[classes]))
        tokens, offsets = np.frombuffer(one["tokens"], "<u4"), np.frombuffer(one["offsets"], "<i8")
        starts = offsets[:-1]
        out = {"ids": one["ids"], "null": one["null"], "held": one["held"], "offsets": one["offsets"], "classes": classes.astype("<u4")[tokens].tobytes(),
               "known": np.add.reduceat((c > 0).astype(np.int64)[tokens], starts).tobytes(), "base": np.add.reduceat(base[tokens], starts).tobytes(), "within": np.add.reduceat(within[tokens], starts).tobytes()}
        return pa.table({"chunk": left.column("chunk"), **{k: pa.array([x], pa.binary()) for k, x in out.items()}})

    wide = chunks.drop("counts", "n_words", "n_train").groupBy("chunk")
    return wide.cogroup(merged.where("chunk >= 0").select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(encode, _ENCODED)


@dataclass
class Hmm:
    """Start, transition and emission (class x state) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


@dataclass
class Expected:
    """Expected counts of one or more passes over sequences."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def zero(states: int, classes: int) -> Expected:
        return Expected(np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)))

    def add(self, model: Hmm, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Forward-backward over the sequences, all of one batch side by side."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # sequences longer than t
        k = len(model.start)
        at = np.concatenate([starts[:n] + t for t, n in enumerate(active.tolist())])
        c = classes[at]
        # a row per state, so that a step's sequences lie side by side
        out = np.ascontiguousarray(model.emit[c].T)
        edge = np.concatenate([[0], np.cumsum(active)]).tolist()
        alpha, scale = np.empty((k, len(c))), np.empty(len(c))
        forward = np.ascontiguousarray(model.move.T)
        for t, n in enumerate(active.tolist()):
            lo, hi = edge[t], edge[t + 1]
            a = (forward @ alpha[:, edge[t - 1] : edge[t - 1] + n] if t else model.start[:, None]) * out[:, lo:hi]
            s = a.sum(axis=0)
            scale[lo:hi] = s
            np.divide(a, s, out=alpha[:, lo:hi])
        beta = np.ones((k, len(c)))
        out /= scale
        moved = np.zeros((k, k))
        for t in range(len(active) - 1, 0, -1):
            lo, hi = edge[t], edge[t + 1]
            later = beta[:, lo:hi] * out[:, lo:hi]
            before = slice(edge[t - 1], edge[t - 1] + hi - lo)
            moved += alpha[:, before] @ later.T
            beta[:, before] = model.move @ later
        self.move += model.move * moved
        alpha *= beta
        self.start += alpha[:, : active[0]].sum(axis=1)
        for s in range(k):
            self.emit[:, s] += np.bincount(c, alpha[s], minlength=len(self.emit))

    def model(self, v: Vocabulary) -> Hmm:
        """The next parameters: emission smoothed towards a uniform choice of word types, as in ``base_score``."""
        total = self.emit.sum(axis=0)
        extra = total / max(v.tokens, 1) * 0.5 * (v.distinct + 1)
        emit = (self.emit + extra * (v.types / (v.distinct + 1))[:, None]) / np.maximum(total + extra, 1e-300)
        start = self.start + 0.1
        move = self.move + 0.1
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)


def _sequences(offsets: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (starts, lengths) of the segments of the chosen texts."""
    n = np.diff(offsets)[chosen]
    parts = -(-n // SEGMENT)
    number = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(offsets[:-1][chosen], parts) + number * SEGMENT
    lengths = np.minimum(SEGMENT, np.repeat(n, parts) - number * SEGMENT)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    cut = np.flatnonzero(np.diff(np.cumsum(lengths) // BATCH)) + 1
    yield from ((s, x) for s, x in zip(np.split(starts, cut), np.split(lengths, cut), strict=True) if len(s))


def log10_likelihood(model: Hmm, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 P(classes of each text) by the scaled forward recursion; texts are never empty."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    out = np.zeros(len(order))
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []
    a, forward = np.zeros((len(model.start), 0)), np.ascontiguousarray(model.move.T)
    for t, n in enumerate(np.asarray(active).tolist()):
        a = (forward @ a[:, :n] if t else model.start[:, None]) * model.emit[classes[starts[:n] + t]].T
        s = a.sum(axis=0)
        a /= s
        out[:n] += np.log10(s)
    result = np.empty(len(order))
    result[order] = out
    return result


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["classes"], "<u4"), np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["held"], "u1").astype(bool)


def _first(v: Vocabulary, states: int, seed: int) -> Hmm:
    """Sticky states whose emissions are the corpus frequencies, disturbed."""
    noise = np.exp(np.random.default_rng(seed).normal(0, 1, (len(v.counts), states))) if states > 1 else np.ones((len(v.counts), 1))
    e = Expected(np.ones(states), np.full((states, states), 1.0) + np.eye(states) * 20 * states, v.counts[:, None] * noise)
    e.emit *= v.tokens / states / np.maximum(e.emit.sum(axis=0), 1e-300)
    return e.model(v)


def _pass(encoded: DataFrame, v: Vocabulary, model: Hmm) -> Hmm:
    """One round of Baum-Welch over all training documents."""
    states = len(model.start)
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    columns = [f"s{k}" for k in range(states)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        e = Expected.zero(states, len(m.emit))
        for b in batches:
            for row in b.to_pylist():
                classes, offsets, held = _arrays(row)
                for s, n in _sequences(offsets, ~held):
                    e.add(m, classes, s, n)
        seen = np.flatnonzero(e.emit.any(axis=1))
        table = np.concatenate([e.emit[seen], e.move, e.start[None]])
        key = np.concatenate([seen, -1 - np.arange(states + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(pa.array(table[:, k]) for k in range(states))], names=["class", *columns])

    rows = encoded.select("classes", "offsets", "held").mapInArrow(expect, "class int, " + ", ".join(f"{c} double" for c in columns))
    # at most one row a class: bounded by CLASSES + SHARED
    summed = rows.groupBy("class").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    key, values = summed.column("class").to_numpy(), np.stack([summed.column(c).to_numpy() for c in columns], axis=1)
    e = Expected.zero(states, len(v.counts))
    e.emit[key[key >= 0]] = values[key >= 0]
    for k in range(states):
        e.move[k] = values[key == -1 - k].sum(axis=0)
    e.start = values[key == -1 - states].sum(axis=0)
    return e.model(v)


def language_model(docs: DataFrame, states: int = 8, rounds: int = 2, warm_docs: int | None = None, warm_rounds: int = 8, modulus: int = 5, remainder: int = 1, seed: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Rows whose crc32 of the id as text leaves ``remainder`` modulo ``modulus`` are held out of training.
    ``warm_docs`` has no effect (it once sized a sample): every round reads all training documents.
    """
    spark: SparkSession = docs.sparkSession
    base = workspace(spark, "lm")
    chunks = written(_chunks(docs, modulus, remainder), f"{base}/chunks")
    n_words, n_train = (int(x or 0) for x in chunks.agg(F.sum("n_words"), F.sum("n_train")).first())
    merged = written(_merged(chunks, n_words, n_train), f"{base}/counts")
    v = _vocabulary(merged, n_train, max(1, -(-n_words // BUCKET)))
    encoded = written(_encoded(chunks, merged, v), f"{base}/encoded")
    model = _first(v, states, seed)
    for _ in range(warm_rounds + rounds if n_train else 0):
        model = _pass(encoded, v, model)
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                classes, offsets, held = _arrays(row)
                value = log10_likelihood(sent.value, classes, offsets) + np.frombuffer(row["within"], np.float64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["null"], "u1").astype(bool)), "held_out": pa.array(held),
                    "n_tokens": pa.array(np.diff(offsets)), "n_known": pa.array(np.frombuffer(row["known"], np.int64)), "train_tokens": pa.array(np.full(len(held), n_train, np.int64)),
                    "base_score": pa.array(np.frombuffer(row["base"], np.float64)), "score": pa.array(value)})

    return encoded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
