"""MinHash near-duplicates with sequential Bayesian verification.

Documents are linked when the Jaccard similarity of their sets of word shingles reaches
``num / den``. The steps, each linear in its rows:

1. One scan gives every document its shingle count, a 128-bit key of its full set and a
   MinHash signature. Equal sets are one class; everything below works on classes.
2. The signature is cut into bands; classes that share a band's values are candidates. Rows
   and bands follow from the threshold so that a pair exactly at it is missed with at most
   ``miss`` probability.
3. Candidates are verified sequentially: signature values are compared batch by batch, and a
   pair is dropped as soon as the posterior probability (uniform prior) that its similarity
   reaches the threshold is below ``prune``. Survivors are verified exactly on full sets.
4. Only connected components are asked for, so no group's pairs are listed: first every class
   is compared with one hub of its buckets (the class with most neighbours), which collapses groups of
   near copies; then buckets that still hold several components are compared in full, in
   blocks of bounded size, leaving out pairs inside one component; a block passes on a spanning
   forest of its links.

Classes are numbered when they are written and go by that number through every step; ids enter
again at the end, where a component is named by its smallest one. A bucket with over 1/1024 of
all band rows is salted in every join on buckets: there are fewer than 1024 such buckets at any
size, so their list is broadcast.

Defined results: null, empty and blank texts have an empty set and link with nothing; with
fewer words than a shingle the whole sequence is one; repeated rows and exact copies form
one class; rows that share an id but differ in text are documents of their own, each linked by
its own text; rows with a null id are counted but never linked, as no id can name them; an empty
table gives an empty result; other columns are ignored; texts are whole, of any length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corridor.llm.bytewords import shingles, words
from corridor.llm.components import Forest, components
from corridor.llm.shared import grouped, ragged, slices, texts_of, workspace, written

#: Classes, and shingles of classes, in one block of a bucket.
BLOCK = 2048
BLOCK_SHINGLES = 1_500_000
#: A bucket with more than this share of all band rows is salted, into so many parts.
HOT_SHARE, SALTS = 1 / 1024, 64
#: Parts of a component where its rows meet its smallest id.
NAME_SALTS = 16
#: The column that tells the texts of one id apart.
_TEXT_KEY = "_minhash_text_key"
#: Shingles hashed at once, so that the working set stays in cache.
_CACHE = 1 << 15


@dataclass(frozen=True)
class Settings:
    """What counts as near, and the error bounds of the search."""

    size: int = 5
    num: int = 80
    den: int = 100
    miss: float = 1e-6
    prune: float = 1e-6
    batch: int = 16
    most: int = 128

    @property
    def rows(self) -> int:
        """The most selective band that keeps the signature within ``most`` values."""
        return next(r for r in range(8, 0, -1) if r * self.bands_for(r) <= self.most or r == 1)

    @property
    def bands(self) -> int:
        return self.bands_for(self.rows)

    def bands_for(self, rows: int) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.num / self.den) ** rows))

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    def least_matches(self) -> list[tuple[int, int]]:
        """(n, least matches among the first n values for which the posterior stays above ``prune``).

        With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
        """
        t, out = self.num / self.den, []
        for n in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            total, m = 0.0, -1
            while total < self.prune:
                m += 1
                total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_229)
    return (r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(hashes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """MinHash values (sets x n, uint32) of non-empty ragged sets."""
    a, b = _permutations(n)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, n), np.uint32)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CACHE, side="right")) - 1)
        part, begin = x[offsets[at] : offsets[to]], (offsets[at:to] - offsets[at]).astype(np.int64)
        buffer = np.empty_like(part)
        for j in range(n):
            np.multiply(part, a[j], out=buffer)
            np.add(buffer, b[j], out=buffer)
            out[at:to, j] = np.minimum.reduceat(buffer, begin)
        at = to
    return out


def sets_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and offsets by text."""
    h, offsets = shingles(words(texts), size)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    if len(h) > 1:
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def _fingerprints(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, sig) of every document; key and signature are null for empty sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, offsets = sets_of(texts_of(batch), s.size)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            sig = signatures(h, np.concatenate([offsets[:-1][full], offsets[-1:]]), s.hashes) if len(full) else np.zeros((0, s.hashes), np.uint32)
            keys: list[bytes | None] = [None] * len(sizes)
            sigs: list[bytes | None] = [None] * len(sizes)
            for k, i in enumerate(full.tolist()):
                keys[i] = hashlib.blake2b(h[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
                sigs[i] = sig[k].tobytes()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "text_key": batch.column("text_key"), "n_shingles": pa.array(sizes.astype(np.int64)), "set_key": pa.array(keys, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(scan, "doc_id long, text_key long, n_shingles long, set_key binary, sig binary")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """Equal-length binary values as rows of uint32."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, n)


def _survives(left: np.ndarray, right: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices pass every batch of the sequential test."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, m in least:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        good = matches >= m
        alive, matches, done = alive[good], matches[good], n
        if not len(alive):
            break
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _by_salt(buckets: DataFrame) -> DataFrame:
    """A row of each bucket for each of its salts."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _bands(every: DataFrame, rows: int) -> DataFrame:
    """(bucket, salt, salts, rep, n) of the buckets with more than one of the ``rows`` band rows; ``n`` is a bucket's size."""
    hot = rows * HOT_SHARE
    salts = F.when(F.col("n") > hot, SALTS).otherwise(1)
    crowd = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("salts", salts)
    # fewer than 1 / HOT_SHARE rows, as each stands for more than that share
    heavy = F.broadcast(crowd.where(F.col("n") > hot).select("bucket", F.lit(SALTS).alias("parts")))
    salted = every.join(heavy, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int"))
    return salted.join(crowd.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), ["bucket", "salt"]).select("bucket", "salt", "salts", "rep", "n")


def _hub_pairs(bands: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """(a, b): each class with the best hub of its buckets, if the sequential test passes.

    A bucket's hub is its class with the most neighbours over all bands: the original of a group of
    copies rather than an outlier.
    """
    least = s.least_matches()
    weights = bands.groupBy("rep").agg(F.sum("n").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("rep")).alias("low")))
    hubs = bands.join(weights, "rep").groupBy("bucket").agg(best.alias("hub"), F.max("salts").alias("salts"))
    near = bands.join(_by_salt(hubs), ["bucket", "salt"]).groupBy("rep").agg(F.max("hub").alias("hub")).select("rep", (-F.col("hub.low")).alias("hub")).where("hub <> rep")
    pairs = (near.join(classes.select("rep", "sig"), "rep")
             .join(classes.select(F.col("rep").alias("hub"), F.col("sig").alias("hub_sig")), "hub"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = _survives(_matrix(b.column("sig"), s.hashes), _matrix(b.column("hub_sig"), s.hashes), least)
                yield pa.RecordBatch.from_arrays([b.column("hub"), b.column("rep")], names=["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(test, "a long, b long")


def _rest_links(bands: DataFrame, classes: DataFrame, joined: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links between different components so far, from all buckets; of each block's links a spanning forest.

    A bucket is cut into blocks of bounded size and every two blocks meet in one group, so a group
    holds at most two blocks whatever the bucket's size. Candidates pass the sequential test and are
    verified there on full sets, so pairs never leave their task.
    """
    least = s.least_matches()
    comp = bands.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(classes.select("rep", "n_shingles"), "rep").select("bucket", "salt", "salts", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp"))
    size = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = comp.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), size.alias("blocks"), F.max("salts").alias("salts")).where("lo < hi")
    rows = comp.drop("salts").join(_by_salt(blocks.select("bucket", "blocks", "salts")), ["bucket", "salt"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # the group of blocks (i, j), i <= j, gets the rows of both
    rows = rows.select("bucket", "rep", "comp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("rep", "comp", "mine", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("meet"),
                       F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    wide = classes.select("rep", "sig").join(texts, F.col("rep") == F.col("node")).select("rep", "sig", "text")
    rows = rows.join(wide, "rep").repartition("meet").sortWithinPartitions("meet", "rep")

    def links(g: pa.Table) -> list[tuple[int, int]]:
        g = g.combine_chunks()
        rep, comp, mine, i, j = (g.column(c).to_numpy() for c in ("rep", "comp", "mine", "i", "j"))
        sig, sets = _matrix(g.column("sig"), s.hashes), _Sets(*sets_of(g.column("text").combine_chunks().fill_null(""), s.size))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        forest = Forest()
        for p in left:
            q = right[(comp[right] != comp[p]) & ((right > p) | (i[p] != j[p]))]
            q = q[[forest.root(x) != forest.root(int(comp[p])) for x in comp[q].tolist()]] if len(q) else q
            if len(q):
                q = q[_survives(np.broadcast_to(sig[p], (len(q), sig.shape[1])), sig[q], least)]
            if len(q):
                both = sets.common(int(p), q)
                union = sets.sizes[p] + sets.sizes[q] - both
                for k in q[s.den * both >= s.num * union].tolist():
                    forest.add(int(comp[p]), int(comp[k]), (int(rep[p]), int(rep[k])))
        return forest.links

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "meet"):
            if group.num_rows > 1 and (found := links(group)):
                yield pa.RecordBatch.from_pydict({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return rows.mapInArrow(test, "a long, b long")


class _Sets:
    """Sets of a block as sorted ranges, with an inverted index over them."""

    def __init__(self, h: np.ndarray, offsets: np.ndarray):
        self.offsets, self.sizes = offsets, np.diff(offsets)
        values, self.code = np.unique(h, return_inverse=True)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(self.code, kind="stable")
        self.holder = owner[order]
        self.starts = np.searchsorted(self.code[order], np.arange(len(values) + 1))

    def common(self, p: int, q: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set p with the sets q."""
        mine = self.code[self.offsets[p] : self.offsets[p + 1]]
        if len(q) < 8:
            return np.array([_common(mine, self.code[self.offsets[k] : self.offsets[k + 1]]) for k in q.tolist()])
        lengths = self.starts[mine + 1] - self.starts[mine]
        return np.bincount(self.holder[ragged(self.starts[mine], lengths)], minlength=len(self.sizes))[q]


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose full sets reach the threshold.

    A row of the exchange is one text: ``a``'s text once per share of its pairs, each ``b``'s text once
    per pair. A hot ``a`` is salted into shares, so no task holds all of its partners; a task keeps one
    set and streams the others.
    """
    share = 256
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
    salted = pairs.join(count, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    wanted = salted.select("a", "share", F.col("b").alias("node"), F.lit(1).alias("role")).union(
        salted.select("a", "share", F.col("a").alias("node"), F.lit(0).alias("role")).distinct())
    rows = wanted.join(texts, "node").select("a", "share", "role", "node", "text")
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", "role")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: np.ndarray | None = None
        whose: int | None = None
        for batch in slices(batches):
            h, offsets = sets_of(texts_of(batch), s.size)
            a, role, node = (batch.column(c).to_pylist() for c in ("a", "role", "node"))
            out: list[tuple[int, int]] = []
            for i in range(len(a)):
                mine = h[offsets[i] : offsets[i + 1]]
                if role[i] == 0:
                    base, whose = mine.copy(), a[i]
                elif whose == a[i] and base is not None:
                    both = _common(base, mine)
                    if s.den * both >= s.num * (len(base) + len(mine) - both):
                        out.append((a[i], node[i]))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.mapInArrow(verify, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _members(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_key, n_shingles, class_id, root, smallest) of every row.

    ``class_id`` is the smallest id of the class, ``root`` a number of the component and ``smallest`` its
    smallest id; all three are null for rows that link with nothing.
    """
    base = workspace(docs.sparkSession, "minhash")
    prints = written(_fingerprints(docs, s), f"{base}/prints")
    keyed = prints.where("set_key is not null and doc_id is not null")
    # the rows of a class have one size and signature, so any of them will do; numbers are fixed by the write
    source = F.min(F.struct("doc_id", "text_key")).alias("source")
    made = keyed.groupBy("set_key").agg(source, F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = written(made.select(F.monotonically_increasing_id().alias("rep"), "set_key", "source.doc_id", "source.text_key", "sig", "n_shingles"), f"{base}/classes")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = _matrix(b.column("sig"), s.hashes)
                buckets = np.empty((len(sig), s.bands), np.int64)
                mult = np.random.default_rng(7).integers(0, 1 << 63, (s.bands, s.rows + 1), dtype=np.uint64) | np.uint64(1)
                for j in range(s.bands):
                    x = np.full(len(sig), mult[j, -1], np.uint64)
                    for r in range(s.rows):
                        x = (x ^ (sig[:, j * s.rows + r].astype(np.uint64) * mult[j, r])) * np.uint64(0x9E3779B97F4A7C15)
                        x ^= x >> np.uint64(29)
                    buckets[:, j] = x.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(np.repeat(b.column("rep").to_numpy(), s.bands))], names=["bucket", "rep"])

    every = classes.select("rep", "sig").mapInArrow(band, "bucket long, rep long")
    bands = written(_bands(every, classes.count() * s.bands), f"{base}/bands")

    crowd = bands.select("rep").distinct().join(classes.select("rep", "doc_id", "text_key"), "rep")
    # repeated rows collapse before the shuffle that meets the classes
    once = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").dropDuplicates(["doc_id", "text_key"])
    texts = written(once.join(crowd, ["doc_id", "text_key"]).select(F.col("rep").alias("node"), "text"), f"{base}/texts")

    hub = written(_verified(written(_hub_pairs(bands, classes, s), f"{base}/hub-pairs"), texts, s), f"{base}/hub-links")
    joined = written(components(hub, "minhash-hubs"), f"{base}/hub-components")
    rest = written(_rest_links(bands, classes, joined, texts, s), f"{base}/rest-links")
    found = components(hub.union(rest), "minhash-components")

    own = classes.select("rep", "set_key", F.col("doc_id").alias("class_id"))
    linked = own.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    grown = written(linked.where("component is not null").withColumn("salt", F.pmod("rep", F.lit(NAME_SALTS)).cast("int")), f"{base}/linked")
    least = grown.groupBy("root").agg(F.min("class_id").alias("smallest")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1))))
    columns = ["set_key", "class_id", "root", "smallest"]
    alone = linked.where("component is null").withColumn("smallest", F.col("class_id"))
    named = grown.join(least, ["root", "salt"]).select(columns).union(alone.select(columns))
    out = prints.join(named, "set_key", "left")
    mine = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_key", "n_shingles", *(F.when(mine, F.col(c)).alias(c) for c in columns[1:]))


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) of every document.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable by links.
    """
    component = F.coalesce("smallest", "doc_id")
    return _members(docs, settings or Settings()).select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents, all columns, with one of each group of near-duplicates: the smallest id, of its texts one.

    Rows that link with nothing stay, repeated rows of them once; rows with a null id stay as they are.
    """
    members = _members(docs, settings or Settings()).where("doc_id is not null")
    first = F.min(F.struct("doc_id", "text_key")).alias("one")
    chosen = members.where("root is not null").groupBy("root").agg(first).select("one.doc_id", "one.text_key")
    kept = chosen.union(members.where("root is null").select("doc_id", "text_key").distinct())
    kept = kept.select(F.col("doc_id").alias("_minhash_id"), F.col("text_key").alias(_TEXT_KEY + "_kept"))
    mine = docs.where("doc_id is not null").withColumn(_TEXT_KEY, F.xxhash64("text"))
    met = mine.join(kept, (mine.doc_id == kept._minhash_id) & (mine[_TEXT_KEY] == kept[_TEXT_KEY + "_kept"]), "left_semi")
    return met.dropDuplicates(["doc_id", _TEXT_KEY]).select(docs.columns).union(docs.where("doc_id is null"))
