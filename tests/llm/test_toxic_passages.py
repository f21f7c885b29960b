"""Toxic passages inside clean texts, and the block-max index against a full scan."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from corridor.llm import bytewords, toxicity
from corridor.llm.toxicity import BLOCK, NEIGHBOURS

from .test_operators import SF, crc


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()


def test_toxic_passages_inside_clean_texts_are_caught(spark, labelled):
    """Held-out toxic texts appended to clean ones, between clean ones, and cut to a passage inside them."""
    docs, labels, rows = labelled
    held = [r for r in rows if crc(r.doc_id) % 3 == 1]
    toxic, clean = [r.text for r in held if r.toxic], [r.text for r in held if not r.toxic]
    rnd = random.Random(4)
    planted = []
    for t in toxic[:80]:
        planted += [rnd.choice(clean) + "\n" + t, "\n".join([*rnd.sample(clean, 2), t, rnd.choice(clean)])]
    mixed = ["\n".join(rnd.sample(clean, 3)) for _ in range(200)]
    new = spark.createDataFrame([(10_000_000 + i, x) for i, x in enumerate(planted)] + [(20_000_000 + i, x) for i, x in enumerate(mixed)], "doc_id long, text string")
    got = toxicity.score(new, toxicity.fit(docs, labels.where("crc32(cast(doc_id as string)) % 3 <> 1"))).collect()
    caught = [r.score >= 0.7 for r in got if r.doc_id < 20_000_000]
    left = [r.score < 0.7 for r in got if r.doc_id >= 20_000_000]
    assert sum(caught) >= 0.8 * len(caught) and sum(left) >= 0.99 * len(left), (sum(caught), len(caught), sum(left), len(left))
    assert all(r.passage for r in got if r.score >= 0.7 and r.doc_id < 20_000_000)


def test_blocks_are_skipped_and_nothing_is_lost(labelled):
    """The k nearest equal those of a full scan, though blocks of other languages are skipped."""
    rows = labelled[2][:1200]
    texts = pa.array([r.text for r in rows], pa.string())
    label = np.array([r.toxic == 1 for r in rows])
    owner, term, _ = toxicity._counted(*toxicity._terms(texts))
    vocabulary = np.unique(term)
    idf = np.log((len(rows) + 1) / (np.bincount(np.searchsorted(vocabulary, term)) + 1)) + 1
    index = toxicity._index(np.arange(len(rows)), texts, label, np.ones(len(rows)), vocabulary, idf)
    v = index.vectors(texts)
    index.skipped = index.scored = 0
    some = list(range(0, len(rows), 3))
    for i, example, cosine, _ in index.each_nearest(v, some, {i: np.array([i]) for i in some}):
        terms, values = v.terms[v.offsets[i] : v.offsets[i + 1]], v.weights[v.offsets[i] : v.offsets[i + 1]]
        every = index._products(terms, values)
        every[i] = 0
        best = np.sort(every[every > 0])[::-1][:NEIGHBOURS]
        assert np.allclose(cosine, best) and np.allclose(every[example], cosine)
    assert index.skipped > 0.1 * (index.skipped + index.scored), (index.skipped, index.scored)
    assert len(index.order) == len(rows) > 10 * BLOCK and sorted(index.order.tolist()) == list(range(len(rows)))


def test_passages_hold_the_words_around_a_mark():
    words = [f"w{i}" for i in range(100)]
    words[37] = "bad"
    texts = pa.array([" ".join(words), "none of it", "bad"], pa.string())
    owner, at, _, term = toxicity._placed(texts)
    mark = toxicity._placed(pa.array(["bad"]))[3]
    text, number, passage, terms = toxicity._windows(mark, owner, at, term)
    assert list(zip(text.tolist(), number.tolist(), strict=True)) == [(0, 2), (2, 0)]
    hashed = {w: toxicity._placed(pa.array([w]))[3][0] for w in words}
    assert {w for w in words if hashed[w] in set(terms[passage == 0].tolist())} == set(words[32:48])


def test_scores_of_stored_and_built_indexes_agree(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    folder = toxicity.fit(docs, labels)
    scorer = toxicity.loaded(folder)
    rows = docs.orderBy("doc_id").limit(200).collect()
    scores, evidence, _ = scorer.scores(pa.array([r.text for r in rows], pa.string()))
    got = {r.doc_id: r for r in toxicity.score(docs, folder).collect()}
    assert np.allclose([got[r.doc_id].score for r in rows], scores)
    assert all([tuple(e) for e in got[r.doc_id].evidence] == e2 for r, e2 in zip(rows, evidence, strict=True))


def test_places_of_terms_in_a_vocabulary():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 5000):
        some = draw.integers(0, 2**64, n, dtype=np.uint64)
        vocabulary = np.unique(np.concatenate([some, np.arange(40, dtype=np.uint64), np.array([2**64 - 1], np.uint64)])) if n > 2 else np.unique(some)
        term = np.concatenate([vocabulary, draw.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        place, hit = toxicity.Places(vocabulary).known(term)
        assert (hit == np.isin(term, vocabulary)).all() and (vocabulary[place[hit]] == term[hit]).all()


def test_batches_of_queries_add_up_like_single_ones(monkeypatch):
    """Sums over several queries at once, in chunks of any size, are those of each query alone."""
    texts = pa.array([f"w{i % 7} x{i % 11} y{i % 5} z{i}" for i in range(200)])
    owner, term, _ = toxicity._counted(*toxicity._terms(texts))
    vocabulary = np.unique(term)
    index = toxicity._index(np.arange(200), texts, np.arange(200) % 3 == 0, np.ones(200), vocabulary, np.linspace(1, 2, len(vocabulary)))
    v = index.vectors(texts)
    queries = [(v.terms[a:b], v.weights[a:b]) for a, b in zip(v.offsets[:-1], v.offsets[1:], strict=True)] + [(v.terms[:0], v.weights[:0])]
    single = np.stack([index._products(*q)[index.order] for q in queries])
    for postings in (1, 500, 1 << 20):
        monkeypatch.setattr(toxicity, "POSTINGS", postings)
        assert np.allclose(index._sums(queries), single, atol=1e-12)


def test_hashes_of_words_without_their_endings():
    """All endings from one pass equal the hashes of the shorter words, also over block borders and in words longer than a block."""
    texts = pa.array(["ab abcdef " * 9000, "x" * 70_000 + " stem stems stemmed", "", "é" * 40_000])
    w = bytewords.words(texts)
    cuts = (0, *toxicity.ENDINGS)
    for n, got in zip(cuts, bytewords.cut_hashes(w.data, w.starts, w.ends, cuts), strict=True):
        long = w.ends - w.starts > n
        short = pa.array([w.data[a : b - n].tobytes().decode("latin-1") for a, b in zip(w.starts[long], w.ends[long], strict=True)])
        plain = np.concatenate([np.frombuffer(x.encode("latin-1") + b" ", np.uint8) for x in short.to_pylist()])
        ends = np.flatnonzero(plain == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        assert (got[long] == bytewords.hashes_of(plain, starts, ends)).all()


def test_windows_equal_a_plain_search():
    draw = np.random.default_rng(3)
    owner, at = np.sort(draw.integers(0, 30, 4000)), draw.integers(0, 90, 4000)
    term = draw.integers(0, 2**64, 300, dtype=np.uint64)[draw.integers(0, 300, 4000)]
    for marking in (np.unique(term)[:3], np.unique(term)[:0], np.array([5], np.uint64)):
        text, number, passage, terms = toxicity._windows(marking, owner, at, term)
        chosen = sorted({(int(o), int(a) // toxicity.PASSAGE) for o, a, t in zip(owner, at, term, strict=True) if t in set(marking.tolist())})
        assert list(zip(text.tolist(), number.tolist(), strict=True)) == chosen
        want = sorted((chosen.index((o, a // toxicity.PASSAGE)), t) for o, a, t in zip(owner.tolist(), at.tolist(), term.tolist(), strict=True) if (o, a // toxicity.PASSAGE) in chosen)
        assert sorted(zip(passage.tolist(), terms.tolist(), strict=True)) == want


def _plain(texts: list[str]) -> tuple[toxicity.Index, toxicity.Vectors]:
    """An index of the texts over all their terms, and their vectors."""
    array = pa.array(texts)
    owner, term, _ = toxicity._counted(*toxicity._terms(array))
    vocabulary = np.unique(term)
    n = len(texts)
    index = toxicity._index(np.arange(n), array, np.arange(n) % 3 == 0, np.ones(n), vocabulary, np.linspace(1, 2, len(vocabulary)))
    return index, index.vectors(array)


def test_neighbours_and_cosines_do_not_depend_on_the_batch(monkeypatch):
    """Bit by bit those of a query alone, also where examples are nearly as near as each other."""
    r = np.random.default_rng(7)
    pool = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in ("nter", "shing", "ldest", "r")]
    texts = [" ".join(r.choice(pool, int(r.integers(20, 120)))) for _ in range(700)]
    texts += [texts[k] + f" rare{k}x{j}" for k in range(20) for j in range(12)]
    index, v = _plain(texts)
    rows = list(range(len(texts)))
    found = {i: (e, c) for i, e, c, _ in index.each_nearest(v, rows)}
    dense = np.zeros((len(texts), len(index.vocabulary)))
    for i in rows:
        dense[i, v.terms[v.offsets[i] : v.offsets[i + 1]]] = v.weights[v.offsets[i] : v.offsets[i + 1]]
    every = dense @ dense.T
    for i in rows[::7] + rows[700:]:
        example, cosine = index.nearest(v.terms[v.offsets[i] : v.offsets[i + 1]], v.weights[v.offsets[i] : v.offsets[i + 1]])
        assert (found[i][0] == example).all() and (found[i][1] == cosine).all()
        best = np.lexsort((rows, -np.round(every[i], 12)))[:NEIGHBOURS]
        assert np.allclose(cosine, every[i][best], rtol=0, atol=1e-12) and np.allclose(every[i][example], cosine, rtol=0, atol=1e-12)


def test_postings_of_terms_that_occur_once_need_no_weights():
    """Only those that occur more often in an example carry a weight of their own; the sums are those of the full vectors."""
    r = np.random.default_rng(8)
    texts = [" ".join(r.choice([f"w{k}ord" for k in range(400)], int(r.integers(5, 60)))) for _ in range(150)] + ["twice twice"]
    index, v = _plain(texts)
    assert 0 < len(index.more) < 0.5 * len(index.value)
    dense = np.zeros((len(texts), len(index.vocabulary)))
    for i in range(len(texts)):
        dense[i, v.terms[v.offsets[i] : v.offsets[i + 1]]] = v.weights[v.offsets[i] : v.offsets[i + 1]]
    queries = [(v.terms[a:b], v.weights[a:b]) for a, b in zip(v.offsets[:-1], v.offsets[1:], strict=True)]
    assert np.allclose(index._sums(queries), (dense @ dense.T)[:, index.order], rtol=0, atol=1e-12)


def test_words_with_signs_and_their_stems():
    """Signs are left out of a word's hash, but count among the bytes that a stem loses."""
    texts = pa.array(["Don't 'quoted', (well-known) walked", "", "--", "état l'état", "x" * 40_000 + "'s walking"])
    w, short = bytewords.content_words(texts, toxicity.ENDINGS, toxicity.STEM)
    spans = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    assert spans[:4] == [b"don't", b"quoted", b"well-known", b"walked"] and np.diff(w.offsets).tolist() == [4, 0, 0, 2, 2]

    def hashed(x: bytes) -> np.uint64:
        return bytewords.hashes_of(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]

    assert w.hashes.tolist() == [hashed(x.replace(b"'", b"").replace(b"-", b"")) for x in spans]
    for n, got in zip(toxicity.ENDINGS, short, strict=True):
        assert got.tolist() == [hashed(x[:-n]) if len(x) - n >= toxicity.STEM else 0 for x in spans]
