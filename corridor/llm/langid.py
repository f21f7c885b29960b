"""Language identification in two levels: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte 2- to 4-grams of the lower-cased text, with every run of other signs
than letters as one blank; a text is the mean of its n-grams' weights, so scoring is a sum
over the whole text. The models (one weight vector per pair of families and per pair of
languages of one family) are linear SVMs with squared hinge loss, trained by accelerated
gradient steps in one task on a bounded sample of labelled rows: at most about ``max_rows``
texts, an equal number of each language. Margins become probabilities by a logistic scale
fitted on the training margins; the score is P(family) * P(language | family), pairs being
combined by their mean.

Languages are put into families by ``FAMILIES``; others are a family of their own.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
first family or language in alphabetical order; repeated rows are predicted each; an empty
table gives an empty result; without training rows every text is ``und``; other columns are
ignored; whole texts count.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corridor.llm.bytewords import text_bytes
from corridor.llm.shared import slices, texts_of, workspace

#: Usual genealogy of widely written languages.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "sinitic": ("yue", "zh"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
}
#: Hashed n-grams of each length have 2^BITS places.
BITS = 11
#: Bytes of text at once; n-grams take some thirty times as much.
SLICE = 4 << 20
UNDETERMINED = "und"


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def training_row(salt: int = 1, modulus: int = 3) -> Column:
    """Rows whose crc32 of the id as text leaves another remainder than ``salt``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != salt


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams (n = 2, 3, 4) that begin at each byte of the cleaned texts, and byte offsets by text."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    letter = _LETTER[data]
    # one blank for each run of other signs: keep letters and the first other sign after a letter
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    keep = letter | (np.concatenate([[False], letter[:-1]]) & ~first[:-1]) if len(data) else letter
    clean = np.where(letter, data, 32)[keep].astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = []
    for n in (2, 3, 4):
        h = np.zeros(len(clean), np.uint64)
        for k in range(n):
            part = clean[k:]
            h[: len(part)] = (h[: len(part)] + part + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out.append((h >> np.uint64(64 - 9 - BITS) & np.uint64((1 << BITS) - 1)).astype(np.int32))
    return out, ends


def features(texts: pa.Array) -> np.ndarray:
    """Relative n-gram frequencies, one row of 3 * 2^BITS per text."""
    size = 1 << BITS
    out = np.zeros((len(texts), 3 * size), np.float32)
    at = 0
    for batch in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), limit=SLICE):
        grams, ends = _grams(batch.column(0))
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), at):
            if b > a:
                for n, g in enumerate(grams):
                    out[i, n * size : (n + 1) * size] = np.bincount(g[a : max(a, b - n - 1)], minlength=size) / (b - a)
        at += batch.num_rows
    return out


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 120) -> tuple[np.ndarray, float, float]:
    """(weights, bias, scale) of a squared-hinge SVM; classes weigh equally; P(+) = 1 / (1 + exp(-scale * margin))."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    lipschitz = 1 + 2 * c * float(weight @ np.einsum("ij,ij->i", x, x) + 1)
    w = v = np.zeros(x.shape[1], np.float32)
    b = vb = 0.0
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + vb)) * weight * y
        grad, grad_b = v - 2 * c * (slack @ x), -2 * c * slack.sum()
        nw, nb = (v - grad / lipschitz).astype(np.float32), vb - grad_b / lipschitz
        v, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    margin = y * (x @ w + b)
    scales = np.geomspace(0.5, 32, 25)
    loss = [float((weight * np.logaddexp(0, -s * margin)).sum()) for s in scales]
    return w, float(b), float(scales[int(np.argmin(loss))])


@dataclass
class Model:
    """Weights by n-gram (3 * 2^BITS x pairs), biases, scales, and which languages each pair divides."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]  # (level, a, b): level "" for families, else the family
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, in one pass over its n-grams."""
        texts_ = pc.fill_null(texts, "")
        grams, ends = _grams(texts_)
        counts = np.maximum(1, np.diff(ends)).astype(np.float64)
        size, margin = 1 << BITS, np.zeros((len(texts), len(self.pairs)))
        for p in range(len(self.pairs)):
            for n, g in enumerate(grams):
                total = np.concatenate([[0.0], np.cumsum(self.weights[n * size : (n + 1) * size, p].astype(np.float64)[g])])
                # n-grams that lie in the text as a whole
                margin[:, p] += total[np.maximum(ends[:-1], ends[1:] - n - 1)] - total[ends[:-1]]
        chance = 1 / (1 + np.exp(-np.clip((margin / counts[:, None] + self.bias) * self.scale, -40, 40)))

        def votes(level: str, members: list[str]) -> np.ndarray:
            out = np.full((len(texts), len(members)), 1.0 if len(members) == 1 else 0.0)
            for p, (at, a, b) in enumerate(self.pairs):
                if at == level:
                    out[:, members.index(a)] += chance[:, p] / (len(members) - 1)
                    out[:, members.index(b)] += (1 - chance[:, p]) / (len(members) - 1)
            return out

        family = votes("", self.families)
        top = family.argmax(axis=1)
        langs, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        for f, name in enumerate(self.families):
            mine = np.flatnonzero(top == f)
            if len(mine):
                within = votes(name, self.languages[name])[mine]
                best = within.argmax(axis=1)
                langs[mine] = np.array(self.languages[name], object)[best]
                score[mine] = family[mine, f] * within[np.arange(len(mine)), best]
        none = ~pc.match_substring_regex(texts_, r"\pL").to_numpy(zero_copy_only=False)
        langs[none], score[none] = UNDETERMINED, 0.0
        return langs.tolist(), score


def _train(texts: pa.Array, langs: list[str]) -> list[tuple[str, str, str, bytes, float, float]]:
    """A row (level, a, b, weights, bias, scale) for each pair of families and of languages within one."""
    x = features(texts)
    typical = np.sqrt((x * x).mean(axis=0)) + np.float32(1e-5)  # rare n-grams count as much as common ones
    x /= typical
    norm = np.sqrt(max(1e-9, float(np.einsum("ij,ij->i", x, x).mean())))
    x /= np.float32(norm)
    lang, family = np.array(langs, object), np.array([family_of(v) for v in langs], object)
    rows = []
    for level, who, member in [("", family, np.ones(len(lang), bool)), *((f, lang, family == f) for f in sorted(set(family)))]:
        for a, b in itertools.combinations(sorted(set(who[member])), 2):
            use = member & ((who == a) | (who == b))
            w, bias, scale = _svm(x[use], np.where(who[use] == a, 1.0, -1.0).astype(np.float32))
            rows.append((level, a, b, (w / typical / norm).astype(np.float32).tobytes(), bias, scale))
    return rows


def fit(labelled: DataFrame, max_rows: int = 4000) -> Model | None:
    """A model from (doc_id, text, lang) rows with a language; about ``max_rows`` of them are used."""
    spark = labelled.sparkSession
    workspace(spark, "langid")
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(1, max_rows // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < share[F.col("lang")]).withColumn("one", F.lit(0))

    def train(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
        out = _train(table.column("text").combine_chunks(), table.column("lang").to_pylist())
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(
            [("level", pa.string()), ("a", pa.string()), ("b", pa.string()), ("w", pa.binary()), ("bias", pa.float64()), ("scale", pa.float64())])})

    got = sample.groupBy("one").applyInArrow(train, "level string, a string, b string, w binary, bias double, scale double").collect()
    langs = sorted(counts)
    families = sorted({family_of(v) for v in langs})
    weights = np.stack([np.frombuffer(r.w, np.float32) for r in got], axis=1) if got else np.zeros((3 << BITS, 0), np.float32)
    return Model(families, {f: [v for v in langs if family_of(v) == f] for f in families}, [(r.level, r.a, r.b) for r in got], weights,
                 np.array([r.bias for r in got]), np.array([r.scale for r in got]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, all columns, with ``lang_pred`` and ``lang_score`` after them (in place of columns of those names)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ("lang_pred", "lang_score")
    docs = docs.drop(*names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            if sent.value is None:
                langs, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                langs, score = sent.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, all columns, whose language is determined; without a model, those with a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            if sent.value is None:
                yield batch.filter(pc.match_substring_regex(texts_of(batch), r"\pL"))
            else:
                yield batch.filter(pa.array([x != UNDETERMINED for x in sent.value.predict(batch.column("text"))[0]], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def languages(docs: DataFrame, max_rows: int = 4000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that aren't held out, predicted for all."""
    model = fit(docs.where(training_row()), max_rows)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~F.coalesce(training_row(), F.lit(True))).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
