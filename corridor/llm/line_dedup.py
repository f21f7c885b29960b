"""Lines that repeat across documents, dropped everywhere but in one document.

Method: two Bloom filters over the keys of all lines.

* Every task hashes the keys of its documents' lines and hands on, by segment of the filter, the
  bits it has set once and those set by two documents or more. A segment's task folds what
  all tasks send: a bit is in the *once-seen* filter when any document sets it, in the
  *twice-seen* filter when a second one does. Only bit positions are shuffled here, no lines.
* A line is suspected if all its bits are in the twice-seen filter. A line of two documents
  always is; one of a single document is by the filter's error rate, which costs work and
  changes no result.
* Only suspected lines are shuffled, as digests of 128 bits with their document: distinct
  pairs first, so that a line of very many documents is spread, then partial counts by line.
  Lines of ``min_docs`` documents or more are confirmed, and the document that keeps them is
  chosen. Each other document gets the list of its own lines to drop.

The filter has ``BITS`` bits for each line that is long enough, at most ``max_bits``; beyond that
more lines are suspected and their digests shuffled, and results stay the same. It lies as a
table in the shared folder; each worker reads it once. Nothing of it passes the driver.

Defined results: a null or empty text is one empty line; rows with one id are one document (so
are all rows without an id, which comes before all others); of repeated rows each is cleaned;
a text whose lines all go becomes empty; very long texts and lines count whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, functions as F

from corridor.llm.binary_ids import filesystem
from corridor.llm.bytewords import hashes_of, text_bytes
from corridor.llm.shared import kept_in_worker, slices, texts_of, workspace, written

#: Bits of the filter for each line, bits set by a line, and segments that the filter is folded in.
BITS = 16
PROBES = (1, 0xD6E8FEB86659FD93)
SEGMENTS = 1024
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
#: Bits that a task holds before it hands them on.
HELD = 2 << 20
BLANKS = " \t\n\x0b\x0c\r"


def line_keys(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(lines, their keys, where each text's lines begin)."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    return lines, pc.ascii_lower(pc.ascii_trim(lines, BLANKS)), lists.offsets.to_numpy()


def _long(keys: pa.Array, min_length: int) -> np.ndarray:
    return np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_length).to_numpy(zero_copy_only=False))


def _hashed(keys: pa.Array, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the keys numbered ``at``."""
    data, ends = text_bytes(keys)
    return np.searchsorted(offsets, at, side="right") - 1, hashes_of(data, ends[at], ends[at + 1])


def _bits(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The filter's bits of each hash; ``width``: the filter has 2**width bits."""
    return [(hashes * np.uint64(p)) >> np.uint64(64 - width) for p in PROBES]


def _by_segment(bits: np.ndarray, width: int) -> pa.RecordBatch:
    """(segment, bits set once, bits set twice or more), places inside the segment."""
    bits = np.sort(bits)
    new = np.ones(len(bits), bool)
    new[1:] = bits[1:] != bits[:-1]
    again = np.unique(bits[~new])
    inside = np.uint64(width - SEGMENTS.bit_length() + 1)
    edges = np.arange(SEGMENTS + 1, dtype=np.uint64) << inside

    def parts(values: np.ndarray) -> list[bytes]:
        cuts = np.searchsorted(values, edges).tolist()
        values = (values & ((np.uint64(1) << inside) - np.uint64(1))).astype("<u4")
        return [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    once, twice = parts(np.setdiff1d(bits[new], again, assume_unique=True)), parts(again)
    some = [k for k in range(SEGMENTS) if once[k] or twice[k]]
    return pa.RecordBatch.from_pydict({"segment": pa.array(some, pa.int32()), "once": pa.array([once[k] for k in some], pa.binary()), "twice": pa.array([twice[k] for k in some], pa.binary())})


def twice_seen(docs: DataFrame, folder: str, width: int, min_length: int = 40) -> DataFrame:
    """(segment, bits) of the twice-seen filter of 2**width bits, written to ``folder``."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches):
            _, keys, offsets = line_keys(texts_of(batch))
            owner, hashes = _hashed(keys, offsets, _long(keys, min_length))
            # a line repeated inside one document sets its bits once
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            held += _bits(hashes[new], width)
            n += len(PROBES) * int(new.sum())
            if n > HELD:
                yield _by_segment(np.concatenate(held), width)
                held, n = [], 0
        if n:
            yield _by_segment(np.concatenate(held), width)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, seen = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bits": pa.array([np.packbits(seen > 1, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != segment:
                    if segment is not None:
                        yield done()
                    segment, seen = s, np.zeros((1 << width) // SEGMENTS, np.uint8)
                once = np.frombuffer(once, "<u4")
                seen[once] = np.minimum(seen[once] + 1, 2)
                seen[np.frombuffer(twice, "<u4")] = 2
        if segment is not None:
            yield done()

    sent = docs.select("text").mapInArrow(parts, "segment int, once binary, twice binary")
    return written(sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(fold, "segment int, bits binary"), folder)


def _loaded(folder: str, width: int) -> np.ndarray:
    """The twice-seen filter as bytes; a worker keeps the last one it has read."""
    kept = kept_in_worker("line filter", dict)
    if folder not in kept:
        kept.clear()
        fs, path = filesystem(folder)
        out = np.zeros((1 << width) // 8, np.uint8)
        each = len(out) // SEGMENTS
        for batch in pads.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=True).to_batches():
            for s, bits in zip(batch.column("segment").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                out[s * each : (s + 1) * each] = np.frombuffer(bits, np.uint8)
        kept[folder] = out
    return kept[folder]


def digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


def suspects(docs: DataFrame, folder: str, width: int, min_length: int = 40) -> DataFrame:
    """(digest, doc_id, row) of the lines whose bits are all in the filter; ``row``: a hash of id and text."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _loaded(folder, width)
        for batch in slices(batches):
            _, keys, offsets = line_keys(texts_of(batch))
            at = _long(keys, min_length)
            owner, hashes = _hashed(keys, offsets, at)
            hit = np.ones(len(at), bool)
            for b in _bits(hashes, width):
                hit &= (bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
            found = sorted({(i, digest(k)) for i, k in zip(owner[hit].tolist(), keys.take(pa.array(at[hit])).to_pylist(), strict=True)})
            rows = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([d for _, d in found], pa.binary()), batch.column("doc_id").cast(pa.int64()).take(rows), batch.column("row").take(rows)], names=["digest", "doc_id", "row"])

    return docs.mapInArrow(probe, "digest binary, doc_id long, row long")


def deduplicated(docs: DataFrame, min_length: int = 40, min_docs: int = 5, keep: str = "last", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row, without the lines that ``min_docs`` documents share.

    Such lines stay in the document of the largest id that holds them (``keep="first"``: the smallest).
    """
    if max_bits < 8 * SEGMENTS:
        raise ValueError(f"max_bits: at least {8 * SEGMENTS}")
    base = workspace(docs.sparkSession, "lines")
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    # runs without a line break: no fewer than the lines that are long enough once stripped
    lines = docs.agg(F.sum(F.regexp_count("text", F.lit(f"[^\\n]{{{min_length},}}")))).first()[0] or 0
    width = min(max(MIN_BITS, BITS * lines), max_bits).bit_length() - 1
    twice_seen(docs, f"{base}/filter", width, min_length)
    found = written(suspects(rows, f"{base}/filter", width, min_length), f"{base}/suspects")
    # both distincts use the one shuffle by line and document
    each = found.repartition("digest", "doc_id").distinct()
    chosen = (F.max if keep == "last" else F.min)("doc_id").alias("keeper")
    repeated = each.select("digest", "doc_id").distinct().groupBy("digest").agg(F.count("*").alias("n"), chosen, F.max(F.col("doc_id").isNull()).alias("without"))
    if keep == "first":  # rows without an id come first
        repeated = repeated.withColumn("keeper", F.when(~F.col("without"), F.col("keeper")))
    repeated = written(repeated.where(F.col("n") >= min_docs).select("digest", "keeper"), f"{base}/repeated")
    drops = found.distinct().join(repeated, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = written(drops.groupBy("row", F.col("doc_id").alias("of")).agg(F.collect_list("digest").alias("drop")), f"{base}/drops")
    met = rows.join(drops, (rows["row"] == drops["row"]) & rows["doc_id"].eqNullSafe(drops["of"]), "left").select("doc_id", "text", "drop")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            counts = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
            dropped, out = np.zeros(len(texts), np.int64), []
            listed = np.flatnonzero(batch.column("drop").is_valid().to_numpy(zero_copy_only=False))
            last = 0
            for i in listed.tolist():
                out.append(texts.slice(last, i - last))
                lines, keys, _ = line_keys(texts.slice(i, 1))
                gone = set(batch.column("drop")[i].as_py())
                stays = np.ones(len(lines), bool)
                for k in _long(keys, min_length).tolist():
                    stays[k] = digest(keys[k].as_py()) not in gone
                dropped[i], last = len(lines) - stays.sum(), i + 1
                out.append(pa.array(["\n".join(lines.filter(pa.array(stays)).to_pylist())], pa.string()))
            out.append(texts.slice(last))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.concat_arrays([x.cast(pa.string()) for x in out]), counts, pa.array(dropped)], names=["doc_id", "text", "n_lines", "n_dropped"])

    return met.mapInArrow(clean, "doc_id long, text string, n_lines long, n_dropped long")
