"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back by memory map.

Layout of a folder, one group of files per shard, shards in ascending document order:

* ``<name>.ids``      the ids of all documents of the shard, little-endian uint16 (uint32
  for vocabularies above 65,536 ids), each document followed by the end id
* ``<name>.offsets``  n + 1 little-endian int64: where each document's ids begin
* ``<name>.docs``     n little-endian int64 document ids, then n bytes: 1 if the id is null

The manifest has a row per shard (as many as write tasks): its name, counts, and the base,
the number of ids in the shards before it, from a prefix sum over the shards.

Defined results: a null text is empty and gives the end id alone; null document ids come
first; rows with equal ids stay separate, ordered by their text; an empty table gives an
empty manifest; other columns are ignored. Files are named by task attempt and only those of
the attempts that count enter the manifest, so a lost executor or a second attempt can't
spoil them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corridor.llm.shared import slices, texts_of
from corridor.llm.tokenpieces import SLICE, byte_level

MANIFEST = "shard int, name string, width int, n_docs long, n_tokens long"
#: Ids read at once from a file that can't be mapped, and documents in a returned batch.
READ_DOCS = 4096


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder in the cluster's shared storage."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (pafs.LocalFileSystem(), folder) if folder.startswith("/") else pafs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the files, and return the manifest with ``base``."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder, total, files, offsets, ids = byte_level(tokenizer), 0, None, [np.zeros(1, "<i8")], []
        end = np.array([end_id], encoder.kind)
        for batch in slices(batches, limit=SLICE):
            flat, starts = encoder.ids(texts_of(batch))
            files = files or fs.open_output_stream(f"{path}/{name}.ids")
            files.write(np.insert(flat, starts[1:], end[0]).astype(encoder.kind).tobytes())
            offsets.append((total + starts[1:] + np.arange(1, len(starts))).astype("<i8"))
            total = int(offsets[-1][-1])
            ids.append(batch.column("doc_id").cast(pa.int64()))
        if files is None:
            return
        files.close()
        column = pa.concat_arrays(ids)
        with fs.open_output_stream(f"{path}/{name}.offsets") as f:
            f.write(np.concatenate(offsets).tobytes())
        with fs.open_output_stream(f"{path}/{name}.docs") as f:
            f.write(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            f.write(column.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([task.partitionId()], pa.int32()), "name": [name], "width": pa.array([encoder.kind.itemsize], pa.int32()), "n_docs": [len(column)], "n_tokens": [total]})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted(ordered.mapInArrow(write, MANIFEST).collect())
    base, rows = 0, []
    for r in shards:
        rows.append((*r, base))
        base += r.n_tokens
    frame = spark.createDataFrame(rows, f"{MANIFEST}, base long")
    return frame.repartition(max(1, len(rows)))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            n, stem = row["n_docs"], f"{path}/{row['name']}"
            ids, offsets = Flat(fs, f"{stem}.ids", f"<u{row['width']}"), Flat(fs, f"{stem}.offsets", "<i8")
            known, null = Flat(fs, f"{stem}.docs", "<i8"), Flat(fs, f"{stem}.docs", "u1")
            for at in range(0, n, READ_DOCS):
                to = min(n, at + READ_DOCS)
                off = offsets[at : to + 1]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(known[at:to], mask=null[8 * n + at : 8 * n + to].astype(bool)), "start": pa.array(row["base"] + off[:-1]),
                    "n_tokens": pa.array(np.diff(off)), "ids_crc32": pa.array(crc, pa.int64())})

    return manifest.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Flat:
    """Slices of a flat binary file: by memory map where the file system is mounted, else by ranged reads."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: str):
        self.kind = np.dtype(kind)
        self.map = np.memmap(path, self.kind, "r", shape=(fs.get_file_info(path).size // self.kind.itemsize,)) if isinstance(fs, pafs.LocalFileSystem) else None
        self.file = None if self.map is not None else fs.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.map is not None:
            return np.asarray(self.map[part])
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * size, part.start * size), self.kind)


def document_ids(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of every document, for users that want the ids as rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            n, stem = row["n_docs"], f"{path}/{row['name']}"
            ids, offsets = Flat(fs, f"{stem}.ids", f"<u{row['width']}"), Flat(fs, f"{stem}.offsets", "<i8")
            known, null = Flat(fs, f"{stem}.docs", "<i8"), Flat(fs, f"{stem}.docs", "u1")
            for at in range(0, n, 512):
                to = min(n, at + 512)
                off = offsets[at : to + 1]
                lists = pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), pa.array(ids[int(off[0]) : int(off[-1])].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(known[at:to], mask=null[8 * n + at : 8 * n + to].astype(bool)), lists], names=["doc_id", "ids"])

    return manifest.mapInArrow(read, "doc_id long, ids array<int>").select(F.col("doc_id"), F.col("ids"))
