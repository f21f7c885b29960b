"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the largest permitted length; pieces are dealt by hash
into shards of about ``SHARD`` pieces, and each shard is packed on its own:

* pieces in descending length (ties by id) go into the open bin with the least room that holds
  them (best fit);
* if none does, the bin size of least cost is opened: the permitted size with the least
  ``(overhead + size) / content``, where the content expected in it is the piece plus as much
  of what is still to come as fits, counting only pieces no longer than the room left;
* at the end every bin is downsized to the smallest permitted size that holds its contents.

The sizes are optimised jointly: the shard is also packed with each larger size withheld, and
the packing with the least total cost is kept.

The shard count follows the number of pieces, so work and memory of a task don't grow with the
input; a shard wastes at most one underfull bin of each size.

Defined results: a null or empty text still has its end token, so it is packed; a null id packs
like any other; repeated rows are packed each; an empty table gives an empty result; a text of
any length is cut, never dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corridor.llm.bytewords import words
from corridor.llm.shared import slices, texts_of, workspace

SIZES = (512, 1024, 2048, 4096)
#: Pieces packed in one task.
SHARD = 20_000
#: Cost of a bin besides its size, in tokens.
OVERHEAD = 16
PLACED = "doc_id long, piece int, piece_start long, piece_tokens int, bin_id string, bin_size int, bin_tokens int, position int, at int"


def opening(length: int, rest: np.ndarray, sizes: list[int], overhead: int) -> int:
    """The least-cost size for a new bin; ``rest[r]`` is the tokens to come in pieces of at most r tokens."""
    def cost(size: int) -> tuple[float, int]:
        room = size - length
        content = length + min(room, int(rest[room]))
        return (overhead + size) / content, size

    return min((s for s in sizes if s >= length), key=cost)


def pack(lengths: list[int], sizes: list[int], overhead: int) -> tuple[list[list[int]], list[int], int]:
    """(bins of piece indices, their final sizes, total cost) for pieces given in descending length."""
    largest = max(sizes)
    by_length = np.zeros(largest + 1, np.int64)
    for n in lengths:
        by_length[n] += n
    rest = np.cumsum(by_length)
    bins: list[list[int]] = []
    held: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i, n in enumerate(lengths):
        # taken out of what is to come; only entries below the next lengths are read again
        rest[n:] -= n
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            b = len(bins)
            room = opening(n, rest, sizes, overhead)
            bins.append([])
            held.append(0)
        bins[b].append(i)
        held[b] += n
        if room - n:
            insort(rooms, (room - n, b))
    final = [min(s for s in sizes if s >= h) for h in held]
    return bins, final, sum(final) + overhead * len(final)


def best_pack(lengths: list[int], sizes: list[int], overhead: int) -> tuple[list[list[int]], list[int], int]:
    """The cheapest packing over the largest size allowed to be opened."""
    longest = lengths[0] if lengths else 0
    options = [sizes[: k + 1] for k in range(len(sizes)) if sizes[k] >= longest]
    return min((pack(lengths, o, overhead) for o in options), key=lambda p: p[2])


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words and one end token of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = np.diff(words(texts_of(batch)).offsets) + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64))], names=["doc_id", "n_tokens"])

    workspace(docs.sparkSession, "packing")
    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")


def packed(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """Placement of every piece: (doc_id, piece, piece_start, piece_tokens, bin_id, bin_size, bin_tokens, position, at).

    ``lengths`` is (doc_id, n_tokens); ``at`` is the piece's first token in its bin.
    """
    order = sorted(set(sizes))
    top = order[-1]
    pieces = lengths.where("n_tokens > 0").select(
        "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / top).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * top).alias("piece_start"),
                           F.least(F.lit(top), F.col("n_tokens") - F.col("piece").cast("long") * top).cast("int").alias("piece_tokens"))
    total = lengths.agg(F.sum(F.ceil(F.col("n_tokens") / top))).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    # the row's place takes part in the hash, so that rows of one repeated id spread too
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "piece_tokens", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(shards)))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("piece_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        bins, final, _ = best_pack(rows.column("piece_tokens").to_pylist(), order, overhead)
        n = np.fromiter(map(len, bins), np.int64, len(bins))
        out = rows.take(pa.array(np.concatenate([np.asarray(b) for b in bins])))
        tokens = out.column("piece_tokens").to_numpy().astype(np.int64)
        first = np.cumsum(n) - n
        before = np.cumsum(tokens) - tokens
        number = np.repeat(np.arange(len(bins)), n).tolist()
        shard = key[0].as_py()
        return pa.table({
            "doc_id": out.column("doc_id"), "piece": out.column("piece"), "piece_start": out.column("piece_start"), "piece_tokens": out.column("piece_tokens"),
            "bin_id": pa.array([f"{shard}-{b}" for b in number], pa.string()), "bin_size": pa.array(np.repeat(np.asarray(final), n), pa.int32()),
            "bin_tokens": pa.array(np.repeat(np.add.reduceat(tokens, first), n), pa.int32()),
            "position": pa.array(np.arange(len(tokens)) - np.repeat(first, n), pa.int32()), "at": pa.array(before - np.repeat(before[first], n), pa.int32())})

    return dealt.groupBy("shard").applyInArrow(place, PLACED)
