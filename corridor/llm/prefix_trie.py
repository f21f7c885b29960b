"""Prefix trie of conversations: a node for each distinct sequence of first turns.

Method: SQL ROLLUP over positional columns. A turn's id is a digest of its role and text. Each
conversation becomes a row per block of ``WIDTH`` turns with a column per position, keyed by
the trie's node at which the block before it ends; one ``GROUP BY block, node, ROLLUP(t0, ...)``
aggregates all prefixes of all blocks together, and ``grouping_id`` tells a prefix's length. A
node is named by its depth and two 64-bit XORs over its turns' hashes by position, so blocks of any
depth are keyed without going block by block.

Sums over subtrees come from a second rollup: each node counts once, at its smallest
conversation; a conversation carries, for each of its prefixes, the sum over its own nodes from
there on, and the members' sums add up to the subtree's.

Scale: texts are read once and never shuffled, only digests are; a conversation of any length
is spread over its blocks, a prefix of any number of conversations is counted by partial sums,
and conversations that end at one node are listed in pieces that stream through its digest.

Defined results: rows without a conversation id belong to none and are left out; turns are
ordered by number, nulls first, equal numbers by the digest of role and text; null roles and
texts are empty; repeated rows are turns of their own; very long texts count whole; the conversation whose
beginning is taken is ``conv_id - conv_id % 100`` with the remainder's sign as in SQL; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corridor.llm.ordered import ranked, running
from corridor.llm.shared import workspace, written

WIDTH = 8
#: Conversation ids in one piece of a node's list.
PIECE = 1 << 16
SLOTS = [f"t{i}" for i in range(WIDTH)]
NODE = ["depth", "s1", "s2"]


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of a digest of role and text, and the text's code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 32), F.lit(":"), F.length(text).cast("string"))


def _hashes(position: Column, turn: Column) -> tuple[Column, Column]:
    position = position.cast("long")
    return F.xxhash64(position, turn), F.xxhash64(F.lit("second"), turn, position)


def _xor(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def rebuilt(conversations: DataFrame, folder: str, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, position, tid, length) of every conversation: its group's first turns, then its own.

    A conversation takes the first ``crc32(conv_id) % most`` turns of the group's first conversation
    in place of as many of its own. One without any turn left has a row without a position.
    """
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("tid"))
    own = written(ranked(turns, "conv_id", ["turn", "tid"], folder).select("conv_id", "rank", "size", "tid"), f"{folder}/own")
    cut = F.crc32(F.col("conv_id").cast("string")) % most
    first = F.col("conv_id") - F.col("conv_id") % group
    # at most ``most`` turns a conversation
    heads = own.where((F.col("conv_id") % group == 0) & (F.col("rank") < most)).groupBy(F.col("conv_id").alias("first"))
    heads = heads.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tid"))), lambda x: x["tid"]).alias("head"))
    plan = own.where("rank = 0").select("conv_id", "size", cut.alias("cut"), first.alias("first")).join(heads, "first", "left")
    plan = plan.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("cut").cast("int")), F.array().cast("array<string>")))
    plan = written(plan.select("conv_id", "cut", "head", (F.size("head") + F.greatest(F.col("size") - F.col("cut"), F.lit(0))).cast("long").alias("length")), f"{folder}/plan")
    begun = plan.select("conv_id", F.posexplode_outer("head").alias("position", "tid"), "length").where("position is not null or length = 0")
    rest = own.where(F.col("rank") >= cut).join(plan.select("conv_id", "cut", F.size("head").alias("taken"), "length"), "conv_id")
    rest = rest.select("conv_id", (F.col("taken") + F.col("rank") - F.col("cut")).alias("position"), "tid", "length")
    return begun.withColumn("position", F.col("position").cast("long")).select(rest.columns).unionByName(rest)


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, k, length, t0.., p1, p2, x1, x2): a conversation's k-th block, the hashes of the turns before it and of its own."""
    h1, h2 = _hashes(F.col("position"), F.col("tid"))
    turns = turns.withColumns({"k": F.coalesce(F.floor(F.col("position") / WIDTH), F.lit(0).cast("long")), "h1": F.when(F.col("tid").isNotNull(), h1), "h2": F.when(F.col("tid").isNotNull(), h2)})
    slots = [F.max(F.when(F.col("position") % WIDTH == i, F.col("tid"))).alias(t) for i, t in enumerate(SLOTS)]
    rows = turns.groupBy("conv_id", "k").agg(F.max("length").alias("length"), *slots, *(F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias(x) for h, x in (("h1", "x1"), ("h2", "x2"))))
    none = F.lit(0).cast("long")
    return running(rows, "conv_id", "k", {"p1": (F.bit_xor, F.col("x1"), none), "p2": (F.bit_xor, F.col("x2"), none)})


def _rollup(blocks: DataFrame, measures: str) -> DataFrame:
    """All prefixes of all blocks: k, the prior node, the prefix's turns (null beyond it), ``level`` turns of the block, measures."""
    slots = ", ".join(SLOTS)
    query = f"SELECT k, p1, p2, {slots}, {WIDTH} - bit_count(grouping_id()) AS level, {measures} FROM {{blocks}} GROUP BY k, p1, p2, ROLLUP({slots})"
    found = blocks.sparkSession.sql(query, blocks=blocks)
    # a conversation that ends before the level counts with its own end; whole blocks are the next one's root
    last = F.element_at(F.array(*SLOTS), F.greatest(F.col("level"), F.lit(1)))
    return found.where(((F.col("level") > 0) & last.isNotNull()) | ((F.col("level") == 0) & (F.col("k") == 0)))


def _nodes(blocks: DataFrame) -> DataFrame:
    """(depth, s1, s2, q1, q2, conv_id, n_convs, childless, code_points) of each node; q1, q2: its parent's."""
    found = _rollup(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs, max(length) AS longest")
    pairs = [_hashes(F.col("k") * WIDTH + i, F.col(t)) for i, t in enumerate(SLOTS)]
    zero = F.lit(0).cast("long")
    s = [_xor([F.col(p), *(F.when(F.col(t).isNotNull(), pair[j]).otherwise(zero) for t, pair in zip(SLOTS, pairs, strict=True))]) for j, p in enumerate(("p1", "p2"))]
    depth, last = (F.col("k") * WIDTH + F.col("level")).cast("long"), F.coalesce(*reversed(SLOTS))
    found = found.select(depth.alias("depth"), s[0].alias("s1"), s[1].alias("s2"), "conv_id", "n_convs", (F.col("longest") == depth).alias("childless"), last.alias("last"))
    own = _hashes(F.col("depth") - 1, F.col("last"))
    parent = [F.when(F.col("last").isNotNull(), F.col(x).bitwiseXOR(h)).alias(q) for x, h, q in zip(("s1", "s2"), own, ("q1", "q2"), strict=True)]
    return found.select(*NODE, *parent, "conv_id", "n_convs", "childless", F.coalesce(F.substring_index("last", ":", -1).cast("long"), zero).alias("code_points"))


def _subtrees(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of each node."""
    values = {"leaves": F.col("childless").cast("long"), "saved": (F.col("n_convs") - 1) * F.col("code_points")}
    at = (F.col("depth") - 1) % WIDTH
    mine = nodes.where("depth > 0").groupBy("conv_id", F.floor((F.col("depth") - 1) / WIDTH).alias("k"))
    mine = mine.agg(*(F.sum(F.when(at == i, v).otherwise(0)).alias(f"{n}{i}") for n, v in values.items() for i in range(WIDTH)))
    names = [f"{n}{i}" for n in values for i in range(WIDTH)]
    rows = blocks.join(mine, ["conv_id", "k"], "left").fillna(0, names)
    each = {n: sum((F.col(f"{n}{i}") for i in range(1, WIDTH)), F.col(f"{n}0")) for n in values}
    rows = running(rows, "conv_id", "k", {f"after_{n}": (F.sum, each[n], F.lit(0).cast("long")) for n in values}, backwards=True)
    # from each position of the block on
    sums = {f"{n}{i}": sum((F.col(f"{n}{j}") for j in range(i, WIDTH)), F.col(f"after_{n}")) for n in values for i in range(WIDTH)}
    rows = rows.select("conv_id", "k", "p1", "p2", *SLOTS, *(v.alias(n) for n, v in sums.items()))
    found = _rollup(rows, "min(conv_id) AS conv_id, " + ", ".join(f"sum({n}) AS {n}" for n in names))
    pick = {n: F.element_at(F.array(*(f"{n}{i}" for i in range(WIDTH))), F.greatest(F.col("level"), F.lit(1))) for n in values}
    return found.select("conv_id", (F.col("k") * WIDTH + F.col("level")).cast("long").alias("depth"), pick["leaves"].alias("n_leaves"), pick["saved"].alias("saved_tokens"))


def _ends(blocks: DataFrame) -> DataFrame:
    """(depth, s1, s2, ends_sha256): digest of the ids of the conversations that end at the node, ascending, with commas."""
    final = F.col("k") == F.floor((F.greatest(F.col("length"), F.lit(1)) - 1) / WIDTH)
    ends = blocks.where(final).select(F.col("length").alias("depth"), F.col("p1").bitwiseXOR(F.col("x1")).alias("s1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("s2"), "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({**{n: pa.array([v], pa.int64()) for n, v in zip(NODE, node, strict=True)}, "first": pa.array([held[0]], pa.int64()), "ids": [",".join(map(str, held))]})

        for batch in batches:
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != node or len(held) == PIECE:
                    if held:
                        yield done()
                    node, held = own, []
                held.append(conv)
        if held:
            yield done()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_pydict({**{n: pa.array(c, pa.int64()) for n, c in zip(NODE, columns, strict=False)}, "ends_sha256": list(columns[3])})

        for batch in batches:
            for *own, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if node is not None:
            yield batch_of([*out, (*node, state.hexdigest())])

    placed = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    listed = placed.mapInArrow(pieces, "depth long, s1 long, s2 long, first long, ids string")
    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, s1 long, s2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node.

    A node is named by its smallest member and its depth; ``saved_tokens`` (in code points) is what
    the members share below and at the node: each node's last text, once less than its members.
    """
    base = workspace(conversations.sparkSession, "trie")
    turns = written(rebuilt(conversations, f"{base}/turns"), f"{base}/rebuilt")
    blocks = written(_blocks(turns), f"{base}/blocks")
    nodes = written(_nodes(blocks), f"{base}/nodes")
    sums = written(_subtrees(nodes, blocks), f"{base}/subtrees")
    ends = written(_ends(blocks), f"{base}/ends")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("s1"), F.col("q2").alias("s2")).agg(F.count("*").alias("n_children"))
    below = written(below, f"{base}/children")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("q1"), F.col("s2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["conv_id", "depth"]).join(parents, ["depth", "q1", "q2"], "left").join(below, NODE, "left").join(ends, NODE, "left")
    # only the root has no turn of its own to count as a leaf
    alone = (F.col("childless") & (F.col("depth") == 0)).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), (F.col("n_leaves") + alone).alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
