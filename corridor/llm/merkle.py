"""Merkle manifest of a table: a leaf per row, a tree per partition value, proofs to one root.

A leaf is the hash of the row's columns; the leaves of a group (``lang``) ascend by id, and every
eight consecutive nodes become the hash of their digests until one is left, the group's subroot.
The subroots, ordered by group, become the root in the same way. A proof is the list of a
leaf's siblings, level by level; folding the leaf with them gives the root.

Method: a nested-struct rollup with built-in functions alone. Ranks are cut into base-8 digits;
each block of 512 consecutive nodes is dealt to one task by one shuffle, and its three digit
columns are grouped away one after the other, each grouping nesting the structs of its children
and hashing them. A block's row then holds all that its proofs need. The blocks' own nodes,
1/512 of the rows, are the next round's leaves, until each group is one block. On the way back
a block's row meets the proof of its top node by one grouping of exactly two rows (no join),
and a transform and an explode emit a row per child with its proof. No row holds more than one
block; a group of any size is spread over its blocks.

Defined results: null columns hash as ``-``, other values as byte count, ``:`` and value; rows
with equal ids are ordered by their leaf, rows equal in all columns are interchangeable; null
ids come first and are never tampered with; the null group comes before all others; an empty table gives
an empty result; very long texts are hashed whole in their own row and go no further; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corridor.llm.ordered import ranked
from corridor.llm.shared import workspace, written

FANOUT = 8
DIGITS = 3
BLOCK = FANOUT**DIGITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<on: boolean, before: string, after: string>>"


def field(column: Column) -> Column:
    """A value as it enters a leaf: its byte count and itself, or ``-``."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` and its siblings give; levels that are not hashed (a lone node) are passed over."""
    return F.aggregate(path, start, lambda digest, x: F.when(x["on"], F.sha2(F.concat(x["before"], digest, x["after"]), 256)).otherwise(digest))


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(g, n, rank, h, payload) -> (g, n, b, h, kids): the top of each block, its children nested in it.

    ``n`` is the number of the group's nodes on this round's lowest level; a level is hashed only
    while more than one node remains there.
    """
    digit = [F.pmod(F.floor(F.col("rank") / FANOUT**k), F.lit(FANOUT)).cast("tinyint").alias(f"d{k}") for k in range(DIGITS)]
    rows = nodes.select("g", "n", F.floor(F.col("rank") / BLOCK).alias("b"), *digit, "h", F.struct(*payload).alias("row"))
    rows, inside = rows.repartition("g", "b"), "row"
    for k in range(DIGITS):
        keys = ["g", "n", "b", *(f"d{j}" for j in range(DIGITS - 1, k, -1))]
        rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(f"d{k}", "h", inside))).alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda x: x["h"]), ""), 256)
        rows, inside = rows.withColumn("h", F.when(F.col("n") > FANOUT**k, joined).otherwise(F.col("kids")[0]["h"])), "kids"
    return rows


def _children(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(g, rank, row, path, subroot) of every node of a round: ``above`` holds the path and subroot of each block's top."""
    empty = {"path": F.lit(None).cast(PATH), "subroot": F.lit(None).cast("string")}
    theirs = above.select("g", F.col("rank").alias("b"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(blocks.schema["kids"].dataType).alias("kids"), "path", "subroot")
    both = blocks.select("g", "b", "n", "kids", *(v.alias(k) for k, v in empty.items())).unionByName(theirs)
    met = both.groupBy("g", "b").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "subroot")))

    def side(k: int) -> str:
        """The siblings of child i of ``kids`` on level k."""
        of, i = ("kids", "c2.kids", "c1.kids")[2 - k], f"i{k}"
        return (f"named_struct('on', n > {FANOUT**k}, 'before', array_join(transform(slice({of}, 1, {i}), x -> x.h), ''), "
                f"'after', array_join(transform(slice({of}, {i} + 2, {FANOUT}), x -> x.h), ''))")

    child = f"named_struct('rank', b * {BLOCK} + c2.d2 * {FANOUT**2} + c1.d1 * {FANOUT} + c0.d0, 'row', c0.row, 'path', array({side(0)}, {side(1)}, {side(2)}))"
    each = f"flatten(transform(kids, (c2, i2) -> flatten(transform(c2.kids, (c1, i1) -> transform(c1.kids, (c0, i0) -> {child})))))"
    out = met.select("g", "path", "subroot", F.explode(F.expr(each)).alias("x"))
    return out.select("g", F.col("x.rank").alias("rank"), F.col("x.row").alias("row"), F.concat("x.path", "path").alias("path"), "subroot")


class Tree:
    """Trees over the nodes of every group, round by round of ``DIGITS`` levels."""

    def __init__(self, nodes: DataFrame, order: list[str], payload: list[str], folder: str):
        nodes = ranked(nodes, "g", order, folder).withColumnRenamed("size", "n")
        self.rounds: list[DataFrame] = []
        while True:
            self.rounds.append(written(_blocks(nodes, payload), f"{folder}/round-{len(self.rounds)}"))
            # of a group's blocks, only as many as there are rounds to come
            if (self.rounds[-1].agg(F.max("b")).first()[0] or 0) == 0:
                break
            nodes = self.rounds[-1].select("g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("b").alias("rank"), "h", F.lit(0).alias("none"))
            payload = ["none"]

    def tops(self) -> DataFrame:
        """(g, h): one node per group."""
        return self.rounds[-1].select("g", "h")

    def children(self, above: DataFrame) -> DataFrame:
        """All nodes that were given, with their paths; ``above`` (g, rank = 0, path, subroot): what continues each group's."""
        for blocks in reversed(self.rounds):
            above = _children(blocks, above)
        return above


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, path, subroot, root, tampered) of every row: its proof, and what its leaf would be after tampering.

    Tampering lower-cases A-Z of the text where 3 divides the CRC-32 of the decimal id; ``tampered``
    is the leaf of the table as it is then.
    """
    spark, base = docs.sparkSession, workspace(docs.sparkSession, "merkle")
    columns = [F.col(c) for c in COLUMNS]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # the null group first, others in byte order
    leaves = docs.select(
        group.alias("g"), "doc_id", "lang", leaf(columns).alias("h"),
        F.when(changed, leaf([*columns[:-1], F.translate("text", UPPER, LOWER)])).alias("other"))
    langs = Tree(leaves, ["doc_id", "h"], ["doc_id", "lang", "h", "other"], f"{base}/rows")
    table = Tree(langs.tops().select(F.lit("").alias("g"), F.col("g").alias("lang"), "h"), ["lang"], ["lang", "h"], f"{base}/groups")
    root = [r.h for r in table.tops().collect()]  # one row, or none of an empty table
    top = spark.range(1).select(F.lit("").alias("g"), F.lit(0).cast("long").alias("rank"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    above = table.children(top).select(F.col("row.lang").alias("g"), F.lit(0).cast("long").alias("rank"), "path", F.col("row.h").alias("subroot"))
    found = langs.children(above)
    return found.select("row.doc_id", "row.lang", F.col("row.h").alias("leaf"), "path", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
                        F.coalesce("row.other", "row.h").alias("tampered"))


def siblings(path: Column) -> Column:
    """The siblings' digests in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def verified(rows: DataFrame) -> DataFrame:
    """``manifest`` rows with the proof's digest, the root folded from the tampered leaf, and whether it is the root."""
    rows = rows.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")), 256), "folded_root": fold(F.col("tampered"), F.col("path"))})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
