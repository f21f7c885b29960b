"""Line dedup, Merkle manifest and prefix trie against brute force and their SQL, with their corner cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.checks.compare import compare, duck
from corridor.llm import line_dedup, merkle, ordered, prefix_trie, queries
from corridor.llm.shared import workspace

from .test_operators import DOCS, SF, TRICKY, lower

EMPTY = hashlib.sha256(b"").hexdigest()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def key(row) -> tuple:
    return tuple((x is not None, x) for x in row)


def same(got, want) -> bool:
    return sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("name", ["op11_line_duplicates", "op12_merkle_proofs", "op13_conversation_trie"])
def test_queries_match_their_sql(spark, name):
    res = compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], duck(SF))
    assert res["columns_match"] and res["types_match"] and res["match"], res


# ---- ranks and running totals ---------------------------------------------------

def test_ranks_of_hot_groups_and_equal_rows(spark):
    data = [("hot", i % 50, None) for i in range(3000)] + [(f"g{i % 7}", i, i % 3) for i in range(200)] + [("hot", None, 1)]
    df = spark.createDataFrame(data, "g string, a long, b long").repartition(5)
    got = ordered.ranked(df, "g", ["a", "b"], workspace(spark, "ranks")).collect()
    groups = defaultdict(list)
    for g, a, b in data:
        groups[g].append((a, b))
    for g, rows in groups.items():
        own = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(rows))) and {r["size"] for r in own} == {len(rows)}
        assert [(r.a, r.b) for r in own] == sorted(rows, key=key)


@pytest.mark.parametrize("backwards", [False, True])
def test_running_totals_over_blocks(spark, monkeypatch, backwards):
    monkeypatch.setattr(ordered, "STRIDE", 16)
    rnd = random.Random(1)
    data = [(g, k, rnd.getrandbits(62)) for g, n in ((1, 100), (2, 1), (3, 16)) for k in range(n)]
    df = spark.createDataFrame(data, "g long, k long, v long")
    zero = F.lit(0).cast("long")
    got = ordered.running(df, "g", "k", {"x": (F.bit_xor, F.col("v"), zero), "s": (F.sum, F.col("v") % 1000, zero)}, backwards).collect()
    assert len(got) == len(data) and set(got[0].asDict()) == {"g", "k", "v", "x", "s"}
    for r in got:
        before = [v for g, k, v in data if g == r.g and (k > r.k if backwards else k < r.k)]
        assert r.x == int(np.bitwise_xor.reduce(np.array(before or [0]))) and r.s == sum(v % 1000 for v in before)


# ---- lines ------------------------------------------------------------------------

def brute_lines(rows, min_length=40, min_docs=5, first=False):
    def line_key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= min_length:
                held[line_key(line)].add(i)
    keep = {k: (min if first else max)(v, key=lambda i: (i is not None, i or 0)) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if line_key(x) not in keep or keep[line_key(x)] == i]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def line_rows():
    rnd = random.Random(5)
    pool = [f"Line number {i} of the pool, of some {'long ' * rnd.randint(0, 9)}words, É{i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    for i in range(300):
        lines = [rnd.choice([str.upper, str, lambda x: "  " + x + "\t\r", lambda x: x + " ", lambda x: "\x0b" + x])(rnd.choice(pool)) if rnd.random() < 0.3 else f"own line {i} {rnd.random()} which no other document has at all" for _ in range(rnd.randint(0, 12))]
        rows.append((100 + i, "\n".join([*lines, *lines[:2], "x" * 39, "short"])))
    common = "this line is in nearly every document of the table, again and again"
    rows += [(1000 + i, common + "\n" + "y" * rnd.choice([39, 40, 41])) for i in range(200)]
    # ids with several texts, repeated rows, rows without an id, very long texts
    rows += [(1000, common), (1000, "another text of the id\n" + pool[3]), rows[150], rows[150], (None, pool[1] + "\n" + pool[2]), (None, pool[1]), (None, None)]
    rows += [(2000, "\n".join([*pool, common] * 400)), (2001, pool[7] * 3000)]
    return rows


@pytest.mark.parametrize(("max_bits", "keep"), [(line_dedup.MAX_BITS, "last"), (line_dedup.MIN_BITS >> 7, "last"), (line_dedup.MAX_BITS, "first")])
def test_lines_match_brute_force(spark, monkeypatch, max_bits, keep):
    """Also with a filter that is far too small: more suspects, the same result."""
    if max_bits < line_dedup.MIN_BITS:
        monkeypatch.setattr(line_dedup, "MIN_BITS", max_bits)
    monkeypatch.setattr(line_dedup, "HELD", 500)
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, None, None, None, "s", "l") for i, t in rows], DOCS).repartition(4)
    got = line_dedup.deduplicated(docs, max_bits=max_bits, keep=keep)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    want = brute_lines(rows, first=keep == "first")
    assert same(got.collect(), want) and sum(r[3] for r in want) > 500


def test_only_suspected_lines_are_shuffled(spark):
    """Lines of one document alone pass the twice-seen filter by its error rate; lines of two always do."""
    rows = [(i, "\n".join(f"line {j} of document {i}, with enough letters to count" for j in range(50))) for i in range(400)]
    rows += [(1000 + i, f"the line that both documents of pair {i // 2} hold in their text") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = workspace(spark, "lines")
    line_dedup.twice_seen(docs, folder, 20)
    got = line_dedup.suspects(docs.withColumn("row", F.col("doc_id")), folder, 20).collect()
    pairs = {r.doc_id for r in got} & {i for i, _ in rows[400:]}
    assert len(pairs) == 100 and len(got) - 100 < 0.02 * 20_000
    assert {bytes(r.digest) for r in got if r.doc_id >= 1000} == {line_dedup.digest(t) for _, t in rows[400:]}


def test_lines_of_an_empty_table(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], DOCS)).collect() == []
    none = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert same(line_dedup.deduplicated(none).collect(), [(None, "", 1, 0), (1, "", 1, 0)])


# ---- Merkle manifest -----------------------------------------------------------------

def brute_merkle(rows):
    def join(*x):
        return sha("".join(x))

    def leaf(row):
        return join(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
            for k, p in enumerate(at):
                proofs[k].append((runs[p // 8][: p % 8], runs[p // 8][p % 8 + 1 :]))
            nodes, at = [join(*r) for r in runs], [p // 8 for p in at]
        return nodes[0], proofs

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        langs[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in langs[g]]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, p in zip(langs[g], trees[g][1], strict=True):
            path = p + top
            at = leaf((*r[:4], None if r[4] is None else lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for a, b in path:
                at = join(*a, at, *b)
            out.append((r[0], leaf(r), trees[g][0], root, join(*(x for a, b in path for x in a + b)), at, at == root))
    return out


PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows(sizes):
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            rows.append((n * 37 % 100_003, f"s{n % 3}" if n % 5 else None, lang, n if n % 4 else None, f"Text {n} Aé" if n % 6 else None))
            n += 1
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {None: 7, "a": 8, "b": 9, "é": 64, "z": 65}, {"en": 513, "fr": 1, "": 2}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_proofs_match_brute_force(spark, sizes):
    rows = manifest_rows(sizes)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, h string, path string")
    got = merkle.verified(merkle.manifest(df.repartition(5))).select(PROOF).collect()
    assert same(got, brute_merkle(rows))


def test_blocks_above_blocks(spark, monkeypatch):
    """Blocks of 512 nodes in three rounds: a group of 5,000 leaves and one of 600."""
    rows = manifest_rows({"en": 5000, "de": 600})
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert same(merkle.verified(merkle.manifest(df)).select(PROOF).collect(), brute_merkle(rows))


def test_manifest_corner_cases(spark):
    rows = [(1, None, None, None, None), (None, None, None, None, None), (None, "a", "en", 1, "B"), (5, "", "", 0, ""), (5, "", "", 0, "A")]
    rows += [rows[0]] * 20 + [(5, "s", "en", i, "A" * 200_000) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    out = merkle.verified(merkle.manifest(df)).select(PROOF).collect()
    assert same(out, brute_merkle(rows)) and all(r.verified for r in out if r.doc_id is None)
    assert merkle.verified(merkle.manifest(df.limit(0))).select(PROOF).collect() == []


# ---- prefix trie ----------------------------------------------------------------------

def brute_trie(rows):
    def turn_id(role, text):
        return sha(f"{len(role.encode())}:{role}{text}")[:32] + f":{len(text)}"

    own, built = defaultdict(list), {}
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, turn_id(r or "", x or ""), r or "", x or ""))
    own = {c: [y[3:] for y in sorted(v)] for c, v in own.items()}
    for c, v in own.items():
        h, first = zlib.crc32(str(c).encode()) % 6, abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(first, [])[:h] + v[h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if built[c] == p)))
            for p, m in members.items()]


TURNS = "conv_id long, turn long, role string, text string"


def turn_rows(seed: int, longest: int) -> list:
    """Conversations of few different turns, so that they share beginnings of any length."""
    rnd, rows = random.Random(seed), []
    for c in [*range(90, 130), *range(200, 260), *range(-120, -95), 400, 401, 7_000_000_001]:
        n = rnd.choice([1, 2, 8, 9, 16, 17, rnd.randint(1, longest)])
        for i in range(n):
            rows.append((c, i, rnd.choice(["user", "user", None]), ["hello", "hello", "é🙂", None, ""][min(4, rnd.randint(0, 60) // 12)] if i % 3 else f"turn {i}"))
    return rows


@pytest.mark.parametrize(("seed", "longest"), [(1, 5), (2, 40), (3, 300)])
def test_trie_matches_brute_force(spark, monkeypatch, seed, longest):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    monkeypatch.setattr(ordered, "STRIDE", 4)
    rows = turn_rows(seed, longest)
    got = prefix_trie.trie(spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", depth string").repartition(5)).collect()
    assert same(got, brute_trie(rows)) and max(r.depth for r in got) > 8


def test_trie_of_many_equal_conversations(spark, monkeypatch):
    """Most conversations are one and the same: listed in pieces, counted by partial sums."""
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    rows = [(c * 100, t, "user", f"t{t}") for c in range(400) for t in range(3)] + [(c * 100 + 50, 0, "user", "other") for c in range(50)]
    assert same(prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect(), brute_trie(rows))


def test_trie_corner_cases(spark):
    rows = [(None, 0, "user", "no conversation"), (5, None, None, None), (5, None, "user", "b"), (5, None, "user", "a"), (5, 1, "user", "x" * 300_000), (5, 1, "user", "x" * 300_000),
            (200, 0, "a", "1:b"), (100, 0, "a1:", "b"), (101, 3, "", "ab")]
    df = spark.createDataFrame(rows, TURNS)
    assert same(prefix_trie.trie(df).collect(), brute_trie(rows))
    assert prefix_trie.trie(df.limit(0)).collect() == [] and prefix_trie.trie(df.where("conv_id is null")).collect() == []
    # 1 and 3 lose all turns to a group that has none: members of the root alone
    bare = [(c, 0, "user", "gone") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 6 > 0]
    got = prefix_trie.trie(spark.createDataFrame(bare, TURNS)).collect()
    assert same(got, brute_trie(bare)) and len(got) == 1 and got[0].n_leaves == 1 and got[0].ends_sha256 != EMPTY
