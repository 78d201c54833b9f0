"""N-gram Jaccard join: a MinHash forest of sorted prefixes for candidates, then exact verification and exact link counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import BASE, BLANKS, dropped, hashed, mixed, removed, smaller, split_words, table_size, texts_of, written
from .graph import components

#: Trees of the forest, the full depth of their signatures, and the bits of a level in a tree's sorted key.
TREES, DEPTH, BITS = 32, 6, 10
#: Prefixes are shortened until pairs at the threshold meet with at least this probability.
RECALL = 0.99999
#: Shingles that a block of documents holds when groups are compared block by block.
BLOCK = 500_000
#: Documents of a block at most, on average.
BLOCK_DOCS = 512
#: Groups in a node beyond which they are compared as one cluster, not pair by pair.
DENSE = 32


def depth_for(threshold: float, trees: int = TREES, deepest: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which one of the trees still brings a pair at the threshold together often enough."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shingles(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the n-word shingles of each text; a text of fewer words is one shingle."""
    for c in BLANKS[1:]:
        texts = pc.replace_substring(texts, c, " ")
    codes, first, words = split_words(texts)
    keep = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[codes]
    at = hashed(words)[codes[keep]]
    ends = np.r_[0, np.cumsum(keep)][first]
    order = [np.uint64((2 * k + 1) * int(BASE) % (1 << 64)) for k in range(n)]
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(at) - n + 1), np.uint64)
        for k, m in enumerate(order):
            rolled += at[k : len(at) - n + 1 + k] * m if len(at) >= n else 0
        rolled = mixed(rolled)
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(rolled[a : b - n + 1]))
            elif b > a:
                out.append(mixed(np.array([sum(int(x) * int(m) for x, m in zip(at[a:b], order)) % (1 << 64)], np.uint64) ^ np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _key(s: np.ndarray) -> int | None:
    """A text's class: a 64-bit digest of its shingle set; texts without words have none."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _signature(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 1024):
        np.minimum(low, (s[k : k + 1024, None] * factors[None, :]).min(axis=0), out=low)
    return low


def signed_texts(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, class key, and the key of its signature in each tree: BITS bits of each level, the first level highest.

    So a tree is its keys in sorted order, and a key shifted right by BITS is its prefix one level shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        factors = np.random.default_rng(7).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = np.array([BITS * (DEPTH - 1 - k) for k in range(DEPTH)], np.uint64)
        for batch in smaller(batches):
            keys, trees = [], []
            with np.errstate(over="ignore"):
                for s in shingles(batch.column(1), n):
                    keys.append(_key(s))
                    level = mixed(_signature(s, factors).reshape(TREES, DEPTH)) >> np.uint64(64 - BITS) if len(s) else None
                    trees.append((level << shift).sum(axis=1, dtype=np.uint64).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(trees, pa.list_(pa.int64()))], names=["doc_id", "k", "trees"])

    return texts_of(docs).mapInArrow(run, "doc_id long, k long, trees array<long>")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """Class key and shingle set of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        for batch in smaller(batches):
            found = [s for s in shingles(batch.column(1), n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["k", "n", "shingles"])

    return texts_of(docs).mapInArrow(run, "k long, n long, shingles binary")


def _similar(inter, a, b, least: Fraction):
    return inter * least.denominator >= least.numerator * (a + b - inter)


def _verified(pairs: DataFrame, least: Fraction) -> DataFrame:
    """Of rows (u, v, a, b) with both sets, the pairs whose Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                ok.append(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _intersections(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two blocks, by products of 0/1 matrices over the shingles that both have."""
    if len(xs) * len(ys) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in ys] for x in xs], np.int64).reshape(len(xs), len(ys))
    both = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    out = np.zeros((len(xs), len(ys)), np.int64)
    rows = []
    for block in (xs, ys):
        of = np.repeat(np.arange(len(block)), [len(s) for s in block])
        values = np.concatenate(block)
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        hit = both[at] == values if len(both) else np.zeros(len(values), bool)
        rows.append((of[hit], at[hit]))
    for start in range(0, len(both), 4096):
        parts = []
        for (of, at), block in zip(rows, (xs, ys)):
            inside = (at >= start) & (at < start + 4096)
            m = np.zeros((len(block), min(4096, len(both) - start)), np.float32)
            m[of[inside], at[inside] - start] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _forest(linked: np.ndarray, kx: list[int], ky: list[int]) -> list[tuple[int, int]]:
    """Edges that connect what the links of a task connect, one less than the members of each part."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = find(kx[i]), find(ky[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((kx[i], ky[j]))
    return out


def _counted_links(tasks: DataFrame, least: Fraction) -> DataFrame:
    """Compare the two sides of each task; rows (k, links) and edges (u, v) that connect what is linked.

    A task's rows arrive together and in order; links are counted in documents and never listed.
    """

    def compared(key, sides):
        same = key[0] == 0 and key[2] == key[3]
        (kx, wx, xs), (ky, wy, ys) = sides[0], sides[0] if same else sides[1]
        if not kx or not ky:
            return [], []
        nx, ny = np.array([len(s) for s in xs]), np.array([len(s) for s in ys])
        linked = _similar(_intersections(xs, ys), nx[:, None], ny[None, :], least)
        if same:
            np.fill_diagonal(linked, False)
        links = list(zip(kx, (linked @ np.array(wy)).tolist()))
        if not same:
            links += list(zip(ky, (linked.T @ np.array(wx)).tolist()))
        return [x for x in links if x[1]], _forest(linked, kx, ky)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        schema = pa.schema([("k", pa.int64()), ("links", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
        key, sides, links, joins = None, ([], [], []), [], []

        def out() -> pa.RecordBatch:
            rows = [(k, n, None, None) for k, n in links] + [(None, None, h, g) for h, g in joins]
            links.clear()
            joins.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=schema)

        for batch in batches:
            for kind, host, b1, b2, side, k, weight, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, host, b1, b2) != key:
                    if key is not None:
                        a, b = compared(key, sides)
                        links += a
                        joins += b
                        if len(links) + len(joins) > 20_000:
                            yield out()
                    key, sides = (kind, host, b1, b2), (([], [], []), ([], [], []))
                s = sides[side]
                s[0].append(k)
                s[1].append(weight)
                s[2].append(np.frombuffer(raw, np.uint64))
        if key is not None:
            a, b = compared(key, sides)
            links += a
            joins += b
        yield out()

    order = ["kind", "host", "b1", "b2"]
    parts = table_size(tasks.sparkSession)
    dealt = tasks.repartition(parts, *order).sortWithinPartitions(*order, "side", "k")
    return dealt.select("kind", "host", "b1", "b2", "side", "k", "weight", "shingles").mapInArrow(run, "k long, links long, u long, v long")


def _descent(reps: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The nodes where signatures meet at `depth` (tree, p, k), and the ties to verify (u, v), over all levels down to it.

    Prefixes start at their full depth and are shortened a level at a time. A signature is tied to the least one of
    the longest prefix that it shares; when a prefix is shortened, only the least of each node is tied on, to the
    least of the wider node, so signatures that met at a longer prefix cost nothing more.
    """
    entries = reps.select("k", F.posexplode("trees").alias("tree", "leaf"))
    at = lambda d: F.shiftright("leaf", BITS * (DEPTH - d))
    shared = entries.groupBy("tree", at(depth).alias("p")).agg(F.count("*").alias("size")).where("size > 1").drop("size")
    met = written(entries.withColumn("p", at(depth)).join(shared, ["tree", "p"]), "near-met")
    ties, level = None, met.select("tree", "leaf", F.col("k").alias("lead"))
    for d in range(DEPTH, depth - 1, -1):
        node = level.withColumn("q", at(d))
        least = node.groupBy("tree", "q").agg(F.min("lead").alias("least"))
        new = node.join(least, ["tree", "q"]).where("lead <> least").select(F.col("lead").alias("u"), F.col("least").alias("v"))
        ties = new if ties is None else ties.unionAll(new)
        level = node.groupBy("tree", "q").agg(F.min("lead").alias("lead"), F.first("leaf").alias("leaf")).select("tree", "leaf", "lead")
    return met, ties.distinct()


def _classes(docs: DataFrame, threshold: float, n: int, counted: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k) of all documents, and k with its class_id and n_links; links are counted only if asked for."""
    least = Fraction(str(threshold))
    rows = written(signed_texts(docs, n), "near-rows")
    reps = written(rows.where("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("weight"), F.first("trees").alias("trees")), "near-reps")
    met, ties = _descent(reps, depth_for(threshold))

    # Only documents that met another: their texts are read once more for their sets.
    involved = written(met.select("k").distinct().join(reps.select("k", "least_doc", "weight"), "k"), "near-involved")
    wanted = involved.select(F.coalesce("least_doc", F.lit(-(1 << 63))).alias("id")).distinct()
    again = texts_of(docs).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(wanted, "id", "left_semi").drop("id")
    sets = written(shingle_sets(again, n).join(involved.select("k", "weight"), "k").groupBy("k").agg(F.first("n").alias("n"), F.first("weight").alias("weight"), F.first("shingles").alias("shingles")), "near-sets")

    sizes = sets.select("k", "n")
    close = ties.join(sizes.select(F.col("k").alias("u"), F.col("n").alias("nu")), "u").join(sizes.select(F.col("k").alias("v"), F.col("n").alias("nv")), "v")
    close = close.where(F.least("nu", "nv") * least.denominator >= F.greatest("nu", "nv") * least.numerator).select("u", "v")
    left, right = sets.select(F.col("k").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("k").alias("v"), F.col("shingles").alias("b"))
    verified = written(_verified(close.join(left, "u").join(right, "v"), least), "near-verified")
    groups = components(verified, "near-groups")
    member = written(sizes.join(groups.select(F.col("node").alias("k"), F.col("component").alias("own")), "k", "left").select("k", "n", F.coalesce("own", "k").alias("own")), "near-members")

    # One row per node and group, so a large group counts once in each. Nodes of many groups tie them into clusters.
    seats = written(met.select("tree", "p", "k").join(member.select("k", "own"), "k").select("tree", "p", "own").distinct(), "near-seats")
    filled = seats.groupBy("tree", "p").agg(F.count("*").alias("groups"), F.min("own").alias("head")).where("groups > 1")
    dense = components(seats.join(filled.where(F.col("groups") > DENSE), ["tree", "p"]).select(F.col("own").alias("u"), F.col("head").alias("v")), "near-dense")
    cluster = dense.select(F.col("node").alias("own"), F.col("component").alias("c"))
    clustered = written(member.join(cluster, "own", "left").select("k", "n", "own", F.coalesce("c", "own").alias("g")), "near-clusters")

    # Blocks: a cluster of many shingles or documents is cut by hash into blocks of bounded size.
    blocks = lambda total, count: F.greatest(F.lit(1), F.ceil(total / BLOCK), F.ceil(count / BLOCK_DOCS)).cast("int")
    per = clustered.groupBy("g").agg(F.count("*").alias("members"), F.sum("n").alias("total"), (F.min("own") != F.max("own")).alias("several")).withColumn("nb", blocks(F.col("total"), F.col("members")))
    placed = clustered.join(per, "g").withColumn("b", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int"))
    # A group hangs together by what is verified; its members are compared with each other only to count links.
    inner = placed.where("members > 1" if counted else "several").select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    inner = inner.select(F.lit(0).alias("kind"), F.col("g").alias("host"), F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), (F.col("o") < F.col("b")).cast("int").alias("side"), "k")

    # Clusters that share a node of few groups: the larger is host, its guests come in blocks.
    sparse = seats.join(filled.where(F.col("groups") <= DENSE).select("tree", "p"), ["tree", "p"]).join(cluster, "own", "left").select("tree", "p", F.coalesce("c", "own").alias("g")).distinct()
    beside = sparse.join(sparse.select("tree", "p", F.col("g").alias("g2")), ["tree", "p"]).where("g < g2").select("g", "g2").distinct()
    total = per.select("g", "total", "members")
    beside = beside.join(total, "g").join(total.select(F.col("g").alias("g2"), F.col("total").alias("total2"), F.col("members").alias("members2")), "g2")
    first = F.col("total") >= F.col("total2")
    beside = written(beside.select(F.when(first, F.col("g")).otherwise(F.col("g2")).alias("host"), F.when(first, F.col("g2")).otherwise(F.col("g")).alias("guest"), F.least("total", "total2").alias("size"), F.when(first, F.col("members2")).otherwise(F.col("members")).alias("count")), "near-beside")
    visits = beside.groupBy("host").agg(blocks(F.sum("size"), F.sum("count")).alias("vb"))
    hosts = placed.join(visits, placed["g"] == visits["host"]).select("host", "k", "b", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("o"))
    guests = beside.join(visits, "host").join(per.select(F.col("g").alias("host"), "nb"), "host").join(clustered, beside["guest"] == clustered["g"]).select("host", "k", F.pmod(F.xxhash64("k"), F.col("vb")).cast("int").alias("o"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    outer = hosts.select(F.lit(1).alias("kind"), "host", F.col("b").alias("b1"), F.col("o").alias("b2"), F.lit(0).alias("side"), "k").unionAll(guests.select(F.lit(1).alias("kind"), "host", F.col("b").alias("b1"), F.col("o").alias("b2"), F.lit(1).alias("side"), "k"))
    tasks = inner.unionAll(outer).join(sets.select("k", "weight", "shingles"), "k")
    found = written(_counted_links(tasks, least), "near-links")

    joined = components(verified.unionAll(found.where("u IS NOT NULL").select("u", "v")), "near-joined")
    final = joined.select(F.col("node").alias("k"), F.col("component").alias("c"))
    every = reps.select("k", "least_doc", "weight").join(final, "k", "left").select("k", "least_doc", "weight", F.coalesce("c", "k").alias("c"))
    names = every.groupBy("c").agg(F.min("least_doc").alias("class_id"))
    links = found.where("k IS NOT NULL").groupBy("k").agg(F.sum("links").alias("links"))
    classes = written(every.join(names, "c").join(links, "k", "left").select("k", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "near-classes")
    removed(reps, met, involved, sets, verified, member, seats, clustered, beside, found)
    return rows, classes


def near_join(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Words are split at space and U+0009-U+000D; a document's set holds the hashes of its n-word shingles (of
    all words if fewer). Two documents link if their sets' Jaccard similarity is at least the threshold;
    class_id is the least doc_id that a document reaches over links, n_links the number of other documents
    it links to, copies included. Null texts and texts without words link to nothing: their own doc_id and 0.
    Null doc_ids join in with the rest and never name a class that has another. Repeated rows are copies.

    Documents of equal sets are one class from the start, so copies cost one row each. Class signatures lie in trees of
    sorted prefixes, which are shortened from their full depth, a level at a time, until a pair at the threshold meets
    with probability RECALL; on the way only the ties between the least members of nodes are verified. What these tie
    is a provisional group; groups that crowd one node form a cluster. All members of a cluster, and of clusters that
    share a node, are then compared exactly, in blocks of bounded size that give counts and connecting edges, never
    pairs. A pair at exactly the threshold that no tree brings together is missed with a probability below 1 - RECALL.
    """
    rows, classes = _classes(docs, threshold, n, True)
    alone = rows.where("k IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("k IS NOT NULL").select("doc_id", "k").join(classes, "k").select("doc_id", "class_id", "n_links").unionAll(alone)


def near_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """doc_id and class_id of near_join, without its links: groups that already hang together are not compared within."""
    rows, classes = _classes(docs, threshold, n, False)
    alone = rows.where("k IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return rows.where("k IS NOT NULL").select("doc_id", "k").join(classes.select("k", "class_id"), "k").select("doc_id", "class_id").unionAll(alone)
