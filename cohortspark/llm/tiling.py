"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, dropped, hashed, smaller, split_words, texts_of

#: Shortest tile in words, and the share of an item's words that tiles must cover.
LEAST_TILE, COVERAGE = 5, 0.5
#: An item shorter than that is a tile as a whole; it must not stand in more than this share of all documents, nor in more than so many of a few.
COMMON, FEW = 0.01, 10
#: Words of benchmark items that one broadcast block holds.
BLOCK_WORDS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def coded_words(texts: pa.Array) -> list[np.ndarray]:
    """The words of each text as 64-bit hashes: lower case, without punctuation at either end; bare punctuation is no word."""
    for c in BLANKS[1:]:
        texts = pc.replace_substring(texts, c, " ")
    codes, first, parts = split_words(texts)
    bare = pc.utf8_lower(pc.replace_substring_regex(parts, r"\A[^\pL\pN]+|[^\pL\pN]+\z", ""))
    keep = (pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0)[codes]
    words, ends = hashed(bare)[codes[keep]], np.r_[0, np.cumsum(keep)][first]
    return [words[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n words, from prefix sums modulo 2**64."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)], dtype=np.uint64)
        if n <= 8:
            out = np.zeros(len(words) - n + 1, np.uint64)
            for k in range(n):
                out += words[k : len(words) - n + 1 + k] * powers[n - 1 - k]
            return out
        return np.lib.stride_tricks.sliding_window_view(words, n) @ powers[::-1]


def _free_windows(marked: np.ndarray, n: int) -> np.ndarray:
    """Windows of n words none of which is marked."""
    total = np.r_[0, np.cumsum(marked)]
    return total[n:] == total[:-n] if len(marked) >= n else np.zeros(0, bool)


def _shared(item, doc, marked_item, marked_doc, n):
    """Pairs of places where an unmarked window of n words is the same in both, by hash and then by word."""
    a, b = rolled(item, n), rolled(doc, n)
    ka, kb = np.flatnonzero(_free_windows(marked_item, n)), np.flatnonzero(_free_windows(marked_doc, n))
    order = ka[np.argsort(a[ka], kind="stable")]
    low, high = np.searchsorted(a[order], b[kb], "left"), np.searchsorted(a[order], b[kb], "right")
    return order, [(k, lo, hi) for k, lo, hi in zip(kb[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist())]


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, words), longest first, none overlapping in either text.

    Each round finds the longest length that unmarked words still share, by bisection over lengths, and marks
    its matches from the left of the document; only shorter ones are left for the next round.
    """
    marked_item, marked_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    top = min(len(item), len(doc))
    while top >= least:
        low, high = least - 1, top
        while low < high:
            middle = (low + high + 1) // 2
            if _shared(item, doc, marked_item, marked_doc, middle)[1]:
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        order, found = _shared(item, doc, marked_item, marked_doc, low)
        for at, lo, hi in found:
            if marked_doc[at : at + low].any():
                continue
            for place in sorted(order[lo:hi].tolist()):
                if not marked_item[place : place + low].any() and (item[place : place + low] == doc[at : at + low]).all():
                    marked_item[place : place + low] = True
                    marked_doc[at : at + low] = True
                    out.append((place, at, low))
                    break
        # Every shared window of this length is now marked or overlaps a marked word.
        top = low - 1
    return out


class Items:
    """A block of benchmark items with the seeds by which documents find them."""

    def __init__(self, ids: list, texts: list[str], least: int, common: frozenset[int] = frozenset()):
        self.ids, self.least = ids, least
        self.words = coded_words(pa.array(texts, pa.string()))
        # Items shorter than a seed, by their number of words: hashes in order, and the item of each.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        parts = [(rolled(w, least), np.full(len(w) - least + 1, k), np.arange(len(w) - least + 1)) for k, w in enumerate(self.words) if len(w) >= least]
        for n in range(1, least):
            of = np.array([k for k, w in enumerate(self.words) if len(w) == n and k not in common], np.int64)
            if len(of):
                h = np.array([rolled(self.words[k], n)[0] for k in of], np.uint64)
                order = np.argsort(h, kind="stable")
                self.short[n] = h[order], of[order]
        h, item, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.seeds, self.item_of, self.place = h[order], item[order], at[order]

    def short_hits(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """(document, item) for each short item that stands in a document, once."""
        out: set[tuple[int, int]] = set()
        if not docs or not self.short:
            return []
        words, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
        for n, (hashes, items) in self.short.items():
            h = rolled(words, n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(lo < hi)
            doc = np.searchsorted(ends, hit, side="right")
            for at, d in zip(hit[hit + n <= ends[doc]].tolist(), doc[hit + n <= ends[doc]].tolist()):
                out |= {(d, k) for k in items[lo[at] : hi[at]].tolist() if (self.words[k] == words[at : at + n]).all()}
        return sorted(out)

    def search(self, docs: list[np.ndarray], coverage: float) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, item words, covered words, tiles, longest tile) wherever coverage is reached."""
        out = [(d, k, n, n, 1, n) for d, k in self.short_hits(docs) for n in (len(self.words[k]),)]
        if not docs or not len(self.seeds):
            return out
        n, words, ends = self.least, np.concatenate(docs), np.cumsum([len(d) for d in docs])
        h = rolled(words, n)
        hit = np.flatnonzero(self.seeds[np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)] == h)
        doc_of = np.searchsorted(ends, hit, side="right")
        inside = hit + n <= ends[doc_of]
        hit, doc_of = hit[inside], doc_of[inside]
        # Hits are in text order: those of a document lie together.
        some, start = np.unique(doc_of, return_index=True)
        for d, found in zip(some.tolist(), np.split(h[hit], start[1:])):
            found = np.unique(found)
            lo, hi = np.searchsorted(self.seeds, found, "left"), np.searchsorted(self.seeds, found, "right")
            rows = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist())])
            for k in np.unique(self.item_of[rows]).tolist():
                item = self.words[k]
                could = np.zeros(len(item), bool)
                for p in self.place[rows[self.item_of[rows] == k]].tolist():
                    could[p : p + n] = True
                if could.sum() < coverage * len(item):
                    continue
                laid = tiles(item, docs[d], n)
                covered = sum(t[2] for t in laid)
                if covered and covered >= coverage * len(item):
                    out.append((d, k, len(item), covered, len(laid), max(t[2] for t in laid)))
        return out


def item_blocks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TILE, common: float = COMMON, words: int = BLOCK_WORDS):
    """The benchmark's items in broadcast blocks of a bounded number of words (or one item); rows without text or words match nothing.

    Where a block has items shorter than a seed, the documents (doc_id, text) that hold each are counted in one more pass.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text IS NOT NULL")
    counted = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = -(-counted // words)
    for b in range(blocks):
        # Bounded by the block's size.
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if rows:
            ids, texts = [r["item_id"] for r in rows], [r["text"] for r in rows]
            often = common_items(docs, Items(ids, texts, least), ids, texts, least, common)
            yield spark.sparkContext.broadcast((ids, texts, least, often))


def common_items(docs: DataFrame, items: Items, ids: list, texts: list[str], least: int, common: float) -> frozenset[int]:
    """Numbers of the short items that stand in more than the share `common` of all documents, and in more than FEW."""
    if not items.short:
        return frozenset()
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        own = Items(*shared.value)
        counts = np.zeros(len(own.ids) + 1, np.int64)
        for batch in smaller(batches):
            counts[-1] += batch.num_rows
            np.add.at(counts, [k for _, k in own.short_hits(coded_words(batch.column(1)))], 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["item", "n"])

    rows = docs.mapInArrow(run, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).collect()
    count = {r["item"]: r["n"] for r in rows}
    most = max(FEW, common * count.pop(len(ids), 0))
    return frozenset(k for k, n in count.items() if n > most)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_TILE) -> DataFrame:
    """One row per document and benchmark item of which tiles cover at least `coverage`: doc_id, item_id, item_words,
    covered_words, coverage, tiles, longest_tile.

    Words are compared in lower case without outer punctuation. Seeds are windows of `least` words shared by both
    texts; where they could cover enough of an item, tiles are laid, so passages in another order are found as well.
    An item of fewer words is a seed and a tile by itself, wherever it stands; one that more than the share COMMON of all
    documents (and more than FEW) hold is a common word or phrase and leaks nowhere. Documents are never shuffled or cut: blocks of items come to
    them, one pass per block, and one more where a block has such short items. Null or empty texts leak nothing; repeated rows give their rows again; items of
    equal text each match.
    """
    schema = "doc_id long, item_id long, item_words long, covered_words long, coverage double, tiles long, longest_tile long"

    def searched(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dropped()
            items = Items(*block.value)
            for batch in smaller(batches):
                found = items.search(coded_words(batch.column(1)), coverage)
                ids = batch.column(0)
                rows = [(ids[d].as_py(), items.ids[k], n, c, c / n, t, m) for d, k, n, c, t, m in found]
                kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles", "longest_tile"])

        return run

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    out = None
    for block in item_blocks(source, benchmark, least):
        part = source.mapInArrow(searched(block), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_TILE) -> DataFrame:
    """The documents without a leak, all columns as they were; one pass per block of items, no shuffle."""
    place = docs.columns.index("text")

    def filtered(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dropped()
            items = Items(*block.value)
            for batch in smaller(batches, place):
                found = items.search(coded_words(pc.fill_null(batch.column(place), "")), coverage)
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in found]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in item_blocks(texts_of(docs), benchmark, least):
        docs = docs.mapInArrow(filtered(block), docs.schema)
    return docs
