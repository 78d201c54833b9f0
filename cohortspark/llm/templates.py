"""Line dedup: a fixed-depth template tree over lines and sentences, and passages by content-chosen windows; what recurs across documents goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import BASE, BLANKS, bytes_of, dropped, gathered, hashed_words, mixed, removed, smaller, spread, summed, written

#: A line, sentence or template recurs if this many documents hold it; a passage if two do.
LEAST_DOCUMENTS, LEAST_SHARING = 3, 2
#: Shortest unit in words, for whole lines and for sentences inside them.
LINE_WORDS, SENTENCE_WORDS = 3, 8
#: Leading words that are a unit's path in the tree, and the fixed words that a template has at least, and as a share.
LEADING, FIXED_WORDS, FIXED_SHARE = 2, 3, 2 / 3
#: Words of a window, neighbouring windows of which the least is chosen, and the words of a run that is a passage.
WINDOW, CHOICE, RUN = 16, 16, 20
#: A document of whose words this share goes is itself a repeat.
REPEAT = 0.8
#: Recurring keys that are broadcast at most (16 bytes each); more are joined.
BROADCAST_TEMPLATES = 3_000_000

#: The two lowest bits of a key tell lines and sentences, windows and leaves of the tree apart.
UNIT, PASSAGE, LEAF = 0, 1, 2
# Words that are variable fields (numbers, dates, hexadecimal ids, addresses, links).
FIELDS = (r"\A\W*[0-9.,:/%+-]*[0-9][0-9.,:/%+-]*\w{0,3}\W*\z", r"\A\W*(?:[0-9a-fA-F-]{5,}[0-9][0-9a-fA-F-]*|[0-9a-fA-F-]*[0-9][0-9a-fA-F-]{5,})\W*\z", r"\A\W*(?:\S+@\S+|\w+://\S+|www\.\S+)\z")
FIELD = np.uint64(0x2545F4914F6CDD1D)


#: For each byte whether it separates words (0), is part of one (1) or a line feed (2).
KINDS = bytes(2 if c == 10 else 0 if chr(c) in BLANKS else 1 for c in range(256))
#: Bytes of text, or one row, that are worked on at once: what they need stays near the processor.
BATCH = 1_000_000


def _flags(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """The least (or greatest) of every n neighbours."""
    width = 1
    while 2 * width <= n:
        x, width = least(x[:-width], x[width:]), 2 * width
    return least(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


class Units:
    """The lines, sentences and chosen windows of a batch of texts and their keys.

    A text is cut at line feeds; a sentence ends at a word that ends in . ! ? or an ellipsis. Word places are global in
    the batch; a unit is [start, end). A window is WINDOW words in a row, across line feeds as well; of CHOICE
    neighbouring ones the one of the least hash is chosen, so texts that share WINDOW + CHOICE - 1 words choose a window
    in them alike, wherever they stand.
    """

    def __init__(self, texts: pa.Array, windows: bool = True):
        raw, at = self.raw, self.at = bytes_of(texts)
        self._split()
        n, is_feed, ends, last = len(self.first), self.is_feed, self.text_ends, self.last
        self.doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        breaks = np.zeros(n + 1, bool)
        breaks[ends] = True
        # Line starts: after a feed or at a new text.
        breaks[1:] |= is_feed
        breaks[:-1] |= is_feed
        at_line = breaks.copy()
        at_line[n] = True
        lines = self._runs(breaks[:-1], is_feed)
        final = raw[last - 1]
        stop = (final == ord(".")) | (final == ord("!")) | (final == ord("?"))
        some = np.flatnonzero((final == 0xA6) & (last - self.first >= 3))
        stop[some[(raw[last[some] - 2] == 0x80) & (raw[last[some] - 3] == 0xE2)]] = True  # an ellipsis
        breaks[1:] |= stop
        sentences = self._runs(breaks[:-1], is_feed)
        sentences = sentences[sentences[:, 1] - sentences[:, 0] >= SENTENCE_WORDS]
        # A sentence that is a whole line is that line's unit.
        sentences = sentences[~(at_line[sentences[:, 0]] & at_line[sentences[:, 1]])]
        lines = lines[lines[:, 1] - lines[:, 0] >= LINE_WORDS]
        spans = np.concatenate([lines, sentences])
        self.start, self.end = spans[:, 0], spans[:, 1]
        self.of = self.doc[self.start] if len(spans) else np.zeros(0, np.int64)
        self._fields()
        with np.errstate(over="ignore"):
            self._key()
            if windows:
                self._choose()

    def _split(self) -> None:
        """Where each word and line feed of the batch begins and ends in its bytes, and its hash; a line feed is a word of its own."""
        size = len(self.raw)
        kinds = np.zeros(size + 2, np.uint8)
        text = self.raw.tobytes()
        kinds[1:-1] = np.frombuffer(text.translate(KINDS), np.uint8)
        before, after = kinds[:-1], kinds[1:]
        turn = before != after
        turn[self.at] = True
        self.first = np.flatnonzero((after != 0) & (turn | (after == 2)))
        self.last = np.flatnonzero((before != 0) & (turn | (before == 2)))
        self.is_feed = after[self.first] == 2
        self.text_ends = np.searchsorted(self.first, self.at)
        self.words = hashed_words(np.frombuffer(text.translate(None, BLANKS.replace("\n", "").encode()), np.uint8), self.last - self.first)

    def _fields(self) -> None:
        """Words that are variable fields get one hash. Only those with a digit, an @, :// or www can be."""
        raw, (a, b, c) = self.raw, (self.raw[k : len(self.raw) - 2 + k] for k in range(3)) if len(self.raw) > 2 else (self.raw[:0],) * 3
        odd = (raw - np.uint8(ord("0")) < 10) | (raw == ord("@"))
        odd[: len(a)] |= ((a == ord(":")) & (b == ord("/")) & (c == ord("/"))) | ((a == ord("w")) & (b == ord("w")) & (c == ord("w")))
        of = np.searchsorted(self.first, np.flatnonzero(odd), "right") - 1
        of = of[np.r_[True, of[1:] != of[:-1]]] if len(of) else of
        size = self.last[of] - self.first[of]
        places = summed(size).astype(np.int32)
        words = pa.StringArray.from_buffers(len(of), pa.py_buffer(places), pa.py_buffer(raw[spread(self.first[of], size)])).dictionary_encode()
        if len(of):
            self.words[of[np.logical_or.reduce([_flags(words.dictionary, f) for f in FIELDS])[words.indices.to_numpy()]]] = FIELD

    @staticmethod
    def _runs(breaks: np.ndarray, is_feed: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(breaks)
        ends = np.r_[starts[1:], len(breaks)]
        real = ~is_feed[starts]
        return np.stack([starts[real], ends[real]], axis=1).astype(np.int64) if len(starts) else np.zeros((0, 2), np.int64)

    @staticmethod
    def _of_kind(x: np.ndarray, kind: int) -> np.ndarray:
        return ((mixed(x) & ~np.uint64(3)) | np.uint64(kind)).view(np.int64)

    def _key(self) -> None:
        """Each unit's key, of its path (word count and leading words) and all its words, and the leaf at the end of its path.

        A unit of so few words that no template fits in lies in no leaf.
        """
        size = self.end - self.start
        # Every word is mixed with its place in the unit, so sums over places are exact prefix differences.
        begin, at = np.cumsum(size) - size, spread(self.start, size)
        place = (at - np.repeat(self.start, size)).astype(np.uint64)
        place *= BASE
        place += self.words[at]
        total = summed(mixed(place))
        lead = np.minimum(size, LEADING)
        self.leaf = mixed(total[begin + lead] - total[begin] + size.astype(np.uint64) * BASE)
        self.keys = self._of_kind(total[begin + size] - total[begin] + self.leaf, UNIT)
        self.leaves, self.deep = self._of_kind(self.leaf, LEAF), size > FIXED_WORDS

    def _choose(self) -> None:
        """The chosen windows: key, document and place among the words that are no line feeds."""
        self.plain = np.flatnonzero(~self.is_feed)
        words, doc = mixed(self.words[self.plain]), self.doc[self.plain]
        n, span = len(words) - WINDOW + 1, WINDOW + CHOICE - 1
        self.chosen = np.zeros(0, np.int64)
        if len(words) >= span:
            # The k-th word of a window counts 2k + 1 times: from prefix sums of words and of words times their places.
            place = np.arange(len(words), dtype=np.uint64)
            once, placed = (summed(x) for x in (words, words * place))
            once, placed = once[WINDOW:] - once[:n], placed[WINDOW:] - placed[:n]
            rolled = mixed((np.uint64(2) * (placed - place[:n] * once) + once) * BASE) | np.uint64(1)
            low = _sliding(rolled, CHOICE, np.minimum)
            low[doc[: len(low)] != doc[span - 1 :]] = 0
            edge = np.zeros(CHOICE - 1, np.uint64)
            self.chosen = np.flatnonzero(_sliding(np.r_[edge, low, edge], CHOICE, np.maximum) == rolled)
            rolled = rolled[self.chosen]
        self.window_keys = self._of_kind(rolled, PASSAGE) if len(self.chosen) else np.zeros(0, np.int64)
        self.window_of = doc[self.chosen]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, key) pairs."""
        doc = np.concatenate([self.of, self.window_of, self.of[self.deep]])
        keys = np.concatenate([self.keys, self.window_keys, self.leaves[self.deep]])
        with np.errstate(over="ignore"):
            once = np.unique(mixed(keys.view(np.uint64) + doc.astype(np.uint64) * BASE), return_index=True)[1]
        return doc[once], keys[once]

    def drop(self, gone: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words to drop, given for each unit and each window whether it goes; and how many units and passages each text loses."""
        texts = len(self.text_ends) - 1
        out = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(out, self.start[gone], 1)
        np.add.at(out, self.end[gone], -1)
        words = np.cumsum(out)[:-1] > 0
        cover = np.zeros(len(self.plain) + 1, np.int64)
        np.add.at(cover, self.chosen[shared], 1)
        np.add.at(cover, self.chosen[shared] + WINDOW, -1)
        # A run ends with its text.
        covered, doc = np.cumsum(cover)[:-1] > 0, self.doc[self.plain]
        turn = np.r_[True, (covered[1:] != covered[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(turn)
        size = np.diff(np.r_[first, len(covered)])
        passage = covered[first] & (size >= RUN)
        words[self.plain[np.repeat(passage, size)]] = True
        return words, np.bincount(self.of[gone], minlength=texts) + np.bincount(doc[first[passage]], minlength=texts)


    def without(self, text: int, gone: np.ndarray) -> str:
        """A text without its dropped words; kept stretches stay as they were, and a line that is now blank goes."""
        a, b = self.text_ends[text], self.text_ends[text + 1]
        turn = np.flatnonzero(np.diff(np.r_[True, gone[a:b], True]))
        begins, ends = self.first[a + turn[::2]].tolist(), self.last[a + turn[1::2] - 1].tolist()
        lines = b" ".join([self.raw[x:y].tobytes() for x, y in zip(begins, ends)]).decode().split("\n")
        return "\n".join([x.strip(BLANKS) if len(begins) > 1 else x for x in lines if x.strip(BLANKS)])


def _places(ids: pa.Array) -> np.ndarray:
    """The order of documents: doc_id, null ones last."""
    return pc.fill_null(ids.cast(pa.int64()), (1 << 63) - 1).to_numpy()


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def recurring_keys(docs: DataFrame, least_documents: int) -> DataFrame:
    """key and the first document's place of everything that recurs: one row for each document and key, pre-aggregated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        for batch in smaller(batches, 1, BATCH):
            doc, keys = Units(batch.column(1)).rows()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(_places(batch.column(0))[doc])], names=["key", "place"])

    counted = _source(docs).mapInArrow(run, "key long, place long").groupBy("key").agg(F.count("*").alias("documents"), F.min("place").alias("place"))
    return counted.where(F.col("documents") >= F.when(F.expr(f"key & 3 = {PASSAGE}"), LEAST_SHARING).otherwise(least_documents)).select("key", "place")


def _leaf_units(docs: DataFrame, found: DataFrame, broadcast_most: int) -> DataFrame:
    """leaf, key and place of every unit in a leaf that recurs, and the words of each key once at least.

    found: the recurring keys and their first places. A unit that recurs as it stands gives its words in its first
    document only; one that stands several times in a document gives several rows.
    """
    few = found.count() <= broadcast_most
    leaves, whole = found.where(f"key & 3 = {LEAF}").select("key"), found.where(f"key & 3 = {UNIT}").select("key", "place")
    known = (np.sort(*gathered(leaves)), *gathered(whole)) if few else None
    if few:
        order = np.argsort(known[1])
        known = known[0], known[1][order], known[2][order]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        known = shared.value
        for batch in smaller(batches, 1, BATCH):
            units = Units(batch.column(1), windows=False)
            places, open_ = _places(batch.column(0))[units.of], units.deep
            told = np.ones(len(open_), bool)
            if known is not None:
                own, keys, firsts = known
                open_ = open_ & (own[np.minimum(np.searchsorted(own, units.leaves), len(own) - 1)] == units.leaves) if len(own) else np.zeros(len(open_), bool)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, units.keys), len(keys) - 1)
                    told = (keys[at] != units.keys) | (firsts[at] == places)
            some = np.flatnonzero(open_)
            sizes = np.where(told[some], units.end[some] - units.start[some], 0)
            ends = np.cumsum(sizes)
            at = np.repeat(units.start[some] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
            words = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(units.words[at].view(np.int64)), mask=pa.array(~told[some]))
            yield pa.RecordBatch.from_arrays([pa.array(units.leaves[some]), pa.array(units.keys[some]), pa.array(places[some]), words], names=["leaf", "key", "place", "words"])

    units = _source(docs).mapInArrow(run, "leaf long, key long, place long, words array<long>")
    if not few:
        units = units.join(leaves.select(F.col("key").alias("leaf")), "leaf", "left_semi")
    return units


def _sorted_if_few(longs: DataFrame, most: int):
    """The one long column of a table as a broadcast sorted array, or None where it has more than `most` rows."""
    return longs.sparkSession.sparkContext.broadcast(np.sort(*gathered(longs))) if longs.count() <= most else None


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _slots(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of units (key, leaf, documents, words): the hash of leaf, position and word for each of their words, and the unit of each."""
    words = batch.column(3)
    offsets = words.offsets.to_numpy().astype(np.int64)
    values = words.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    unit = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    at = (np.arange(len(values)) - (offsets[:-1] - offsets[0])[unit]).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(mixed(values + (at + np.uint64(1)) * BASE) + batch.column(1).to_numpy().view(np.uint64)[unit]).view(np.int64), unit


def general_templates(docs: DataFrame, found: DataFrame, least_documents: int, broadcast_most: int) -> DataFrame:
    """key and place of the units whose template recurs: place is the first document's of the template.

    In each leaf of the tree (word count and leading words) the values of every position are counted over all its units,
    lines and sentences of any length. A value that fewer than `least_documents` documents have there is a variable
    field. A unit's template is what remains fixed, at least FIXED_WORDS words and FIXED_SHARE of them; documents are counted by
    doc_id.
    """
    units = written(_leaf_units(docs, found, broadcast_most), "units")
    documents = units.select("key", "place").distinct().groupBy("key").agg(F.count("*").alias("documents"))
    once = units.where("words IS NOT NULL").groupBy("key").agg(F.first("leaf").alias("leaf"), F.first("words").alias("words"))
    once = written(once.join(documents, "key").select("key", "leaf", "documents", "words"), "units-once")
    # A leaf of one unit has nothing to generalise: what recurs there recurs as it stands.
    several = once.groupBy("leaf").agg(F.count("*").alias("units")).where("units > 1").select("leaf")
    leaves = _sorted_if_few(several, broadcast_most)
    source = once if leaves else once.join(several, "leaf", "left_semi").select("key", "leaf", "documents", "words")

    def shared(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_among(batch.column(1).to_numpy(), leaves.value))) if leaves else batch

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        for batch in map(shared, batches):
            slots, unit = _slots(batch)
            once, of = np.unique(slots, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(once), pa.array(np.bincount(of, batch.column(2).to_numpy()[unit], len(once)).astype(np.int64))], names=["slot", "documents"])

    fixed = source.mapInArrow(counted, "slot long, documents long").groupBy("slot").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least_documents).select("slot")
    fixed = written(fixed, "fixed-words")
    known = _sorted_if_few(fixed, broadcast_most)

    def generalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, words, and what is fixed: each word's slot, or at once their number and the template they make."""
        dropped()
        for batch in map(shared, batches):
            slots, unit = _slots(batch)
            sizes = np.bincount(unit, minlength=batch.num_rows)
            if known is None:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(unit)), pa.array(sizes[unit]), pa.array(np.ones(len(unit), np.int64)), pa.array(slots)], names=["key", "n", "fixed", "template"])
                continue
            stays = _among(slots, known.value)
            slots, unit = slots[stays], unit[stays]
            some, first = np.unique(unit, return_index=True)
            template = np.bitwise_xor.reduceat(slots, first) if len(first) else slots
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(sizes[some]), pa.array(np.bincount(unit, minlength=batch.num_rows)[some]), pa.array(template)], names=["key", "n", "fixed", "template"])

    stays = source.mapInArrow(generalised, "key long, n long, fixed long, template long")
    if known is None:
        stays = stays.join(fixed.withColumnRenamed("slot", "template"), "template", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.sum("fixed").alias("fixed"), F.bit_xor("template").alias("template"))
    # Written, so that the join below is free to split a unit that very many documents hold.
    stays = written(stays.where((F.col("fixed") >= FIXED_WORDS) & (F.col("fixed") >= F.col("n") * FIXED_SHARE)).select("key", "template"), "unit-templates")
    held = units.select("key", "place").join(stays, "key").select("template", "place").distinct()
    first = held.groupBy("template").agg(F.count("*").alias("documents"), F.min("place").alias("place")).where(F.col("documents") >= least_documents)
    out = written(stays.join(first, "template").select("key", "place"), "general")
    removed(units, once, fixed, stays)
    return out


def recurring_templates(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, broadcast_most: int = BROADCAST_TEMPLATES) -> DataFrame:
    """key and first place of every recurring line, sentence and window, and of every line and sentence of a recurring template."""
    found = written(recurring_keys(docs, least_documents), "recurring")
    general = general_templates(docs, found, least_documents, broadcast_most)
    out = written(found.where(f"key & 3 <> {LEAF}").unionAll(general).groupBy("key").agg(F.min("place").alias("place")), "templates")
    removed(found, general)
    return out


def _rewritten(batch: pa.RecordBatch, place: int, gone_of, repeat: float) -> tuple:
    """New texts, words before and after, dropped units, and whether each document stays."""
    units = Units(pc.fill_null(batch.column(place), ""))
    gone, count = units.drop(*gone_of(units))
    words, n = ~units.is_feed, batch.num_rows
    before, after = np.bincount(units.doc[words], minlength=n), np.bincount(units.doc[words & ~gone], minlength=n)
    stays = ~((after < before) & ((after == 0) | (before - after >= repeat * before)))
    changed = np.flatnonzero(count)
    mask = np.zeros(n, bool)
    mask[changed] = True
    texts = pa.array([units.without(k, gone) for k in changed.tolist()], pa.string())
    return pc.replace_with_mask(batch.column(place).cast(pa.string()), pa.array(mask), texts), before, after, count, stays


def _marker(keys: np.ndarray, places: np.ndarray):
    """Which units and windows of a batch hold one of the sorted keys that was first seen in an earlier document."""

    def earlier(found: np.ndarray, own: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        return (keys[at] == found) & (places[at] < own)

    return lambda units, ids: (earlier(units.keys, ids[units.of]), earlier(units.window_keys, ids[units.window_of]))


def _deduplicated(docs: DataFrame, least_documents: int, broadcast_most: int, schema, result) -> DataFrame:
    """Map every batch of docs (any columns, doc_id and text among them) with result(batch, mark); mark(units) says which units and windows go."""
    spark = docs.sparkSession
    names = docs.columns
    at_id, at_text = names.index("doc_id"), names.index("text")
    recurring = recurring_templates(docs, least_documents, broadcast_most)
    if recurring.count() <= broadcast_most:
        keys, places = gathered(recurring.select("key", "place"))
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], places[order]))
        del keys, places, order
        removed(recurring)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dropped()
            mark = _marker(*shared.value)
            for batch in smaller(batches, at_text, BATCH):
                ids = _places(batch.column(at_id))
                yield result(batch, lambda units: mark(units, ids))

        return docs.mapInArrow(run, schema)

    # Each document's own keys meet the recurring ones; what is found goes back to it by doc_id and a hash of its text.
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        for batch in smaller(batches, 1, BATCH):
            doc, keys = Units(batch.column(1)).rows()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(_places(batch.column(0))[doc]), batch.column(2).take(pa.array(doc))], names=["key", "own", "row"])

    row = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))
    # Rows of one key on this side are split where they are many; the other side has one row for each key.
    hits = _source(docs).withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(keyed, "key long, own long, row long").join(recurring, "key").where("place < own")
    per = hits.groupBy("row").agg(F.collect_set("key").alias("keys"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), row.alias("row")).join(per, "row", "left")
    joined = packed.select(*[F.col("doc")[c].alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col("keys"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        for batch in smaller(batches, at_text, BATCH):
            lists = batch.column(batch.num_columns - 1)
            own = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            order = np.lexsort((own, keys := lists.flatten().to_numpy()))
            keys, own = keys[order], own[order]

            def among(found: np.ndarray, of: np.ndarray) -> np.ndarray:
                """Whether (key, document) is one of the sorted pairs."""
                lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                out = np.zeros(len(found), bool)
                for k in np.flatnonzero(hi > lo).tolist():
                    at = lo[k] + np.searchsorted(own[lo[k] : hi[k]], of[k])
                    out[k] = at < hi[k] and own[at] == of[k]
                return out

            yield result(pa.RecordBatch.from_arrays(batch.columns[:-1], names=names), lambda units: (among(units.keys, units.of), among(units.window_keys, units.window_of)))

    return joined.mapInArrow(run_joined, schema)


def line_dedup(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, repeat: float = REPEAT, broadcast_most: int = BROADCAST_TEMPLATES) -> DataFrame:
    """doc_id, text, words_before, words_after, dropped_units, kept for every document.

    Units are lines, and sentences of at least SENTENCE_WORDS words inside longer lines. A unit's path in the tree is
    its word count and its first LEADING words; words that are variable fields count as one wildcard, and the leaf
    generalises the words of units that differ (general_templates). What at least `least_documents` documents hold is
    dropped from all but the first of them (least doc_id, null last; rows of that doc_id all keep it). Runs of at
    least RUN words that lie in chosen windows which an earlier document holds are passages and go from the second
    document on; any 50 words in a row that two documents share are found, but for a few words at their ends.
    A document with nothing left, or of all whose words at least `repeat` go, is a repeat: kept is false.
    Null and blank texts stay as they are and are kept; an empty table gives no rows; other columns play no part. Only keys, doc_ids and the words of units that share a leaf are
    shuffled, pre-aggregated. Keys are 64-bit hashes, two bits of which tell their kind.

    Recurring keys are broadcast only where their count is within `broadcast_most`; beyond it each
    document's keys are joined to them, with the same result.
    """
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def result(batch, gone_of) -> pa.RecordBatch:
        text, before, after, count, stays = _rewritten(batch, 1, gone_of, repeat)
        return pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(count, pa.int64()), pa.array(stays)], names=["doc_id", "text", "words_before", "words_after", "dropped_units", "kept"])

    return _deduplicated(source, least_documents, broadcast_most, "doc_id long, text string, words_before long, words_after long, dropped_units long, kept boolean", result)


def without_repeats(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, repeat: float = REPEAT, broadcast_most: int = BROADCAST_TEMPLATES) -> DataFrame:
    """The documents that line_dedup keeps, with their new texts and all other columns as they were."""
    names = docs.columns
    at = names.index("text")

    def result(batch, gone_of) -> pa.RecordBatch:
        text, _, _, _, stays = _rewritten(batch, at, gone_of, repeat)
        return pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(batch.columns)], names=names).filter(pa.array(stays))

    return _deduplicated(docs, least_documents, broadcast_most, docs.schema, result)
