"""Conversation prefix trie: suffix containers under trie heads, burst where oversized, sorted and swept where not."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import removed, table_size, written

#: Turns of suffixes that a container may hold before it is burst.
CONTAINER_TURNS = 20_000
#: Ids joined into one piece of a node's list of ended conversations.
PIECE_IDS = 50_000
#: The part of a conversation's number that tells which one opens it, and one more than the most turns taken from that one.
FAMILY, MOST_SHARED = 5, 9
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SWEPT = NODE + ", above array<long>"
NONE_ENDED = hashlib.sha256(b"").hexdigest()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, ids (a 64-bit hash of role and text for each turn, in order) and sums (UTF-8 bytes of the texts up to each turn).

    Turns are ordered by turn (null first), then role and text; a null role or text is empty; rows of a null
    conv_id belong to no conversation. One row holds 16 bytes a turn of its conversation and no text.
    """
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("conv_id", F.row_number().over(order).alias("at"), F.xxhash64("role", "text").alias("id"), F.sum(F.octet_length("text").cast("long")).over(upto).alias("sum"))
    turns = F.sort_array(F.collect_list(F.struct("at", "id", "sum")))
    return placed.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.sum").alias("sums"))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """Each conversation with its first h turns taken from the one that opens its family of five; h is crc32(conv_id) mod 9.

    The opening conversation gives all its turns where it has fewer, none where it is absent; the
    conversation's own turns from number h on follow.
    """
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = arrays.select("conv_id", "ids", "sums", family.alias("opens"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int").alias("h"))
    heads = arrays.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("opens"), F.slice("ids", 1, MOST_SHARED - 1).alias("head_ids"), F.slice("sums", 1, MOST_SHARED - 1).alias("head_sums"))
    both = own.join(heads, "opens", "left")
    none = F.array().cast("array<bigint>")
    first = F.when(F.col("head_ids").isNull(), none).otherwise(F.slice("head_ids", F.lit(1), F.col("h")))
    first_sums = F.when(F.col("head_ids").isNull(), none).otherwise(F.slice("head_sums", F.lit(1), F.col("h")))
    both = both.select(
        "conv_id", "h", first.alias("first"), first_sums.alias("first_sums"),
        F.slice("ids", F.col("h") + 1, F.size("ids")).alias("rest"), F.slice("sums", F.col("h") + 1, F.size("ids")).alias("rest_sums"),
        F.coalesce(F.try_element_at("sums", F.when(F.col("h") > 0, F.col("h"))), F.lit(0)).alias("cut"),
    )
    shift = F.coalesce(F.try_element_at("first_sums", F.lit(-1)), F.lit(0)) - F.col("cut")
    return both.select("conv_id", F.concat("first", "rest").alias("ids"), F.concat("first_sums", F.transform("rest_sums", lambda x: x + shift)).alias("sums"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) rows as comma-joined bytes: one row for each key and PIECE_IDS ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, ids = (batch.column(c).to_numpy() for c in range(3))
        new = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        starts = [s for a, b in zip(new, np.r_[new[1:], len(ids)]) for s in range(a, b, PIECE_IDS)]
        words = ids.astype(str)
        texts = [",".join(words[a:b]).encode() for a, b in zip(starts, [*starts[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(ids[starts]), pa.array(np.diff([*starts, len(ids)])), pa.array(texts, pa.binary())], names=["k1", "k2", "first", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces, a key after the other: the hash of each key's joined ids, their number and the least."""
    key, digest, n, least, out = None, None, 0, 0, []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "n", "conv_id", "ends"])

    for batch in batches:
        for k1, k2, first, count, ids in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, n, least, digest.hexdigest()))
                key, digest, n, least = (k1, k2), hashlib.sha256(ids), count, first
            else:
                digest.update(b"," + ids)
                n += count
        if len(out) > 10_000:
            yield table()
            out = []
    if key is not None:
        out.append((*key, n, least, digest.hexdigest()))
        yield table()


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """Every different sequence once: ids, sums, how many conversations are it, the least of them and the hash of all.

    A sequence is known by two 64-bit hashes of its ids. Copies are joined in pieces over ranges of (sequence,
    conv_id), so a sequence that many conversations share is split; only the pieces' bytes meet in one task.
    """
    n = table_size(conversations.sparkSession)
    keyed = conversations.select(F.xxhash64("ids").alias("k1"), F.xxhash64(F.reverse("ids"), F.size("ids")).alias("k2"), "conv_id")
    pieces = keyed.repartitionByRange(n, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_pieces, "k1 long, k2 long, first long, n long, ids binary")
    found = pieces.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, n long, conv_id long, ends string")
    return found.select("conv_id", "n", "ends").join(conversations, "conv_id")


def _common(a: str, b: str) -> Column:
    """How many leading elements two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers, one after the other and each in the order of its sequences, as nodes with the sums of their subtrees.

    A stack holds the open path. The nodes of one container are kept until it ends, since a parent's least
    member is known only then.
    """
    fields = [pa.field(x.split()[0], {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[x.split()[1]]) for x in SWEPT.split(", ")]
    nodes: list[list] = []
    # A frame: conv_id, n, children, leaves, saved, ends, numbers of its children in `nodes`.
    stack: list[list] = []
    head, depth, up, above, before, sums = None, 0, None, None, None, None

    def close(to: int) -> None:
        while len(stack) > to:
            least, n, children, leaves, saved, ends, below = stack.pop()
            at = depth + len(stack)
            saved += (n - 1) * int(sums[at - 1] - (sums[at - 2] if at > 1 else 0))
            leaves = leaves or 1
            for k in below:
                nodes[k][2] = least
            nodes.append([least, at, up, n, children, leaves, saved, ends, None if stack else above])
            if stack:
                top = stack[-1]
                top[0], top[1], top[2], top[3], top[4] = min(top[0], least), top[1] + n, top[2] + 1, top[3] + leaves, top[4] + saved
                top[6].append(len(nodes) - 1)

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes), fields)], schema=pa.schema(fields))

    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        values = {c: columns[c].values.to_numpy() for c in ("ids", "sums")}
        at = columns["ids"].offsets.to_numpy().tolist()
        sums_at = columns["sums"].offsets.to_numpy().tolist()
        plain = [columns[c].to_pylist() for c in ("head", "depth", "up", "n", "conv_id", "ends")]
        for k, (key, d, parent, n, conv, ends) in enumerate(zip(*plain)):
            ids = values["ids"][at[k] : at[k + 1]]
            if key != head:
                close(0)
                if len(nodes) > 10_000:
                    yield table()
                    nodes = []
                head, depth, up, above, shared = key, d, parent, columns["above"][k].as_py(), d - 1
            else:
                size = min(len(ids), len(before))
                same = ids[:size] == before[:size]
                shared = size if same.all() else int(same.argmin())
                close(shared - depth + 1)
            # Copied, so that the last row of a batch does not hold the whole batch.
            before, sums = ids.copy(), values["sums"][sums_at[k] : sums_at[k + 1]].copy()
            for _ in range(shared, len(ids)):
                stack.append([conv, 0, 0, 0, 0, NONE_ENDED, []])
            stack[-1][0], stack[-1][1], stack[-1][5] = min(stack[-1][0], conv), stack[-1][1] + n, ends
    close(0)
    if nodes:
        yield table()


def prefix_trie(conversations: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """The nodes of the trie of all sequences in `conversations` (conv_id, ids, sums; conv_id unique), one row each.

    A container holds the sequences under one head. One of more than container_turns turns below its head is
    burst: the turns that all its sequences share become nodes, and the next turn's id tells the new heads.
    Containers that are small enough are sorted and swept into nodes; their sums go to all heads above them.
    A hot prefix costs one round of bursting, however long it is; copies of a sequence are one row. No rows
    give no nodes. Ties do not exist: a node is a sequence of turns.
    """
    spark = conversations.sparkSession
    base = written(distinct_sequences(conversations), "trie-sequences")
    rows = base.select(F.lit(0).cast("long").alias("head"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("up"), F.array().cast("array<bigint>").alias("above"), "ids", "sums", "n", "conv_id", "ends")
    used, small, burst, ended = [base], [], [], []
    over = F.sum(F.size("ids") - F.col("depth")) > container_turns
    while True:
        sizes = rows.groupBy("head").agg(F.count("*").alias("seqs"), over.alias("over"), F.first("depth").alias("top"))
        large = sizes.where("(over AND seqs > 1) OR top = 0").select("head")
        span = rows.join(large, "head").groupBy("head").agg(
            F.min(F.struct("ids", "sums")).alias("low"), F.max("ids").alias("high"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.first("above").alias("above")
        )
        span = span.withColumn("low_ids", F.col("low.ids")).withColumn("stop", _common("low_ids", "high"))
        own = F.slice("low.sums", F.greatest(F.col("depth"), F.lit(1)), F.col("stop") - F.greatest(F.col("depth"), F.lit(1)) + 1)
        passed = F.when(F.col("depth") > 1, F.element_at("low.sums", F.greatest(F.col("depth") - 1, F.lit(1)))).otherwise(F.lit(0).cast("long"))
        heads = written(span.select("head", "depth", "stop", "n", "conv_id", "up", "above", F.when(F.col("stop") >= F.greatest(F.col("depth"), F.lit(1)), own).otherwise(F.array().cast("array<bigint>")).alias("sums"), passed.alias("passed")), "trie-heads")
        used.append(heads)
        if heads.isEmpty():
            small.append(rows)
            break
        small.append(rows.join(heads.select("head"), "head", "left_anti"))
        inside = rows.join(heads.select("head", "stop", F.col("conv_id").alias("least")), "head")
        ended.append(inside.where(F.size("ids") == F.col("stop")).select("head", "ends"))
        turn = F.element_at("ids", F.col("stop") + 1)
        rows = written(
            inside.where(F.size("ids") > F.col("stop")).select(F.xxhash64("head", turn).alias("head"), (F.col("stop") + 1).alias("depth"), F.col("least").alias("up"), F.concat("above", F.array("head")).alias("above"), "ids", "sums", "n", "conv_id", "ends"),
            "trie-rows",
        )
        used.append(rows)
        burst.append(heads)
    if not burst:
        removed(*used)
        return spark.createDataFrame([], NODE)

    def all_of(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    n = table_size(spark)
    columns = ["head", "depth", "up", "above", "n", "conv_id", "ends", "ids", "sums"]
    swept = written(all_of(small).select(columns).repartition(n, "head").sortWithinPartitions("head", "ids").mapInArrow(_sweep, SWEPT), "trie-swept")
    tops, heads = swept.where("above IS NOT NULL"), all_of(burst)
    # What lies under each burst head: the tops of swept containers, and the shared turns of heads burst below it.
    own = (F.col("n") - 1) * F.coalesce(F.try_element_at("sums", F.lit(-1)) - F.col("passed"), F.lit(0))
    below = tops.select(F.explode("above").alias("head"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).unionByName(heads.select(F.explode("above").alias("head"), F.lit(0).cast("long").alias("leaves"), own.alias("saved")))
    below = below.groupBy("head").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    next_heads = tops.select(F.element_at("above", -1).alias("head")).unionByName(heads.where("depth > 0").select(F.element_at("above", -1).alias("head")))
    forks = next_heads.groupBy("head").agg(F.count("*").alias("forks"))
    chains = heads.join(below, "head", "left").join(forks, "head", "left").join(all_of(ended), "head", "left")
    chains = chains.withColumn("at", F.explode(F.sequence("depth", "stop")))
    last, top = F.col("at") == F.col("stop"), F.col("at") == F.col("depth")
    total = F.coalesce(F.try_element_at("sums", F.lit(-1)), F.col("passed"))
    # The element of `sums` that stands for the turn before this node's own.
    place = F.col("at") - F.greatest(F.col("depth"), F.lit(1))
    before = F.when(place > 0, F.try_element_at("sums", F.greatest(place, F.lit(1)))).otherwise(F.col("passed"))
    leaves = F.coalesce("leaves", F.lit(0)) + F.when(F.col("forks").isNull(), 1).otherwise(0)
    chain_nodes = chains.select(
        "conv_id", F.col("at").cast("long").alias("depth"), F.when(top, F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("forks", F.lit(0))).otherwise(1).cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * (total - before)).cast("long").alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(NONE_ENDED))).otherwise(F.lit(NONE_ENDED)).alias("ends_sha256"),
    )
    out = written(swept.drop("above").unionByName(chain_nodes), "trie-nodes")
    removed(*used, swept)
    return out


def conversation_trie(conversations: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with the opening turns of its family.

    Nulls: see turn_arrays. An empty text is a turn of 0 bytes; repeated rows are repeated turns; columns other
    than conv_id, turn, role and text play no part; an empty table gives no nodes. Two different turns under
    one parent would count as one where their 64-bit hashes agree.
    """
    sequences = written(rebuilt(turn_arrays(conversations)), "trie-rebuilt")
    out = prefix_trie(sequences, container_turns)
    removed(sequences)
    return out
