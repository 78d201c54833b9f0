"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import bursttrie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def subtree(node):
        stack, leaves, saved = [node], 0, 0
        while stack:
            x = stack.pop()
            leaves += x not in children
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
            stack += children.get(x, [])
        return leaves, saved

    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), *subtree(node), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, convs, words=3, most=9):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randrange(most)):
            rows.append((c, t, r.choice(["user", "assistant"]) if t else "user", r.choice(["a", "bé", "", None][:words])))
    return rows


ROWS = {
    "shared prefixes": made(1, 120),
    "copies": [(c, t, "user", f"same {t}") for c in range(60) for t in range(6)] + made(2, 20),
    "long shared prefix": [(c, t, "user", "x" if t < 40 else f"{c % 7} {t}") for c in range(30) for t in range(44)],
    "nulls, ties and repeats": [(1, None, None, None), (1, None, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "lost"), (2, 0, "", ""), (3, 5, "z", "ü" * 3000), (0, 1, "user", "x"), (0, 1, "system", "x")],
    "one conversation": [(5, t, "user", str(t)) for t in range(12)],
    "alone": [(7, 0, "user", "hello")],
    "opening turns absent": [(1, 0, "user", "gone"), (6, 0, "user", "gone")],
}


@pytest.mark.parametrize("name", ROWS)
@pytest.mark.parametrize("turns", [1, 40])
def test_nodes(spark, name, turns):
    rows = ROWS[name]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", ids int, depth int")
    got = [tuple(r) for r in bursttrie.conversation_trie(df, turns).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_whole_containers_and_empty_table(spark):
    df = spark.createDataFrame(ROWS["shared prefixes"], SCHEMA)
    assert {tuple(r) for r in bursttrie.conversation_trie(df).collect()} == plain(ROWS["shared prefixes"])
    assert bursttrie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ends_are_joined_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(bursttrie, "PIECE_IDS", 7)
    rows = spark.range(100).select(F.col("id").alias("conv_id"), F.array(F.lit(3).cast("long")).alias("ids"), F.array(F.lit(1).cast("long")).alias("sums"))
    got = bursttrie.distinct_sequences(rows).collect()
    assert [(r["n"], r["conv_id"], r["ends"]) for r in got] == [(100, 0, hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest())]
