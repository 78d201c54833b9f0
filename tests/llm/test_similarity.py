"""Near-duplicate join, benchmark leaks and line dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import graph, nearjoin, queries, templates, tiling

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]


def prose(n, source=rng):
    return " ".join(source.choice(WORDS) for _ in range(n))


def varied(text, k, source=rng):
    w = text.split()
    for _ in range(k):
        w[source.randrange(len(w))] = source.choice(WORDS)
    return " ".join(w)


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(set)
    for k, s in enumerate(sets):
        for x in s:
            where[x].add(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > k}:
            if len(s & sets[j]) >= threshold * len(s | sets[j]) - 1e-12:
                links[k] += 1
                links[j] += 1
                parent[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return Counter((i, least.get(find(k)), links[k]) for k, (i, _) in enumerate(rows))


def hostile():
    base, other = prose(120), prose(300)
    rows = [(k, varied(base, 2)) for k in range(60)] + [(100 + k, base) for k in range(30)]
    rows += [(200 + k, varied(other, 12)) for k in range(40)] + [(300 + k, prose(80)) for k in range(60)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "one two"), (None, base), (None, "only null here at all"), (405, "x " * 9000), (406, "x " * 9000), (7, varied(base, 2))]
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "doc_id long, text string, k int, g string, weight int").repartition(5)


@pytest.mark.parametrize("block, dense", [(nearjoin.BLOCK, nearjoin.DENSE), (700, 3)])
def test_near_join(spark, small, block, dense, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK", block)
    monkeypatch.setattr(nearjoin, "DENSE", dense)
    rows = hostile()
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in nearjoin.near_join(as_docs(spark, rows)).collect())
    assert got == brute_near(rows)
    if block == 700:
        docs = queries.table(spark, small, "documents")
        got = Counter((r.doc_id, r.class_id, r.n_links) for r in nearjoin.near_join(docs).collect())
        assert got == brute_near([(r.doc_id, r.text) for r in docs.collect()])


def test_near_join_empty(spark, no_docs):
    assert nearjoin.near_join(no_docs).count() == 0


def test_forest_depth():
    assert nearjoin.depth_for(0.8) == 5 and nearjoin.depth_for(0.8, recall=0.9999999) == 4


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (5, 5), (102, 101), (102, 101)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_tiles(item, doc, least):
    mi, md, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best, found = least, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not mi[i + k] and not md[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return covered
        for i, j in sorted(found, key=lambda x: (x[1], x[0])):
            if not any(mi[i : i + best]) and not any(md[j : j + best]):
                mi[i : i + best], md[j : j + best] = [True] * best, [True] * best
                covered += best


@pytest.mark.parametrize("seed", range(25))
def test_tiles_match_plain_tiling(seed):
    g = np.random.default_rng(seed)
    item = g.integers(0, 6, 40).astype(np.uint64)
    doc = np.concatenate([item[20:35], g.integers(0, 6, 60).astype(np.uint64), item[3:20]])
    laid = tiling.tiles(item, doc, 3)
    assert all((item[a : a + n] == doc[b : b + n]).all() for a, b, n in laid)
    assert sum(t[2] for t in laid) == plain_tiles(item.tolist(), doc.tolist(), 3)


def test_leaks(spark, no_docs):
    items = [(k, prose(30)) for k in range(20)] + [(20, "tiny item"), (21, ""), (22, None), (23, prose(3000)), (19, prose(30))]
    text = dict(items)
    w = text[3].split()
    swapped = " ".join(w[15:] + w[:15])
    rows = [(1, prose(100) + " " + text[2].upper() + ". " + prose(50)), (2, prose(40) + " " + swapped + " " + prose(10)), (3, prose(200)), (4, None), (5, ""), (6, "a Tiny, item here"), (9, "Tiny, item!"), (7, prose(9000) + " " + text[5]), (8, " ".join(w[:10])), (None, text[4]), (1, text[2])]
    docs, bench = as_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect())
    assert got == Counter([(1, 2), (1, 2), (2, 3), (6, 20), (9, 20), (7, 5), (None, 4)])
    clean = tiling.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 8]
    assert tiling.leaks(no_docs, bench).count() == 0 and tiling.leaks(docs, bench.where("false")).count() == 0


def test_short_items(spark):
    """Items of one to four words count like others where they stand, unless they are common; words stand in one document only."""
    items = [(1, "zyxomma"), (2, "capital of France"), (3, "the of"), (4, "a b c d"), (5, "of"), (6, "Zyxomma!"), (7, "one two three four five")]
    texts = ["Question: the capital of France is Paris.", "capital of", "France zyxomma", "x a b c d y", "a b c", "d a b", "zyxomma", "", None, "one two three four five", "one two three"]
    docs = as_docs(spark, [(k, t) for k, t in enumerate(texts)] + [(100 + k, f"{prose(5)} the of {prose(5)}") for k in range(30)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in docs.collect():
        own = [w.strip(".!?:,").lower() for w in (r.text or "").split()]
        for k, t in items:
            w = [x.strip("!").lower() for x in t.split()]
            if k not in (3, 5, 7) and any(own[i : i + len(w)] == w for i in range(len(own))):
                want[(r.doc_id, k)] += 1
    want[(9, 7)] += 1
    assert Counter((r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()) == want and (0, 2) in want
    kept = {r.doc_id for r in tiling.decontaminated(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_leaks_by_brute_force(spark, small):
    """Every document of the smallest table against every item, by plain tiling."""
    docs, bench = queries.table(spark, small, "documents"), queries.table(spark, small, "benchmark")
    items = [(r.item_id, tiling.coded_words(pa.array([r.text or ""]))[0]) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        words = [w.strip("".join({c for c in w if not c.isalnum()})).lower() for w in (r.text or "").split()]
        words = tiling.coded_words(pa.array([" ".join(w for w in words if w)]))[0]
        own = set(words.tolist())
        for item, w in items:
            # Plain tiling only where enough words are shared at all.
            if len(w) >= 5 and sum(x in own for x in w.tolist()) >= 0.5 * len(w) and sum(t[2] for t in tiling.tiles(w, words, 5)) >= 0.5 * len(w):
                want.add((r.doc_id, item))
    assert want and {(r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()} == want
    kept = {r.doc_id for r in tiling.decontaminated(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_leaks_in_blocks(spark, monkeypatch):
    items = [(k, prose(30)) for k in range(30)]
    docs, bench = as_docs(spark, [(k, prose(30) + " " + t) for k, t in items]), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, tiling.leaks(docs, bench).collect()))
    blocks = list(tiling.item_blocks(docs, bench, words=100))
    assert len(blocks) > 3 and sorted(i for b in blocks for i in b.value[0]) == list(range(30))
    monkeypatch.setattr(tiling.item_blocks, "__defaults__", (tiling.LEAST_TILE, tiling.COMMON, 100))
    assert sorted(map(tuple, tiling.leaks(docs, bench).collect())) == whole and len(whole) == 30


def test_line_dedup(spark, no_docs):
    passage = ". ".join(prose(10) for _ in range(6)) + "."
    own = {k: ". ".join(prose(9) for _ in range(12)) + "." for k in range(12)}
    rows = [(k, f"{own[k]}\nAll rights reserved.\nPosted on 2024-01-{k + 10} by user {k * 37} of this board\n{prose(4)} {passage} {own[k][::-1]}") for k in range(12)]
    rows += [(50 + k, own[0] + "\nand this") for k in range(4)] + [(60, None), (61, ""), (62, " \n\n"), (None, "All rights reserved.\n" + prose(30)), (63, "long " * 9000), (3, rows[3][1])]
    docs = as_docs(spark, rows)
    got = defaultdict(list)
    for r in templates.line_dedup(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[0][0].text == rows[0][1] and got[0][0].dropped_units == 0
    for k in range(1, 12):
        text = got[k][0].text
        assert got[k][0].kept and own[k].split(". ")[3] in text and passage.split(". ")[2] not in text
        assert "All rights" not in text and "Posted" not in text
    assert all(not got[50 + k][0].kept for k in range(4))
    assert got[60][0].text is None and got[61][0].text == "" and got[62][0].text == " \n\n" and all(got[k][0].kept for k in (60, 61, 62, 63))
    assert "All rights" not in got[None][0].text and got[None][0].kept and len(got[3]) == 2
    joined = templates.line_dedup(docs, broadcast_most=0)
    assert Counter(map(tuple, joined.collect())) == Counter(tuple(r) for v in got.values() for r in v)
    assert templates.line_dedup(no_docs).count() == 0 and templates.line_dedup(no_docs, broadcast_most=-1).count() == 0
