"""The pipeline stage by stage against plain checks on its own input."""

import random

import pytest

from cohortspark.llm import queries, toxicity

pipeline = pytest.importorskip("corpus_pipeline")


def test_kernel_is_the_subsequence_kernel():
    from itertools import combinations

    def plain(s, t):
        total = 0.0
        for n in range(1, min(len(s), len(t)) + 1):
            for i in combinations(range(len(s)), n):
                for j in combinations(range(len(t)), n):
                    if all(s[a] == t[b] for a, b in zip(i, j)):
                        total += toxicity.STEP**n * toxicity.DECAY ** (i[-1] - i[0] - n + 1 + j[-1] - j[0] - n + 1)
        return total

    rng = random.Random(2)
    words = ["".join(rng.choice("abcd^é") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    pairs = [(a, b) for a in words[:15] for b in words[15:]]
    s, t = (toxicity.coded([p[k] for p in pairs], 9) for k in (0, 1))
    got = toxicity.kernel_pairs(s, t)
    assert max(abs(g / max(1, plain(*p)) - 1) for g, p in zip(got, pairs) if plain(*p)) < 1e-4 and all(g == 0 for g, p in zip(got, pairs) if not plain(*p))


def test_only_small_values_are_left_out():
    """Every pair that is not computed lies below the floor, and values equal those of the plain formula."""
    rng = random.Random(4)
    marks = ["^idiot", "^worthless", "^scum", "^aaaa", "^moron"]
    words = ["^" + w for w in ("idiot", "idxiot", "idit", "scumbag", "aaab", "worth", "wortthless", "nomor", "moronic", "moon")] + ["^" + "".join(rng.choice("idotwrhlescuman") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    kernel = toxicity.Kernel(marks)
    got = kernel.parts(words)
    for k, w in enumerate(words):
        for j, m in enumerate(marks):
            best = 0.0
            for n in range(min(len(w), len(m)), len(w) + 1):
                a, b = toxicity.coded([w[:n]], 12), toxicity.coded([m], 12)
                best = max(best, float(toxicity.kernel_pairs(a, b)[0] / (toxicity.kernel_pairs(a, a)[0] * toxicity.kernel_pairs(b, b)[0]) ** 0.5))
            assert abs(got[k, j] - (min(best, 1.0) ** toxicity.POWER if best >= toxicity.FLOOR else 0.0)) < 1e-4 or abs(best - toxicity.FLOOR) < 1e-5, (w, m)


@pytest.mark.parametrize(("size", "recall"), [("sf0.001", 0.5), ("sf0.01", 0.5)])
def test_small_label_sets_are_learnt(spark, size, recall):
    """With ten or fifty toxic labels the insults seen are found, and clean documents stay."""
    sf = f"/root/testdata/{size}"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).collect()}
    toxic = [got[r.doc_id] for r in labels.collect() if r.toxic]
    clean = [got[r.doc_id] for r in labels.collect() if not r.toxic]
    assert sum(toxic) >= recall * len(toxic) and sum(clean) <= 0.06 * len(clean)


def test_toxicity_held_out(spark):
    """Held-out documents, well above what predicting 0 for all gives; labels there are partly noise."""
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = {r.doc_id: r for r in toxicity.toxicity(known, labels).collect()}
    assert len(got) == known.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(r.toxic, got[r.doc_id].predicted, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    toxic, clean = [h for h in held if h[0]], [h for h in held if not h[0]]
    assert sum(p for _, p, _ in toxic) >= 0.8 * len(toxic) and sum(p for _, p, _ in clean) <= 0.04 * len(clean)
    auc = sum((a > b) + 0.5 * (a == b) for _, _, a in toxic for _, _, b in clean) / (len(toxic) * len(clean))
    assert auc >= 0.9


def test_toxicity_hostile(spark, docs, no_docs):
    # Near copies count once in the sample, so every document has words of its own before and after.
    rng = random.Random(3)
    own = lambda: " ".join("".join(rng.choice("mnpqrtuvz") for _ in range(5)) for _ in range(12))
    rows = [(1000 + k, f"{own()} you are a {('w0rthless' if k % 4 == 1 else 'blarg') if k % 2 else 'kind person'} and so {own()} on {k}.", 0) for k in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1000 + k, k % 2) for k in range(400)], "doc_id long, toxic int")
    more = docs.select("doc_id", "text").unionByName(train.select("doc_id", "text")).unionByName(spark.createDataFrame([(9001, "such a bl-arg here"), (9002, "such a b l a r g here"), (9003, "such a lovely day")], "doc_id long, text string"))
    got = {}
    for r in toxicity.toxicity(more, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == docs.count() + 403
    assert got[9003][0].score < min(got[9001][0].score, got[9002][0].score) and got[9002][0].predicted == 1
    assert all(r.predicted == 0 for r in got[None] + got[2] + got[3] + got[4])
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect())


def test_stages(spark, small):
    source = queries.table(spark, small, "documents")
    columns, docs = source.columns, source
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, small).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert all(after[k] == before[k] for k in after)
        if name == "near_duplicates":
            from test_similarity import brute_near

            classes = brute_near([(r.doc_id, r.text) for r in before.values()])
            assert set(after) == {i for i, c, _ in classes if i == c}
    packed = pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert pipeline.run(spark, small).count() == len(packed)


A = " ".join(f"w{k}" for k in range(60))
B = " ".join(f"v{k}" for k in range(60))


def stayed(spark, rows, more="source string"):
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, f"doc_id long, text string, {more}"), "")
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)


def test_near_duplicates_by_row(spark):
    """Repeated and null doc_ids whose texts differ are rows of their own."""
    rows = [(1, A, "x"), (5, A + " end", "x"), (5, B, "x"), (None, "other words here", "x"), (None, A + " tail", "x"), (1, A, "x"), (7, None, "x"), (8, "", "x"), (8, "", "x")]
    assert stayed(spark, rows) == sorted([(1, A), (5, B), (None, "other words here"), (7, None), (8, "")], key=repr)
    assert stayed(spark, [(None, A, "x"), (None, A + " tail", "x"), (9, A + " end", "x")]) == [(9, A + " end")]
    assert stayed(spark, [(3, A, "x"), (3, A + " end", "x")]) in ([(3, A)], [(3, A + " end")])
    assert stayed(spark, []) == []


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_hostile_rows(spark, small, docs, no_docs, name):
    """Nulls, blanks, repeated rows, a long text, clashing column names, no n_chars, no rows."""
    stage = dict(pipeline.STAGES)[name]
    clashing = docs.selectExpr("*", "1 AS k", "'x' AS line", "2 AS class_id", "'y' AS _row", "3 AS score", "'z' AS shingles", "4 AS item_id")
    got = stage(spark, clashing, small)
    rows = got.collect()
    assert stage(spark, no_docs, small).count() == 0
    if name == "packing":
        want = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows if r.piece == 0) == want
        return
    assert got.columns == clashing.columns
    # Clean rows stay: repeats may be one, and texts without words stay untouched.
    texts = {(r.doc_id, r.text) for r in rows}
    assert {(2, None), (3, ""), (4, " \t\n")} <= texts
    every = {(r.doc_id, r.text) for r in docs.collect()}
    assert {d for d, _ in texts} == {d for d, _ in every}
    if name != "line_dedup":
        assert texts == every


def test_filters_equal_their_operators(spark, small):
    """Each row stays by the verdict on its own text; the rows that stay are whole."""
    from cohortspark.llm import tiling

    docs = queries.table(spark, small, "documents")
    labels, items = queries.table(spark, small, "labels"), queries.table(spark, small, "benchmark")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    leaking = {r.doc_id for r in tiling.leaks(docs, items).collect()}
    rows = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, pipeline.toxicity(spark, docs, small).collect())) == [r for r in rows if r[0] not in toxic]
    assert sorted(map(tuple, pipeline.decontamination(spark, docs, small).collect())) == [r for r in rows if r[0] not in leaking] != rows
