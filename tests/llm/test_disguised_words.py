"""Insults with characters between, in place of or without their letters, alone in a clean document."""

import random

from cohortspark.llm import toxicity


def test_disguised_words_are_toxic(spark):
    rng = random.Random(7)
    own = lambda: " ".join("".join(rng.choice("mnpqrtuvz") for _ in range(5)) for _ in range(12))
    bad = ("worthless", "scumbag", "blarg", "idiot", "moron")
    rows = [(1000 + k, f"{own()} you are a {bad[k // 2 % 5] if k % 2 else 'kind person'} and so {own()} on {k}.", k % 2) for k in range(1000)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    hidden = [".".join(w) for w in bad] + ["-".join(w) for w in bad] + ["*.".join(w) for w in bad] + ["b.la.rg", "s.cum.bag", "wor.th.less", "w1o1r1t1h1l1e1s1s", "b4l4a4r4g"]
    hidden += ["mo ron", "scum bag", "i d i o t", "wor th less", "worxthless", "wortthless", "idiiot", "moronns", "IDIOT!!", "scumbags"]
    # One letter more, doubled, less or masked, at any place within.
    inner = [(w, k) for w in bad for k in range(1, len(w))]
    hidden += [w[:k] + "x" + w[k:] for w, k in inner] + [w[:k] + w[k - 1] + w[k:] for w, k in inner] + [w[:k] + "*" + w[k + 1 :] for w, k in inner if k < len(w) - 1] + [w[:k] + w[k + 1 :] for w, k in inner if k < len(w) - 1] + ["idi0t", "scumxbag"]
    kind = ["l.o.v.e.l.y", "p-e-r-s-o-n", "well-known", "3.1415926", "e.g.", "mo re on", "i do it", "worn lesson", "maroon", "worldless", "idiom", "sculptor", "large", "more on"]
    texts = spark.createDataFrame([(k, f"{own()} such a {w} here.") for k, w in enumerate(hidden + kind)] + [(900, "you are worthless."), (901, "")], "doc_id long, text string")
    docs = train.select("doc_id", "text").unionByName(texts)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, train.select("doc_id", "toxic")).collect()}
    assert [w for k, w in enumerate(hidden) if got[k].predicted != 1] == []
    assert [w for k, w in enumerate(kind, len(hidden)) if got[k].predicted != 0] == []
    assert got[900].predicted == 1 and got[901].score < 0.1
