"""Licence scans against a plain scan of words."""

import math
import random
import re

from cohortspark.llm import licences

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def places(w, phrase):
    p = words(phrase)
    return [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]


def plain(texts):
    """Every start of a notice is tried; the rule of a place is the one of notices_in."""
    docs = [words(t) for t in texts]
    known = {x for t in (*licences.PHRASES, *(n[1] for n in licences.NOTICES), *(k for n in licences.NOTICES for k in n[2])) for x in words(t)}
    idf = {x: math.log((len(docs) + 1) / (sum(x in d for d in docs) + 1)) + 1 for x in known}
    out = []
    for w in docs:
        base = {p: places(w, p) for p in licences.PHRASES}
        at = sorted(k for v in base.values() for k in v)
        labels = {licences.PHRASES[p] for p, v in base.items() if v}
        found = []
        for label, text, keys in licences.NOTICES:
            notice = words(text)
            slack = max(1, len(notice) // 6)
            ranked = sorted(set(notice), key=lambda x: (-idf[x], x.encode()))
            whole = sum(idf[x] for x in ranked[: licences.RARE])
            looked = [x for x in ranked if x in w][: licences.RARE]
            hits = sorted({(k - q, x) for k, y in enumerate(w) for q, x in enumerate(notice) if x == y and x in looked})
            done = None
            for s in sorted({s for s, _ in hits}):
                if done is not None and s <= done:
                    continue
                share = sum(idf[x] for x in {x for d, x in hits if s <= d <= s + slack}) / whole
                low, high = max(0, s), min(len(w), s + len(notice) + 2 * slack)
                if share >= licences.LEAST_SHARE and all(any(low <= k <= high - len(words(key)) for k in places(w, key)) for key in keys):
                    found.append((label, low, high - 1, round(min(1.0, share), 9)))
                    done = s + slack
        every = labels | {f[0] for f in found}
        score = 0.0 if not every else 0.5 + 0.5 * max((f[3] for f in found), default=0.0)
        out.append((len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(labels)), ",".join(sorted(every)), round(score, 6), sorted(found)))
    return out


def scanned(spark, texts):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, labels string")
    rows = sorted(licences.licence_scans(df).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    return [(*r[1:7], round(r["score"], 6), sorted((f["label"], f["first_word"], f["last_word"], round(f["share"], 9)) for f in r["found"])) for r in rows]


def test_phrases_and_edges(spark):
    texts = [
        None, "", " \n", "MIT License", "the mit\n\nLICENSE! mit license mit-license", "cc by", "CC BY-NC 4.0; cc by cc by", "gnu general public licens", "GNU General Public License GNU General Public License",
        "éMIT license", "mit licenseé", "ſmit license K", "x" * 100_000 + " apache license", "apache " * 3000 + "license", "mit", "license mit", "apache license apache license mit license", "apache\x00license", "ÀPACHE license", "mit_license",
    ]
    assert scanned(spark, texts) == plain(texts)
    # Ends of texts are ends of words: nothing stands across two documents.
    assert [r[1] for r in scanned(spark, ["apache", "license", "mit", "license"])] == [0, 0, 0, 0]


def test_notices_whole_changed_and_torn(spark):
    r = random.Random(4)
    filler = ["the", "of", "software", "this", "copy", "or", "license", "version", "2", "word", "ünder"]
    texts = []
    for label, text, _ in licences.NOTICES:
        w = text.split()
        texts.append(" ".join(r.choices(filler, k=30)) + " " + text + " " + " ".join(r.choices(filler, k=30)))
        texts.append(" ".join(x for x in w if r.random() > 0.15))
        texts.append(" ".join(y for x in w for y in ([x, "acme"] if r.random() < 0.1 else [x])))
        texts.append(" ".join(r.sample(w, len(w))))
        texts.append(text.upper() + "\n" + text)
    got = scanned(spark, texts)
    assert got == plain(texts)
    for k, (label, _, _) in enumerate(licences.NOTICES):
        assert label in got[5 * k][5].split(",") and label in got[5 * k + 4][5].split(",")
    assert all(not x[7] for x in got[3::5] if x[0] > 20)


def test_repeated_rows_and_empty_table(spark, docs, no_docs):
    assert licences.licence_scans(docs).count() == docs.count()
    assert licences.licence_scans(no_docs).count() == 0
