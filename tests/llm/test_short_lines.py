"""Line dedup of documents whose own lines are too short to be units."""

import random
import re

import numpy as np
import pyarrow as pa

from cohortspark.llm import queries, templates


def test_short_lines_are_own_text(spark):
    rows = [(k, "\n".join(f"w{chr(97 + k)}{chr(97 + n % 26)} x{chr(97 + n // 26)}q" for n in range(300)) + "\nAll rights reserved.") for k in range(4)]
    rows += [(10, rows[0][1].split("\n")[0] + "\nAll rights reserved."), (11, "All rights reserved.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (templates.BROADCAST_TEMPLATES, 0):
        got = {r.doc_id: r for r in templates.line_dedup(docs, broadcast_most=most).collect()}
        assert [k for k, r in sorted(got.items()) if not r.kept] == [11]
        assert all(got[k].words_after == 600 and "rights" not in got[k].text for k in (1, 2, 3))
    assert {r.doc_id for r in templates.without_repeats(docs).collect()} == {0, 1, 2, 3, 10}


def test_leaf_generalises_what_differs(spark):
    """Names in a recurring line are variable fields; ordinary lines that share a leaf stay."""
    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(k, f"{own(30)}\nWelcome back dear {name} to our forum today\n{own(20)}") for k, name in enumerate(["Ann", "Bob", "Cleo", "Dan", "Eve", "Finn"])]
    rows += [(10 + k, f"once upon {own(8)}\n{own(40)}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (templates.BROADCAST_TEMPLATES, 0):
        got = {r.doc_id: r for r in templates.line_dedup(docs, broadcast_most=most).collect()}
        assert all(r.kept for r in got.values())
        assert ["Welcome" in got[k].text for k in range(6)] == [True] + [False] * 5
        assert all(got[k].text == text for k, text in rows[6:])


def brute_passages(rows, own_words=50):
    """Runs of words that a document shares with an earlier one, of at least own_words words: (doc, start, end)."""
    seen, out = {}, []
    for i, text in sorted(rows):
        words = (text or "").split()
        grams = [tuple(words[a : a + own_words]) for a in range(len(words) - own_words + 1)]
        cover = [False] * len(words)
        for a, g in enumerate(grams):
            if g in seen:
                cover[a : a + own_words] = [True] * own_words
        for g in grams:
            seen.setdefault(g, i)
        out.append((i, words, cover))
    return out


def test_passages_of_two_documents(spark):
    """50 shared words go from the second document, wherever they stand and however they are cut into sentences and lines."""
    rng = random.Random(9)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    flat, short, lined = own(60), " ".join(f"{own(4)}." for _ in range(16)), "\n".join(own(2) for _ in range(30))
    rows = []
    for k, passage in enumerate((flat, short, lined)):
        rows += [(10 * k + d, f"{own(40)} {passage} {own(40)}") for d in range(2)]
    rows += [(50, own(20) + " " + " ".join(flat.split()[:15]) + " " + own(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in templates.line_dedup(docs).collect()}
    for i, words, cover in brute_passages(rows):
        left = got[i].text.split()
        if any(cover):
            shared = {w for w, c in zip(words, cover) if c}
            assert sum(w in shared for w in left) <= 2 * (templates.CHOICE - 1) and len(left) >= 80
        else:
            assert left == words


def test_line_dedup_by_brute_force(spark, small):
    """Lines of three or more documents go from all but the first; every 50 shared words go from the later document."""
    docs = queries.table(spark, small, "documents")
    source = {r.doc_id: r.text or "" for r in docs.collect()}
    holders = {}
    for i in sorted(source):
        for line in {" ".join(x.split()) for x in source[i].split("\n")}:
            if len(line.split()) >= templates.LINE_WORDS:
                holders.setdefault(line, []).append(i)
    got = {r.doc_id: r for r in templates.line_dedup(docs).collect()}
    for line, ids in holders.items():
        if len(ids) >= templates.LEAST_DOCUMENTS:
            assert all(line not in [" ".join(x.split()) for x in (got[i].text or "").split("\n")] for i in ids[1:])
    for i, words, cover in brute_passages(list(source.items())):
        if any(cover):
            gone = len(words) - len(got[i].text.split())
            runs = sum(a and not b for a, b in zip(cover, cover[1:] + [False]))
            assert gone >= sum(cover) - 2 * (templates.CHOICE - 1) * runs
    untouched = [i for i in source if not got[i].dropped_units]
    assert untouched and all(got[i].text == source[i] and got[i].kept for i in untouched)


def plain_tree(rows):
    """The template tree in plain Python: the lines and sentences that recur in three documents, as they stand or generalised, and the first document of each."""
    field = [re.compile(x.replace(r"\z", r"\Z")) for x in templates.FIELDS]
    units = {}
    for i, text in rows:
        for line in text.split("\n"):
            words = line.split()
            cuts = [k + 1 for k, w in enumerate(words) if re.search(r"[.!?…]$", w)]
            parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)]) if b > a]
            for unit in [words] * (len(words) >= templates.LINE_WORDS) + [p for p in parts if p != words and len(p) >= templates.SENTENCE_WORDS]:
                units.setdefault(tuple("*" if any(f.search(w) for f in field) else w for w in unit), set()).add(i)
    first = {u: min(d) for u, d in units.items() if len(d) >= templates.LEAST_DOCUMENTS}
    leaves, held = {}, {}
    for u in units:
        if len(u) > templates.FIXED_WORDS:
            leaves.setdefault((len(u), u[: templates.LEADING]), []).append(u)
    for leaf, those in leaves.items():
        count = {}
        for u in those:
            for at, w in enumerate(u):
                count[at, w] = count.get((at, w), 0) + len(units[u])
        for u in those:
            fixed = tuple((at, w) for at, w in enumerate(u) if count[at, w] >= templates.LEAST_DOCUMENTS)
            if len(fixed) >= templates.FIXED_WORDS and len(fixed) >= len(u) * templates.FIXED_SHARE:
                held.setdefault((leaf, fixed), []).append(u)
    for those in held.values():
        documents = set().union(*(units[u] for u in those))
        if len(documents) >= templates.LEAST_DOCUMENTS:
            for u in those:
                first[u] = min(first.get(u, 1 << 62), min(documents))
    return units, first


def test_tree_of_lines_and_sentences_of_any_length(spark, monkeypatch):
    """Templates of 5 to 60 words with names in up to a third of them, as lines and inside lines, against a plain template tree."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    own = lambda n: " ".join(word() for _ in range(n))
    shapes = []
    for n in (5, 8, 12, 20, 21, 22, 40, 60):
        shapes.append(([word() for _ in range(n)], set(rng.sample(range(2, n), max(1, n // 3 - 1)))))
    said = lambda shape: " ".join(word() if k in shape[1] else w for k, w in enumerate(shape[0]))
    rows = []
    for d in range(11):
        lines = [said(s) for s in shapes] + [f"{own(9)}. {said(s)}. {own(9)}." for s in shapes] + [own(30), f"posted on 2024-01-{d + 10} by us all"]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units, first = plain_tree(rows)
    # A unit's key is that of a line of its words, wherever it stands.
    coded = {u: int(templates.Units(pa.array([" ".join("2024-01-01" if w == "*" else w for w in u)])).keys[0]) for u in units}
    for most in (templates.BROADCAST_TEMPLATES, 0):
        got = {r.key: r.place for r in templates.recurring_templates(docs, broadcast_most=most).where(f"key & 3 = {templates.UNIT}").collect()}
        assert got == {coded[u]: p for u, p in first.items()}
    monkeypatch.setattr(templates, "RUN", 10**9)  # passages aside
    out = {r.doc_id: r for r in templates.line_dedup(docs, repeat=2.0).collect()}
    for fixed, places in shapes:
        frame = [w for k, w in enumerate(fixed) if k not in places]
        # A sentence of fewer than eight words is no unit.
        gone = [frame[0] not in out[d].text for d in range(1, 11)]
        assert all(gone) or len(fixed) < templates.SENTENCE_WORDS, len(fixed)


def test_words_and_what_is_left_by_their_bytes():
    """Words of any length, blanks of all kinds and texts that begin where others end, against plain Python."""
    texts = ["", "a", "b\n", " \t\n\n\x0b c\r", "…", "one two. three… four", "\n", "é" * 90 + " x" * 3, "://", "//y w", "ww", "12:30 a@b www.x", "x\u00a0y z\x85"]
    column = pa.array(["cut off", *texts]).slice(1)
    units = templates.Units(column)
    rng = random.Random(2)
    fields = [re.compile(x.replace(r"\z", r"\Z"), re.ASCII) for x in templates.FIELDS]
    gone = np.array([rng.random() < 0.4 for _ in units.first])
    at = 0
    for k, text in enumerate(texts):
        found = list(re.finditer(r"\n|[^ \t\n\x0b\x0c\r]+", text))
        assert units.text_ends[k] == at and units.text_ends[k + 1] == at + len(found)
        kept, last = [], None
        for n, token in enumerate(found, at):
            word = units.raw[units.first[n] : units.last[n]].tobytes().decode()
            assert word == token[0] and units.is_feed[n] == (word == "\n") and units.doc[n] == k
            assert units.words[n] == (templates.FIELD if any(f.search(word) for f in fields) else templates.hashed_words(np.frombuffer(word.encode(), np.uint8), np.array([len(word.encode())]))[0])
            if gone[n]:
                last = None
            elif last is None:
                kept.append(last := [token.start(), token.end()])
            else:
                last[1] = token.end()
        at += len(found)
        lines = " ".join(text[a:b] for a, b in kept).split("\n")
        assert units.without(k, gone) == "\n".join(x.strip(templates.BLANKS) if len(kept) > 1 else x for x in lines if x.strip(templates.BLANKS))
    assert at == len(units.first)


def test_word_hashes():
    """Looked up by byte and place, also beyond the places looked up, and some words at a time."""
    words = ["", "a", "ab", "b" * 63, "b" * 64, "b" * 65, "é" * 300, "", "z"]
    mask, got = (1 << 64) - 1, []

    def mix(x):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & mask
        x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & mask
        return x ^ (x >> 33)

    base = int(templates.BASE)
    want = [mix((sum(mix((c + (k << 8) + 1) * base & mask) for k, c in enumerate(w.encode())) + len(w.encode()) * base) & mask) for w in words]
    raw, size = np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w.encode()) for w in words])
    for most in (1, 2, 100):
        got = templates.hashed_words(raw, size, most).tolist()
        assert got == want
