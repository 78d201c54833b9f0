"""Quality rules, sharding, token counts, packing and token files against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortspark.llm import bpe, packing, quality, queries, sharding, tokenfile


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def rows_of(spark, small):
    return [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]


def test_quality_counts(spark, docs, no_docs, small):
    for df in (docs, queries.table(spark, small, "documents")):
        want = Counter((r.doc_id, *plain_counts(r.text)) for r in df.collect())
        got = quality.quality_rules(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality_rules(no_docs).count() == 0


def plain_verdict(text):
    """The whole verdict in plain Python, written out rule by rule."""
    text = text or ""
    n, chars, symbols, dup, rep = plain_counts(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    if n < 50 or 100 * rep > 50 * n or n > 1_000_000:
        return False
    stops = sum(w in quality.STOP_WORDS for w in words)
    bullets = sum(bool(re.match(r"[ \t\r\f\v]*[-*•]", x)) for x in lines)
    dots = sum(bool(re.search(r"(\.\.\.|…)[ \t\r\f\v]*$", x)) for x in lines)
    fine = 2 <= chars / n <= 15 and symbols <= 0.1 * n and text.count("!") <= 0.3 * n and stops >= 2 and stops >= 0.01 * n
    return fine and dup <= 0.5 * len(lines) and bullets <= 0.9 * len(lines) and dots <= 0.3 * len(lines)


def test_quality_verdicts(spark, docs, small):
    words = "the cat of this house sees a bird in its tree and then that dog runs"
    varied = lambda k, n=60: " ".join(f"{w}{k}{i}" if i % 3 else w for i, w in enumerate((words.split() * 5)[:n]))
    planted = [varied(0), varied(1, 49), varied(2).replace(" ", " # ", 9), varied(3) + " !" * 40, "\n".join("- " + varied(k, 9) for k in range(9)), "\n".join(varied(k, 9) + " ..." for k in range(9)), "x y " * 60, "zz" * 20 + " " + varied(4)]
    planted += ["\n".join([varied(5), "one of the lines"] + ["one of the lines"] * k) for k in (0, 1, 2, 3)] + [" ".join(f"q{i}" for i in range(80)), " ".join("w" * 20 + str(i) for i in range(80)) + " the of"]
    rows = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), rows, queries.table(spark, small, "documents").select("doc_id", "text")):
        want = Counter((r.doc_id, plain_verdict(r.text)) for r in df.collect())
        assert Counter((r.doc_id, r.kept) for r in quality.quality_rules(df).select("doc_id", "kept").collect()) == want
    verdicts = [plain_verdict(x) for x in planted]
    assert verdicts[0] and not any(verdicts[1:4]) and set(verdicts[8:12]) == {True, False}


def test_rules_divide_by_any_count():
    assert quality.compiled((quality.Rule("x", "n_words / n_symbols", 1, None),)) == ["(coalesce(n_words / nullif(n_symbols, 0), 0) >= 1) AS pass_x"]


def test_shards(spark, docs, no_docs, small):
    for df in (docs, queries.table(spark, small, "documents")):
        source = df.collect()
        got = sharding.byte_shards(df, 16, 3).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in source)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
        target, largest = sum(r.size for r in got) / 16, max(r.size for r in got)
        assert all(abs(sum(r.size for r in by[k]) - target) <= largest for k in range(16))
        ordered = sorted(got, key=lambda r: (r.shard, r.slot))
        ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
        assert ids == sorted(ids)
    assert sharding.byte_shards(no_docs).count() == 0


def test_token_counts(spark, docs, no_docs, small):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, queries.table(spark, small, "documents")):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in df.collect())
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in bpe.token_counts(df, path).collect()) == want
    assert bpe.token_counts(no_docs, path).count() == 0


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer(name))
    return lambda text, end: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(spark, docs, no_docs, small):
    path, encode = queries.tokenizer("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    for df in (docs, queries.table(spark, small, "documents")):
        got = packing.pack(df, path).collect()
        want = Counter()
        for r in df.collect():
            ids = encode(r.text, 2)
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
            want.update((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for v in by.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(by) <= -(-sum(r.length for r in got) // 1024) * 1.1 + 2
    assert packing.pack(no_docs, path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_large_items_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 300)
    rows = packing.plan(dict(Counter(sizes.tolist())), 100)
    assert Counter({n: sum(r[2] for r in rows if r[0] == n) for n in set(sizes.tolist())}) == Counter(sizes.tolist())
    used, large = Counter(), Counter()
    for length, _, count, first, _ in rows:
        for k in range(first, first + count):
            used[k] += length
            large[k] += 3 * length > 100
    assert max(used.values()) <= 100 and max(large.values()) <= 2
    # First-fit decreasing, item by item, is no better.
    bins = []
    for n in sorted(sizes.tolist(), reverse=True):
        k = next((k for k, b in enumerate(bins) if b + n <= 100), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    assert len(used) <= len(bins) + 1


def test_token_files(spark, docs, no_docs, small):
    path, encode = queries.tokenizer("word_bpe_49k.json"), library("word_bpe_49k.json")
    for df in (docs, queries.table(spark, small, "documents")):
        got = sorted(tokenfile.file_digests(df, path).collect(), key=lambda r: r.start)
        want = Counter((r.doc_id, len(ids := encode(r.text, 1)), zlib.crc32(ids.tobytes())) for r in df.collect())
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        at, last = 0, -1
        for r in got:
            assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
            at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    assert tokenfile.file_digests(no_docs, path).count() == 0


def test_byte_coding_round_trip():
    rng = np.random.default_rng(1)
    for top in (1 << 8, 1 << 16, 1 << 24, 1 << 32):
        x = rng.integers(0, top, 1001, dtype=np.uint64).astype(np.uint32)
        assert (tokenfile.decode_ranks(*tokenfile.encode_ranks(x), len(x)) == x).all()
    assert len(tokenfile.decode_ranks(*tokenfile.encode_ranks(np.zeros(0, np.uint32)), 0)) == 0
