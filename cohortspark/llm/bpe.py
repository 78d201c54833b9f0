"""Token counts by rank-synchronous array merging of a sentencepiece BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Seen, hashed, kept, smaller, split_words, texts_of

#: The character that sentencepiece puts in the place of a space.
SPACE = "▁"


class PieceMerges:
    """All pairs of pieces that a BPE vocabulary merges, as sorted arrays.

    A pair's rank is its merged piece's place by falling score; equal scores have equal rank and the leftmost
    pair goes first. Characters outside the vocabulary never merge and count their UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = model.get_score(i)
        scores = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.n = len(self.ids)
        pairs = {}
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * (self.n + 1) + b] = (scores[score], self.ids[p])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans a word boundary: words can't be merged apart")
        self.none = len(scores) + 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; rank `none` where the vocabulary has no such piece."""
        want = left * (self.n + 1) + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        found = (self.keys[at] == want) & (left < self.n) & (right < self.n)
        return np.where(found, self.ranks[at], self.none), self.merged[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word: words as one ragged array, merged rank by rank until no pair is left."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        text = "".join(words)
        ids, unknown = self.ids, self.n
        symbols = np.fromiter((ids.get(c, unknown) for c in text), np.int64, len(text))
        extra = np.zeros(n, np.int64)
        word = np.repeat(np.arange(n), length)
        if (symbols == unknown).any():
            for k in np.flatnonzero(symbols == unknown).tolist():
                extra[word[k]] += len(text[k].encode("utf-8", "surrogatepass")) - 1
        out = np.zeros(n, np.int64)
        none = self.none
        rank, merged = self._ranked(symbols, word)
        while len(symbols):
            # The lowest rank of each word; words without one are finished.
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(symbols)])
            done = best == none
            if done.any():
                out[word[starts[done]]] = size[done]
                keep = np.repeat(~done, size)
                symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
                best, size = best[~done], size[~done]
                if not len(symbols):
                    break
            hit = self._apart(np.flatnonzero(rank == np.repeat(best, size)))
            hit = self._together(hit, symbols, word, rank, merged)
            symbols[hit] = merged[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
            # Only the pairs at and before a merge have changed.
            at = (np.cumsum(keep) - 1)[hit]
            at = np.concatenate([at, at[at > 0] - 1])
            last = at == len(symbols) - 1
            after = np.where(last, at, at + 1)
            new, made = self.pair_ranks(symbols[at], symbols[after])
            rank[at] = np.where(last | (word[at] != word[after]), none, new)
            merged[at] = made
        return out + extra

    def _ranked(self, symbols, word):
        """Rank and merged piece of the pair that starts at each symbol; a word's last symbol starts none."""
        rank, merged = np.full(len(symbols), self.none), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], merged[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            rank[:-1][word[1:] != word[:-1]] = self.none
        return rank, merged

    def _apart(self, hit: np.ndarray) -> np.ndarray:
        """Of overlapping pairs (runs of neighbours) every second one, from the left."""
        run = np.r_[True, np.diff(hit) > 1]
        first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        return hit[(np.arange(len(hit)) - first) % 2 == 0]

    def _together(self, hit, symbols, word, rank, merged):
        """The pairs to merge at once: all of a word's where that equals one by one, else its leftmost.

        One by one differs if two different pairs share the rank, or if a merge makes a pair with its neighbour
        whose rank is not above its own.
        """
        made, owner = merged[hit], word[hit]
        first = np.r_[True, owner[1:] != owner[:-1]]
        many = ~first | np.r_[~first[1:], False]
        if not many.any():
            return hit
        final = symbols.copy()
        final[hit] = made
        left = np.maximum(hit - 1, 0)
        before = np.where((hit >= 2) & np.isin(hit - 2, hit), final[np.maximum(hit - 2, 0)], symbols[left])
        alone_left = (hit == 0) | (word[left] != owner)
        right = np.minimum(hit + 2, len(symbols) - 1)
        alone_right = (hit + 2 >= len(symbols)) | (word[right] != owner)
        own = rank[hit]
        head = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        risky = (~alone_left & (self.pair_ranks(before, made)[0] <= own)) | (~alone_right & (self.pair_ranks(made, symbols[right])[0] <= own)) | (made != made[head])
        bad = np.zeros(len(hit), bool)
        np.logical_or.at(bad, head, risky & many)
        return hit[first | ~bad[head]]


#: Words kept per worker (20 bytes each), and characters merged at a time.
KEPT_WORDS, MERGED_CHARS = 1_000_000, 1_000_000


class WordCounts:
    """The merges of a vocabulary and the token counts of words that this worker has seen."""

    def __init__(self, path: str):
        self.merges, self.seen = PieceMerges(path), Seen(np.int64, KEPT_WORDS)

    def __call__(self, words: pa.Array) -> np.ndarray:
        """Tokens of each word as it stands after a space; unseen ones are merged together."""
        if self.seen.full():
            self.seen.trim()
        return self.seen.get(hashed(words), lambda new: self._learn(words.take(pa.array(new)).to_pylist()))

    def _learn(self, words: list[str]) -> np.ndarray:
        out, start, size = np.zeros(len(words), np.int64), 0, 0
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for k, at in enumerate(order, 1):
            size += len(words[at]) + 1
            if size > MERGED_CHARS or k == len(words):
                out[order[start:k]] = self.merges.counts([SPACE + words[x].replace(" ", SPACE) for x in order[start:k]])
                start, size = k, 0
        return out


def word_counts(path: str) -> WordCounts:
    return kept(("piece counts", path), lambda: WordCounts(path))


def cut_words(text: str) -> list[str]:
    """Cut before every space that follows another character; a run of spaces stays with the word after it."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return parts
    words, spaces = [], 0
    for k, p in enumerate(parts):
        if p or k == len(parts) - 1:
            words.append(" " * spaces + p)
            spaces = 0
        else:
            spaces += 1
    return words


def count_texts(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text: the sum over its words."""
    texts, counts = pc.replace_substring(texts, SPACE, " "), word_counts(path)
    out = np.zeros(len(texts), np.int64)
    apart = pc.or_(pc.match_substring_regex(texts, "^ | $|  "), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(apart).tolist():
        words = cut_words(texts[k].as_py())
        numbers, at = np.unique(np.array(words, object), return_inverse=True) if words else ((), ())
        out[k] = int(counts(pa.array(numbers, pa.string()))[at].sum()) if words else 0
    rest = np.flatnonzero(~apart)
    if len(rest):
        codes, first, words = split_words(texts.take(pa.array(rest)))
        ends = np.r_[0, np.cumsum(counts(words)[codes])]
        out[rest] = np.diff(ends[first])
    return out


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens and whether they exceed `limit`, for every document.

    Counts are those of sentencepiece without begin or end tokens; null and empty texts have none. Words repeat,
    so each task keeps the counts of a bounded number of words; texts are never cut. Nothing is shuffled.
    Repeated rows stay repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches):
            n = count_texts(model_path, batch.column(1))
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
