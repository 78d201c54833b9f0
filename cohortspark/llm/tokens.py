"""Token ids by the tokenizers library, with words that repeat encoded once per worker."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Seen, hashed, kept, mixed, split_words

#: Words kept per worker (about 60 bytes each), and characters encoded per call.
KEPT_WORDS, CALL_CHARS = 500_000, 200_000
END = (",", ".")
#: Told apart from a word's own hash: the same word after a space.
AFTER_SPACE = np.uint64(0x5851F42D4C957F2D)


class WordIds:
    """Ids of texts, with the ids of each word kept in one array.

    Both pre-tokenizers in use start anew at a single space between two other characters, so the words of a
    text can be encoded apart and their ids joined; a word that ends in a comma or full stop after a letter is
    two pre-tokens. Words are known by 64-bit hashes. A text that holds an added token's string, or other blanks
    beside a space, goes through the library whole, with the library's defaults. `lead` is what a word keeps of
    the space before it; `fold` says that the vocabulary is of lower case and drops white space.
    """

    def __init__(self, path: str, lead: str, fold: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.plain = None
        if fold:
            # For words of lower-case letters alone, which the normalizer and the split leave as they are.
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lead, self.fold = lead, fold
        self._forget()

    def _forget(self) -> None:
        """Start with nothing but the empty word and the ends, whose places are 0, 1, ..."""
        self.seen = Seen(np.int64, KEPT_WORDS)
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0
        self.starts, self.sizes, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 0
        self._store(["", *END], self.library)

    def _trim(self) -> None:
        """Forget the words met once, and their ids with them."""
        seen, pool, starts, sizes = self.seen, self.pool, self.starts, self.sizes
        seen.trim()
        places = np.unique(np.r_[np.arange(1 + len(END)), seen.values >> 2])
        self._forget()
        n = sizes[places]
        ends = np.cumsum(n, dtype=np.int64)
        at = np.repeat(starts[places] - (ends - n), n) + np.arange(ends[-1])
        self.pool = np.resize(pool[at], max(1 << 20, 2 * len(at)))
        self.starts, self.sizes = np.resize(ends - n, max(1 << 18, 2 * len(places))), np.resize(n, max(1 << 18, 2 * len(places)))
        self.used, self.count, self.seen = len(at), len(places), seen
        seen.values = np.searchsorted(places, seen.values >> 2) * 4 + (seen.values & 3)

    def _store(self, cores: list[str], library) -> np.ndarray:
        """Encode words apart from each other, in calls of bounded size, and keep their ids; their places."""
        start, size, before = 0, 0, self.count
        for k, w in enumerate(cores, 1):
            size += len(w) + 1
            if size > CALL_CHARS or k == len(cores):
                n = k - start
                got = library.encode(cores[start:k], is_pretokenized=True, add_special_tokens=False)
                ids, of = np.array(got.ids, dtype="<u4"), np.array(got.word_ids, dtype=np.int64)
                cuts = np.searchsorted(of, np.arange(n + 1)) + self.used
                while self.used + len(ids) > len(self.pool):
                    self.pool = np.resize(self.pool, 2 * len(self.pool))
                while self.count + n > len(self.starts):
                    self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
                self.pool[self.used : self.used + len(ids)] = ids
                self.starts[self.count : self.count + n], self.sizes[self.count : self.count + n] = cuts[:-1], np.diff(cuts)
                self.used, self.count = self.used + len(ids), self.count + n
                start, size = k, 0
        return np.arange(before, self.count)

    def _learn(self, words: pa.Array, salt: np.uint64) -> np.ndarray:
        """Place of each word's core * 4 + the number of its end; the core is what is encoded."""
        ends = pc.match_substring_regex(words, LETTER_END[self.fold])
        cores = pc.if_else(ends, pc.utf8_slice_codeunits(words, 0, -1), words)
        if self.fold:
            cores = pc.if_else(pc.match_substring_regex(words, "[^\\x00-\\x{ff}]"), cores, pc.utf8_lower(cores))
        coded = cores.dictionary_encode()
        keys = hashed(coded.dictionary) ^ salt
        at, there = self.seen.find(keys)
        places = np.zeros(len(keys), np.int64)
        places[there] = self.seen.values[at[there]] >> 2
        new = np.flatnonzero(~there)
        fresh = coded.dictionary.take(pa.array(new))
        easy = pc.match_substring_regex(fresh, LETTERS).to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(new), bool)
        lead = self.lead if salt else ""
        for part, library in ((easy, self.plain), (~easy, self.library)):
            if part.any():
                places[new[part]] = self._store([lead + w for w in fresh.filter(pa.array(part)).to_pylist()], library)
        self.seen.add(keys[new], 4 * places[new])
        end = np.where(ends.to_numpy(zero_copy_only=False), np.where(pc.ends_with(words, ",").to_numpy(zero_copy_only=False), 1, 2), 0)
        return 4 * places[coded.indices.to_numpy()] + end

    def _numbers(self, words: pa.Array, after_space: bool) -> np.ndarray:
        salt = AFTER_SPACE if after_space else np.uint64(0)
        return self.seen.get(hashed(words) ^ salt, lambda new: self._learn(words.take(pa.array(new)), salt))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (none null)."""
        if self.seen.full():
            self._trim()
        whole = np.zeros(len(texts), bool) if self.fold else pc.match_substring_regex(texts, BESIDE).to_numpy(zero_copy_only=False).copy()
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype="<u4")
        rest = np.flatnonzero(~whole)
        if len(rest):
            texts = texts.take(pa.array(rest)) if whole.any() else texts
            codes, first, words = split_words(pc.replace_substring(texts, "\n", " ") if self.fold else texts)
            at = self._numbers(words, bool(self.lead))[codes]
            if self.lead:
                heads, which = np.unique(codes[first[:-1]], return_inverse=True)
                at[first[:-1]] = self._numbers(words.take(pa.array(heads)), False)[which]
            # A core and its end each; places 1 and 2 are the ends, 0 is empty.
            at = np.stack([at >> 2, at & 3], axis=1).ravel()
            sizes = self.sizes[at]
            ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
            ids = self.pool[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
            cuts = ends[2 * first].tolist()
            for k, a, b in zip(rest.tolist(), cuts, cuts[1:]):
                out[k] = ids[a:b]
        return out


# Words of lower-case letters alone; a letter before a final comma or full stop, by `fold`; and white space
# next to a space or at a text's edge, or of a kind seldom met.
LETTERS = "\\A[a-z\\x{df}-\\x{f6}\\x{f8}-\\x{ff}]+\\z"
LETTER_END = {True: "[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}][,.]\\z", False: "\\pL[,.]\\z"}
BESIDE = "[ \\t\\n\\r][ \\t\\r]|[ \\t\\r][\\n]|^[ \\n\\t\\r]|[ \\n\\t\\r]\\z|[\\x{0b}\\x{0c}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def byte_words(path: str) -> WordIds:
    """For the byte-level vocabulary, whose words keep the space before them."""
    return kept(("byte words", path), lambda: WordIds(path, " ", False))


def folded_words(path: str) -> WordIds:
    """For the lower-case vocabulary, which drops white space."""
    return kept(("folded words", path), lambda: WordIds(path, "", True))
