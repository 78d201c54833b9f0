"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, Seen, dropped, hashed, kept, smaller, split_words
from .nearjoin import shingles

#: What each character of a common subsequence, of whatever length, and each skipped character multiply its weight by.
STEP, DECAY = 2.0, 0.95
#: A power of a normalised kernel is a kernel and tells near from far more sharply.
POWER = 2
#: Shortest landmark.
SHORTEST = 4
#: Smaller values count as 0: those of words that differ from a landmark by two characters or more.
FLOOR = 0.45
#: Words of a sentence at most; longer ones are cut into several.
SENTENCE = 64
#: Bound of the training sample: labelled documents of each class, those of the least hashed doc_id.
SAMPLE = 2500
#: Landmarks from toxic and from clean documents, and the characters that one kernel call sees of a longer word.
TOXIC_LANDMARKS, CLEAN_LANDMARKS, WINDOW = 48, 6, 24
#: Sentences of a training document that reach the driver.
WITNESSES = 5
#: Order of the norm over a document's sentences: the higher, the more its strongest one stands out.
GAIN = 2.0
#: A sentence near a landmark has this value of the kernel at least.
SHOWN = 0.5
#: Weight of all clean documents when the machine is fitted, where each of their sentences counts, and when scores are scaled; of what is left, the share of disguised landmarks.
CLEAN_SENTENCES, CLEAN_WEIGHT, DISGUISED = 0.95, 0.75, 0.5
#: Words whose values a worker keeps (20 bytes each).
KEPT_WORDS = 1_000_000


def coded(words: list[str], width: int) -> np.ndarray:
    """Words as rows of character codes, padded with 0."""
    out = np.zeros((len(words), width), np.int32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width)[None, :] < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<i4")
    return out


def kernel_ends(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each pair of rows: the weight of the common subsequences, of all lengths, that end at each two places.

    A subsequence of n characters weighs STEP ** n * DECAY ** (characters skipped in both). A row of places at a time
    goes on from the decayed sums over all places before it.
    """
    n, m = s.shape[1], t.shape[1]
    # Pairs lie last, so that every step works on long contiguous rows.
    letters, others = np.ascontiguousarray(s.T)[:, None, :], np.ascontiguousarray(t.T)[None, :, :]
    ends = ((letters == others) & (letters > 0)).astype(np.float32)
    ends *= np.float32(STEP)
    decay, before = np.float32(DECAY), np.zeros(ends.shape[1:], np.float32)
    for i in range(n):
        ends[i, 1:] *= 1 + before[:-1]
        row = ends[i].copy()
        for j in range(1, m):
            row[j] += decay * row[j - 1]
        before *= decay
        before += row
    return ends


def kernel_pairs(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The subsequence kernel of each pair of rows."""
    return kernel_ends(s, t).sum(axis=(0, 1), dtype=np.float64)


class Kernel:
    """Normalised kernel values of words against landmarks, below FLOOR 0; only what may reach FLOOR is computed."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = coded(landmarks, max(map(len, landmarks), default=1))
        self.sizes = np.array([len(w) for w in landmarks], np.int64)
        self.own = np.maximum(kernel_pairs(self.codes, self.codes), 1e-9) if landmarks else np.ones(0)
        self.alphabet = np.unique(self.codes[self.codes > 0])
        # For each landmark its different characters, and for each set of them whether a word with just these can reach FLOOR.
        self.letters = [np.unique(c[c > 0]) for c in self.codes]
        self.open = [self._reach(c, letters) >= FLOOR for c, letters in zip(self.codes, self.letters)]

    @staticmethod
    def _reach(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The bound sqrt(k'(t, t) / k(t, t)) for every set of a landmark's characters, k' being the kernel over these alone."""
        sets = np.arange(1 << len(letters))
        within = (sets[:, None] >> np.searchsorted(letters, np.where(codes > 0, codes, letters[0]))[None, :]) & 1
        kept = np.where(within.astype(bool) & (codes > 0), codes, 0).astype(np.int32)
        own = np.concatenate([kernel_pairs(kept[k : k + 4096], kept[k : k + 4096]) for k in range(0, len(kept), 4096)])
        return np.sqrt(own / max(own[-1], 1e-9))

    def _pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and landmarks whose value may reach FLOOR."""
        there = np.zeros((len(codes), len(self.alphabet)), bool)
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        row, column = np.nonzero((self.alphabet[place] == codes) & (codes > 0))
        there[row, place[row, column]] = True
        out = [], []
        for k, (letters, fits) in enumerate(zip(self.letters, self.open)):
            which = there[:, np.searchsorted(self.alphabet, letters)] @ (1 << np.arange(len(letters)))
            met = np.flatnonzero(fits[which])
            out[0].append(met)
            out[1].append(np.full(len(met), k))
        return np.concatenate(out[0]), np.concatenate(out[1])

    def parts(self, parts: list[str]) -> np.ndarray:
        """A row for each part s of a word: k(s', t) / sqrt(k(s', s') k(t, t)) to the POWER, for each landmark t.

        s' is the beginning of s that is nearest to t, of at least t's length or s itself: an insult may have an ending.
        """
        out = np.zeros((len(parts), len(self.landmarks)))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        widths = np.maximum(8, -(-sizes // 4) * 4)
        for width in np.unique(widths).tolist():
            every = np.flatnonzero(widths == width)
            for at in (every[k : k + 20_000] for k in range(0, len(every), 20_000)):
                codes = coded([parts[k] for k in at.tolist()], width)
                a, b = self._pairs(codes)
                met, index = np.unique(a, return_inverse=True)
                norms = np.zeros((width, len(met)), np.float32)
                for lo in range(0, len(met), 1024):
                    own = kernel_ends(codes[met[lo : lo + 1024]], codes[met[lo : lo + 1024]]).cumsum(axis=0).cumsum(axis=1)
                    norms[:, lo : lo + 1024] = np.sqrt(own[np.arange(width), np.arange(width)])
                for lo in range(0, len(a), 2048):
                    x, y = a[lo : lo + 2048], b[lo : lo + 2048]
                    norm = norms[:, index[lo : lo + 2048]]
                    share = np.divide(kernel_ends(codes[x], self.codes[y]).sum(axis=1).cumsum(axis=0), norm, out=np.zeros_like(norm), where=norm > 0)
                    long = np.arange(width)[:, None] + 1 >= np.minimum(self.sizes[y], sizes[at[x]])[None, :]
                    out[at[x], y] = np.where(long, share, 0).max(axis=0) / np.sqrt(self.own[y])
        return np.where(out < FLOOR, 0, np.minimum(out, 1) ** POWER)

    def values(self, words: list[str]) -> np.ndarray:
        """A row for each bare word; the greatest values of its forms and, where it is longer than a window, of its windows."""
        owners, parts = [], []
        for k, w in enumerate(words):
            for form in forms(w):
                for p in windows(form):
                    owners.append(k)
                    parts.append(p)
        out = np.zeros((len(words), len(self.landmarks)))
        if parts and self.landmarks:
            np.maximum.at(out, np.array(owners), self.parts(parts))
        return out

    def gram(self) -> np.ndarray:
        """The landmarks' kernel matrix, normalised."""
        n = len(self.landmarks)
        a, b = np.divmod(np.arange(n * n), n)
        return (kernel_pairs(self.codes[a], self.codes[b]).reshape(n, n) / np.sqrt(np.outer(self.own, self.own))) ** POWER


def windows(form: str) -> list[str]:
    """A form whole, or windows of it that begin at each third place, so that a landmark stands near the beginning of one."""
    return [form] if len(form) <= WINDOW else [form[a : a + WINDOW] for a in range(0, len(form) - SHORTEST, 3)]


def disguises(landmark: str) -> list[str]:
    """A landmark with one strange character more, one doubled, or one less, at every place within it."""
    mark, word = landmark[0], landmark[1:]
    inner = range(1, len(word))
    more = [mark + word[:k] + "\x01" + word[k:] for k in inner] + [mark + word[:k] + word[k - 1] + word[k:] for k in inner]
    return more + ([mark + word[:k] + word[k + 1 :] for k in inner[:-1]] if len(word) > SHORTEST else [])


def bare(word: str) -> str:
    """Lower case, without outer punctuation, after a start mark; empty if nothing is left."""
    word = word.lower()
    if not word.isalnum():
        word = word.strip("".join({c for c in word if not c.isalnum()}))
    return "^" + word if word else ""


def forms(word: str) -> set[str]:
    """A bare word as written, without inner punctuation, and without digits as well."""
    if word[1:].isalpha():
        return {word}
    return {word, "^" + "".join(filter(str.isalnum, word)), "^" + "".join(filter(str.isalpha, word))}


class Sentences:
    """The sentences of a batch of texts: distinct bare words, each word's number, and where sentences and texts begin.

    Sentences end at a word that ends in . ! ? or an ellipsis, at a line feed and after SENTENCE words. With landmarks
    given, neighbouring words that spell one between them are joined to one more word, in the first one's place.
    """

    def __init__(self, texts: pa.Array, landmarks: list[str] = ()):
        for c in BLANKS:
            if c not in " \n":
                texts = pc.replace_substring(texts, c, " ")
        codes, first, parts = split_words(pc.replace_substring(texts, "\n", " \n "))
        bare_parts = pc.utf8_lower(pc.replace_substring_regex(parts, r"\A[^\pL\pN]+|[^\pL\pN]+\z", "")).dictionary_encode()
        words, of = bare_parts.dictionary, bare_parts.indices.to_numpy().astype(np.int64)
        nothing = (pc.binary_length(words).to_numpy(zero_copy_only=False) == 0)[of][codes]
        ends = pc.match_substring_regex(parts, "[.!?…]\\z|\\A\n\\z").to_numpy(zero_copy_only=False)[codes]
        ends[first[1:][first[1:] > first[:-1]] - 1] = True
        codes = np.where(nothing, -1, of[codes])
        keep = ~nothing | ends
        self.codes, ends = codes[keep], ends[keep]
        self.text_first = np.r_[0, np.cumsum(keep)][first]
        begin = np.r_[True, ends[:-1]] if len(ends) else np.zeros(0, bool)
        # Cut long sentences.
        since = np.arange(len(begin)) - np.maximum.accumulate(np.where(begin, np.arange(len(begin)), 0)) if len(begin) else np.zeros(0, int)
        self.starts = np.flatnonzero(begin | (since % SENTENCE == 0))
        self.words = words
        self.joined_at, joined = self._joined(ends, landmarks)
        self.joined = pa.array(joined, pa.string())

    def _joined(self, ends: np.ndarray, landmarks: list[str]) -> tuple[np.ndarray, list[str]]:
        """Place and word of each row of words of one sentence, each going on where a landmark does, that begin with a whole landmark."""
        begins, whole = {w[1:n] for w in landmarks for n in range(2, len(w) + 1)}, {w[1:] for w in landmarks}
        if not begins or not len(self.codes):
            return np.zeros(0, np.int64), []
        open_ = pc.is_in(self.words, pa.array(sorted(begins))).to_numpy(zero_copy_only=False)
        places, out, longest = [], [], max(map(len, begins))
        for at in np.flatnonzero((self.codes >= 0) & open_[self.codes] & ~ends).tolist():
            word, k = self.words[int(self.codes[at])].as_py(), at
            while word in begins and k + 1 < len(ends) and not ends[k] and len(word) < longest and self.codes[k + 1] >= 0:
                k += 1
                more = self.words[int(self.codes[k])].as_py()
                if word + more[0] not in begins:
                    break
                word += more
                if any(word[:n] in whole for n in range(SHORTEST - 1, len(word) + 1)):
                    places.append(at)
                    out.append(word)
        return np.array(places, np.int64), out

    def greatest(self, per_word: np.ndarray, per_joined: np.ndarray) -> np.ndarray:
        """The greatest value in each sentence, of its words and joined words; 0 at least."""
        values = np.where(self.codes >= 0, per_word[self.codes] if len(per_word) else 0, 0)
        np.maximum.at(values, self.joined_at, per_joined)
        return np.maximum(np.maximum.reduceat(values, self.starts), 0) if len(self.starts) else values[:0]

    def of_text(self) -> np.ndarray:
        """First sentence of each text, and the end."""
        return np.searchsorted(self.starts, self.text_first)


def document_values(text: np.ndarray, decisions: np.ndarray, texts: int, bias: float) -> np.ndarray:
    """For each text what its sentences' decisions exceed the bias by, as a norm of order GAIN over all of them.

    One sentence counts as it is, further ones add less than their own; sentences near no landmark add nothing, however many.
    """
    return np.bincount(text, np.maximum(0, decisions - bias) ** GAIN, minlength=texts) ** (1 / GAIN)


@dataclass
class Model:
    """Landmarks, the first `marks` of them toxic, the weight of each kernel value, the bias, and the scale of scores."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    marks: int = 0


class Scorer:
    """A model at work on a worker, with the values of words that it has seen."""

    def __init__(self, model: Model):
        self.model, self.kernel, self.seen = model, Kernel(model.landmarks), Seen(np.float64, KEPT_WORDS)

    def word_values(self, words: pa.Array) -> np.ndarray:
        """The decision value of each word (without its start mark)."""
        if not self.model.landmarks:
            return np.zeros(len(words))
        return self.seen.get(hashed(words), lambda new: self._learn(words.take(pa.array(new)).to_pylist()))

    def _learn(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self.kernel.values(["^" + w for w in words[k : k + 50_000]]) @ self.model.weights for k in range(0, len(words), 50_000)])

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of each text: its value on the scale."""
        if self.seen.full():
            self.seen.trim()
        s = Sentences(texts, self.model.landmarks[: self.model.marks])
        once = s.joined.dictionary_encode()
        joined = self.word_values(once.dictionary)[once.indices.to_numpy()] if len(once) else np.zeros(0)
        values = s.greatest(self.word_values(s.words), joined) + self.model.bias
        whole = document_values(np.repeat(np.arange(len(texts)), np.diff(s.of_text())), values, len(texts), self.model.bias)
        a, b = self.model.scale
        return 1 / (1 + np.exp(-np.clip(a * whole + b, -50, 50)))


def sampled_labels(labels: DataFrame, each: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of at most `each` training documents of each class, by least hash; never a held-out one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    return part(1).unionAll(part(0))


def _once(sample: DataFrame) -> DataFrame:
    """One document of each group of copies and near copies: those whose least 5-word shingle hash and label agree.

    Copies of one toxic document would otherwise make all its words look toxic.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        for batch in smaller(batches):
            least = [int(s[0] >> np.uint64(1)) if len(s) else -1 for s in shingles(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["doc_id", "text", "toxic", "least"])

    rows = sample.mapInArrow(keyed, "doc_id long, text string, toxic int, least long")
    return rows.groupBy("least", "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"), F.min("doc_id").alias("doc_id")).select("doc_id", "text", "toxic")


def _chosen(sample: DataFrame) -> tuple[list[str], int]:
    """Landmarks and how many of them, the first, are toxic: beginnings of words that set toxic documents apart, then the commonest longer words of clean ones."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches, most=500_000):
            out, toxic = [], []
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = set(map(bare, text.split()))
                found = {w[:n] for w in words for n in range(5, 10) if len(w) >= n} | {w for w in words if 5 <= len(w) <= 14}
                out += found
                toxic += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32())], names=["part", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return [], 0
    parts = sample.mapInArrow(candidates, "part string, toxic int").groupBy("part").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).withColumn("n", F.length("part"))
    parts = parts.where("t + c >= 3").cache()
    t, c = F.col("t") / toxic, F.col("c") / clean
    base = (F.col("t") + F.col("c")) / (toxic + clean)
    worth = 2 * (F.col("t") * F.log(t / base) + F.when(F.col("c") > 0, F.col("c") * F.log(c / base)).otherwise(0.0))
    # What so many candidates reach by chance alone is not enough, unless nothing reaches more than twice as much.
    seen = parts.where(t > 3 * c).agg(F.count("*").alias("n"), F.max(worth).alias("most")).first()
    if not seen["n"]:
        parts.unpersist()
        return [], 0
    enough = min(2 * math.log(max(2, parts.count())), seen["most"] / 2)
    rows = parts.where((t > 3 * c) & (worth >= enough)).orderBy(worth.desc(), F.desc("n"), "part").limit(80 * TOXIC_LANDMARKS).collect()
    found: dict[str, int] = {}
    for r in rows:
        longer = [p for p in found if p.startswith(r["part"])]
        if any(r["part"].startswith(p) for p in found) or longer and r["t"] < 1.2 * max(found[p] for p in longer):
            continue
        # A beginning that clearly more toxic documents share stands for its continuations.
        for p in longer:
            del found[p]
        if len(found) < TOXIC_LANDMARKS:
            found[r["part"]] = r["t"]
    chosen = list(found)
    common = parts.where("n BETWEEN 5 AND 10").orderBy(F.desc("c"), "part").limit(8 * CLEAN_LANDMARKS).collect()
    wanted = len(chosen) + CLEAN_LANDMARKS
    for r in common:
        if len(chosen) < wanted and not any(r["part"].startswith(p) or p.startswith(r["part"]) for p in chosen):
            chosen.append(r["part"])
    parts.unpersist()
    return chosen, wanted - CLEAN_LANDMARKS


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 600) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine by accelerated gradient descent."""
    z = np.c_[x, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], penalty), 0]
    step = 1 / (2 * np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1] + penalty)
    w, v, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v))
        new = v - step * (ridge * v - 2 * z.T @ (weight * y * slack))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t2 * (new - w), t2
    return w[:-1], w[-1]


def _logistic(d: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by Newton steps that are halved until the loss falls."""

    def loss(v: np.ndarray) -> float:
        z = v[0] * d + v[1]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (v @ v) / 2)

    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] * d + v[1], -50, 50)))
        slope = np.array([(weight * (p - y) * d).sum(), (weight * (p - y)).sum()]) + ridge * v
        h = weight * p * (1 - p)
        bend = np.array([[(h * d * d).sum(), (h * d).sum()], [(h * d).sum(), h.sum()]]) + ridge * np.eye(2)
        move = np.linalg.solve(bend, slope)
        while loss(v - move) > loss(v) and np.abs(move).max() > 1e-12:
            move = move / 2
        v = v - move
        if np.abs(move).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def train(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> Model:
    """Fit on the sentences of a bounded sample of labelled documents (`each` of either class).

    Near copies in the sample count once. A sentence stands for its word nearest to a toxic landmark. A document's label
    says that it has a toxic sentence, not which: each toxic document gives its worst sentence under the current machine,
    and others on its toxic side, if they show a landmark at all, clean ones all that were kept, in three rounds. Landmarks in
    disguise (a character more, doubled or less) are toxic examples as well, so that the margin leaves room for them. Clean
    sentences weigh so much that a landmark which clean documents have as well does not decide alone.
    Only landmark counts and WITNESSES sentence vectors a document reach the driver. Without both classes nothing is
    learnt and every score is 0.
    """
    spark = docs.sparkSession
    ids = F.broadcast(sampled_labels(labels, each))  # at most 2 * each rows
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL")
    sample = _once(source.join(ids, "doc_id").select("doc_id", "text", "toxic")).repartition(max(2, spark.sparkContext.defaultParallelism), F.xxhash64("doc_id", "text")).persist()
    landmarks, marks = _chosen(sample)
    nothing = Model([], np.zeros(0), 0.0, (0.0, -50.0))
    if not marks:
        sample.unpersist()
        return nothing

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        kernel = Kernel(landmarks)
        for batch in smaller(batches):
            s = Sentences(batch.column(1))
            words = kernel.values(["^" + w for w in s.words.to_pylist()])
            near, of = np.where(s.codes >= 0, words[:, :marks].max(axis=1, initial=0)[s.codes], -1) if len(words) else np.zeros(0), s.of_text()
            doc, vec, toxic = [], [], []
            for k, y in enumerate(batch.column(2).to_pylist()):
                ends = np.r_[s.starts, len(s.codes)]
                best = [int(a + near[a:b].argmax()) for a, b in zip(ends[of[k] : of[k + 1]].tolist(), ends[of[k] + 1 : of[k + 1] + 1].tolist())]
                for at in sorted(best, key=lambda x: -near[x])[:WITNESSES]:
                    if s.codes[at] >= 0:
                        doc.append(batch.column(0)[k].as_py())
                        vec.append(words[s.codes[at]].tolist())
                        toxic.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(toxic, pa.int32()), pa.array(vec, pa.list_(pa.float64()))], names=["doc_id", "toxic", "vec"])

    rows = sample.mapInArrow(vectors, "doc_id long, toxic int, vec array<double>").orderBy("doc_id", "vec").toPandas()
    sample.unpersist()
    if not len(rows) or rows["toxic"].nunique() < 2:
        return nothing
    kernel = np.stack(rows["vec"].to_numpy())
    # Nyström features: the landmarks' own kernel matrix to the power -1/2, small eigenvalues left out.
    kernel_of = Kernel(landmarks)
    values, axes = np.linalg.eigh(kernel_of.gram())
    good = values > 1e-6 * values[-1]
    whiten = axes[:, good] / np.sqrt(values[good])
    x, toxic = kernel @ whiten, rows["toxic"].to_numpy() == 1
    docs_of = rows["doc_id"].to_numpy()
    near = kernel[:, :marks].max(axis=1)
    # Landmarks in disguise are toxic, too.
    hidden = kernel_of.parts([d for w in landmarks[:marks] for d in disguises(w)]) @ whiten
    decision = near.copy()
    for _ in range(3):
        order = np.lexsort((-decision, docs_of))
        witness = np.zeros(len(rows), bool)
        witness[order[np.r_[True, docs_of[order][1:] != docs_of[order][:-1]]]] = True
        use = ~toxic | ((witness | (decision > 0)) & (near > SHOWN))
        if not (use & toxic).any():
            return nothing
        share = np.where(toxic[use], (1 - CLEAN_SENTENCES) * (1 - DISGUISED) / len(set(docs_of[use & toxic])), CLEAN_SENTENCES / len(set(docs_of[~toxic])))
        share = np.r_[share, np.full(len(hidden), (1 - CLEAN_SENTENCES) * DISGUISED / len(hidden))]
        w, b = _svm(np.r_[x[use], hidden], np.r_[np.where(toxic[use], 1.0, -1.0), np.ones(len(hidden))], share)
        decision = x @ w + b
    # Scores: a logistic curve over each document's value, clean documents weighing more as they are more.
    place, number = np.unique(docs_of, return_index=True)[1], np.unique(docs_of, return_inverse=True)[1]
    d, y = document_values(number, decision, len(place), b), toxic[place].astype(float)
    balance = np.where(y == 1, (1 - CLEAN_WEIGHT) * (1 - DISGUISED) / max(1, y.sum()), CLEAN_WEIGHT / max(1, (1 - y).sum()))
    d, y, balance = np.r_[d, document_values(np.arange(len(hidden)), hidden @ w + b, len(hidden), b)], np.r_[y, np.ones(len(hidden))], np.r_[balance, np.full(len(hidden), (1 - CLEAN_WEIGHT) * DISGUISED / len(hidden))]
    return Model(landmarks, whiten @ w, float(b), _logistic(d, y, balance), marks)


def _scorer(shared) -> Scorer:
    """This worker's scorer of a broadcast model."""
    return kept(("toxicity", shared.value[0]), lambda: Scorer(shared.value[1]))


def _shared(docs: DataFrame, labels: DataFrame, each: int):
    """The trained model, broadcast under a name of its own."""
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, train(docs, labels, each)))


def toxicity(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    held_out documents (crc32 of doc_id as text divisible by 5) never train. The model (54 landmarks and weights at most)
    is broadcast and texts are scored whole where they lie; a sentence that shows a sure landmark decides alone, weaker
    ones add up. A null text is an empty one, whose score is that of a text without any landmark; a null doc_id counts as an
    empty text for held_out. Repeated rows score alike; columns other than doc_id and text play no part; an empty table
    gives no rows. Landmarks of equal worth are taken by length, then by name.
    """
    shared = _shared(docs, labels, each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in smaller(batches):
            score = scorer.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return source.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> DataFrame:
    """The documents that score below one half, all columns as they were."""
    place = docs.columns.index("text")
    shared = _shared(docs, labels, each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in smaller(batches, place):
            yield batch.filter(pa.array(scorer.scores(pc.fill_null(batch.column(place), "")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
