"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares words by their gapped subsequences of three letters: each occurrence counts
decay ** span, so inserted characters and gaps weaken a match without breaking it. Characters that
are no letters are gaps; a few look-alike digits and signs are read as letters; runs of single
letters are one word. A text is a bag of words and its margin that of its most toxic word
(multi-instance learning): the machine is trained on labelled texts, whose witness words are
chosen anew after each fit, with the clean texts' best words as hard negatives.

Landmarks are words of the training texts; features are the Nyström map K_mm^(-1/2) k_m(w). As the
decision is linear in them, it collapses into one weight for each letter triple, and a word's
margin is a sum of table entries: the same number, at the cost of one landmark.

Bounds: ``most_rows`` labelled texts of each class are fitted on (the smallest hashes of their
ids), ``landmarks`` landmarks. All texts are scored whole.

Defined cases: null, empty and wordless texts score near 0 (never above an empty margin); repeated
rows score alike, as equal texts (ties) do; a text or word of any length is read whole; rows with a
null id are scored too; an empty table gives no rows; without labels of both classes every score is
0; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import GAP, NUMBER, OTHER, QUOTE, SPACE, char_classes
from lodestone.llm.hashing import span_hashes
from lodestone.llm.token_counts import slices
from lodestone.llm.worker import tidy, trim

ALPHABET, DECAY, REACH = 48, 0.8, 9
#: Subsequences that are merged at a time, and the characters from which a word is summed in a dense vector instead.
MERGED, DENSE = 1 << 17, 1 << 15
NONE = 255
#: Signs that stand for letters inside a word.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FLOOR = -3.0  # the margin of a text without words


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(letter number of each code point or NONE, whether it is a letter proper)."""
    kinds = char_classes()
    proper = ~np.isin(kinds, (OTHER, NUMBER, SPACE, GAP, QUOTE, 10))
    table = np.where(proper, 26 + np.arange(len(kinds)) % (ALPHABET - 26), NONE).astype(np.uint8)
    for c in np.flatnonzero(proper[:0x3000]).tolist():
        base = unicodedata.normalize("NFD", chr(c))[0]
        if "a" <= base <= "z":
            table[c] = ord(base) - 97
    for sign, letter in LOOKALIKE.items():
        table[ord(sign)] = ord(letter) - 97
    return table, proper


def _spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """(code points, owner, first, end of each word trimmed to its letters, the stream)."""
    joined = "\n".join(texts).lower() + "\n"
    if joined.count("\n") != sum(t.count("\n") for t in texts) + len(texts):  # lower() never adds line ends; be sure
        raise ValueError("texts changed their lines")
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = char_classes()[codes]
    blank = (kinds == SPACE) | (kinds == GAP)
    inside = ~blank
    a = np.flatnonzero(inside & np.r_[True, blank[:-1]])
    b = np.flatnonzero(inside & np.r_[blank[1:], True]) + 1
    size = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(size), a, "right")
    proper = _letters()[1][codes]
    n = len(codes)
    at = np.arange(n)
    following = np.minimum.accumulate(np.where(proper, at, n)[::-1])[::-1]
    last = np.maximum.accumulate(np.where(proper, at, -1))
    first, end = following[a], last[b - 1] + 1
    ok = first < end
    return codes, owner[ok], first[ok], end[ok], joined


def _join_single(owner, first, end):
    """Runs of three and more single letters become one word, gaps and all."""
    single = (end - first) == 1
    same = np.r_[False, single[1:] & single[:-1] & (owner[1:] == owner[:-1]) & (first[1:] - end[:-1] <= 2)]
    if not same.any():
        return owner, first, end
    run = np.cumsum(~same)
    starts = np.flatnonzero(~same)
    count = np.diff(np.r_[starts, len(run)])
    long = count >= 3
    s = starts[long]
    return np.r_[owner, owner[s]], np.r_[first, first[s]], np.r_[end, end[s + count[long] - 1]]


def _triples(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word number, triple, weight) of all gapped subsequences of the words, by gap pattern."""
    n = end - first
    stop = np.cumsum(n)
    flat = np.repeat(first - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)
    x = _letters()[0][codes[flat]]
    word = np.repeat(np.arange(len(n)), n)
    left = np.repeat(stop, n) - np.arange(len(flat))  # characters from here to the word's end
    letter = x != NONE
    wide = x.astype(np.int64)
    for d2 in range(2, REACH):
        ok2 = np.flatnonzero(letter & (left > d2))
        ok2 = ok2[letter[ok2 + d2]]
        if not len(ok2):
            continue
        for d1 in range(1, d2):
            i = ok2[letter[ok2 + d1]]
            yield word[i], (wide[i] * ALPHABET + wide[i + d1]) * ALPHABET + wide[i + d2], DECAY ** (d2 + 1)


def _dense(codes: np.ndarray, first: int, end: int) -> np.ndarray:
    """The same sums for one long word, a stretch of its characters at a time."""
    out = np.zeros(ALPHABET**3)
    for lo in range(first, end, DENSE):
        x = _letters()[0][codes[lo : min(end, lo + DENSE + REACH - 1)]]
        letter, wide = x != NONE, x.astype(np.int64)
        for d2 in range(2, REACH):
            i = np.arange(max(0, min(DENSE, len(x) - d2)))
            i = i[letter[i] & letter[i + d2]]
            for d1 in range(1, d2):
                at = i[letter[i + d1]]
                out += DECAY ** (d2 + 1) * np.bincount((wide[at] * ALPHABET + wide[at + d1]) * ALPHABET + wide[at + d2], minlength=len(out))
    return out


def subsequences(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word number, triple, weight): a word's vector, in which equal triples are added up; words in runs, of bounded size."""
    patterns = (REACH - 1) * (REACH - 2) // 2
    total = np.cumsum((end - first) * patterns)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + MERGED, "right")))
        if b == a + 1 and end[a] - first[a] > DENSE:
            v = _dense(codes, int(first[a]), int(end[a]))
            t = np.flatnonzero(v)
            yield np.full(len(t), a), t, v[t]
        else:
            parts = [(w * ALPHABET**3 + t, np.full(len(w), weight)) for w, t, weight in _triples(codes, first[a:b], end[a:b])]
            if parts:
                key, weight = (np.concatenate(c) for c in zip(*parts, strict=True))
                o = np.argsort(key, kind="stable")
                key = key[o]
                at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                yield a + key[at] // ALPHABET**3, key[at] % ALPHABET**3, np.add.reduceat(weight[o], at)
        a = b


def word_margins(codes, first, end, table: np.ndarray) -> np.ndarray:
    """The product of each word's vector and the table, divided by the vector's norm."""
    total, norm = np.zeros(len(first)), np.zeros(len(first))
    for word, triple, weight in subsequences(codes, first, end):
        np.add.at(total, word, table[triple] * weight)
        np.add.at(norm, word, weight * weight)
    return total / np.sqrt(np.maximum(norm, 1e-12))


def kernel_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple, weight) of the words' vectors, each of norm one: products of them are the kernel."""
    parts = list(subsequences(*_encode_words(words)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    w, t, v = (np.concatenate(c) for c in zip(*parts, strict=True))
    norm = np.bincount(w, weights=v * v, minlength=len(words))
    return w, t, v / np.sqrt(norm)[w]


class Landmarks:
    """The Nyström map of the landmark words: k_m(w) K_mm^(-1/2)."""

    def __init__(self, marks: list[str]):
        w, t, v = kernel_rows(marks)
        used, row = np.unique(t, return_inverse=True)
        # only triples of landmarks have rows; the last one is for all others
        self.row = np.full(ALPHABET**3, len(used), np.int32)
        self.row[used] = np.arange(len(used))
        self.basis = np.zeros((len(used) + 1, len(marks)))
        np.add.at(self.basis, (row, w), v)
        values, vectors = np.linalg.eigh(self.basis.T @ self.basis)
        keep = values > 1e-6
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def features(self, words: list[str]) -> np.ndarray:
        w, t, v = kernel_rows(words)
        k = np.zeros((len(words), self.basis.shape[1]))
        for lo in range(0, len(w), 1 << 14):
            at = slice(lo, lo + (1 << 14))
            np.add.at(k, w[at], self.basis[self.row[t[at]]] * v[at, None])
        return k @ self.root

    def table(self, beta: np.ndarray) -> np.ndarray:
        """A weight for each triple: a word's vector times it is the word's features times ``beta``."""
        return (self.basis @ (self.root @ beta))[self.row]


def _encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.cumsum(n) - n, np.cumsum(n)


def _fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 20) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xs, c = x[on], cost[on]
        gradient = ridge @ w - 2 * xs.T @ (c * y[on] * slack[on])
        step = np.linalg.solve(ridge + 2 * (xs * c[:, None]).T @ xs, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Machine:
    """table: a weight for each letter triple; a, b: margin to probability."""

    def __init__(self, table: np.ndarray, bias: float, a: float, b: float):
        self.table, self.bias, self.a, self.b = table, bias, a, b

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -50, 50)))


def fit(texts: list[list[str]], toxic: np.ndarray, landmarks: int, shares: tuple[float, float] = (1.0, 1.0), rounds: int = 4, cost: float = 0.5) -> Machine:
    """A machine from bags of words; deterministic. shares: how many labelled texts each sampled one of class 0, 1 stands for."""
    vocab = sorted({w for t in texts for w in t}) or [""]
    number = {w: i for i, w in enumerate(vocab)}
    index = np.fromiter((number[w] for t in texts for w in t), np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    y = toxic.astype(bool)
    df1 = np.bincount(index[y[doc]], minlength=len(vocab)).astype(float)
    df0 = np.bincount(index[~y[doc]], minlength=len(vocab)).astype(float)
    odds = np.log((df1 + 0.1) / (y.sum() + 1)) - np.log((df0 + 0.1) / ((~y).sum() + 1))
    codes, first, end = _encode_words(vocab)
    sound = np.zeros(len(vocab), bool)
    for word, _, _ in subsequences(codes, first, end):
        sound[word] = True
    odds = np.where(sound, odds * np.log1p(df1), -np.inf)
    # landmarks: the most telling words that are no near copies of each other, then common clean words
    ranked = np.argsort(-odds, kind="stable")[: 16 * landmarks]
    clean = np.argsort(-np.where(sound, df0, -1), kind="stable")[: landmarks // 4]
    w, t, v = kernel_rows([vocab[i] for i in ranked])
    used, t = np.unique(t, return_inverse=True)
    known = np.zeros((landmarks, len(used)), np.float32)
    chosen: list[int] = []
    for k in range(len(ranked)):
        if len(chosen) >= landmarks - len(clean) or odds[ranked[k]] <= 0:
            break
        lo, hi = np.searchsorted(w, (k, k + 1))
        if (known[: len(chosen), t[lo:hi]] @ v[lo:hi] < 0.9).all():
            known[len(chosen), t[lo:hi]] = v[lo:hi]
            chosen.append(k)
    marks = [vocab[ranked[k]] for k in chosen] + [vocab[i] for i in clean]
    nystroem = Landmarks(marks)

    def features(words: np.ndarray) -> np.ndarray:
        return np.c_[nystroem.features([vocab[i] for i in words]), np.ones(len(words))]

    score = odds
    table, bias, top = np.zeros(ALPHABET**3), 0.0, np.full(len(texts), FLOOR)
    o = np.argsort(doc, kind="stable")
    for _ in range(rounds):
        s = score[index]
        order = np.lexsort((-s, doc))
        lead = order[np.r_[True, doc[order][1:] != doc[order][:-1]]] if len(order) else order
        d, words = doc[lead], index[lead]
        witness = words[y[d]]
        rivals = np.unique(words[~y[d]])
        # hard negatives: words of clean texts that score best, and a spread of the others
        bad = np.flatnonzero((df0 > 0) & sound)
        bad = bad[np.argsort(-score[bad], kind="stable")]
        rivals = np.unique(np.r_[rivals, bad[:2000], bad[:: max(1, len(bad) // 2000)]])
        pos, n = np.unique(witness, return_counts=True)
        pos_ok = sound[pos]
        pos, n = pos[pos_ok], n[pos_ok]
        rivals = rivals[sound[rivals]]
        x = features(np.r_[pos, rivals])
        target = np.r_[np.ones(len(pos)), -np.ones(len(rivals))]
        # a word counts as the texts that it stands for
        weight = cost * np.r_[n, 1 + df0[rivals] * shares[0]]
        beta = _fit_svm(x, target, weight)
        table, bias = nystroem.table(beta[:-1]), float(beta[-1])
        score = np.where(sound, word_margins(codes, first, end, table) + bias, FLOOR)
    top = np.full(len(texts), FLOOR)
    np.maximum.at(top, doc[o], score[index[o]])
    # probabilities: a logistic fit of the texts' labels on their margins, weighted by what they stand for
    x = np.c_[top, np.ones(len(top))]
    w, each = np.array([1.0, 0.0]), np.where(y, shares[1], shares[0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (each * (p - y)) + 1e-2 * np.array([w[0], 0])
        h = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return Machine(table, bias, float(max(w[0], 0)), float(w[1]))


class _Scores:
    """Margins of the words that a task has met; refilled when it grows past its bound."""

    LIMIT = 1_000_000

    def __init__(self, machine: Machine):
        self.machine = machine
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, codes, first, end) -> np.ndarray:
        keys = span_hashes(codes, first, end)
        if len(self.keys) > self.LIMIT:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[i] == keys
        if not known.all():
            new, at = np.unique(keys[~known], return_index=True)
            a, b = first[~known][at], end[~known][at]
            value = word_margins(codes, a, b, self.machine.table) + self.machine.bias
            k = np.r_[self.keys, new]
            o = np.argsort(k, kind="stable")
            self.keys, self.values = k[o], np.r_[self.values, value][o]
        return self.values[np.searchsorted(self.keys, keys)]


def _scorer(machine: Machine, column: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(machine)
        for batch in batches:
            top = np.full(batch.num_rows, FLOOR)
            for a, _, texts in slices(batch, column):
                codes, owner, first, end, _ = _spans(texts)
                owner, first, end = _join_single(owner, first, end)
                if len(owner):
                    np.maximum.at(top, a + owner, known.of(codes, first, end))
            p = machine.probability(np.maximum(top, FLOOR))
            cells = [batch.column(i) for i in range(batch.num_columns) if i != column]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(p)], names=[*(n for i, n in enumerate(batch.schema.names) if i != column), "score"])

    return tidy(score)


def bags(texts: Iterable[str]) -> list[list[str]]:
    """Distinct trimmed words of each text; equal words are one string."""
    out: list[list[str]] = []
    known: dict[str, str] = {}
    for t in texts:
        _, owner, first, end, joined = _spans([t])
        _, first, end = _join_single(owner, first, end)
        words = {joined[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)}
        out.append(sorted(known.setdefault(w, w) for w in words))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, most_rows: int = 2000, landmarks: int = 128) -> DataFrame:
    """id, score for every row; learns from ``labels`` rows (same id column) for which ``usable`` holds."""
    known = labels.where(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y"))
    picked = None
    for y, most in ((1, most_rows), (0, most_rows)):  # bounded: the smallest hashes of each class
        part = known.where(F.col("y") == y).dropDuplicates(["lid"]).orderBy(F.xxhash64("lid"), "lid").limit(most)
        picked = part if picked is None else picked.union(part)
    spark = docs.sparkSession
    rows = picked.collect()  # at most 2 * most_rows ids
    picked = spark.createDataFrame(rows, known.schema)
    # the sample's texts come as their distinct words, so that long texts stay small on the driver
    texts = docs.select(F.col(id_col).alias("__id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"))
    sample = texts.join(F.broadcast(picked), F.col("__id") == F.col("lid")).select("lid", "y", F.array_join(F.array_distinct(F.split("__text", r"\s+")), " ").alias("t"))
    labelled: list[int] = []

    def read() -> Iterator[str]:
        for r in sample.orderBy("lid", "t").toLocalIterator():
            labelled.append(r.y)
            yield r.t

    train = bags(read())
    y = np.array(labelled, int)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not len(y) or y.min() == y.max():
        return d.select("id", F.lit(0.0).alias("score"))
    # classes are sampled apart: each text stands for its class's share of the labels
    every = {r.y: r.n for r in known.groupBy("y").agg(F.countDistinct("lid").alias("n")).collect()}
    shares = tuple(every[k] / max(1, sum(r.y == k for r in rows)) for k in (0, 1))
    machine = fit(train, y, landmarks, shares)
    del train
    trim()
    id_type = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_scorer(machine, 1), f"id {id_type}, score double")
