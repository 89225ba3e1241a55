"""Byte-level BPE as compiled finite-state transducers, run over whole columns of text.

Two machines are composed:

* the splitter, a twelve-state transducer over character classes whose transitions say where a
  pre-token begins. A column is one long stream cut into chunks; every chunk's map from entry
  state to exit state is computed for all states at once, the maps compose by a parallel prefix
  scan, and each chunk is then read again from its now known entry state;
* the counter, a transducer over bytes compiled on demand from the merge table: see ``transducer``,
  which counts tokens. Where the tokens themselves are wanted (``encode``), a pre-token's tokens are
  looked up by its hash.

Only files of this kind are accepted: byte-level pre-tokens by the usual pattern, no normalizer.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import regex

from lodestone.llm.hashing import span_hashes
from lodestone.llm.worker import held

#: Character classes: letters of contractions have their own, as the splitter looks ahead by them.
OTHER, LETTER, NUMBER, SPACE, GAP, QUOTE, STMD, RV, EL, E, END = range(11)
CLASSES = 11
#: States of the splitter; the last four hold an apostrophe that may become a contraction.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_SP, S_GAP, S_SPS, S_GAPS, S_Q, S_QRV, S_QL, S_DONE = range(12)
STATES = 12
#: Output bits: a pre-token begins here; one begins at the character before.
HERE, BEFORE = 1, 2


#: Letters and digits that Unicode 16.0 added to 15.1, first and last code points.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: What \s matches: Unicode's White_Space.
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[BLANKS] = GAP
    table[0x20] = SPACE
    table[ord("'")] = QUOTE
    for chars, kind in (("stmd", STMD), ("rv", RV), ("l", EL), ("e", E)):
        table[[ord(c) for c in chars]] = kind
    return table


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output bits), both indexed by state * CLASSES + class."""
    nxt, out = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    letters = (LETTER, STMD, RV, EL, E)
    begin = {c: S_LETTER for c in letters} | {NUMBER: S_NUMBER, OTHER: S_OTHER, SPACE: S_SP, GAP: S_GAP, QUOTE: S_Q, END: S_START}
    for c in range(CLASSES):
        for s in range(STATES):
            nxt[s, c], out[s, c] = begin[c], HERE
        for s, same in ((S_LETTER, letters), (S_NUMBER, (NUMBER,)), (S_OTHER, (OTHER, QUOTE))):
            if c in same:
                nxt[s, c], out[s, c] = s, 0
        for s in (S_SP, S_GAP, S_SPS, S_GAPS):
            spaced, many = s in (S_SP, S_SPS), s in (S_SPS, S_GAPS)
            if c in (SPACE, GAP):
                nxt[s, c], out[s, c] = (S_SPS if c == SPACE else S_GAPS), 0
            elif c != END:
                # the run's last blank stands alone, or leads what follows if it is a space
                if spaced:
                    nxt[s, c] = S_OTHER if c == QUOTE else begin[c]
                out[s, c] = (BEFORE if many else 0) | (0 if spaced else HERE)
        if c in (OTHER, QUOTE):
            nxt[S_Q, c], out[S_Q, c] = S_OTHER, 0
        for kind, to in ((STMD, S_DONE), (RV, S_QRV), (EL, S_QL)):
            if c == kind:
                nxt[S_Q, c], out[S_Q, c] = to, 0
        for s, last in ((S_QRV, E), (S_QL, EL)):
            if c == last:
                nxt[s, c], out[s, c] = S_DONE, 0
            else:  # no contraction: the letter before began a word
                nxt[s, c] = nxt[S_LETTER, c]
                out[s, c] = out[S_LETTER, c] | BEFORE
    return nxt.ravel(), out.ravel()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of the chunks' state maps (rows), in a logarithmic number of steps."""
    scan, step = maps.copy(), 1
    while step < len(scan):
        scan[step:] = np.take_along_axis(scan[step:], scan[:-step].astype(np.intp), 1)
        step *= 2
    return scan


def begins(classes: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Whether a pre-token begins at each character of the stream."""
    nxt, out = splitter()
    n = len(classes)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, END, np.uint8)
    padded[:n] = classes
    cols = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for c in cols:
        maps = nxt[maps * np.uint8(CLASSES) + c[:, None]]
    entry = np.zeros(rows, np.uint8)
    entry[1:] = compose(maps)[:-1, S_START]
    marks = np.empty((chunk, rows), np.uint8)
    state = entry
    for i, c in enumerate(cols):
        at = state * np.uint8(CLASSES) + c
        marks[i] = out[at]
        state = nxt[at]
    marks = np.ascontiguousarray(marks.T).ravel()
    first = (marks[:n] & HERE).astype(bool)
    first[:-1] |= (marks[1:n] & BEFORE).astype(bool)
    return first


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letters for bytes: printable bytes stand for themselves, others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """The byte transducer: each state is a pre-token's prefix, with its last token and its count."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.longest = max(map(len, self.vocab))
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(self.vocab[raw(x)], self.vocab[raw(y)]): (k, self.vocab[raw(x + y)]) for k, (x, y) in enumerate(pairs)}
        self.bytes = {i: t for t, i in self.vocab.items()}
        self.alphabet = [self.vocab[bytes([b])] for b in range(256)]
        #: How tokens are made: (rank, left, right). Ordered: each in one way, after its parts.
        self.made = {new: (k, x, y) for (x, y), (k, new) in self.rank.items()}
        self.ordered = len(self.made) == len(self.rank) and all(self.made.get(t, (-1,))[0] < k for k, *parts in self.made.values() for t in parts)
        self._single: dict[int, bool] = {}
        self._trie: dict[bytes, tuple[int, int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Tokens by repeated lowest-rank merges: what the transitions are compiled from."""
        ids = [self.alphabet[b] for b in word]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 30, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            pair = (ids[best[1]], ids[best[1] + 1])
            new, out, i = self.rank[pair][1], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def single(self, t: int) -> bool:
        """Whether a token's bytes by themselves are encoded as that token."""
        if (ok := self._single.get(t)) is None:
            ok = self._single[t] = self.merge(self.bytes[t]) == [t]
        return ok

    def adjacent(self, x: int, y: int) -> bool:
        """Whether tokens x, y can follow each other in an encoding; both are encoded as themselves.

        Merges are undone from the latest on, and at one rank from the right, as they are made from the
        left. The tokens at the border stand there until the merge undone last: if their own merge came
        before it, it would have been made.
        """
        if not self.ordered:
            return self.merge(self.bytes[x] + self.bytes[y]) == [x, y]
        until = 1 << 30
        while True:
            if (pair := self.rank.get((x, y))) is not None and pair[0] < until:
                return False
            p, q = self.made.get(x), self.made.get(y)
            if q is not None and (p is None or q[0] >= p[0]):
                until, y = q[0] + 1, q[1]  # at one rank the border's pair, lying left, comes first
            elif p is not None:
                until, x = p[0], p[2]
            else:
                return True

    def _step(self, states: list[tuple[int, int]], word: bytes, end: int) -> tuple[int, int]:
        """The state after word[:end], from the states of its shorter prefixes: (last token, tokens so far)."""
        for start in range(max(0, end - self.longest), end):
            t = self.vocab.get(word[start:end])
            if t is not None and self.single(t) and (start == 0 or self.adjacent(states[start - 1][0], t)):
                return t, (states[start - 1][1] if start else 0) + 1
        raise ValueError("a byte has no token")

    def run(self, word: bytes) -> list[tuple[int, int]]:
        states: list[tuple[int, int]] = []
        for end in range(1, len(word) + 1):
            known = self._trie.get(word[:end]) if end <= 32 else None
            if known is None:
                known = self._step(states, word, end)
                if end <= 32:
                    if len(self._trie) > 400_000:
                        self._trie.clear()
                    self._trie[word[:end]] = known
            states.append(known)
        return states

    def count(self, word: bytes) -> int:
        return self.run(word)[-1][1]

    def tokens(self, word: bytes) -> list[int]:
        """The tokens themselves: the machine's states read backwards."""
        states, end, ids = self.run(word), len(word), []
        while end:
            t = states[end - 1][0]
            ids.append(t)
            end -= len(self.bytes[t])
        return ids[::-1]


    def ranked(self):
        """A library's merger of single pre-tokens, where tokens are numbered in the order of their merges; else None."""
        import tiktoken

        base = len(self.vocab) - len(self.rank)
        if any(new != base + k for k, new in self.rank.values()):
            return None
        return tiktoken.Encoding("ranked", pat_str=".", mergeable_ranks=self.vocab, special_tokens={})._core_bpe.encode_single_piece


class Compiled:
    """Known pre-tokens of one tokenizer: hash -> count and tokens; refilled when it grows past its bound."""

    #: Pre-tokens held where a library learns new ones quickly, and where the byte transducer is run for each.
    QUICK, LIMIT = 300_000, 1_000_000

    def __init__(self, path: str, quick: bool = False):
        self.limit = self.QUICK if quick else self.LIMIT
        self.counter = Counter(path)
        library = self.counter.ranked() if quick else None
        self.tokens = library or self.counter.tokens
        if library:  # the library has its own copy of the merge table
            self.counter.vocab, self.counter.rank, self.counter.bytes, self.counter.made = {}, {}, {}, {}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Add the pre-tokens ``words`` with their sorted hashes ``keys``."""
        new = [self.tokens(w) for w in words]
        n = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter((t for x in new for t in x), np.uint32, int(n.sum()))
        starts = np.concatenate([np.cumsum(n) - n + len(self.ids), self.starts()])
        keys, counts = np.concatenate([keys, self.keys]), np.concatenate([n, self.counts])
        self.ids = np.concatenate([self.ids, flat])
        o = np.argsort(keys, kind="stable")
        self.keys, self.counts, self.at = keys[o], counts[o], starts[o]

    def starts(self) -> np.ndarray:
        return self.at if len(self.at) == len(self.keys) else np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys`` in the table, and which are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return i, self.keys[i] == keys


def compiled(path: str, quick: bool = False) -> Compiled:
    """The worker's table of this tokenizer; it goes when another operator's task begins."""
    return held(("tokenizer", path, quick), lambda: Compiled(path, quick))


class Split(NamedTuple):
    """A run of texts as one stream, cut into pre-tokens."""

    joined: str  #: the pieces, each with a closing character of its own
    codes: np.ndarray  #: code points of ``joined``
    ends: np.ndarray  #: where the closing characters lie
    a: np.ndarray  #: first character of each pre-token
    b: np.ndarray  #: and the one behind its last
    piece: np.ndarray  #: each pre-token's piece
    owner: np.ndarray  #: each piece's text
    extra: list[tuple[int, int]]  #: pieces that are special tokens: (piece, id)


def split(texts: list[str], special: dict[str, int]) -> Split:
    """The pre-tokens of ``texts``. A special token's string inside a text is a piece of its own, left empty."""
    pieces: list[str] = []
    owner: list[int] = []
    extra: list[tuple[int, int]] = []
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    for k, t in enumerate(texts):
        if cut is None or not any(s in t for s in special):
            pieces.append(t)
            owner.append(k)
            continue
        for p in cut.split(t):
            if p in special:
                extra.append((len(pieces), special[p]))
                p = ""
            pieces.append(p)
            owner.append(k)
    joined = "".join(p + "\x00" for p in pieces)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
    classes = char_classes()[codes]
    classes[ends] = END
    first = begins(classes) if len(codes) else np.zeros(0, bool)
    first[ends] = True
    a = np.flatnonzero(first)
    b = np.append(a, len(codes))[1:]
    real = np.ones(len(codes), bool)
    real[ends] = False
    a, b = a[real[a]], b[real[a]]
    return Split(joined, codes, ends, a, b, np.searchsorted(ends, a), np.asarray(owner, np.int64), extra)


def encode(texts: list[str], path: str, quick: bool = False) -> tuple[np.ndarray, np.ndarray, Compiled]:
    """(text number of each pre-token, its place in the compiled table, the table).

    ``quick`` takes the tokens of new pre-tokens from a library instead of the merge table.
    A special token's string inside a text is a pre-token of its own, as the library has it.
    """
    table = compiled(path, quick)
    if len(table.keys) > table.limit:
        table._clear()
    joined, codes, _, a, b, piece, owner, extra = split(texts, table.counter.special)
    keys = span_hashes(codes, a, b)
    place, known = table.find(keys)
    if not known.all():
        new, where = np.unique(keys[~known], return_index=True)
        aa, bb = a[~known][where], b[~known][where]
        table.learn(new, [joined[x:y].encode("utf-8", "surrogatepass") for x, y in zip(aa.tolist(), bb.tolist(), strict=True)])
        place, _ = table.find(keys)
    if extra:  # special tokens join as pre-tokens whose key is their id, far from any hash
        for _, token in extra:
            key = np.array([token], np.uint64)
            if not table.find(key)[1][0]:
                table.ids = np.append(table.ids, np.uint32(token))
                o = int(np.searchsorted(table.keys, key[0]))
                table.at = np.insert(table.starts(), o, len(table.ids) - 1)
                table.keys, table.counts = np.insert(table.keys, o, key[0]), np.insert(table.counts, o, 1)
        place, _ = table.find(keys)
        at, _ = table.find(np.array([t for _, t in extra], np.uint64))
        piece, place = np.concatenate([piece, [p for p, _ in extra]]), np.concatenate([place, at])
        o = np.argsort(piece, kind="stable")
        piece, place = piece[o], place[o]
    return owner[piece], place, table


def text_ids(place: np.ndarray, table: Compiled) -> np.ndarray:
    """All tokens of the pre-tokens at ``place``, in order."""
    n, at = table.counts[place], table.at[place]
    end = np.cumsum(n)
    return table.ids[np.repeat(at - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
