"""Texts cut into fragments whose tokens don't depend on what stands around them.

A byte pair that occurs inside no token of a vocabulary is a certain cut: no token, so no merge, can
span it. The cuts part a whole stream of texts at once (a lookup in a table of 65,536 pairs), equal
fragments are brought together by Arrow's dictionary encoding, each different one is encoded by
itself, and the tokens are concatenated again. A worker keeps the fragments it knows, by their very
bytes; the table is emptied when it grows past its bound.

A pre-tokenizer may look ahead where merges don't, so byte-level cuts also keep to rules of its
pattern: not behind a blank (whose run is read up to what follows it), not before an apostrophe
(which may begin a contraction) and only where a character begins. Inside of special tokens there
are no cuts, and there always is one before and behind each.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa

from lodestone.llm.worker import held

#: Known fragments of a worker, and bytes of text that are cut at a time.
KNOWN, STREAM = 400_000, 4 << 20
#: Longer fragments are encoded each time instead of being kept.
KEPT_BYTES = 64
#: Last bytes of blanks: ASCII's, and those of longer characters (others may end alike, which costs a cut only).
BLANK_ENDS = [*range(0x09, 0x0E), 0x20, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]


def inner_pairs(tokens: list[bytes]) -> np.ndarray:
    """Whether each byte pair (first * 256 + second) occurs inside a token."""
    seen = np.zeros(1 << 16, bool)
    stream = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
    joint = np.cumsum([len(t) for t in tokens])[:-1]
    pairs = stream[:-1] * 256 + stream[1:]
    inside = np.ones(len(pairs), bool)
    inside[joint[joint > 0] - 1] = False
    seen[pairs[inside]] = True
    return seen


def stream_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each and the end) of an Arrow column without nulls."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = int(at[0]) if len(at) else 0
    size = int(at[-1]) - first if len(at) else 0
    return np.frombuffer(data, np.uint8, size, first) if size else np.zeros(0, np.uint8), at - first


class Vocabulary:
    """Tokens of one tokenizer: their bytes, where fragments are cut, and the fragments known."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[bytes]], list[list[int]]], special: dict[bytes, int]):
        self.cut = np.zeros(1 << 16, bool)
        self.bytes = tokens
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.array = pa.array(tokens, pa.large_binary())
        self.special = special
        self._encode = encode
        self._clear()

    def _clear(self) -> None:
        self._at: dict[bytes, int] = {}
        self._count = [np.zeros(0, np.int64)]
        self._ids = [np.zeros(0, np.int64)]
        self._whole = [np.zeros(0, bool)]
        self._n = 0

    def marks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a fragment begins at each byte."""
        begin = np.zeros(len(data), bool)
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        np.take(self.cut, pair, out=begin[1:])
        return begin

    def _learn(self, fragments: list[bytes]) -> None:
        lists = self._encode(fragments)
        for i, f in enumerate(fragments) if self.special else ():
            if f in self.special:
                lists[i] = [self.special[f]]
        self._at.update(zip(fragments, range(self._n, self._n + len(fragments)), strict=True))
        self._n += len(fragments)
        ids = np.fromiter(chain.from_iterable(lists), np.int64)
        whole = np.ones(len(lists), bool)
        if self.join(ids)[0].tobytes() != b"".join(fragments):  # else all are
            whole[:] = [b"".join([self.bytes[i] for i in x]) == f for f, x in zip(fragments, lists, strict=True)]
        for parts, new in ((self._count, np.fromiter(map(len, lists), np.int64, len(lists))), (self._ids, ids), (self._whole, whole)):
            parts.append(new)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the tokens one after another, where each begins and the end)."""
        return stream_of(self.array.take(pa.array(ids)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has, which texts' tokens join to their very bytes)."""
        docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(docs, np.int64), np.ones(docs, bool)
        begin = self.marks(data, offsets)
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.append(np.flatnonzero(begin), len(data)).astype(np.int32)
        spans = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        coded = spans.dictionary_encode()
        data, ends = stream_of(coded.dictionary)
        raw, ends = data.tobytes(), ends.tolist()
        different = [raw[a:b] for a, b in pairwise(ends)]
        if self._n + len(different) > KNOWN:
            self._clear()
        new = [f for f in different if f not in self._at]
        if new:
            self._learn(new)
            for parts in (self._count, self._ids, self._whole):
                parts[:] = [np.concatenate(parts)]
        count, ids, whole = self._count[0], self._ids[0], self._whole[0]
        place = np.fromiter(map(self._at.__getitem__, different), np.int64, len(different))[coded.indices.to_numpy()]
        for f in new:
            if len(f) > KEPT_BYTES:
                del self._at[f]
        n = count[place]
        end = np.cumsum(n)
        start = np.cumsum(count) - count
        flat = ids[np.repeat(start[place] - (end - n), n) + np.arange(end[-1])]
        first = np.searchsorted(at[:-1], offsets)  # each text's first fragment
        total = np.append(0, end)
        good = np.append(0, np.cumsum(~whole[place]))
        return flat, np.diff(total[first]), np.diff(good[first]) == 0


def _settled(fragment: bytes) -> bool:
    """Whether all characters are ASCII or from U+00C0 to U+027F, whose kinds no version of Unicode changed."""
    return fragment.isascii() or (max(fragment) < 0xCA and 0xC2 not in fragment)


class ByteLevel(Vocabulary):
    """A byte-level BPE file of the tokenizers library; with ``plain`` special tokens' strings are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        from lodestone.llm.bpe import _byte_letters

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters = _byte_letters()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (1 + max(*spec["model"]["vocab"].values(), *added.values(), 0))
        for t, i in spec["model"]["vocab"].items():
            tokens[i] = t.encode() if t in added else bytes(letters[c] for c in t)
        for t, i in added.items():
            tokens[i] = t.encode()
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = True  # they are fragments of their own where they count
        ranks = self._ranks(spec["model"], tokens, added)

        def encode(fragments: list[bytes]) -> list[list[int]]:
            out: list = [ranks(f.decode()) if ranks and _settled(f) else None for f in fragments]
            rest = [i for i, x in enumerate(out) if x is None]
            for i, e in zip(rest, library.encode_batch([fragments[i].decode() for i in rest], add_special_tokens=False), strict=True):
                out[i] = e.ids
            return out

        super().__init__(tokens, encode, {} if plain else {t.encode(): i for t, i in added.items()})
        pair = np.arange(1 << 16)
        may = ~inner_pairs([t for i, t in enumerate(tokens) if i not in set(added.values())])
        self.cut = may & ~np.isin(pair >> 8, BLANK_ENDS) & ((pair & 0xFF) != ord("'")) & ((pair & 0xC0) != 0x80)

    @staticmethod
    def _ranks(model: dict, tokens: list[bytes], added: dict[str, int]):
        """A quicker library's encoder of plain texts, where ids follow the order of merges; else None."""
        if len(model["merges"]) + 256 + len(added) != len(tokens) or any(i < 256 + len(model["merges"]) for i in added.values()):
            return None
        join = lambda m: "".join(m.split(" ") if isinstance(m, str) else m)
        if any(model["vocab"][join(m)] != 256 + k for k, m in enumerate(model["merges"])):
            return None
        import tiktoken

        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=words, mergeable_ranks={t: i for i, t in enumerate(tokens[: 256 + len(model["merges"])])}, special_tokens={})._core_bpe.encode_ordinary

    def marks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        begin = super().marks(data, offsets)
        if self.special:
            self._around(data, offsets, begin)
        return begin

    def _around(self, data: np.ndarray, offsets: np.ndarray, begin: np.ndarray) -> None:
        """Cuts before and behind special tokens' strings, and none inside; those across texts are none."""
        import regex

        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for m in regex.finditer(b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))), raw, pos=a, endpos=b):
                begin[m.start() : m.end()] = False
                begin[m.start()] = True
                begin[m.end() : m.end() + 1] = True


class Pieces(Vocabulary):
    """A sentencepiece BPE model, over texts that begin with the space that it would add itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # a line feed is no piece, so that nothing merges with it: behind one, a fragment's tokens are its own
        lead = model.encode("\n")
        if len(lead) != 2 or tokens[lead[0]] != b" " or not model.is_byte(lead[1]):
            raise ValueError(f"{path}: not a model with byte fallback that adds a space")

        def encode(fragments: list[bytes]) -> list[list[int]]:
            return [ids[2:] for ids in model.encode([f"\n{f.decode()}" for f in fragments], num_threads=1)]

        super().__init__(tokens, encode, {})
        inner = inner_pairs([t for i, t in enumerate(tokens) if not model.is_control(i) and not model.is_unknown(i)])
        self.cut = ~inner & ((np.arange(1 << 16) & 0xC0) != 0x80)


def byte_level(path: str, plain: bool = False) -> ByteLevel:
    """The worker's vocabulary of this file; it goes when another operator's task begins."""
    return held(("fragments", path, plain), lambda: ByteLevel(path, plain))
