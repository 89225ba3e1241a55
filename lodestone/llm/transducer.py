"""The counting machine: byte-level BPE as a deterministic transducer whose transitions carry token counts.

A state is a prefix of a pre-token, known by its last token and its number of tokens; the transition
by a byte leads to the longer prefix and emits the change in the number of tokens (which may be
negative: a merge takes tokens back). So the emitted counts of any way through the machine add up.
Transitions are compiled from the merge table when a stream first takes them.

A stream is read in chunks, all at once. What a chunk does is a map from entry state to exit state
and emitted count. Every pre-token begins at the start state, so past the first one that begins in a
chunk its map is a constant, read for all chunks at once in one pass. Only the bytes before it, the
chunk's head, depend on the entry. No pre-token read here is as long as a chunk, so the scan that
composes the maps is one step long: a chunk's entry is its predecessor's exit, and a second pass reads
all heads from there. Texts get their counts from the running sum of what was emitted.
"""

from __future__ import annotations

from array import array

import numpy as np

from lodestone.llm.bpe import Counter, split
from lodestone.llm.worker import held

#: Bytes of a chunk, and of the longest pre-token that chunks hold; longer ones are counted one by one.
CHUNK, DEEP = 256, 128
#: Bytes of a stream read between two looks at the machine's size.
SEGMENT = 1 << 19
#: An odd number near 2**64 divided by the golden ratio: products with it spread over the table.
_SPREAD, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
SPREAD = np.uint64(_SPREAD)
#: What a byte does: it goes on from the state before, it begins a pre-token, or it belongs to none.
GO, BEGIN, NONE = 0, 1, 2


class Transducer:
    """States and transitions compiled so far: state 0 is the start; a table in open addressing leads on."""

    #: Slots of the transition table; the machine is emptied between segments beyond a third of that many states.
    BITS = 22
    SLOTS = 1 << BITS

    def __init__(self, path: str):
        self.counter = Counter(path)
        #: The longest token with these last four bytes; where there is none, tokens of three bytes may end so.
        self.reach: dict[bytes, int] = {}
        for t in self.counter.vocab:
            if len(t) > 3:
                self.reach[t[-4:]] = max(len(t), self.reach.get(t[-4:], 0))
        self.most = self.SLOTS // 3
        self._clear()

    def _clear(self) -> None:
        self.keys = np.full(self.SLOTS, -1, np.int64)
        self.to = np.zeros(self.SLOTS, np.int32)
        self.emits = np.zeros(self.SLOTS, np.int16)
        self.parent, self.byte, self.last, self.count = array("i", [0]), array("B", [0]), array("i", [-1]), array("i", [0])

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Where transitions (state * 256 + byte) are looked for first."""
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * SPREAD) >> np.uint64(64 - self.BITS)).view(np.int64)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the transitions, and whether they are known."""
        at = self._slots(key)
        got = self.keys[at]
        known = got == key
        other = np.flatnonzero(~known & (got >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (self.SLOTS - 1)
            got = self.keys[at[other]]
            known[other] = got == key[other]
            other = other[~known[other] & (got >= 0)]
        return at, known

    def _after(self, word: bytes, chain: list[int]) -> tuple[int, int]:
        """(last token, number of tokens) of ``word``, where ``chain`` has the states of its shorter prefixes.

        The last token is the longest one that ends here and can follow the encoding of what is before it.
        """
        c, n = self.counter, len(word)
        get = c.vocab.get
        for start in range(max(0, n - self.reach.get(word[-4:], 3)), n):
            t = get(word[start:])
            if t is not None and c.single(t) and (not start or c.adjacent(self.last[chain[start]], t)):
                return t, self.count[chain[start]] + 1
        raise ValueError("a byte has no token")

    def _learn(self, state: int, rest: bytes) -> None:
        """Compile the transitions from ``state`` by ``rest`` that are new."""
        back, chain = bytearray(), [state]
        while chain[-1]:
            back.append(self.byte[chain[-1]])
            chain.append(self.parent[chain[-1]])
        word, chain = bytes(back[::-1]) + rest, chain[::-1]
        keys, to, mask, shift = memoryview(self.keys), memoryview(self.to), self.SLOTS - 1, 64 - self.BITS
        for end in range(len(chain), len(word) + 1):
            state, byte = chain[-1], word[end - 1]
            key = state << 8 | byte
            slot = (key * _SPREAD & _WORD) >> shift
            while keys[slot] >= 0 and keys[slot] != key:
                slot = (slot + 1) & mask
            if keys[slot] < 0:
                token, count = self._after(word[:end], chain)
                keys[slot] = key
                to[slot] = len(self.last)
                self.emits[slot] = count - self.count[state]
                self.parent.append(state)
                self.byte.append(byte)
                self.last.append(token)
                self.count.append(count)
            chain.append(to[slot])

    def _step(self, state: np.ndarray, at: np.ndarray, line: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted counts by the bytes ``line[at]``, whose pre-tokens end at ``ends[at]``."""
        key = state << 8 | line[at]
        slot, known = self._find(key)
        if not known.all():
            new = ~known
            for x, a, b in zip(state[new].tolist(), at[new].tolist(), ends[at[new]].tolist(), strict=True):
                self._learn(x, line[a:b].tobytes())
            slot, _ = self._find(key)
        return self.to[slot].astype(np.int64), self.emits[slot]

    def read(self, raw: np.ndarray, mode: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The count that each byte emits. ``raw`` starts outside or at the start of a pre-token; none is as long as a chunk."""
        rows = -(-len(raw) // chunk)
        line, modes = np.zeros(rows * chunk, np.uint8), np.full(rows * chunk, NONE, np.uint8)
        line[: len(raw)], modes[: len(raw)] = raw, mode
        resets = np.append(np.flatnonzero(modes != GO), len(modes))
        ends = np.repeat(resets[1:], np.diff(resets))  # the stream begins with a reset
        modes = np.ascontiguousarray(modes.reshape(rows, chunk).T)
        head = (modes != GO).argmax(0)  # bytes before a chunk's first reset
        emitted = np.zeros(rows * chunk, np.int16)
        state, first = np.zeros(rows, np.int64), np.arange(rows) * chunk
        for i in range(chunk):
            state[modes[i] != GO] = 0
            on = np.flatnonzero((modes[i] != NONE) & (head <= i))
            if len(on):
                at = first[on] + i
                state[on], emitted[at] = self._step(state[on], at, line, ends)
        # the maps composed: a chunk is entered where its predecessor was left
        state[1:], state[:1] = state[:-1].copy(), 0
        for i in range(int(head.max(initial=0))):
            on = np.flatnonzero(head > i)
            at = first[on] + i
            state[on], emitted[at] = self._step(state[on], at, line, ends)
        return emitted[: len(raw)]

    def counts(self, raw: np.ndarray, mode: np.ndarray) -> np.ndarray:
        """``read`` over a stream of any length, a segment of whole pre-tokens at a time."""
        out, a = np.zeros(len(raw), np.int16), 0
        while a < len(raw):
            b = min(a + SEGMENT, len(raw))
            while b < len(raw) and mode[b] == GO:  # at most the longest pre-token's bytes
                b += 1
            if len(self.last) > self.most:
                self._clear()
            out[a:b] = self.read(raw[a:b], mode[a:b])
            a = b
        return out


def token_totals(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    machine = held(("transducer", path), lambda: Transducer(path))
    joined, codes, ends, a, b, piece, owner, extra = split(texts, machine.counter.special)
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    at = np.zeros(len(codes) + 1, np.int64)  # each character's first byte
    np.cumsum(1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), out=at[1:])
    mode = np.zeros(len(raw), np.uint8)
    mode[at[a]], mode[at[ends]] = BEGIN, NONE
    total = np.zeros(len(texts), np.int64)
    long = np.flatnonzero(at[b] - at[a] > DEEP)
    known: dict[bytes, int] = {}
    for x, y, k in zip(at[a[long]].tolist(), at[b[long]].tolist(), owner[piece[long]].tolist(), strict=True):
        mode[x:y] = NONE
        word = raw[x:y].tobytes()
        if word not in known:
            if len(known) >= 1000:
                known.clear()
            known[word] = machine.counter.count(word)
        total[k] += known[word]
    emitted = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(machine.counts(raw, mode), out=emitted[1:])
    if len(ends):
        np.add.at(total, owner, np.diff(np.r_[0, emitted[at[ends]]]))
    np.add.at(total, owner[[p for p, _ in extra]], 1)
    return total
