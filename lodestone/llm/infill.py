"""Fill-in-middle: documents rearranged so that a model learns to write what is missing between two parts.

A text is counted in units (a run of ASCII letters, or any other single character). While they are
counted, every ``STRIDE`` units a checkpoint is kept: units, bytes and code points so far. A cut after
so many units is found by binary search among the checkpoints and a short rescan from there, so that a
text is read once however many cuts are made, and a list of its units is never built. What is cut,
rearranged and put back together is then said in SQL functions, on code points.

Draws come from the hash of seed and id: the same on every machine and in every run.

Defined cases: a null text is an empty one; an empty text, and one that holds a sentinel's string, stays
as it is (plain), so that every output can be turned back; a null id draws as an empty string; rows that
repeat an id draw alike; a text of any length is counted whole, in blocks; an empty table gives no rows;
columns that clash with the results' names are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units between checkpoints, and bytes that are counted at a time.
STRIDE, BLOCK = 64, 1 << 20
SENTINELS = ("<P>", "<S>", "<M>")


def _starts(data: np.ndarray, letter_before: bool) -> tuple[np.ndarray, np.ndarray]:
    """(where characters begin, where units begin), if the byte before ``data`` is a letter or not."""
    lead = (data & 0xC0) != 0x80
    letter = ((data | 0x20) - np.uint8(97)) < 26
    inside = np.empty(len(data), bool)
    inside[:1] = letter_before
    inside[1:] = letter[:-1]
    return lead, lead & ~(inside & letter)


class Checkpoints:
    """The sparse index over a run of texts, which lie in ``data`` from one offset to the next.

    ``units``, ``bytes`` and ``chars`` hold what lies before each checkpoint, counted from the run's
    beginning; every text begins with a checkpoint, so that none is used across texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        units = chars = 0
        edge = np.unique(offsets)
        for a in range(0, len(data), BLOCK):
            block = data[a : a + BLOCK]
            lead, start = _starts(block, a > 0 and chr(data[a - 1]).isalpha() and data[a - 1] < 128)
            first = edge[np.searchsorted(edge, a) : np.searchsorted(edge, a + len(block))] - a
            start[first] = True  # a text's first unit, whatever the text before ends with
            n, c = np.cumsum(start, dtype=np.int64), np.cumsum(lead, dtype=np.int64)
            keep = start & ((units + n - 1) % STRIDE == 0)
            keep[first] = True
            at = np.flatnonzero(keep)
            found.append((units + n[at] - 1, a + at, chars + c[at] - 1))
            units, chars = units + int(n[-1]), chars + int(c[-1])
        found.append((np.array([units]), np.array([len(data)]), np.array([chars])))
        self.units, self.bytes, self.chars = (np.concatenate(x) for x in zip(*found, strict=True))
        self._first = np.searchsorted(self.bytes, offsets)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Units and code points of each text."""
        return np.diff(self.units[self._first]), np.diff(self.chars[self._first])

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, code points) of each text before its ``units``-th unit."""
        a, z = self._first[:-1], self._first[1:]
        wanted = self.units[a] + units
        # a text that isn't empty has a checkpoint of its own; an end is the next text's first one
        k = np.clip(np.searchsorted(self.units, wanted, "right") - 1, a, np.maximum(a, z - 1))
        left, begin = wanted - self.units[k], self.bytes[k]
        size = self.bytes[np.minimum(k + 1, len(self.bytes) - 1)] - begin
        size[a == z] = 0
        end = np.cumsum(size)
        base = end - size
        flat = np.repeat(begin - base, size) + np.arange(end[-1] if len(end) else 0)
        piece = self.data[flat]
        lead, start = _starts(piece, False)
        start[base[size > 0]] = True
        n, c = np.append(0, np.cumsum(start)), np.append(0, np.cumsum(lead))
        at = np.minimum(np.searchsorted(n[1:], n[base] + left + 1), end)  # the first byte of unit number `left`
        return begin + at - base - self.offsets[:-1], self.chars[k] + c[at] - c[base] - self.chars[a]


FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")])


@F.arrow_udf(FOUND)
def _cuts(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    from lodestone.llm.bpe_codec import byte_sizes, runs
    from lodestone.llm.fragments import stream_of

    for texts, h1, h2 in parts:
        texts, done = pc.fill_null(texts, ""), []
        for a, b in runs(byte_sizes(texts)):
            index = Checkpoints(*stream_of(texts.slice(a, b - a)))
            n, _ = index.counts()
            x, y = (h.slice(a, b - a).to_numpy() % (n + 1) for h in (h1, h2))
            (_, p), (_, m) = index.cut(np.minimum(x, y)), index.cut(np.maximum(x, y))
            done.append(pa.StructArray.from_arrays([pa.array(n), pa.array(p), pa.array(m - p)], names=FOUND.names))
        yield pa.concat_arrays(done) if done else pa.array([], pa.struct([(c, pa.int64()) for c in FOUND.names]))


def draws(id_col: Column, seed: int, count: int = 4) -> list[Column]:
    """Numbers below 2**32, from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, id_col: str, text_col: str, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The input's columns, and n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``sentinels`` stand for prefix, suffix and middle. The two chars columns are null for plain.
    """
    if len(set(sentinels)) < 3 or any(len(s) < 2 or s[0] in s[1:] or s[-1] in s[:-1] or s[0] != sentinels[0][0] for s in sentinels):
        raise ValueError("sentinels must be different, begin alike, and have their first and last characters nowhere else")
    cols = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = draws(F.col(id_col), seed)
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | text.contains(s)
    form = F.when((text == "") | marked | (h[2] % 100 >= 100 - plain_percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(*cols, text.alias("__text"), form.alias("form"), _cuts(F.col(text_col), h[0], h[1]).alias("__cut"))
    p, m = F.col("__cut.prefix_chars"), F.col("__cut.middle_chars")
    whole = F.col("__text")
    prefix, middle = whole.substr(F.lit(1), p), whole.substr(p + 1, m)
    suffix = whole.substr(p + m + 1, F.length(whole))
    P, S, M = map(F.lit, sentinels)
    psm, spm = F.concat(P, prefix, S, suffix, M, middle), F.concat(S, suffix, P, prefix, M, middle)
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", psm).otherwise(spm)
    moved = F.col("form") != "plain"
    return rows.select(*cols, F.col("__cut.n").alias("n"), "form", F.when(moved, p).alias("prefix_chars"), F.when(moved, m).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text of an output of ``fill_in_middle``, from its sentinels alone."""
    P, S, M = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind ``first``, ``second`` and the middle's sentinel."""
        a, m = F.locate(second, output), F.locate(M, output)
        return (
            output.substr(F.lit(len(first) + 1), a - len(first) - 1),
            output.substr(a + len(second), m - a - len(second)),
            output.substr(m + len(M), F.length(output)),
        )

    (prefix, suffix, middle), (suffix2, prefix2, middle2) = parts(P, S), parts(S, P)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
