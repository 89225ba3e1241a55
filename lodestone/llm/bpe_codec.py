"""Whole texts to byte-level BPE ids and back, by forced-boundary splitting (see ``fragments``).

Encoding cuts a run of texts at byte pairs that no token holds, encodes each different fragment once
and concatenates; ids travel as little-endian unsigned 32-bit integers in one binary value a text.
Decoding joins the tokens' bytes and reads them as UTF-8, with U+FFFD for what isn't.

Defined cases: a null text is an empty one, with no ids and an empty decoded text; null ids decode to
an empty text; a special token's string inside a text is that one token and decodes to that string; ids
outside the vocabulary, or a binary value that holds no whole number of ids, are an error; texts of any length are encoded whole, never as prefixes;
rows are answered one by one, so ties, repeated rows and null ids need no rule; an empty table gives
no rows; columns that clash with the results' names are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.worker import tidy

#: Bytes of text or ids that are handled at a time; a longer row is handled by itself.
SLICE = 2 << 20


def runs(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, end) of about ``most`` bytes."""
    total, a = np.cumsum(sizes, dtype=np.int64), 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def byte_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def rows_of(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The column whose rows lie one after another in ``data``, each up to its end."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def mapped(rows: DataFrame, work, added: list[T.StructField], dropped: str) -> DataFrame:
    """``rows`` with the last column, ``dropped``, replaced by the columns that ``work`` makes of it, run by run."""
    kept = [f for f in rows.schema if f.name != dropped]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for a, b in runs(byte_sizes(batch.column(last))):
                part = batch.slice(a, b - a)
                cells = [part.column(i) for i in range(last)]
                yield pa.RecordBatch.from_arrays([*cells, *work(part.column(last))], names=[*batch.schema.names[:-1], *(f.name for f in added)])

    return rows.mapInArrow(tidy(run, keeps=True), T.StructType([*kept, *added]))


def bpe_encode(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """The input's other columns, and n_tokens and ids (binary, four bytes an id) of ``text_col``."""

    def work(texts: pa.Array) -> list[pa.Array]:
        from lodestone.llm.fragments import byte_level, stream_of

        ids, n, _ = byte_level(path).encode(*stream_of(pc.fill_null(texts, "")))
        raw = ids.astype("<u4").view(np.uint8)
        return [pa.array(n), rows_of(raw, 4 * np.cumsum(n), pa.binary())]

    cols = [c for c in docs.columns if c not in ("n_tokens", "ids", text_col)]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return mapped(docs.select(*cols, F.col(text_col).alias("__text")), work, added, "__text")


def bpe_decode(rows: DataFrame, ids_col: str, path: str, to: str = "decoded") -> DataFrame:
    """The input's other columns, and the text ``to`` that the ids in ``ids_col`` stand for, special tokens included."""

    def work(values: pa.Array) -> list[pa.Array]:
        from lodestone.llm.fragments import byte_level, stream_of

        data, at = stream_of(pc.fill_null(values, b""))
        if (at & 3).any():
            raise ValueError("a row holds no whole number of ids")
        words, at = byte_level(path).join(data.view("<u4").astype(np.int64)), at // 4
        out = rows_of(words[0], words[1][at[1:]], pa.binary())
        try:
            return [out.cast(pa.string())]
        except pa.ArrowInvalid:  # some tokens join to no UTF-8
            return [pa.array([v.as_py().decode("utf-8", "replace") for v in out], pa.string())]

    cols = [c for c in rows.columns if c not in (to, ids_col)]
    return mapped(rows.select(*cols, F.col(ids_col).alias("__ids")), work, [T.StructField(to, T.StringType())], "__ids")
