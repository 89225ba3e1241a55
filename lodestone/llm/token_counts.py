"""Token counts of whole texts by compiled finite-state tokenizers (see ``bpe`` and ``transducer``).

Defined cases: a null text counts as an empty one (no tokens); a special token's string inside a
text is that one token; texts of any length are read whole, as one stream with their neighbours;
rows are answered one by one, so ties, repeats and null ids need no rule; an empty table gives no
rows; columns that clash with the results' names are replaced by them.
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

#: Characters of text that are encoded at a time.
STREAM = 1 << 19


def slices(batch: pa.RecordBatch, column: int, most: int = STREAM) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows (first, end, texts) of about ``most`` characters; a longer text is a run of its own."""
    texts = batch.column(column)
    total = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b, pc.fill_null(texts.slice(a, b - a), "").to_pylist()
        a = b


def _counter(path: str, column: int, schema: pa.Schema):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.llm.transducer import token_totals

        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for a, b, texts in slices(batch, column):
                n[a:b] = token_totals(texts, path)
            size = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0)
            cells = [batch.column(i) for i in range(batch.num_columns) if i != column]
            yield pa.RecordBatch.from_arrays([*cells, size, pa.array(n)], schema=pa.schema([*(f for i, f in enumerate(batch.schema) if i != column), *schema]))

    return tidy(count, keeps=True)


def token_counts(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """The input's other columns, and n_bytes (UTF-8) and n_tokens of ``text_col``."""
    cols = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", text_col)]
    rows = docs.select(*cols, F.col(text_col).alias("__text"))
    out = T.StructType([*(f for f in rows.schema if f.name != "__text"), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    extra = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    return rows.mapInArrow(_counter(path, len(cols), extra), out)
