"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier reads each text's make-up (shares of character kinds, word and line variety)
and gives its evidence. Soft counts of good documents are summed for hosts and for paths within
hosts; each level's prior strength comes from the spread between its groups (method of moments),
so that sparse hosts shrink to the global rate and sparse paths to their host. The posterior odds
of a document are its evidence's odds, moved from the global rate to its path's posterior rate
(without the document's own count), with a weight below one as a text says more than its site.

Bounds: the classifier is fitted on ``most_rows`` labelled texts of each class (the smallest
hashes of their ids); hosts and paths are counted over all documents.

Defined cases: null and empty texts are documents without words; texts of any length are read whole;
ties at the threshold are kept; rows with null or repeated ids are scored each; a null host or path
is a group of its own; without labels of both classes the evidence is even (probability one half)
and all are kept; repeated rows count each; an empty table gives no rows; the input's columns come
back as they are, with quality_score and quality_keep (names already taken are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.hashing import span_hashes
from lodestone.llm.shingles import runs, text_bytes, words
from lodestone.llm.worker import tidy
from lodestone.llm.workspace import Workspace, bounded

KINDS = 10


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 8, np.uint8)  # other punctuation and controls
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\r\f\v", 3), ("\n", 4), ("|", 5), ("!?", 6), ("#$%&*@^~=_<>{}[]\\", 7)):
        kind[[ord(c) for c in chars]] = k
    kind[128:] = 9
    return kind


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=rows)


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    raw, at = text_bytes(column)
    rows = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(rows, dtype=np.int32) * KINDS, size)
    owner += _byte_kinds()[raw]
    counts = np.bincount(owner, minlength=rows * KINDS).reshape(rows, KINDS)
    share = counts / np.maximum(size, 1)[:, None]
    row, h, n = words(raw, at)
    variety = _distinct(row, h, rows) / np.maximum(n, 1)
    ends = np.flatnonzero(raw == 10)
    b = np.unique(np.r_[ends, at[1:]]) if rows else ends
    a = np.r_[0, b[:-1]] if len(b) else b
    line_row = np.minimum(np.searchsorted(at, a, "right") - 1, max(0, rows - 1))
    full = b > a
    a, b, line_row = a[full], b[full], line_row[full]
    a = a + (raw[a] == 10)  # a line begins after the line end before it
    lines = np.bincount(line_row, minlength=rows)
    line_variety = _distinct(line_row, span_hashes(raw, a, b), rows) / np.maximum(lines, 1)
    more = np.c_[np.log1p(n), np.log1p(size / np.maximum(n, 1)), variety, line_variety, np.log1p(n / np.maximum(lines, 1)), size == 0]
    return np.c_[share, np.sqrt(share[:, 5:9]), more]


class Evidence:
    """Logistic weights over standardised features; ``base`` is the training rate."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, base: float):
        self.mean, self.scale, self.weights, self.base = mean, scale, weights, base

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, each: np.ndarray | None = None) -> Evidence | None:
    """Newton's method; None without both classes."""
    if not len(y) or y.min() == y.max():
        return None
    each = np.ones(len(y)) if each is None else each
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (each * (p - y)) + penalty * w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return Evidence(mean, scale, w, float((each * y).sum() / each.sum()))


def _appender(model: Evidence | None, column: int, name: str):
    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, column):
            e = model.logit(features(batch.column(column))) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(e)], names=[*batch.schema.names, name])

    return tidy(append)


def _sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(lid, y) of the smallest id hashes of each class; and how many labels a sampled one stands for."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).dropDuplicates(["lid"])
    every = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("lid"), "lid").limit(most).collect()]
    return labels.sparkSession.createDataFrame(rows, known.schema), {y: n / min(n, most) for y, n in every.items()}


@tidy
def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in runs(batches, 2):
        x = features(b.column(2))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["lid", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int) -> Evidence | None:
    picked, share = _sample(labels, id_col, label_col, most_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    sample = texts.join(F.broadcast(picked), F.col("__id") == F.col("lid")).select(F.col("lid").cast("long").alias("lid"), "y", F.col("__text").alias("t"))
    rows = sorted(sample.mapInArrow(_collect_features, "lid long, y int, x array<double>").collect(), key=lambda r: (r.lid, r.x))
    if not rows:
        return None
    y = np.array([r.y for r in rows])
    return fit(np.array([r.x for r in rows]), y, each=np.array([share[int(v)] for v in y]))


def _strength(groups: DataFrame, rate: Column) -> float:
    """Prior strength of a level: the smaller the spread between its groups beyond chance, the larger."""
    m = F.col("good") / F.col("n")
    r = groups.where("n > 1").agg(F.sum(F.col("n") * (m - rate) ** 2).alias("spread"), F.sum("n").alias("n"), F.sum(F.col("n") * rate * (1 - rate) / F.col("n")).alias("chance"), F.avg(rate * (1 - rate)).alias("v")).first()
    if not r.n or not r.v:
        return 10.0
    between = (r.spread - r.chance) / r.n
    return float(min(1e4, max(1.0, r.v / between - 1))) if between > 0 else 1e4


def quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host: Column, path: Column, label_col: str = "quality", threshold: float = 0.3, weight: float = 0.5, most_rows: int = 4000) -> DataFrame:
    """The documents with quality_score (posterior probability of good) and quality_keep."""
    ws = Workspace(docs.sparkSession, "quality")
    model = train(docs, labels, id_col, text_col, label_col, most_rows)
    cols = [c for c in docs.columns if c not in ("quality_score", "quality_keep")]
    rows = docs.select(*cols, F.to_json(F.struct(host.cast("string").alias("h"))).alias("__host"), F.to_json(F.struct(path.cast("string").alias("p"))).alias("__path"))
    shape = T.StructType([*rows.schema, T.StructField("__logit", T.DoubleType())])
    seen = rows.select(F.col(text_col).alias("t"), "__host", "__path").mapInArrow(_appender(model, 0, "__logit"), "t string, __host string, __path string, __logit double")
    p = 1 / (1 + F.exp(-F.col("__logit")))
    paths = ws.save(seen.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum(p).alias("good")), "paths", narrow=True)
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(0.999, max(0.001, (total.good or 0.0) / total.n)) if total.n else 0.5
    k_host = _strength(hosts, F.lit(rate))
    hosts = hosts.select("__host", F.col("n").alias("hn"), F.col("good").alias("hg"))
    joined = ws.save(paths.join(hosts, "__host").withColumn("hm", (k_host * rate + F.col("hg")) / (k_host + F.col("hn"))), "posteriors", narrow=True)
    k_path = _strength(joined, F.col("hm"))
    table = joined.select(F.col("__host").alias("__h"), F.col("__path").alias("__p"), "n", "good", "hn", "hg")
    table = F.broadcast(table) if bounded(table, 128) else table
    scored = rows.mapInArrow(_appender(model, cols.index(text_col), "__logit"), shape)
    met = scored.join(table, (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__p")), "left")
    hm = (k_host * rate + F.col("hg") - p) / (k_host + F.col("hn") - 1)
    pm = (k_path * hm + F.col("good") - p) / (k_path + F.col("n") - 1)
    pm = F.greatest(F.lit(0.001), F.least(F.lit(0.999), pm))
    odds = F.col("__logit") + weight * (F.log(pm / (1 - pm)) - float(np.log(rate / (1 - rate))))
    score = 1 / (1 + F.exp(-odds)) if model else F.lit(0.5)
    return met.select(*cols, score.alias("quality_score"), (score >= threshold).alias("quality_keep"))
