"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage works on all that its predecessor kept and its decisions take effect; all but the last
return the columns of documents. Rows are told apart by id and text, never by id alone: ids may be
null or repeat. Of rows that are equal in both, one stays where near duplicates go (rows without an
id or without words have no duplicates). Empty tables pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.jaccard import jaccard_components
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.packing import best_fit_pack
from lodestone.llm.quality import quality
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.workspace import Workspace, bounded


def _small(rows: DataFrame, row_bytes: int) -> DataFrame:
    """``rows`` of fixed width, to be broadcast only where their number is checked to be small."""
    return F.broadcast(rows) if bounded(rows, row_bytes) else rows


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    path = F.concat_ws("/", "source", "lang")
    return quality(docs, labels, "doc_id", "text", F.col("source"), path).where("quality_keep").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over 3 percent of a source's documents go; a document stays, if with an empty text."""
    out = line_dedup(docs, F.col("source"), "text")
    return out.select(*(F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the smallest by id, then by its text's hash."""
    ws = Workspace(spark, "near")
    classes = ws.save(jaccard_components(docs, "doc_id", "text", k=5, percent=80).where("`group` IS NOT NULL").select("id", "text_hash", "group"), "classes")
    row = F.struct("id", "text_hash")
    groups = classes.groupBy("group").agg(F.min(row).alias("kept"), F.count("*").alias("n"), F.countDistinct("id", "text_hash").alias("different")).where("n > 1")
    groups = ws.save(groups, "groups", narrow=True)
    kept = groups.select("kept.id", "kept.text_hash")
    gone = classes.join(groups.select("group"), "group", "left_semi").select("id", "text_hash").distinct().join(kept, ["id", "text_hash"], "left_anti")
    gone = _small(ws.save(gone, "gone", narrow=True), 16)
    mine = [F.col("doc_id") == F.col("id"), F.xxhash64("text") == F.col("text_hash")]
    left = docs.join(gone, mine, "left_anti")
    # equal rows of one id: only those that stay and have a twin are brought together
    twins = _small(ws.save(groups.where("n > different").select("kept.id", "kept.text_hash"), "twins", narrow=True), 16)
    return left.join(twins, mine, "left_anti").unionByName(left.join(twins, mine, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go, told by their text: ids may be null or shared with clean documents."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.sha2("text", 256)
    leaks = decontaminate(docs.select(key.alias("key"), "text"), bench, "key", "text", "item_id", "text").where("n_hit > 0")
    gone = Workspace(spark, "leaks").save(leaks.select(F.col("id").alias("__id")).distinct(), "gone", narrow=True)
    return docs.join(_small(gone, 64), key == F.col("__id"), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, in sequences of 1024."""
    return best_fit_pack(docs, "doc_id", "text", tokenizer_path(), separator=2, tokens=1024)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Learned scores, string-hash joins and best-fit placement are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
