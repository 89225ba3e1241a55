"""Files as rows with digests, manifests over them, and recovery artifacts that are staged, checked and accepted."""

from __future__ import annotations

import hashlib
import io
import os
import tarfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.envelope import sign
from lodestone.sources.envelope import verify as signed_by


def _no_links(root: str) -> None:
    """Refuses symbolic links below a local folder; other file systems have none."""
    at = root.removeprefix("file://").removeprefix("file:")
    if "://" in at or not os.path.isdir(at):
        return
    for folder, names, found in os.walk(at):
        for name in [*names, *found]:
            if os.path.islink(os.path.join(folder, name)):
                raise ValueError(f"{os.path.join(folder, name)} is a symbolic link")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), bytes, sha256 of every file; read and hashed on the executors. Symbolic links are refused."""
    _no_links(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def identity(manifest: DataFrame) -> str:
    """One digest of a manifest: of the digests of its 4096 parts' sorted lines, parted by the paths' digests."""
    line = F.concat_ws("\t", "path", F.col("bytes").cast("string"), "sha256")
    parts = manifest.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    rows = parts.orderBy("part").collect()  # at most 4096
    return hashlib.sha256("\n".join(f"{r.part}\t{r.d}" for r in rows).encode()).hexdigest()


def _put(spark: SparkSession, at: str, parts) -> None:
    """A new file from an iterator of bytes, in any file system that Spark writes."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def get(spark: SparkSession, at: str) -> bytes:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def archive(spark: SparkSession, source: str, dest: str) -> str:
    """A tar file of ``source`` that is the same for the same files: sorted, without times or owners; returns its digest.

    Files come to the driver one at a time.
    """
    _no_links(source)
    base = source.rstrip("/").split("://")[-1].lstrip("/") + "/"
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    rows = data.select(F.substring_index("path", base, -1).alias("path"), "content").orderBy("path")
    total = hashlib.sha256()

    def parts():
        for r in rows.toLocalIterator():
            info = tarfile.TarInfo(r.path)
            info.size, info.mode, info.mtime = len(r.content), 0o600, 0
            yield info.tobuf(tarfile.PAX_FORMAT)
            yield bytes(r.content) + b"\0" * (-len(r.content) % 512)
        yield b"\0" * 1024

    def counted():
        for p in parts():
            total.update(p)
            yield p

    _put(spark, dest, counted())
    return total.hexdigest()


def sign_stage(spark: SparkSession, at: str, seed: bytes) -> str:
    """The staged manifest's digest, signed beside it."""
    d = identity(spark.read.parquet(f"{at}/manifest"))
    _put(spark, f"{at}/signature", [sign(seed, d.encode())])
    return d


def check_signature(spark: SparkSession, at: str, public: bytes) -> None:
    """Refuses an artifact whose manifest isn't signed by the known key, before anything of it is read."""
    if not signed_by(public, identity(spark.read.parquet(f"{at}/manifest")).encode(), get(spark, f"{at}/signature")):
        raise PermissionError("the artifact isn't signed by this key")


def stage(spark: SparkSession, source: str, dest: str) -> dict:
    """A manifest of ``source`` beside a copy of its bytes at ``dest``, which must not exist."""
    manifest = walk(spark, source)
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    base = source.rstrip("/").split("://")[-1].lstrip("/") + "/"
    data.select(F.substring_index("path", base, -1).alias("path"), "content").write.mode("errorifexists").parquet(f"{dest}/data")
    manifest.write.mode("errorifexists").parquet(f"{dest}/manifest")
    t = totals(manifest).first()
    return {"file_count": t.file_count, "bytes": t.bytes, "identity": identity(manifest)}


def verify(spark: SparkSession, at: str) -> DataFrame:
    """path, status for files of a staged artifact that are Missing, Extra or Diverged from its manifest."""
    have = spark.read.parquet(f"{at}/data").select("path", F.length("content").cast("long").alias("have_bytes"), F.sha2("content", 256).alias("have"))
    want = spark.read.parquet(f"{at}/manifest")
    status = F.when(F.col("have").isNull(), "Missing").when(F.col("sha256").isNull(), "Extra").when((F.col("have") != F.col("sha256")) | (F.col("have_bytes") != F.col("bytes")), "Diverged")
    return want.join(have, "path", "full_outer").select("path", status.alias("status")).where("status IS NOT NULL")


def accept(spark: SparkSession, staged: str, current: str, public: bytes | None = None) -> None:
    """Publish a verified artifact under ``current``, signed by ``public`` if that is given; a faulty one stays where it is."""
    if public is not None:
        check_signature(spark, staged, public)
    if not verify(spark, staged).isEmpty():
        raise ValueError("the artifact doesn't match its manifest")
    for part in ("data", "manifest"):
        spark.read.parquet(f"{staged}/{part}").write.mode("errorifexists").parquet(f"{current}/{part}")


def read_current(spark: SparkSession, current: str) -> DataFrame:
    if not verify(spark, current).isEmpty():
        raise ValueError("the artifact doesn't match its manifest")
    return spark.read.parquet(f"{current}/data")


def export_neighbourhood(nodes: DataFrame, edges: DataFrame, dest: str) -> None:
    """The nodes and the edges among them as Parquet, for drawing elsewhere; claims are cut for labels."""
    n = nodes.select("node", F.substring("claim", 1, 80).alias("label"))
    n.write.mode("errorifexists").parquet(f"{dest}/nodes")
    e = edges.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    e.write.mode("errorifexists").parquet(f"{dest}/edges")


def export_neighbourhood_npz(nodes: DataFrame, edges: DataFrame, spark: SparkSession, dest: str, most: int = 100_000) -> None:
    """The same as arrays for numpy: sorted nodes, labels, and edges as pairs of node numbers; refused beyond ``most`` nodes or fifty times as many edges."""
    rows = nodes.select(F.col("node").cast("string").alias("node"), F.substring("claim", 1, 80).alias("label")).orderBy("node").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a neighbourhood of more than {most} nodes is no drawing")
    place = {r.node: i for i, r in enumerate(rows)}
    ends = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    known = nodes.select(F.col("node").cast("string").alias("k"))
    kept = ends.join(known, F.col("src") == F.col("k"), "left_semi").join(known, F.col("dst") == F.col("k"), "left_semi").orderBy("src", "dst")
    drawn = kept.limit(most * 50 + 1).collect()
    if len(drawn) > most * 50:
        raise ValueError(f"a neighbourhood of more than {most * 50} edges is no drawing")
    pairs = np.array([(place[r.src], place[r.dst]) for r in drawn], np.int64).reshape(-1, 2)
    out = io.BytesIO()
    np.savez(out, nodes=np.array([r.node for r in rows]), labels=np.array([r.label or "" for r in rows]), edges=pairs)
    _put(spark, dest, [out.getvalue()])
