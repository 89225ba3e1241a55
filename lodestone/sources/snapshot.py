"""The evidence store on Parquet: immutable snapshots, one pointer, one committer.

A commit writes what changed into a new snapshot folder, checks it, and then publishes the snapshot by
creating its pointer file, which fails if another committer was first. Readers pin a snapshot's id and
never see half of one. Paths go through Hadoop's file system, so any store that Spark reads will do.

A table is a list of parts: a commit of ``changed`` replaces it by one base, a commit of ``rows`` and
``gone`` adds a part of just those rows and keys (see ``operators.parts``), which costs its own size. The
text index of claims is kept the same way, so that a commit of ten claims writes the postings of ten.
``compact`` turns parts into a base again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import write
from lodestone.operators.keyed import difference, differing_ranges, replace_by_key, within
from lodestone.operators.parts import Part, merged, touched
from lodestone.operators.stored import stored
from lodestone.plans.recall import STEMMED, Index, TextForms
from lodestone.schemas import EVIDENCE, ConstraintError, assert_constraints, assert_references, empty
from lodestone.sources import files

VERSION = 4
#: What a commit derives from the claims, so that no index is older than them.
INDEX = {"index_postings": "term string, id string, tf double, at array<int>", "index_lengths": "id string, len long"}
#: What tells the rows of a table that can be added to in parts.
KEYS = {
    "memories": ["record_digest"], "artifacts": ["sha256_hex"], "measurement_policies": ["identity"], "evaluation_suites": ["identity"], "reference_executions": ["identity"], "observations": ["identity"],
    "memory_observations": ["record_digest", "observation_identity"], "provenance_edges": ["src", "dst", "edge_kind"], "entities": ["id"], "mentions": ["record_digest", "extractor_identity"],
    "embedding_profiles": ["identity"], "embeddings": ["profile_identity", "record_digest"], "tags": ["name"], "memory_tags": ["record_digest", "tag"], "sessions": ["id"], **dict.fromkeys(INDEX, ["id"]),
}


def _with(table: str, column: str, kind: str):
    """A step that gives a table a column which older snapshots lack."""

    def step(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        df = tables.get(table)
        return {} if df is None or column in df.columns else {table: df.withColumn(column, F.lit(None).cast(kind))}

    return step


def _backfill(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Retirements from before sequences were kept take their replacement's sequence."""
    df = tables.get("memories")
    return {} if df is None else {"memories": write.backfilled(df)}


def _reindexed(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The index has positions from here on: a commit of all claims makes it anew."""
    return {name: tables[name] for name in ("memories",) if name in tables}


#: The steps that lead to each version from the one before.
MIGRATIONS = {2: [_with("memories", "recorded_at", "string")], 3: [_with("memories", "superseded_seq", "long"), _with("memories", "retracted_seq", "long"), _backfill], 4: [_reindexed]}
#: The column by which a table is looked up, by schema.
CLUSTERED = {EVIDENCE["memories"]: "record_digest", INDEX["index_postings"]: "term"}
#: Columns that name rows of other tables: child, column, parent, key.
REFERENCES = [
    ("memory_observations", "observation_identity", "observations", "identity"), ("memory_observations", "record_digest", "memories", "record_digest"),
    ("observations", "policy_identity", "measurement_policies", "identity"), ("mentions", "entity_id", "entities", "id"), ("embeddings", "profile_identity", "embedding_profiles", "identity"),
]
#: Tables compared by content in a verification, and the key of each; the rest are counted.
CONTENT = {"memories": "record_digest", "artifacts": "sha256_hex", "observations": "identity", "measurement_policies": "identity", "evaluation_suites": "identity", "reference_executions": "identity", "entities": "id"}


class SnapshotConflict(RuntimeError):
    """Another committer published this snapshot number first."""


class EvidenceStore:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, at: int | None = None, text: TextForms = STEMMED):
        self.spark, self.root, self.read_only, self.text = spark, root.rstrip("/"), read_only, text
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.snapshot = self._head() if at is None else at
        if read_only and self.snapshot == 0:
            raise FileNotFoundError(f"no store at {root}")
        head = self._read(f"pointers/{self.snapshot:020d}.json") if self.snapshot else {"version": VERSION, "tables": {}}
        self._tables, self.version = head["tables"], head["version"]
        if self.version > VERSION:
            raise ConstraintError(f"the store has version {self.version}, this library reads up to {VERSION}")

    @classmethod
    def open(cls, spark: SparkSession, root: str, text: TextForms = STEMMED) -> EvidenceStore:
        """``text`` says how claims and queries are cut into terms: the same each time a store is opened."""
        return cls(spark, root, text=text)

    @classmethod
    def open_read_only(cls, spark: SparkSession, root: str, at: int | None = None) -> EvidenceStore:
        return cls(spark, root, True, at)

    def _head(self) -> int:
        at = self._path(f"{self.root}/pointers")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _list(self, name: str, tables: dict | None = None) -> list[dict]:
        """The parts of a table; older snapshots name a single folder."""
        at = (self._tables if tables is None else tables).get(name, [])
        return [{"rows": at}] if isinstance(at, str) else at

    def _load(self, name: str, schema: str, tables: dict | None = None) -> DataFrame:
        read = lambda at, df: self.spark.read.schema(df.schema).parquet(f"{self.root}/{at}")
        shape = self.spark.createDataFrame([], schema)
        parts = self._list(name, tables)
        if not parts:
            return shape
        if len(parts) == 1:
            return read(parts[0]["rows"], shape)
        keys = KEYS[name]
        return merged([Part(read(p["rows"], shape), read(p["touched"], shape.select(*keys)) if p.get("touched") else None, p.get("keys", 0)) for p in parts], keys)

    def table(self, name: str) -> DataFrame:
        return self._load(name, EVIDENCE[name])

    def index(self) -> Index:
        """The text index of this snapshot's claims, as the commits that changed them made it."""
        return Index(*(self._load(k, schema) for k, schema in INDEX.items()), self.text.phrases)

    def parts(self) -> DataFrame:
        """table, part, keys, bytes of every part, the newest last: what each commit wrote."""
        size = lambda at: self._fs.getContentSummary(self._path(f"{self.root}/{at}")).getLength()
        rows = [(name, k, p.get("keys", 0), size(p["rows"]) + (size(p["touched"]) if p.get("touched") else 0)) for name in sorted(self._tables) for k, p in enumerate(self._list(name))]
        return self.spark.createDataFrame(rows, "table string, part int, keys long, bytes long")

    def migrate(self, at: str) -> int:
        """Bring an older store to this version as one new snapshot; the steps' versions and ``at`` are recorded."""
        if self.version == VERSION:
            return self.snapshot
        read = lambda name: self.spark.read.parquet(f"{self.root}/{self._list(name)[0]['rows']}") if len(self._list(name)) == 1 else self.table(name)
        raw = {name: read(name) for name in self._tables if name in EVIDENCE}
        changed: dict[str, DataFrame] = {}
        for version in range(self.version + 1, VERSION + 1):
            for step in MIGRATIONS[version]:
                done = step(raw)
                raw, changed = raw | done, changed | done
        stamps = self.spark.createDataFrame([(v, at) for v in range(self.version + 1, VERSION + 1)], EVIDENCE["schema_migrations"])
        return self.commit({**changed, "schema_migrations": self.table("schema_migrations").unionByName(stamps)})

    def digest(self) -> str:
        """One digest of this snapshot's files, wherever it lies."""
        found = None
        for name in sorted(self._tables):
            for k, part in enumerate(self._list(name)):
                for kind in ("rows", "touched"):
                    if part.get(kind):
                        one = files.walk(self.spark, f"{self.root}/{part[kind]}").withColumn("path", F.concat(F.lit(f"{name}/{k}/{kind}/"), F.col("path")))
                        found = one if found is None else found.unionByName(one)
        return files.identity(found) if found is not None else files.identity(self.spark.createDataFrame([], "path string, bytes long, sha256 string"))

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in EVIDENCE}

    def validate(self, new: dict[str, DataFrame], after: Callable[[str], DataFrame] | None = None, whole: set[str] | None = None) -> None:
        """Rules and references of ``new`` rows among the tables as they will be.

        References to a table in ``whole``, which is replaced or loses rows, are checked from all rows.
        """
        after = after or (lambda n: new[n] if n in new else self.table(n))
        held = lambda n: n in self._tables  # noqa: E731, a table that was never written refers to nothing
        for name, df in new.items():
            assert_constraints(df, name)
        for child, column, parent, key in REFERENCES:
            if child not in new and not held(child):
                continue
            if parent in (new if whole is None else whole):
                assert_references(after(child), column, after(parent), key, child)
            elif child in new:
                assert_references(new[child], column, after(parent), key, child)

    def _write(self, df: DataFrame, schema: str, at: str) -> None:
        """Rows that are looked up by a column lie in its order, with Bloom filters, so that a lookup skips most row groups."""
        df = df.select(*(F.col(f.split()[0]).cast(" ".join(f.split()[1:])) for f in _fields(schema)))
        out = df.write
        if by := CLUSTERED.get(schema):
            # postings come in runs that are in order, and aren't dealt anew: pages and Bloom filters tell a lookup what to skip
            out = (df if schema == INDEX["index_postings"] else df.repartitionByRange(by).sortWithinPartitions(by)).write.option(f"parquet.bloom.filter.enabled#{by}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option(f"parquet.bloom.filter.candidates.number#{by}", "10").option("parquet.block.size", 16 << 20)
        out.mode("errorifexists").option("compression", "zstd").parquet(f"{self.root}/{at}")

    def commit(self, changed: dict[str, DataFrame] | None = None, dry_run: bool = False, rows: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None) -> int:
        """Publish the next snapshot; a failed check leaves the head where it was.

        Tables in ``changed`` are replaced as a whole. Others get a part: ``rows`` that are new or take the
        place of those with their keys, and the keys of rows that are ``gone``.
        """
        if self.read_only:
            raise PermissionError("the store is open read-only")
        changed, rows, gone = changed or {}, dict(rows or {}), gone or {}
        for name in gone:
            rows.setdefault(name, empty(self.spark, name))
        stage = f"snapshots/{uuid.uuid4().hex}"
        for given in (changed, rows):
            if "memories" in given:
                for f in EVIDENCE["memories"].split(","):
                    if f.split()[0] not in given["memories"].columns:
                        raise ConstraintError(f"memories lack {f.split()[0]}")
        staged: dict[str, list[dict]] = {}

        def add(name: str, df: DataFrame, schema: str, lost: DataFrame | None) -> None:
            """A part beside those that the table has; the first one is its base."""
            at, keys = f"{stage}/{name}", KEYS[name]
            self._write(df, schema, f"{at}/rows")
            written = self.spark.read.schema(schema).parquet(f"{self.root}/{at}/rows")
            if not self._list(name):
                staged[name] = [{"rows": f"{at}/rows"}]
                return
            # a claim's postings and lengths go with it: their keys are the claims'
            (lost if name in INDEX else touched(written, lost, keys)).write.option("compression", "zstd").parquet(f"{self.root}/{at}/touched")
            count = self.spark.read.parquet(f"{self.root}/{at}/touched").count()
            staged[name] = [*self._list(name), {"rows": f"{at}/rows", "touched": f"{at}/touched", "keys": count}]

        for name, df in changed.items():
            self._write(df, EVIDENCE[name], f"{stage}/{name}")
            staged[name] = [{"rows": f"{stage}/{name}"}]
        for name, df in rows.items():
            if name in changed or name not in KEYS:
                raise ConstraintError(f"{name} can't be added to in parts here")
            add(name, df, EVIDENCE[name], gone.get(name))
        new = {n: self.spark.read.schema(EVIDENCE[n]).parquet(f"{self.root}/{parts[-1]['rows']}") for n, parts in staged.items()}
        try:
            self.validate(new, lambda n: self._load(n, EVIDENCE[n], self._tables | staged), {*changed, *gone})
        except Exception:
            self._fs.delete(self._path(f"{self.root}/{stage}"), True)
            raise
        if dry_run:
            self._fs.delete(self._path(f"{self.root}/{stage}"), True)
            return self.snapshot
        if "memories" in new:  # the derived index goes with every commit of claims
            made = Index.build(new["memories"], *self.text)
            for k, df in zip(INDEX, (made.postings, made.lengths), strict=True):
                if "memories" in changed:
                    self._write(df, INDEX[k], f"{stage}/{k}")
                    staged[k] = [{"rows": f"{stage}/{k}"}]
                else:
                    # a claim without a token has no row of its own here, yet takes the place of its earlier ones
                    part = staged["memories"][-1]
                    lost = self.spark.read.parquet(f"{self.root}/{part['touched']}") if part.get("touched") else new["memories"].select("record_digest").distinct()
                    add(k, df, INDEX[k], lost.withColumnRenamed("record_digest", "id"))
        return self._publish(self._tables | staged)

    def compact(self, *names: str) -> int:
        """The merged rows of tables with several parts (all of them, if none is named) as their new bases."""
        if self.read_only:
            raise PermissionError("the store is open read-only")
        stage, schemas = f"snapshots/{uuid.uuid4().hex}", EVIDENCE | INDEX
        many = [n for n in (names or self._tables) if len(self._list(n)) > 1]
        for name in many:
            self._write(self._load(name, schemas[name]), schemas[name], f"{stage}/{name}")
        return self._publish(self._tables | {n: [{"rows": f"{stage}/{n}"}] for n in many}) if many else self.snapshot

    def _publish(self, tables: dict[str, list[dict]]) -> int:
        pointer = self._path(f"{self.root}/pointers/{self.snapshot + 1:020d}.json")
        if self._fs.exists(pointer):
            raise SnapshotConflict(f"snapshot {self.snapshot + 1} exists")
        part = self._path(f"{self.root}/pointers/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps({"version": VERSION, "tables": tables}).encode()))
        out.hsync()
        out.close()
        if not self._fs.rename(part, pointer):
            raise SnapshotConflict(f"snapshot {self.snapshot + 1} exists")
        self.snapshot, self._tables, self.version = self.snapshot + 1, tables, VERSION
        return self.snapshot

    def stats(self) -> DataFrame:
        """table, rows for every table."""
        return table_counts(self.tables())

    def backup_to(self, dest: str) -> DataFrame:
        """A copy of this snapshot in a place where nothing is yet; returns its row counts."""
        if self._path(dest).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(self._path(dest)):
            raise FileExistsError(dest)
        copy = EvidenceStore(self.spark, dest, text=self.text)
        if self.version < VERSION:
            copy.commit(self.tables())
            return copy.stats()
        # the rows of a snapshot were checked when it was made, and its index goes with it
        stage, schemas = f"snapshots/{uuid.uuid4().hex}", EVIDENCE | INDEX
        for name in self._tables:
            copy._write(self._load(name, schemas[name]), schemas[name], f"{stage}/{name}")
        copy._publish({name: [{"rows": f"{stage}/{name}"}] for name in self._tables})
        return copy.stats()


class MemoryStore:
    """The same checks and reads over frames that are written nowhere: for one session's work and for tests."""

    def __init__(self, spark: SparkSession):
        self.spark, self.snapshot, self._tables = spark, 0, {}

    def table(self, name: str) -> DataFrame:
        return self._tables.get(name, empty(self.spark, name))

    tables = EvidenceStore.tables
    validate = EvidenceStore.validate
    stats = EvidenceStore.stats

    def index(self) -> Index:
        return Index.build(self.table("memories"))

    def commit(self, changed: dict[str, DataFrame] | None = None, dry_run: bool = False, rows: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None) -> int:
        changed, rows, gone = changed or {}, dict(rows or {}), gone or {}
        after = dict(changed)
        for name in {*rows, *gone}:
            new = rows.get(name, empty(self.spark, name))
            left = self.table(name).join(gone[name].select(*KEYS[name]), KEYS[name], "left_anti") if name in gone else self.table(name)
            after[name] = replace_by_key(left, new, KEYS[name]).select(*self.table(name).columns)
        self.validate(changed | rows, lambda n: after.get(n, self.table(n)), {*changed, *gone})
        if not dry_run:
            self._tables, self.snapshot = self._tables | after, self.snapshot + 1
        return self.snapshot


def _fields(schema: str) -> list[str]:
    return [f.strip() for f in schema.split(",")]


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def verify_replica(source: dict[str, DataFrame], replica: dict[str, DataFrame], versions: tuple[int, int] = (VERSION, VERSION)) -> DataFrame:
    """table, key, status of every difference: Missing, Extra, Diverged, Corrupt (a key twice), Count, SchemaVersion.

    Sides are first compared by the sums of 4,096 ranges of keys; only rows of ranges that differ are
    joined. A key that both sides hold twice alike is no difference between them.
    """
    spark = next(iter(source.values())).sparkSession
    out = spark.createDataFrame([("schema", str(versions), "SchemaVersion")] if versions[0] != versions[1] else [], "table string, key string, status string")
    for name, key in CONTENT.items():
        if name not in source:
            continue
        body = [c for c in source[name].columns if c != "recorded_seq"]
        ranges = stored(differing_ranges(source[name], replica[name], key, body))
        ours, theirs = (within(side[name], key, ranges) for side in (source, replica))
        out = out.unionByName(difference(ours, theirs, key, body).select(F.lit(name).alias("table"), "key", "status"))
        out = out.unionByName(theirs.groupBy(F.col(key).alias("key")).count().where("count > 1").select(F.lit(name).alias("table"), "key", F.lit("Corrupt").alias("status")))
    rest = sorted(set(source) & set(replica) - set(CONTENT))
    if rest:
        counts = table_counts({n: source[n] for n in rest}).join(table_counts({n: replica[n] for n in rest}).withColumnRenamed("rows", "theirs"), "table").where("rows <> theirs")
        out = out.unionByName(counts.select("table", F.lit(None).cast("string").alias("key"), F.lit("Count").alias("status")))
    return out


__all__ = ["EvidenceStore", "MemoryStore", "SnapshotConflict", "ConstraintError", "table_counts", "verify_replica"]
