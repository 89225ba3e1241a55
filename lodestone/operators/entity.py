"""Declared entities: dictionary, mention spans, search by shared entities."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import live
from lodestone.functions.seal import seal
from lodestone.functions.text import pieces_of
from lodestone.operators.keyed import replace_by_key
from lodestone.operators.stored import stored

ALGORITHM = "longest-match-word-bounded.v1"
#: Dictionaries with more forms than this go through an automaton, whose time doesn't grow with their number.
FEW = 64
#: Bytes of the forms that every worker holds; of a larger table only the forms that occur, or none.
FORM_BYTES = 1 << 21
#: Bits of the bitmap for each form of a larger table, and the most in all (16 MB); a row of the bitmap has PAGE bits.
BITS, MOST, PAGE = 16, 1 << 27, 1 << 15
#: Other than ASCII letters and digits.
_OUTSIDE = np.array([not chr(b).isalnum() or b > 127 for b in range(256)])


def _starts_and_ends(raw: bytes, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every place of every form in ``raw``, by one pass of an Aho-Corasick automaton."""
    automaton = _automaton(tuple(forms))
    found = np.fromiter((x for end, size in automaton.iter(raw.decode("latin-1")) for x in (end + 1, size)), np.int64).reshape(-1, 2)
    return found[:, 0] - found[:, 1], found[:, 0]


@lru_cache(maxsize=2)
def _automaton(forms: tuple[bytes, ...]):
    """Built once a worker; bytes go in as the characters of their numbers, so that places are in bytes."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for f in forms:
        automaton.add_word(f.decode("latin-1"), len(f))
    automaton.make_automaton()
    return automaton


def leftmost_longest(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans stay: from the left, at each free place the longest."""
    order = np.lexsort((-end, start))
    kept, free = [], 0
    for k, a, b in zip(order.tolist(), start[order].tolist(), end[order].tolist(), strict=True):
        if a >= free:
            kept.append(k)
            free = b
    return np.array(kept, np.int64)


class Dictionary:
    """Surface forms of entities, longest first; forms of equal length by text, then by entity."""

    def __init__(self, entities: list[tuple[str, str, list[str]]], identity: str | None = None):
        forms = {(form.lower(), eid) for eid, name, aliases in entities for form in [name, *aliases] if form.strip()}
        self.forms = sorted(forms, key=lambda f: (-len(f[0].encode()), f))
        self.identity = identity or seal("entity-extractor", {"algorithm": ALGORITHM, "entityIdentities": [eid for eid, _, _ in entities]})
        self.entity: dict[bytes, str] = {}
        for form, eid in self.forms:
            self.entity.setdefault(form.encode(), eid)
        # the longest form comes first, so that it is the one taken at a place
        self._pattern = "|".join(re.escape(form) for form, _ in dict.fromkeys((f, 0) for f, _ in self.forms)).encode() if len(self.entity) <= FEW else ""

    @classmethod
    def of(cls, entities: DataFrame) -> Dictionary:
        """From the entity table, which is declared by hand and small."""
        return cls([(r.id, r.canonical_name, list(r.aliases or [])) for r in entities.select("id", "canonical_name", "aliases").collect()])

    def spans(self, raw: bytes) -> Iterator[tuple[str, int, int]]:
        """Non-overlapping spans in lower-cased bytes, bounded by other than ASCII letters and digits."""
        if len(self.entity) > FEW:
            start, end = _starts_and_ends(raw, list(self.entity))
            outside = np.append(_OUTSIDE[np.frombuffer(raw, np.uint8)], True)
            alone = (outside[start - 1] | (start == 0)) & outside[end]
            start, end = start[alone], end[alone]
            for k in leftmost_longest(start, end).tolist():
                a, b = int(start[k]), int(end[k])
                yield self.entity[raw[a:b]], a, b
        elif self.entity:
            word = rb"[0-9A-Za-z]"
            for m in re.finditer(rb"(?<!" + word + rb")(?:" + self._pattern + rb")(?!" + word + rb")", raw):
                yield self.entity[m[0]], m.start(), m.end()

    def mentions(self, text: str | None) -> list[tuple[str, int, int]]:
        """entity, start, end of one text's mentions, in bytes of the lower-cased text."""
        return list(self.spans((text or "").lower().encode()))


def _finder(dictionary: Dictionary):
    """The mention rows of batches of (record_digest, claim): about a megabyte of claims is searched as one buffer."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for piece in pieces_of(b.column(1)):
                raw = [t.encode() for t in piece]
                at = np.cumsum([0, *(len(t) + 1 for t in raw)])
                found = list(dictionary.spans(b"\x00".join(raw)))
                start, end = (np.array([f[k] for f in found], np.int64) for k in (1, 2))
                row = np.searchsorted(at, start, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + row)), pa.array([f[0] for f in found], pa.string()), pa.array((start - at[row]).astype(np.int32)), pa.array((end - at[row]).astype(np.int32))], names=["record_digest", "entity_id", "start_offset", "end_offset"])
                lo += len(piece)

    return find


def _claims(memories: DataFrame) -> DataFrame:
    return memories.where("claim IS NOT NULL").select("record_digest", F.lower("claim").alias("claim"))


def index_mentions(memories: DataFrame, dictionary: Dictionary) -> DataFrame:
    """The mention rows of every claim under this dictionary."""
    kind = memories.schema["record_digest"].dataType.simpleString()
    found = _claims(memories).mapInArrow(_finder(dictionary), f"record_digest {kind}, entity_id string, start_offset int, end_offset int")
    return found.withColumn("extractor_identity", F.lit(dictionary.identity))


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forms of (form, id), as a dictionary holds them."""
    for b in batches:
        rows = [(f.lower().encode(), i) for f, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if f and f.strip()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["form", "id"])


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_bits`` needs of a buffer: running sums of its bytes times powers of an odd base, and the powers' inverses, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    powers, inverse = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(raw), x % (1 << 64), np.uint64))]) for x in (base, pow(base, -1, 1 << 64)))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1])]), inverse


def _bits(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a bitmap for the bytes of each span: equal bytes have equal bits."""
    h = (sums[end] - sums[start]) * inverse[start]
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    h ^= h >> np.uint64(33)
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def _marking(bits: int):
    """The bits of batches of forms."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(0).to_pylist()
            at = np.cumsum([0, *map(len, raw)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(*_sums(np.frombuffer(b"".join(raw), np.uint8)), at[:-1], at[1:], bits)))], names=["bit"])

    return mark


def _bitmap(forms: DataFrame, bits: int) -> np.ndarray:
    """The marked bits of all forms, as bytes: at most ``MOST`` bits, whatever the number of forms."""
    marks = forms.select("form").mapInArrow(_marking(bits), "bit long").select(F.expr(f"bit div {PAGE}").alias("page"), (F.col("bit") % PAGE).alias("place"))
    found = np.zeros((bits // PAGE, PAGE // 8), np.uint8)
    for r in marks.groupBy("page").agg(F.bitmap_construct_agg("place").alias("marked")).toLocalIterator():
        found[r.page] = np.frombuffer(r.marked, np.uint8)
    return found.reshape(-1)


def _candidates(lengths: list[int], bitmap: np.ndarray, places: bool):
    """The bounded spans of batches of (row, claim) that may be forms: each one with its place, or a piece's different ones."""
    bits = len(bitmap) * 8
    marked = lambda bit: bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for piece in pieces_of(b.column(1)):
                raw = [t.encode() for t in piece]
                at = np.cumsum([0, *(len(t) + 1 for t in raw)])
                buffer = np.frombuffer(b"\x00".join([*raw, b""]), np.uint8)
                outside, (sums, inverse) = _OUTSIDE[buffer], _sums(buffer)
                begins = np.flatnonzero(np.append(True, outside[:-1]))
                stop = at[np.searchsorted(at, begins, "right")] - 1  # where its claim ends
                start, size = [], []
                for n in lengths:
                    a = begins[begins + n <= stop]
                    a = a[outside[a + n]]
                    one, two = _bits(sums, inverse, a, a + n, bits)
                    a = a[marked(one) & marked(two)]
                    start.append(a)
                    size.append(np.full(len(a), n))
                start, size = np.concatenate(start), np.concatenate(size)
                ends = np.cumsum(size)
                data = buffer[np.repeat(start - ends + size, size) + np.arange(int(size.sum()))]
                form = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])
                if places:
                    row = np.searchsorted(at, start, "right") - 1
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + row)), pa.array((start - at[row]).astype(np.int32)), pa.array((start + size - at[row]).astype(np.int32)), form], names=["row", "start_offset", "end_offset", "form"])
                else:
                    yield pa.RecordBatch.from_arrays([form.unique()], names=["form"])
                lo += len(piece)

    return find


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spans in the order of row, start and falling end the ones that ``leftmost_longest`` keeps; a claim may run over batches."""
    row, free = None, 0
    for b in batches:
        kept = []
        for k, (r, a, e) in enumerate(zip(*(b.column(c).to_pylist() for c in ("row", "start_offset", "end_offset")), strict=True)):
            if r != row:
                row, free = r, 0
            if a >= free:
                kept.append(k)
                free = e
        yield b.take(pa.array(kept, pa.int64()))


def index_mentions_of(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """The mention rows of every claim under an entity table of any size.

    A table beyond ``FORM_BYTES`` stays where it is: a bitmap of its forms' hashes tells which spans of the
    claims may be forms, and a join by their bytes which ones are. A form that occurs nowhere takes no
    span from another one, so the forms that occur are the dictionary; where they are too many for a worker
    too, all spans meet the table and each claim's are chosen in their order.
    """
    named = entities.select(F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"), F.col("id").cast("string").alias("id"))
    forms = stored(named.mapInArrow(_lowered, "form binary, id string").groupBy("form").agg(F.min("id").alias("id")))
    size = forms.agg(F.count("*").alias("n"), F.sum(F.length("form")).alias("bytes")).first()
    if (size.bytes or 0) <= FORM_BYTES:
        return index_mentions(memories, Dictionary.of(entities))
    parts = [F.sum(F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), k, 15), 16, 10).cast("decimal(38,0)")) for k in (1, 16)]
    identity = seal("entity-extractor", {"algorithm": ALGORITHM, "entityIdentities": ["-".join(map(str, entities.select("id").distinct().agg(F.count("*"), *parts).first()))]})
    bitmap = _bitmap(forms, min(MOST, max(PAGE, 1 << (BITS * size.n - 1).bit_length())))
    lengths = sorted(r.n for r in forms.select(F.length("form").alias("n")).distinct().collect())
    claims = _claims(memories)
    met = stored(claims.mapInArrow(_candidates(lengths, bitmap, False), "form binary").distinct().join(forms, "form"))
    if (met.agg(F.sum(F.length("form"))).first()[0] or 0) <= FORM_BYTES:
        return index_mentions(memories, Dictionary([(r.id, bytes(r.form).decode(), []) for r in met.collect()], identity))
    kind = memories.schema["record_digest"].dataType.simpleString()
    rows = claims.select(F.struct(F.monotonically_increasing_id().alias("at"), "record_digest").alias("row"), "claim")
    spans = rows.mapInArrow(_candidates(lengths, bitmap, True), f"row struct<at: bigint, record_digest: {kind}>, start_offset int, end_offset int, form binary").join(met, "form")
    spans = spans.select(F.col("row.at").alias("row"), F.col("row.record_digest").alias("record_digest"), F.col("id").alias("entity_id"), "start_offset", "end_offset")
    spans = spans.repartition("row").sortWithinPartitions("row", "start_offset", F.desc("end_offset")).mapInArrow(_chosen, f"row bigint, record_digest {kind}, entity_id string, start_offset int, end_offset int")
    return spans.drop("row").withColumn("extractor_identity", F.lit(identity))


def reindex(memories: DataFrame, mentions: DataFrame, dictionary: Dictionary) -> DataFrame:
    """The mention table with this extractor's rows made anew."""
    return mentions.where(F.col("extractor_identity") != dictionary.identity).unionByName(index_mentions(memories, dictionary))


def put_entities(store: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by_key(store, new, ["id"])


def entity_search(query: str, dictionary: Dictionary, mentions: DataFrame, memories: DataFrame, limit: int, include_retired: bool = False) -> DataFrame:
    """record_digest, shared, entities: records by how many of the query's entities they mention."""
    wanted = sorted({e for e, _, _ in dictionary.mentions(query)})
    m = memories if include_retired else memories.where(live(F.col("superseded_at"), F.col("retracted_at")))
    hits = mentions.where(F.col("entity_id").isin(wanted) if wanted else F.lit(False)).where(F.col("extractor_identity") == dictionary.identity)
    out = hits.join(m.select("record_digest"), "record_digest", "left_semi").groupBy("record_digest").agg(F.countDistinct("entity_id").alias("shared"), F.sort_array(F.collect_set("entity_id")).alias("entities"))
    return out.orderBy(F.desc("shared"), "record_digest").limit(limit)
