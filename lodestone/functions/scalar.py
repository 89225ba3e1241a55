"""Scalar expressions of retrieval, time, derivation and text, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blend's weights and the recency half-life in days.
WEIGHTS = {"lexical": 0.40, "semantic": 0.25, "entity": 0.20, "graph": 0.10, "recency": 0.05}
HALF_LIFE_DAYS = 180.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def recency(age_days: Column) -> Column:
    """1 for the present and future, halving every half-life; an unknown age is worth one half."""
    return F.when(age_days.isNull(), 0.5).when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / HALF_LIFE_DAYS))


def graph_decay(hops: Column) -> Column:
    return F.when(hops.isNull(), 0.0).otherwise(1.0 / F.greatest(hops, F.lit(1)))


def saturation(n: Column) -> Column:
    return n / (n + 0.5)


def lexical_share(score: Column, best: Column) -> Column:
    """A score as a share of the best one, held to 0..1; 1 where no score is positive."""
    safe = F.when(best <= 0, None).otherwise(best)
    return F.when(best <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / safe)))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def blended(lexical: Column, semantic: Column, entity: Column, graph: Column, recent: Column) -> Column:
    parts = {"lexical": lexical, "semantic": semantic, "entity": entity, "graph": graph, "recency": recent}
    return sum((F.coalesce(parts[k].cast("double"), F.lit(0.0)) * w for k, w in WEIGHTS.items()), F.lit(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; null for unequal lengths, 0 where a norm is 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, 0.0).otherwise(_dot(a, b) / F.when(norms == 0, None).otherwise(norms)))


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(_dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / F.when(norm == 0, None).otherwise(norm)).cast("float")))


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def age_days(as_of: Column, occurred_at: Column) -> Column:
    """Days between two RFC-3339 texts; null where either is missing or not a time."""
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c))
    return (micros(as_of) - micros(occurred_at)) / F.lit(86_400_000_000.0)


def canonical_instant(c: Column) -> Column:
    """Whether a text is exactly YYYY-MM-DDTHH:MM:SS.mmmZ and a real calendar instant."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{3}Z$") & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def canonical_now(at: Column | None = None) -> Column:
    """The canonical text of a moment, the present one by default: for stamps of writes, never for reads."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_like(c: Column, needle: str) -> Column:
    """Substring match that folds ASCII case only; % and _ of the needle stay live, a backslash is itself."""
    pattern = "%" + needle.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%"
    return ascii_lower(c).like(pattern)


def derive(transform: str, a: Column, b: Column) -> Column:
    """struct(value, problem): ratio a / b, delta a - b, percentChange (a - b) / b * 100, guarded before dividing."""
    safe = F.when(b == 0, None).otherwise(b)
    value = {"ratio": a / safe, "delta": a - b, "percentChange": (a - b) / safe * 100.0}[transform]
    zero = (b == 0) if transform != "delta" else F.lit(False)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    problem = F.when(a.isNull() | b.isNull(), "missing-input").when(zero, "division-by-zero").when(bad, "not-finite")
    return F.struct(F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))


def last_decimal(claim: Column) -> Column:
    """The last blank-separated word of a claim that reads as a decimal once all but digits, point and minus are stripped."""
    words = F.reverse(F.transform(F.split(claim, r"\s+"), lambda w: F.regexp_replace(w, r"[^0-9.\-]", "")))
    return F.get(F.filter(words, lambda w: w.rlike(r"^-?(\d+\.?\d*|\.\d+)$")), 0)


def cursor_after(epoch: Column, sequence: Column, e: int, s: int) -> Column:
    """Lexicographic (epoch, sequence) > (e, s)."""
    return (epoch > e) | ((epoch == e) & (sequence > s))


def parse_cursor(c: Column) -> Column:
    """struct(epoch, sequence) of 'E:S'; null for any other text."""
    part = lambda i: F.split_part(c, F.lit(":"), F.lit(i)).cast("long")
    return F.when(c.rlike(r"^\d{1,18}:\d{1,18}$"), F.struct(part(1).alias("epoch"), part(2).alias("sequence")))


def live(superseded_at: Column, retracted_at: Column) -> Column:
    return superseded_at.isNull() & retracted_at.isNull()


def believed_at(seq: Column, recorded: Column, superseded: Column, retracted: Column) -> Column:
    """Half-open belief: written by then and not retired by then."""
    ends = lambda e: e.isNull() | (e > seq)
    return (recorded <= seq) & ends(superseded) & ends(retracted)


def belief_state(seq: Column, recorded: Column, superseded: Column, retracted: Column) -> Column:
    return F.when(recorded > seq, "NotYetKnown").when(believed_at(seq, recorded, superseded, retracted), "Current").otherwise("Retired")


def other_end(me: Column, a: Column, b: Column) -> Column:
    return F.when(a == me, b).otherwise(a)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits and marks' bases: the plain tokenizer of the SQL checks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
