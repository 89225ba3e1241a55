"""The opN_ queries over the driver tables, and their DuckDB equivalents where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.align import align_corpus
from lodestone.llm.bpe_codec import bpe_decode, bpe_encode
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.infill import fill_in_middle, restored
from lodestone.llm.jaccard import jaccard_components
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.packing import best_fit_pack
from lodestone.llm.pii import replace_pii
from lodestone.llm.quality import quality
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.token_counts import token_counts
from lodestone.llm.topk import exact_top_k
from lodestone.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5, scale=256.0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    out = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", usable=fold != 1)
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source as the host; lines on over 3 percent of a source's documents go."""
    out = line_dedup(_table(spark, sf_dir, "documents"), F.col("source"), "text")
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, source, pos, line FROM (
    SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (
  SELECT l.source, line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE trim(line) <> ''
  GROUP BY l.source, line, pages HAVING count(DISTINCT doc_id) > pages * 0.03::DOUBLE AND count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line
), g AS (
  SELECT doc_id, source, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id, source
)
SELECT doc_id, source, n_lines, n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM g
"""


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a fixed one here; a deployment passes its own secret."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return replace_pii(docs, "doc_id", "text", secret="lodestone-demo-key")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(_table(spark, sf_dir, "documents"), "doc_id", "text", k=5, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, "text", tokenizer_path())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = quality(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", F.col("source"), F.concat_ws("/", "source", "lang"))
    return out.select("doc_id", "source", "lang", "quality_score", "quality_keep")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), "doc_id", "text", length=100)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), separator=2, tokens=1024)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", window=10, k=5)
    n_items = F.size("items").cast("long")
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS wtext
  FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
), ms AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS wtext
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)
), h AS (SELECT DISTINCT doc_id, item, p, dw.m AS m FROM dw JOIN iw ON dw.wtext = iw.wtext AND dw.m = iw.m),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items,
  sha256(coalesce(k.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_corpus(docs, "text", tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), digest=True)


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe_encode(docs, "text", tokenizer_path()).withColumn("ids_sha256", F.sha2("ids", 256))
    out = bpe_decode(ids, "ids", tokenizer_path())
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]') AS t,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""


def queries() -> dict:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_toxicity": op2_toxicity,
        "op3_line_dedup": op3_line_dedup,
        "op4_pii_surrogates": op4_pii_surrogates,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_token_counts": op6_token_counts,
        "op7_quality": op7_quality,
        "op8_decontaminate": op8_decontaminate,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_token_alignment": op11_token_alignment,
        "op12_bpe_codec": op12_bpe_codec,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op3_line_dedup": OP3_SQL, "op8_decontaminate": OP8_SQL, "op13_fill_in_middle": OP13_SQL}
