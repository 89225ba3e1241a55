import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm.quality import quality
from lodestone.llm.queries import oracle_sql, queries, tokenizer_path
from tests.llm.test_text_ops import LOWER, brute_hits


def test_registry_has_every_operator():
    names = sorted(queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(oracle_sql()) <= set(names)


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    item = prose(30)
    rows = [(i, prose(60) if i % 5 else " | ".join(word() + "%%%" for _ in range(60)), "en", f"s{i % 3}", 0) for i in range(150)]
    copy = rows[7][1]
    rows += [(500, copy, "en", "s1", 0), (501, copy + " " + word(), "en", "s2", 0), (502, prose(20) + " " + item, "en", "s0", 0), (503, None, "en", None, 0), (504, "", None, "s1", 0)]
    rows = [(i, None if t is None else ("menu\n" + t if s == "s2" else t), g, s, len(t or "")) for i, t, g, s, _ in rows]
    d = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 150)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        columns = docs.columns
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert k == len(cp.STAGES) - 1 or docs.columns == columns, name
    good = {i for i in range(150) if i % 5} | {500, 501, 502}
    assert good <= seen[0] and len(seen[0] - good) <= 4
    assert seen[1] == seen[0]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/out1").collect()}
    assert not any("menu" in (t or "").split("\n") for t in texts.values())
    assert seen[1] - seen[2] == {500, 501}
    assert seen[2] - seen[3] == {502}
    assert seen[4] == seen[3]
    assert {r.doc_id for r in cp.run(spark, d).select("doc_id").distinct().collect()} == seen[4]


def test_benchmark_stage_drops_leaks_without_an_id_and_nothing_else(spark, tmp_path):
    import corpus_pipeline as cp

    item = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "see " + item), (None, "clean"), (None, None), (4, item), (4, "clean too"), (5, "fine")], "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in cp.benchmark_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert left == sorted([(None, "clean"), (None, None), (4, "clean too"), (5, "fine")], key=str)


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as cp

    a, b = "one two three four five six seven", "red blue green white black brown grey"
    rows = [(1, a), (9, a), (9, b), (20, b), (30, "lone words that no other document holds"), (30, "lone words that no other document holds"), (None, a), (None, a), (40, ""), (40, ""), (41, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, group string")
    left = sorted(((r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, docs, "").collect()), key=str)
    assert left == sorted([(1, a), (9, b), (30, rows[4][1]), (None, a), (None, a), (40, ""), (40, ""), (41, None)], key=str)


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.collect() == [] and (name == "packing" or out.columns == empty.columns), name


def plain_lines(rows):
    """Line dedup of (id, text, source), line by line."""
    pages, on = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        on.update((s, line) for line in set((t or "").split("\n")) if line.strip())
    gone = {(s, line) for (s, line), n in on.items() if n >= 3 and n > pages[s] * 0.03}
    return [(i, "\n".join(x for x in (t or "").split("\n") if (s, x) not in gone), s) for i, t, s in rows]


def plain_near(rows):
    """The rows that stay of each group of near duplicates: the smallest id."""
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    best = {}
    for k, r in enumerate(rows):
        best[top(k)] = min(best.get(top(k), r[0]), r[0])
    return [r for k, r in enumerate(rows) if not sets[k] or best[top(k)] == r[0]]


def plain_clean(rows, items):
    return [r for r in rows if brute_hits([(0, r[1])], items)[0][1] == 0]


def test_stages_match_plain_versions_one_after_another(spark, tmp_path):
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    item, menus = prose(24), [prose(5) for _ in range(4)]
    rows = [(i, prose(rng.choice([8, 60, 140])), f"s{i % 3}") for i in range(90)]
    for k in range(0, 40, 4):  # exact and near copies, some of them on other sites
        w = rows[k][1].split(" ")
        w[rng.randrange(len(w))] = word()
        rows.append((100 + k, " ".join(w), f"s{rng.randrange(3)}"))
        rows.append((200 + k, rows[k + 1][1], rows[k + 1][2]))
    rows += [(300 + k, prose(20) + "\n" + " ".join(item.split(" ")[k : k + 9 + k]), "s1") for k in range(6)] + [(400, None, "s2"), (401, "", None), (402, " ".join(prose(9) for _ in range(300)), "s0")]
    rows = [(i, t if not t or rng.random() < 0.4 else f"{rng.choice(menus)}\n{t}\n{rng.choice(menus)}", s) for i, t, s in rows]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    d = str(tmp_path / "sf")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stage = dict(cp.STAGES)
    see = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)
    keep = {r.doc_id for r in quality(docs, spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "text", F.col("source"), F.concat_ws("/", "source", "lang")).where("quality_keep").collect()}
    assert see(stage["quality"](spark, docs, d)) == sorted((r for r in rows if r[0] in keep), key=str)
    lined = stage["line_dedup"](spark, docs, d)
    assert see(lined) == sorted(plain_lines(rows), key=str) and see(lined) != sorted(rows, key=str)
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    rows2 = plain_lines(rows)
    alone = stage["near_duplicates"](spark, lined, d)
    assert see(alone) == sorted(plain_near(rows2), key=str) and len(rows2) - 20 <= len(see(alone)) + 4 < len(rows2)
    rows3 = plain_near(rows2)
    clean = stage["decontamination"](spark, alone, d)
    assert see(clean) == sorted(plain_clean(rows3, [(1, item)]), key=str) and len(see(clean)) < len(rows3)
    rows4, tokenizer = plain_clean(rows3, [(1, item)]), Tokenizer.from_file(tokenizer_path())
    packed = stage["packing"](spark, clean, d).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows4}
    pieces, full = {}, {}
    for r in packed:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(pieces[i])):
            assert (piece, start) == (k, at)
            at += length
        assert at == len(x)
    for spans in full.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 1024
    assert len(full) <= 1 + -(-sum(map(len, ids.values())) // 1024)
