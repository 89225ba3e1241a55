import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, transducer
from lodestone.llm.packing import best_fit_pack, plan_bins
from lodestone.llm.quality import quality
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.token_counts import token_counts
from lodestone.llm import toxicity as tox
from lodestone.llm.toxicity import toxicity


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    parts = [*"ab'strevlldm \n\t  1²é日本!?.-🙂  ́ßÀ", "<|endoftext|>", "'re", "'ll", "  ", "\r\n", "the"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "'", " ", "'r", "a'r", "<|endoftext|>", "\x00a\x00", "word " * 3000]


def test_transducers_match_the_library(library):
    texts = odd_texts(1500)
    for quick in (False, True):
        owner, place, table = bpe.encode(texts, tokenizer_path(), quick)
        n = np.bincount(owner, weights=table.counts[place], minlength=len(texts)).astype(int)
        ids = np.split(bpe.text_ids(place, table), np.cumsum(n)[:-1])
        assert [x.tolist() for x in ids] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_travel_on_transitions(library):
    texts = odd_texts(1500) + ["x" * 127, "日" * 43, "é" * 64, "a" * 129 + " b", "日" * 700, "-" * 5000 + "a", "no\n\n\n" * 400]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert transducer.token_totals(texts, tokenizer_path()).tolist() == want
    assert transducer.token_totals([], tokenizer_path()).tolist() == []


def test_chunks_of_any_size_and_a_machine_that_is_emptied(monkeypatch, library):
    words = [w.encode() for w in odd_texts(300, 5) if 0 < len(w.encode()) <= 40]
    raw = np.frombuffer(b"".join(words), np.uint8)
    mode = np.zeros(len(raw), np.uint8)
    mode[np.cumsum([0, *map(len, words[:-1])])] = transducer.BEGIN
    machine = transducer.Transducer(tokenizer_path())
    whole = machine.read(raw, mode, len(raw))
    assert whole.sum() == sum(len(machine.counter.merge(w)) for w in words)
    for chunk in (41, 64, 1000):
        assert (machine.read(raw, mode, chunk) == whole).all()
    monkeypatch.setattr(transducer, "SEGMENT", 500)
    machine.most = 50
    assert (machine.counts(raw, mode) == whole).all()


def test_neighbours_by_undone_merges_are_those_of_whole_merges():
    c = bpe.Counter(tokenizer_path())
    assert c.ordered
    rng = random.Random(4)
    tokens = [t for t in sorted(c.bytes) if len(c.bytes[t]) < 12 and c.single(t)]
    likely = [(x, y) for x, y in c.rank] + [(t, t) for t in tokens]
    pairs = [rng.choice(likely) for _ in range(3000)] + [(rng.choice(tokens[:2000]), rng.choice(tokens[:2000])) for _ in range(5000)]
    runs = [c.vocab[t * n] for t in (b"-", b"=", b" ", b"e") for n in range(1, 9) if t * n in c.vocab]
    pairs += [(x, y) for x in runs for y in runs]
    for x, y in pairs:
        if c.single(x) and c.single(y):
            assert c.adjacent(x, y) == (c.merge(c.bytes[x] + c.bytes[y]) == [x, y])


def test_chunk_maps_compose():
    classes = np.random.default_rng(1).integers(0, bpe.CLASSES, 5000).astype(np.uint8)
    assert (bpe.begins(classes, 7) == bpe.begins(classes, 4096)).all()


def test_token_counts(spark, library):
    rows = [(i, t) for i, t in enumerate(odd_texts(40))] + [(900, None), (900, None)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(d, "text", tokenizer_path()).collect())
    assert got == sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert token_counts(d.limit(0), "text", tokenizer_path()).collect() == []


def test_packing_round_trip(spark, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["word ", "x", "é", "\n"]) for _ in range(rng.choice([0, 5, 300, 1500]))) for _ in range(60)] + [None, "", "y " * 5000]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rank int").repartition(4)
    rows = best_fit_pack(d, "doc_id", "text", tokenizer_path(), separator=2, tokens=256).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    pieces, bins = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, p in pieces.items():
        at = 0
        for k, (n, start, length) in enumerate(sorted(p)):
            assert (n, start) == (k, at) and (k == 0 or length == 256)
            at += length
        assert at == len(ids[i])
    assert set(pieces) == set(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    lower = -(-sum(map(len, ids.values())) // 256)
    assert len(bins) <= lower * 1.05 + 1
    assert best_fit_pack(d.limit(0), "doc_id", "text", tokenizer_path(), separator=2).collect() == []


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_plan_holds_every_capacity(by):
    rng = random.Random(2)
    counts = {n: rng.randint(0, 200) for n in range(1, 129)}
    runs = plan_bins(counts, 128, 6, 6000, (1.0, 0.5, 0.5), by)
    bins, placed = {}, dict.fromkeys(counts, 0)
    for length, rank, n, first, offset in runs:
        assert rank == placed[length]
        placed[length] += n
        for b in range(first, first + n):
            bins.setdefault(b, []).append((offset, length))
    assert placed == counts
    for b in bins.values():
        assert sum(x for _, x in b) <= 128 and len(b) <= 6
        assert sum(x * x for _, x in b) <= 6000 or len(b) == 1
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length


def sentences(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(2, 7)))
    insults, out = ["idiot", "stupid", "worthless", "moron"], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 3 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(insults)
        out.append((i, " ".join(w), int(toxic)))
    return out


def gapped(word):
    """A word's vector by definition: every choice of three places within reach, each worth decay ** span."""
    out = {}
    x = [tox._letters()[0][ord(c)] for c in word]
    for i in range(len(x)):
        for k in range(i + 2, min(len(x), i + tox.REACH)):
            for j in range(i + 1, k):
                if tox.NONE not in (x[i], x[j], x[k]):
                    t = (int(x[i]) * tox.ALPHABET + int(x[j])) * tox.ALPHABET + int(x[k])
                    out[t] = out.get(t, 0.0) + tox.DECAY ** (k - i + 1)
    norm = sum(v * v for v in out.values()) ** 0.5
    return {t: v / norm for t, v in out.items()}


@pytest.mark.parametrize("merged, dense", [(1 << 20, 1 << 15), (50, 10)])
def test_kernel_and_landmarks_match_their_definition(monkeypatch, merged, dense):
    monkeypatch.setattr(tox, "MERGED", merged)
    monkeypatch.setattr(tox, "DENSE", dense)
    rng = random.Random(11)
    words = ["idiot", "idiiiot", "i-d-i-o-t", "mississippi", "a" * 10, "ha" * 7, "ha" * 20, "ab", "x.y.z"] + ["".join(rng.choice("aab-éo1") for _ in range(n)) for n in range(3, 41)]
    vectors = [gapped(w) for w in words]
    dot = lambda a, b: sum(v * b.get(t, 0.0) for t, v in a.items())
    w, t, v = tox.kernel_rows(words)
    rows = np.zeros((len(words), tox.ALPHABET**3))
    np.add.at(rows, (w, t), v)
    want = np.array([[dot(a, b) for b in vectors] for a in vectors])
    assert np.allclose(rows @ rows.T, want)
    table = np.random.default_rng(1).normal(size=tox.ALPHABET**3)
    assert np.allclose(tox.word_margins(*tox._encode_words(words), table), rows @ table)
    # the map in matrix form, and the table that it collapses into
    marks = [0, 3, 5, 12, 20]
    values, vectors = np.linalg.eigh(want[np.ix_(marks, marks)])
    half = vectors / np.sqrt(values)
    n = tox.Landmarks([words[i] for i in marks])
    beta = np.random.default_rng(2).normal(size=len(marks))
    assert np.allclose(n.features(words) @ n.features(words).T, want[:, marks] @ half @ half.T @ want[marks])
    assert np.allclose(tox.word_margins(*tox._encode_words(words), n.table(beta)), n.features(words) @ beta)


def test_toxicity_on_held_out_and_obfuscated_texts(spark):
    rows = sentences(600, 1)
    odd = [(1000, "you are an i-d-i-o-t really"), (1001, "such a st.upid plan"), (1002, "w0rthless work"), (1003, "m o r o n came in"), (1004, "idiiot here"), (1005, None), (1006, ""), (1007, "... 123"), (1008, "tuesday rain and roses"), (1008, "tuesday rain and roses")]
    d = spark.createDataFrame([(i, t, "y") for i, t, _ in rows] + [(i, t, "y") for i, t in odd], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(2000, 1), (2001, None)], "doc_id long, toxic int")
    got = {r.id: r.score for r in toxicity(d, labels, "doc_id", "text", "toxic", F.col("doc_id") < 400).collect()}
    held = [(got[i] >= 0.7, y == 1) for i, _, y in rows if i >= 400]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(got[i] >= 0.7 for i in (1000, 1001, 1002, 1003)), {i: got[i] for i in range(1000, 1005)}
    assert all(0 <= got[i] < 0.3 for i in (1005, 1006, 1007, 1008))
    none = toxicity(d, labels.limit(0), "doc_id", "text", "toxic", F.lit(True)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity(d.limit(0), labels, "doc_id", "text", "toxic", F.lit(True)).collect() == []


def test_quality_keeps_good_and_shrinks_sparse_sites(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(400):
        good = i % 4 != 0
        w = [word() for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(w) + "." if good else " | ".join(x + rng.choice(["%%%", "$$$"]) for x in w), f"h{i % 7}" if i else None, int(good)))
    d = spark.createDataFrame([(i, t, h, 0.5) for i, t, h, _ in rows] + [(900, None, None, 0.5), (901, "", "lone", 0.5)], "doc_id long, text string, host string, quality_score double")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i % 2 == 0], "doc_id long, quality int")
    out = quality(d, labels, "doc_id", "text", F.col("host"), F.col("host"))
    got = {r.doc_id: r.quality_keep for r in out.collect()}
    assert sum(got[i] == (y == 1) for i, _, _, y in rows if i % 2) >= 0.97 * 200
    assert len(got) == 402 and out.columns == ["doc_id", "text", "host", "quality_score", "quality_keep"]
    kept = quality(d, labels.limit(0), "doc_id", "text", F.col("host"), F.col("host")).collect()
    assert all(r.quality_keep and r.quality_score == 0.5 for r in kept)
    assert quality(d.limit(0), labels, "doc_id", "text", F.col("host"), F.col("host")).collect() == []


def test_quality_posteriors_match_a_plain_recomputation(spark):
    """Evidence, shrinkage and posterior odds made again from their definitions, document by document."""
    import pyarrow as pa

    from lodestone.llm import quality as q

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(150):
        good = i % 3 != 0
        w = [word() for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(w) if good else "|".join(x + "$$" for x in w), f"h{min(i % 11, 4)}", f"h{min(i % 11, 4)}/p{i % 2}", int(good)))
    rows += [(200, None, "h1", None, 1), (201, "", None, None, 0), (202, "lone words stand here", "only", "only/x", 1), (3, rows[3][1], "h3", "h3/p1", 0)]
    d = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:120]], "doc_id long, quality int")
    got = sorted(((r.doc_id, r.host or "", r.quality_score, r.quality_keep) for r in q.quality(d, labels, "doc_id", "text", F.col("host"), F.col("path")).collect()))
    model = q.train(d, labels, "doc_id", "text", "quality", 4000)
    logit = model.logit(q.features(pa.array([r[1] for r in rows], pa.string())))
    p = 1 / (1 + np.exp(-logit))
    host, path = [r[2] for r in rows], [(r[2], r[3]) for r in rows]
    group = lambda keys: {k: (sum(x == k for x in keys), sum(p[i] for i, x in enumerate(keys) if x == k)) for k in set(keys)}
    hosts, paths = group(host), group(path)
    rate = min(0.999, max(0.001, p.mean()))

    def strength(groups, prior):
        kept = [(n, good, prior(k)) for k, (n, good) in groups.items() if n > 1]
        spread, n = sum(n * (good / n - m) ** 2 for n, good, m in kept), sum(n for n, _, _ in kept)
        between = (spread - sum(m * (1 - m) for _, _, m in kept)) / n
        v = sum(m * (1 - m) for _, _, m in kept) / len(kept)
        return min(1e4, max(1.0, v / between - 1)) if between > 0 else 1e4

    k_host = strength(hosts, lambda _: rate)
    k_path = strength(paths, lambda k: (k_host * rate + hosts[k[0]][1]) / (k_host + hosts[k[0]][0]))
    want = []
    for i, r in enumerate(rows):
        hm = (k_host * rate + hosts[host[i]][1] - p[i]) / (k_host + hosts[host[i]][0] - 1)
        pm = (k_path * hm + paths[path[i]][1] - p[i]) / (k_path + paths[path[i]][0] - 1)
        pm = min(0.999, max(0.001, pm))
        score = 1 / (1 + np.exp(-(logit[i] + 0.5 * (np.log(pm / (1 - pm)) - np.log(rate / (1 - rate))))))
        want.append((r[0], r[2] or "", score, bool(score >= 0.3)))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 and a[3] == b[3]
