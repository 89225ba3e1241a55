import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard
from lodestone.llm.components import components
from lodestone.llm.jaccard import jaccard_components
from lodestone.llm.topk import exact_top_k
from lodestone.llm.workspace import Workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_top_k(rows, k, scale):
    import math

    ok = [(i, [math.floor(scale * x) if abs(x) < 1e300 else int(x) * int(scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in ok:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 512), (3, 2)])
def test_top_k_matches_brute_force(spark, blocks):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(rng.choice([4, 6]))]) for i in range(0, 300, 5)]
    rows += [(301, None), (302, [1.0, None]), (303, [float("nan"), 1.0]), (304, [float("inf")]), (None, [1.0, 2.0]), (350, []), (351, rows[0][1]), (352, rows[0][1]), (353, [3e38, -3e38])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, stripe string, score int").repartition(3)
    exact = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    got = exact_top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, 256.0, *blocks, stripes=3)
    assert sorted(map(tuple, got.collect())) == brute_top_k(exact, 5, 256.0)


@pytest.mark.parametrize("blocks", [(8192, 512), (2, 1)])
def test_top_k_of_large_components_is_exact(spark, blocks):
    rows = [(0, [1e7]), (1, [1e7]), (2, [1.5e7]), (3, [1.25e7]), (4, [-1.5e7]), (5, [-1e7]), (6, [1.7e308]), (7, [1.6e308]), (8, [-1.6e308]), (50, [3e38]), (51, [9e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = exact_top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 11, 256.0, *blocks, stripes=2)
    assert sorted(map(tuple, got.collect())) == brute_top_k(rows, 11, 256.0)
    assert [r.vec_id for r in got.where("query_id = 0").orderBy("rank").collect()][:4] == [6, 7, 50, 2]


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect() == []


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=12, size=9, length=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows, i = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([4, 8, length, 2 * length]))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w = w[: -rng.randint(1, 4)] or w
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, " \n"), (903, "Just three words"), (904, "just THREE words"), (905, "É é"), (906, "é é")]
    df = spark.createDataFrame([(i, t, "c", "x") for i, t in rows], "doc_id long, text string, fp string, token string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_components(df, "doc_id", "text").collect()}
    assert got == brute_components(rows)


def test_jaccard_repeated_and_null_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (3, text), (7, None)], "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard_components(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 3, None), (7, 0, 7)], key=str)
    assert jaccard_components(df.limit(0), "doc_id", "text").collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(50)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        if len(seen) > 1:
            want[n] = min(seen)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(ValueError):
        components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), Workspace(spark, "test"), most_rounds=1)


def test_bitmaps_bound_overlaps_from_above():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 400):
        for m in (n, n + n // 4 + 1):
            for share in (0.0, 0.5, 0.9, 1.0):
                common = rng.integers(0, 2**63, int(share * n), np.uint64)
                x, y = (np.unique(np.r_[common, rng.integers(0, 2**63, k - len(common), np.uint64)]) for k in (n, m))
                bound = jaccard.most_shared(jaccard.bitmap(x), jaccard.bitmap(y), len(x), len(y))
                assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))


def test_lists_are_whole_whatever_their_batches():
    token = np.sort(np.random.default_rng(4).integers(0, 40, 500))
    whole = pa.table({"token": token, "place": np.arange(500)})
    for size in (1, 7, 100, 500):
        parts = list(jaccard.whole_lists(iter(whole.to_batches(size)), ["token", "place"]))
        assert np.concatenate([c[1] for _, c in parts]).tolist() == list(range(500))
        starts = [c[0][s] for at, c in parts for s in at]
        assert starts == sorted(set(token.tolist()))


def test_blocks_of_a_list_skip_no_pair():
    rng = np.random.default_rng(5)
    n = np.sort(rng.integers(10, 60, 90)).astype(np.int32)
    pos = (rng.random(90) * 0.2 * n).astype(np.int32)
    batch = pa.RecordBatch.from_pydict({"token": np.zeros(90, np.int64), "fp": np.arange(90), "n": n, "pos": pos, "root": rng.integers(0, 60, 90), **{c: np.full(90, 30 if c[:4] == "size" else jaccard.UNKNOWN) for c in ("size1", "shared1", "size2", "shared2")}})
    root = batch.column("root").to_numpy()
    left = n.astype(int) - pos
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if root[i] != root[j] and min(left[i], left[j]) >= jaccard.pair_overlap(int(n[i] + 0), int(n[j]), 80)}
    bits = pa.array([b"\xff" * 16] * 90, pa.binary())  # full bitmaps rule nothing out
    for side in (2, 7, 512):
        rows = pa.Table.from_batches(jaccard._rest(80, True, side)(iter([batch])))
        assert set(rows.column("fp").to_pylist()) == {x for p in want for x in p}
        pairs = pa.Table.from_batches(jaccard._rest(80, False, side)(iter([pa.RecordBatch.from_arrays([*batch.columns, bits], names=[*batch.schema.names, "bits"])])))
        assert set(zip(pairs.column("leader").to_pylist(), pairs.column("fp").to_pylist(), strict=True)) == want
