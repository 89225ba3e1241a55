import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import align, infill
from lodestone.llm.align import align_corpus, align_tokens, counted_links, pair_counts
from lodestone.llm.bpe_codec import bpe_decode, bpe_encode
from lodestone.llm.fragments import ByteLevel, Pieces, inner_pairs, stream_of
from lodestone.llm.infill import Checkpoints, fill_in_middle, restored
from lodestone.llm.queries import op11_token_alignment, op12_bpe_codec, op13_fill_in_middle, tokenizer_path
from tests.llm.test_models_and_packing import odd_texts

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
TEXTS = [*odd_texts(120), "a▁b", "word " * 4000, "x" * 20_000, " \n\n x", "<P>", "日本語" * 50, "The same line.\n" * 30, "The same line.\n" * 30, "é'll!'s"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    special, plain = Tokenizer.from_file(A), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    return special, plain, SentencePieceProcessor(model_file=B)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_pairs_inside_tokens():
    seen = inner_pairs([b"abc", b"", b"d", b"ca"])
    assert sorted(np.flatnonzero(seen)) == sorted(x * 256 + y for x, y in (b"ab", b"bc", b"ca"))


def test_fragments_match_the_libraries(libraries):
    special, plain, pieces = libraries
    for vocabulary, want in ((ByteLevel(A), [e.ids for e in special.encode_batch(TEXTS, add_special_tokens=False)]), (ByteLevel(A, plain=True), [e.ids for e in plain.encode_batch(TEXTS, add_special_tokens=False)])):
        for _ in range(2):  # the second time from what is known
            ids, n, whole = vocabulary.encode(*stream_of(pa.array(TEXTS)))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want and whole.all()
    ids, n, whole = Pieces(B).encode(*stream_of(pa.array([" " + t for t in TEXTS])))
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [g for g, t in zip(got, TEXTS) if t and "▁" not in t] == [g for g, t in zip(pieces.encode(TEXTS), TEXTS) if t and "▁" not in t]
    assert [w for w, t in zip(whole, TEXTS)] == ["▁" not in t for t in TEXTS]


def test_codec_round_trip(spark, libraries):
    rows = [*enumerate(TEXTS), (900, None), (900, None), (None, "a<|endoftext|>b")]
    d = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    encoded = bpe_encode(d, "text", A)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    got = [(r.doc_id, r.n_tokens, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in encoded.collect()]
    want = [(i, len(e.ids), tuple(e.ids)) for (i, _), e in zip(rows, libraries[0].encode_batch([t or "" for _, t in rows], add_special_tokens=False))]
    assert Counter(got) == Counter(want)
    assert Counter((r.doc_id, r.decoded) for r in bpe_decode(encoded, "ids", A).collect()) == Counter((i, t or "") for i, t in rows)
    assert bpe_decode(bpe_encode(d.limit(0), "text", A), "ids", A).collect() == []


def test_decoding_what_no_text_encodes_to(spark, libraries):
    lone = [libraries[0].encode("é").ids + [220], libraries[0].encode("日").ids[:1], []]
    raw = [(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(lone)] + [(3, None)]
    got = {r.k: r.decoded for r in bpe_decode(spark.createDataFrame(raw, "k int, ids binary"), "ids", A).collect()}
    assert got == {k: libraries[0].decode(x, skip_special_tokens=False) for k, x in enumerate(lone)} | {3: ""}
    with pytest.raises(Exception, match="whole number of ids"):
        bpe_decode(spark.createDataFrame([(bytearray(b"abc"),)], "ids binary"), "ids", A).collect()


def test_codec_query_over_a_whole_table(spark, libraries):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {tuple(r) for r in op12_bpe_codec(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = {(i, len(e), sha(np.array(e, "<u4").tobytes()), sha(libraries[0].decode(e, skip_special_tokens=False))) for i, t in docs.items() for e in [libraries[0].encode(t, add_special_tokens=False).ids]}
    assert got == want


def plain_alignment(texts, libraries):
    """Per text (n_a, n_b, groups, links in order), token by token."""
    _, a_lib, b_lib = libraries
    a_bytes = ByteLevel(A, plain=True).bytes
    out = []
    for t in texts:
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        raw_b = [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_lib.id_to_piece, b)]
        raw_a = [a_bytes[i] for i in a]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            out.append((0, 0, "", []))
            continue
        spans = lambda raw: list(zip(np.cumsum([0, *map(len, raw)])[:-1].tolist(), np.cumsum([*map(len, raw)]).tolist()))
        sa, sb = spans(raw_a), spans(raw_b)
        both = {e for _, e in sa} & {e for _, e in sb}
        sides = []
        for ids, spans_of in ((a, sa), (b, sb)):
            sides.append([[]])
            for i, (_, e) in zip(ids, spans_of):
                sides[-1][-1].append(str(i))
                if e in both:
                    sides[-1].append([])
        groups = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides) if x)
        links, j = [], 0
        for i, (x, y) in zip(a, sa):
            while j and sb[j - 1][1] > x:
                j -= 1
            while j < len(sb) and sb[j][0] < y:
                if sb[j][1] > x:
                    links.append((i, b[j]))
                j += 1
        out.append((len(a), len(b), groups, links))
    return out


def plain_rows(texts, libraries):
    parts = plain_alignment(texts, libraries)
    count = Counter(p for *_, links in parts for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(na, nb, g.count(";") + bool(g), len(links), g, sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)) for na, nb, g, links in parts]


def test_alignment_matches_a_plain_one(spark, libraries):
    texts = [*TEXTS[:100], *[t for t in TEXTS[100:] if len(t) < 3000], None, "a▁b", "x" * 3000, "tie", "tie"]
    d = spark.createDataFrame([(i if i % 7 else None, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(4)
    fields = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    out = align_corpus(d, "text", A, B)
    assert out.columns == ["doc_id", *fields]
    got = Counter(tuple(r) for r in out.collect())
    assert got == Counter((i if i % 7 else None, *row) for i, row in enumerate(plain_rows([t or "" for t in texts], libraries)))
    assert align_corpus(d.limit(0), "text", A, B).collect() == []


def test_hot_pairs_join_apart(spark, monkeypatch):
    links = spark.createDataFrame([(r, a, b, 1 + r % 3) for r in range(60) for a, b in ((1, 1), (1, 2 + r % 5), (2, r % 20))], "__row long, a int, b int, times int")
    pairs = pair_counts(links)
    key = lambda df: sorted(tuple(r) for r in df.select("__row", "times", "n", "best").collect())
    whole = key(counted_links(links, pairs))
    monkeypatch.setattr(align, "HOT", 4)
    monkeypatch.setattr(align, "bounded", lambda *_: False)
    assert key(counted_links(links, pairs)) == whole and len(whole) == 180


def test_alignment_query_over_a_whole_table(spark, libraries):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = sorted(tuple(r) for r in op11_token_alignment(spark, SMALL).select(fields).collect())
    want = plain_rows([t for _, t in docs], libraries)
    assert got == sorted((i, *w[:4], sha(w[4]) if w[4] else "", *w[5:]) for (i, _), w in zip(docs, want))


UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def test_checkpoints_find_every_cut(monkeypatch):
    texts = ["", "ab", "cd1é日🙂ef  g", "", "x" * 300, "é" * 200, "a b " * 90, "z"]
    for stride, block in ((3, 7), (64, 1 << 20), (1, 1)):
        monkeypatch.setattr(infill, "STRIDE", stride)
        monkeypatch.setattr(infill, "BLOCK", block)
        index = Checkpoints(*stream_of(pa.array(texts)))
        units = [UNIT.findall(t) for t in texts]
        n, chars = index.counts()
        assert n.tolist() == list(map(len, units)) and chars.tolist() == list(map(len, texts))
        for k in range(0, 301, 7):
            at = np.minimum(k, n)
            b, c = index.cut(at)
            heads = ["".join(u[:i]) for u, i in zip(units, at.tolist())]
            assert c.tolist() == list(map(len, heads)) and b.tolist() == [len(h.encode()) for h in heads]


def plain_infill(i, text):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    x, y = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rows = [*enumerate([*TEXTS, "<", ">", "P>", "<P", "<<", "S>M>" * 20, "a<S>b", None, "\x00\n" * 40, "<" * 50, "q<M"]), (3, "twice"), (3, "twice"), (None, "no id")]
    rows += [(1000 + k, "<P< S> one two <M three M> <S P>" * 3) for k in range(60)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, form string").repartition(3)
    out = fill_in_middle(d, "doc_id", "text").withColumn("again", restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in out.collect())
    assert got == Counter((i, *plain_infill(i, t or ""), t or "") for i, t in rows)
    assert fill_in_middle(d.limit(0), "doc_id", "text").collect() == []
    with pytest.raises(ValueError, match="sentinels"):
        fill_in_middle(d, "doc_id", "text", sentinels=("<P>", "<P>", "<M>"))


def test_fill_in_middle_query_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = sorted(tuple(r) for r in op13_fill_in_middle(spark, SMALL).collect())
    assert [r[:3] for r in got] == sorted((r.doc_id, *plain_infill(r.doc_id, r.text or "")[:2]) for r in docs)
    assert Counter(r[5:] for r in got) == Counter((sha(plain_infill(r.doc_id, r.text or "")[4]), sha(r.text or "")) for r in docs)
