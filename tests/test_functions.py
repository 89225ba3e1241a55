import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.functions.seal import divergence_id, personal_digest, seal, seal_column
from lodestone.functions.text import canonical_json, fixed_text, index_tokens, query_phrases, stem, strict_object
from lodestone.sources import envelope


def values(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_recency_and_blend(spark):
    null = F.lit(None).cast("double")
    r = values(spark, scalar.recency(null), scalar.recency(F.lit(-3.0)), scalar.recency(F.lit(180.0)), scalar.blended(F.lit(1.0), null, F.lit(0.5), null, F.lit(1.0)))
    assert r == pytest.approx((0.5, 1.0, 0.5, 0.55))
    r = values(spark, scalar.graph_decay(F.lit(0)), scalar.graph_decay(F.lit(4)), scalar.saturation(F.lit(2)), scalar.lexical_share(F.lit(3.0), F.lit(4.0)), scalar.lexical_share(F.lit(0.0), F.lit(0.0)))
    assert r == pytest.approx((1.0, 0.25, 0.8, 0.75, 1.0))


def test_cosine(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = values(spark, scalar.cosine(a(1.0, 0.0), a(1.0, 1.0)), scalar.cosine(a(0.0, 0.0), a(1.0, 1.0)), scalar.cosine(a(1.0), a(1.0, 1.0)), scalar.all_finite(a(1.0, float("nan"))))
    assert r[0] == pytest.approx(2**-0.5) and r[1] == 0.0 and r[2] is None and r[3] is False


def test_instants_and_cursors(spark):
    c = lambda t: scalar.canonical_instant(F.lit(t).cast("string"))
    assert values(spark, c("2024-02-29T23:59:59.999Z"), c("2023-02-29T00:00:00.000Z"), c("2024-01-01T00:00:60.000Z"), c("2024-01-01T00:00:00Z"), c(None)) == (True, False, False, False, False)
    ok, bad = values(spark, scalar.parse_cursor(F.lit("3:41")), scalar.parse_cursor(F.lit("3:x")))
    assert (ok.epoch, ok.sequence) == (3, 41) and bad is None
    assert values(spark, scalar.age_days(F.lit("2024-01-02T00:00:00Z"), F.lit("2024-01-01T12:00:00Z")), scalar.age_days(F.lit("2024-01-02T00:00:00Z"), F.lit("soon"))) == (0.5, None)


def test_ascii_match_leaves_wildcards_live(spark):
    m = lambda t, q: scalar.ascii_like(F.lit(t), q)
    assert values(spark, m("A Claim", "cLA"), m("É", "é"), m("abc", "a_c"), m("a\\c", "a\\c"), m("abc", "x")) == (True, False, True, True, False)


def test_derivations(spark):
    d = lambda t, a, b: scalar.derive(t, F.lit(a), F.lit(b))
    r = values(spark, d("ratio", 287.17, 39.52), d("ratio", 1.0, 0.0), d("percentChange", 8.38, 11.55), d("delta", 1.0, 0.0))
    assert fixed_text(r[0].value, 2) == "7.27" and (r[1].value, r[1].problem) == (None, "division-by-zero")
    assert fixed_text(r[2].value, 1) == "-27.4" and r[3].value == 1.0
    assert fixed_text(-0.001, 2) == "0.00" and fixed_text(1.005, 2) == "1.00"
    assert values(spark, scalar.last_decimal(F.lit("from 3 to 7.27x")), scalar.last_decimal(F.lit("none here"))) == ("7.27", None)


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("probate", "probat"), ("agreed", "agre"), ("is", "is")])
def test_stem(word, want):
    assert stem(word) == want


def test_tokens_and_phrases():
    assert index_tokens("Café_Models' RUNNING") == ["cafe", "model", "run"]
    assert query_phrases('foo_bar "x" OR (y) y') == [["foo", "bar"], ["x"], ["or"], ["y"], ["y"]]
    assert query_phrases(' "" --') == [] and query_phrases(None) == []


def test_seals_agree_and_know_sets_from_lists(spark):
    fields = {"claim": 'a "quoted" claim', "evidenceClass": "observed", "observationIdentities": ["b", "a"]}
    row = spark.createDataFrame([(fields["claim"], "observed", ["a", "b"])], "c string, e string, o array<string>")
    assert row.select(seal_column("memory-record", claim=F.col("c"), evidenceClass=F.col("e"), observationIdentities=F.col("o"))).first()[0] == seal("memory-record", fields)
    assert seal("session-prefix", {"emitted": ["a", "b"]}) != seal("session-prefix", {"emitted": ["b", "a"]})
    assert seal("entity", {"canonicalName": "n", "aliases": ["x", "x"]}) == seal("entity", {"canonicalName": "n", "aliases": ["x"]})
    body = '{"domain":"ns.artifact.v1","artifactKind":"k","sha256Hex":null,"byteSize":3,"mediaType":null,"sourceUri":null}'
    assert seal("artifact", {"artifactKind": "k", "byteSize": 3}, "ns") == hashlib.sha256(body.encode()).hexdigest()
    a, b = values(spark, divergence_id(F.lit("x"), F.lit("y")), divergence_id(F.lit("y"), F.lit("x")))
    assert a == b


def test_canonical_json():
    assert canonical_json({"b": [1e21, 1e-7, 0.1, -0.0, 5.0, 123456789012345680000.0], "a": "\u20ac\n", "\U0001f600": 1, "\ufb33": 2}) == '{"a":"\u20ac\\n","b":[1e+21,1e-7,0.1,0,5,123456789012345680000],"\U0001f600":1,"\ufb33":2}'
    for bad in ('{"a":1,"a":2}', '{"x":{"e\\u0301":1}}', "[1]", '{"a":NaN}'):
        with pytest.raises(ValueError):
            strict_object(bad)
    assert personal_digest("é", "{}", None) == personal_digest("é", "{}", None) != personal_digest("é", "{}", "2024-01-01T00:00:00.000Z")


def test_ed25519_published_vectors():
    # RFC 8032, section 7.1, tests 1 and 2
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert envelope.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert envelope.sign(seed, b"").hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    sig = envelope.sign(seed, b"\x72")
    assert envelope.verify(envelope.public_key(seed), b"\x72", sig) and not envelope.verify(envelope.public_key(seed), b"\x73", sig)
    peers = {envelope.key_id(envelope.public_key(seed)): envelope.public_key(seed)}
    e = envelope.seal_envelope(seed, {"a": 1})
    assert envelope.open_envelope(json.loads(envelope.dumps(e)), peers) == {"a": 1}
    with pytest.raises(PermissionError):
        envelope.open_envelope(e | {"payloadBase64": "e30="}, peers)
    with pytest.raises(PermissionError):
        envelope.open_envelope(e, {})


def test_texts_reach_python_in_small_pieces(spark, monkeypatch):
    import pyarrow as pa

    from lodestone.functions import text

    monkeypatch.setattr(text, "PIECE", 10)
    given = pa.array(["aaaa", None, "bbbbbb", "c" * 30, "", "d"])
    assert list(text._pieces(given)) == [["aaaa", None, "bbbbbb"], ["c" * 30], ["", "d"]] and list(text._pieces(given.slice(4))) == [["", "d"]]
    rows = spark.createDataFrame([(1, "plainé\n"), (2, "ét"), (3, None), (4, ""), (5, "á̖ 가")], "id int, t string")
    got = {r.id: (r.n, r.w) for r in rows.select("id", text.nfc_column(rows.t).alias("n"), text.index_tokens_udf("t").alias("w")).collect()}
    assert got == {1: ("plainé\n", text.index_tokens("plain\u00e9")), 2: ("ét", ["et"]), 3: (None, []), 4: ("", []), 5: ("á̖ 가", ["a", text.fold("가")])}, got
