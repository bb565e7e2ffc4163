import hashlib
import re
import struct

import xxhash
from quillon.llm import fingerprints as G


def chained(values):
    """The hash of several longs, each hashed with the hash before as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def hashes(t):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    words = [x for w in words for x in ([w] if len(w) <= G.LONG_WORD else w)]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return [x - (1 << 64) if x >> 63 else x for x in h]


def brute_places(h):
    return [i for i in range(len(h) - 4) if min(h[i], h[i + 4]) <= min(h[i + 1 : i + 4])]


def brute(t):
    h = hashes(t)
    at = brute_places(h)
    k = [chained(h[i : i + 5]) for i in at]
    if len(at) > 1:
        return {chained([k[i], k[i + 1], at[i + 1] - at[i]]) for i in range(len(at) - 1)}
    return set(k) if k else {chained(h)} if h else set()


def shown(s):
    return "".join(f"{x & ((1 << 64) - 1):016x}" for x in sorted(s))


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_rows_against_brute_force(spark, sf, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(5000, None), (5001, ""), (70000, "a b c d e"), (1 << 40, "far"), ((1 << 62) + 3, "日本語の文章には空白がありません。" * 60), ((1 << 62) + 1, "日本語の文章には空白がありません。" * 59), (-(1 << 50), "low"), (90000, "one two"), (90001, "é" * 50000), (None, "n u l l")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in G.op6_fingerprints(df).collect()}
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        k = len(t) // 3
        assert got[d].n_chars == len(t)
        e = t[: len(t) - k] + n[:k]
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest(), d
        a, b, c = brute(t), brute(e), brute(n)
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (shown(a), shown(b)), d
        assert abs(got[d].near_edited - like(a, b)) < 1e-12 and abs(got[d].near_next - like(a, c)) < 1e-12
    assert got[(1 << 62) + 3].near_next > 0.8
    monkeypatch.setattr(G, "MOST_BUCKETS", 2)
    monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    assert {r.doc_id: r for r in G.op6_fingerprints(df).collect()} == got
    long = [r for r in got.values() if r.n_chars > 600]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert sum(r.near_edited for r in long) / len(long) > 0.4 > 0.2 > sum(r.near_next for r in long) / len(long)
    assert len({r.fingerprint for r in got.values()}) <= len({t or "" for _, t in docs})
    assert G.op6_fingerprints(df.limit(0)).count() == 0
    assert [r.near_next for r in G.op6_fingerprints(df.where("doc_id = 3")).collect()] == [1.0]


def test_syncmers_are_context_free(spark):
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", "y", "z"] + words[50:150]))], "doc_id long, text string")
    rows = G.anchors(df).collect()
    a = {r.hash: r.at for r in rows if r.doc_id == 1 and 50 <= r.at <= 145}
    b = {r.hash: r.at for r in rows if r.doc_id == 2 and r.at >= 3}
    assert a.keys() == b.keys() and len(a) > 20 and {a[h] - b[h] for h in a} == {47}
    assert {r.at for r in rows if r.doc_id == 1} == set(brute_places(hashes(" ".join(words))))


def test_fingerprints_grow_with_the_text(spark):
    words = [f"w{i * 7919 % 10007}" for i in range(4000)]
    texts = [" ".join(t) for t in (words, words[:2000] + ["other"] * 3 + words[2003:], words[:400], words[2000:] + words[:2000])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in G.op6_fingerprints(df).collect()}
    assert all(len(got[i].fingerprint) == 16 * len(brute(t)) > 16 * 100 for i, t in enumerate(texts))
    assert got[0].fingerprint != got[1].fingerprint
    assert 0.1 > got[2].near_next > 0.05 or got[2].near_next == like(brute(texts[2]), brute(texts[1]))
    assert got[1].near_next > 0.98
