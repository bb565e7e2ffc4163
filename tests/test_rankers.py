"""Rankers against straight-line versions."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillon import contract as C
from quillon.functions import hypervectors as hv
from quillon.operators import chunks as K
from quillon.operators import lexical as L
from quillon.operators import rerank as R
from quillon.operators import semantic as S


def corpus(spark):
    rnd = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(25)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "Where is word3 and word17, word40?"), (2, "the of and"), (3, "word5 word5 nothing")], "qid long, question string")


def test_coverage_is_whitened_over_the_whole_corpus(spark):
    docs, qs = corpus(spark)
    dim, k = 64, 4
    index, df = L.index(docs, dim, k, composed=False), K.token_df(docs, k)
    n = K.chunks(docs, k).count()
    terms = L.terms(qs, df, n)
    plan = L.prepared(terms)
    assert {q.qid for q in plan} == {1, 3}
    bags = [(r.doc_id, r.chunk, np.frombuffer(bytes(r.bag), "u8")[0]) for r in K.bags(docs, dim, k, composed=False).orderBy("doc_id", "chunk").collect()]
    for q in plan:
        phi = {}
        for t in {p for x in q.pieces for p in x}:
            v = np.frombuffer(hv.hashed(t.encode(), dim), "u8")[0]
            z = np.array([(32 - int(np.bitwise_count(b ^ v))) / 4 for *_, b in bags])
            phi[t] = np.clip(np.minimum(z / 25, (z - z.mean()) / (z.std() + 1e-9) / 3), 0, 1)
        cov = sum(w * np.min([phi[p] for p in x], axis=0) for w, x in zip(q.weights, q.pieces))
        order = sorted((i for i in range(len(bags)) if cov[i] > 0), key=lambda i: (-round(cov[i], 12), i))[:5]
        got = [r for r in L.retrieve_coverage(index, plan, 5, dim=dim, composed=False).orderBy("qid", "rk").collect() if r.qid == q.qid]
        assert [(r.doc_id, r.chunk, r.gid) for r in got] == [(*bags[i][:2], i) for i in order]
        assert np.allclose([r.cov for r in got], [cov[i] for i in order])
        keep = docs.where("doc_id < 10").select("doc_id")
        some = [r for r in L.retrieve_coverage(index, plan, 5, keep, dim=dim, composed=False).orderBy("qid", "rk").collect() if r.qid == q.qid]
        order = sorted((i for i in range(len(bags)) if cov[i] > 0 and bags[i][0] < 10), key=lambda i: (-round(cov[i], 12), i))[:5]
        assert [(r.doc_id, r.chunk) for r in some] == [bags[i][:2] for i in order]
    rows = {(r.qid, r.word): r for r in terms.collect()}
    assert ("nothing" not in {w for _, w in rows}) and rows[1, "word3"].weight == max(1.0, 4 * math.log(n / rows[1, "word3"].min_df))


def test_common_tokens_are_dropped_unless_all_are(spark):
    toks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "qid long, token string, n long")
    df = spark.createDataFrame([("a", 26), ("b", 25)], "token string, df long")
    got = {(r.qid, r.token): r.kept for r in L.df_filter(toks, df, 100).collect()}
    assert got == {(1, "a"): False, (1, "b"): True, (2, "a"): True}


def test_windows_stay_apart():
    assert L.best_windows(np.array([2.0, 2, 0, 0, 2, 0]), np.zeros(6)) == [0, 4]


def test_neighbours():
    got = L.with_neighbours(np.array([[0, 0.8, 0.05]]))
    assert np.allclose(got, [[0.32, 0.8, 0.32]])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9)), min_size=1, max_size=12), st.integers(1, 6), st.integers(1, 3))
def test_variety_is_the_greedy_walk(spark, rows, k, cap):
    rows = [(1, d, i, i, float(s)) for i, (d, s) in enumerate(rows)]
    order = sorted(rows, key=lambda r: (-r[4], r[3]))
    took, passed, n = [], [], {}
    for r in order:
        if len(took) == k:
            break
        if n.get(r[1], 0) < cap:
            took.append(r[3])
            n[r[1]] = n.get(r[1], 0) + 1
        else:
            passed.append(r[3])
    want = (took + passed)[:k]
    df = spark.createDataFrame(rows, "qid long, doc_id long, chunk long, gid long, score double")
    assert [r.gid for r in R.varied(df, k, cap).orderBy("rk").collect()] == want


def test_semantic_windows_and_scores(spark):
    texts = {i: " ".join(["x"] * n) for i, n in enumerate((1, 16, 64, 65, 80, 144))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in S.windows(docs).collect():
        got.setdefault(r.doc_id, []).append((r.win_start, r.win_len))
    for i, n in enumerate((1, 1, 4, 5, 5, 9)):
        assert sorted(got[i]) == [(s, min(8, n - s)) for s in range(0, max(n - 3, 1), 4)]
    emb = S.embedded(S.windows(docs), S.HashEmbedder(64))
    mu = S.centroid(emb)
    keyed = S.keys(emb, mu, 256)
    e = S.HashEmbedder(64).embed([texts[5]])[0]
    key = hv.pack(((e - np.array(mu)) @ S.projection(256, 64).T > 0)[None])[0].tobytes()
    wins = S.scan(keyed, [(7, key)], 256, ["doc_id", "win_start", "win_len"])
    assert wins.count() == keyed.count() and all(abs(r.sem - math.cos(math.pi * r.ham / 256)) < 1e-12 for r in wins.collect())
    top = S.abstains(wins, tau=1.0).first()
    assert top.abstain == (top.sem_top < 1.0)


def test_rankers_with_production_vectors(spark, tmp_path):
    """cov_topk, cov_windows, graded_topk and composed_bag_topk against straight-line code, at 16,384 composed bits."""
    from quillon import queries as Q

    docs, qs = corpus(spark)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    qs.selectExpr("qid as item_id", "question as text").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    df, n = K.token_df(docs), K.chunks(docs).count()
    chunks = [(r.doc_id, r.chunk, list(r.tokens)) for r in K.chunks(docs).orderBy("doc_id", "chunk").collect()]
    vector = lambda t: hv.unpack([hv.compose(t.encode(), C.DIM)])[0].astype(np.int64)
    tie = hv.unpack([hv.stream(b"TIE", 0, C.DIM)])[0].astype(np.int64)
    majority = lambda ts: (lambda v: np.where(2 * v == len(ts), tie, 2 * v > len(ts)).astype(np.int64))(sum(vector(t) for t in ts))
    bags = np.stack([majority(t) for *_, t in chunks])
    found = L.terms(qs, df, n)
    plan = L.prepared(found, most=1 << 20)
    rows = {name: [tuple(r) for r in Q.Q[name](spark, str(tmp_path)).orderBy("qid", "rk").collect()] for name in ("cov_topk", "cov_windows", "graded_topk", "composed_bag_topk")}
    near = lambda a, b: [x[:5] for x in a] == [x[:5] for x in b] and np.allclose([x[5] for x in a], [x[5] for x in b], atol=2e-6)
    ranked = lambda qid, score, order: [(qid, i + 1, *chunks[g][:2], g, score[g]) for i, g in enumerate(order)]
    want = {name: [] for name in rows}
    for q in plan:
        phi = {}
        for t in {p for x in q.pieces for p in x}:
            z = (C.DIM / 2 - (bags ^ vector(t)).sum(1)) / (C.DIM**0.5 / 2)
            phi[t] = np.clip(np.minimum(z / C.RAW_SCALE, (z - z.mean()) / (z.std() + 1e-9) / C.WHITE_SCALE), 0, 1)
        cov = sum(w * np.min([phi[p] for p in x], axis=0) for w, x in zip(q.weights, q.pieces))
        want["cov_topk"] += ranked(q.qid, cov, [g for g in sorted(range(n), key=lambda g: (-cov[g], g)) if cov[g] > 0][:3])
        sites = []
        for s in range(n - C.WINDOW + 1):
            if chunks[s][0] == chunks[s + C.WINDOW - 1][0]:
                score = sum(w * min(phi[p][s : s + C.WINDOW].max() for p in x) for w, x in zip(q.weights, q.pieces))
                sites.append((score + 1e-6 * cov[s : s + C.WINDOW].sum(), s, score))
        picked = []
        for o, s, score in sorted(sites, key=lambda x: (-x[0], x[1])):
            if score > 0 and all(chunks[s][0] != chunks[p][0] or abs(s - p) > 3 for p, _ in picked):
                picked.append((s, score))
        best = {}
        for s, score in picked[: C.TOP_WINDOWS]:
            for g in range(s, s + C.WINDOW):
                best[g] = max(best.get(g, 0), score + cov[g])
        want["cov_windows"] += ranked(q.qid, best, sorted(best, key=lambda g: (-best[g], g))[:3])
    own = {r.qid: [] for r in qs.collect()}
    for r in found.orderBy("qid", "term_ix").collect():
        own[r.qid] += [(t, int(min(C.GRADED_CAP, max(1, round(4 * math.log(n / r.min_df)))))) for t in r.pieces]
    tokens = {r.qid: list(r.t) for r in qs.select("qid", L.tokenize("question").alias("t")).collect()}
    share = {r.token: r.df / n for r in df.collect()}
    for qid in sorted(own):
        votes = sum(w * (2 * vector(t) - 1) for t, w in own[qid] or [(t, 1) for t in tokens[qid]])
        ham = ((bags ^ (votes > 0)) * np.minimum(np.abs(votes), 15)).sum(1)
        want["graded_topk"] += ranked(qid, ham, sorted(range(n), key=lambda g: (ham[g], g))[:3])
        rare = [t for t in tokens[qid] if share.get(t, 0) <= C.DF_MAX] or tokens[qid]
        ham = (bags ^ majority(rare)).sum(1)
        want["composed_bag_topk"] += ranked(qid, ham, sorted(range(n), key=lambda g: (ham[g], g))[:3])
    for name, got in rows.items():
        shape = lambda r: (r[0], r[1], r[2], r[3], r[4], float(r[5]))
        assert want[name] and near([shape(r) for r in got], [shape(r) for r in want[name]]), name


def test_coverage_where_chunks_are_read(spark, sf, monkeypatch):
    """Scoring chunks in blocks gives what the join of all shared tokens gives, with nulls and ties."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, "some words here"), (9000, None), (9001, ""), (9002, "some words here"), (9003, "some words here")], "doc_id long, text string"))
    asked = [(i, r.text[:200]) for i, r in enumerate(docs.limit(7).collect())] + [(50, "some words"), (51, ""), (52, None), (50, "here")]
    q = spark.createDataFrame(asked, "qid long, question string")
    key = lambda d: sorted((r.qid, r.rk, r.doc_id or -1, r.chunk, round(r.cov, 6)) for r in d.collect())
    want = key(L.joined_coverage(docs, q, 4, 0.5))
    assert len(want) > 20 and key(L.exact_coverage(docs, q, 4, 0.5)) == want
    monkeypatch.setattr(L, "QUESTIONS", 2)
    assert key(L.exact_coverage(docs, q, 4, 0.5)) == want
    monkeypatch.setattr(C, "BROADCAST_ROWS", 1)
    assert key(L.exact_coverage(docs, q, 4, 0.5)) == want
    assert L.exact_coverage(docs.limit(0), q).count() == 0 and L.exact_coverage(docs, q.limit(0)).count() == 0


def test_index_of_many_tokens(spark):
    """More distinct tokens than a worker holds vectors of: each chunk still has the bag of its own tokens."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f" {a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in "abc"]
    docs = spark.createDataFrame([(i, "".join(words[i * 10_000 : i * 10_000 + 10_000])) for i in range(5)], "doc_id long, text string").coalesce(1)
    rows = L.index(docs, 64, composed=False).collect()
    assert sum(len(set(r.tokens)) for r in rows) > 45_000
    for r in rows:
        for c in (0, 300, r.n_chunks - 1):
            part = r.tokens[c * C.CHUNK : (c + 1) * C.CHUNK]
            assert bytes(r.bags)[c * 8 : c * 8 + 8] == hv.bundle([hv.hashed(t.encode(), 64) for t in part], 64)


def test_nearest_among_many_ties(spark):
    """Stored and merely tokenised documents give each query's nearest chunks, ties by place, whatever batches they are in."""
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i * 5000, "".join(rnd.choice([" a", " b", " c", "d"]) for _ in range(rnd.randint(0, 150)))) for i in range(40)], "doc_id long, text string").repartition(3)
    docs = docs.unionByName(spark.createDataFrame([(7, None), (8, "")], "doc_id long, text string"))
    asked = [(3, hv.hashed(b"x", 64)), (4, hv.hashed(b" a", 64)), (5, bytes(8))]
    bags = [(r.doc_id, r.chunk, bytes(r.bag)) for r in K.bags(docs, 64, 4, composed=False).orderBy("doc_id", "chunk").collect()]
    ham = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    want = {q: [(*bags[g][:2], g, h) for h, g in sorted((ham(b, v), g) for g, (*_, b) in enumerate(bags))[:6]] for q, v in asked}
    df, n, sizes = L.survey(docs, spark.createDataFrame([(1, "a b q"), (2, None)], "qid long, question string"), 4)
    assert n == len(bags) == K.chunks(docs, 4).count()
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in K.token_df(docs, 4).where("token in ('a', ' a', ' b', ' q', 'q', 'b')").collect()}
    for found in (L.nearest(L.index(docs, 64, 4, composed=False), asked, 6, dim=64), L.with_gid(L.nearest(L.tokenised(docs), asked, 6, size=4, composed=False, dim=64), sizes)):
        got = {q: [] for q, _ in asked}
        for r in found.orderBy("qid", "rk").collect():
            got[r.qid].append((r.doc_id, r.chunk, r.gid, r.ham))
        assert got == want


def test_distances_by_products():
    """Distances out of matrix products are the counts of bits that differ, all of them if need be."""
    rng = np.random.default_rng(6)
    for dim, n in ((24, 3), (64, 5), (1024, 4), (C.DIM, 5), (C.DIM, 1)):
        bags = np.concatenate([rng.integers(0, 256, (5, dim // 8), np.uint8), np.full((1, dim // 8), 255, np.uint8), np.zeros((1, dim // 8), np.uint8)])
        rows = np.concatenate([rng.integers(0, 256, (n - 1, dim // 8), np.uint8), np.full((1, dim // 8), 255, np.uint8)])
        differ = hv.unpack(bags)[:, None] ^ hv.unpack(rows)[None]
        assert (L.Distances(rows).of(bags) == differ.sum(2)).all()
        weigh = rng.integers(0, 16, (n, dim))
        assert (L.Distances(rows, weigh).of(bags) == (differ * weigh[None]).sum(2)).all()


def test_coverage_reads_chunks_once(spark, monkeypatch):
    """The chunks held by guessed moments give the answer; if the guess is bad, all chunks are scored again."""
    docs, qs = corpus(spark)
    df, n, _ = L.survey(docs, qs)
    plan = L.prepared(L.terms(qs, df, n), most=1 << 20)
    found = lambda: [tuple(r) for r in L.retrieve_coverage(L.tokenised(docs), plan, 3, dim=1024, composed=False).orderBy("qid", "rk").collect()]
    again, scored_by = [], L.scored_by
    monkeypatch.setattr(L, "scored_by", lambda *a: again.append(a[1]) or scored_by(*a))
    want = found()
    assert len(want) == 6 and not again
    every = {r.doc_id for r in docs.collect()}
    kept = L.retrieve_coverage(L.tokenised(docs), plan, 3, docs.select("doc_id"), dim=1024, composed=False)
    assert len(every) == 25 and [tuple(r) for r in kept.orderBy("qid", "rk").collect()] == want and again.pop()
    monkeypatch.setattr(L, "LIKELY", 1)
    monkeypatch.setattr(L, "guessed", lambda index, tokens, *_: (np.linspace(-20, 20, len(tokens)), np.full(len(tokens), 1e-3)))
    assert found() == want and again == [[1, 3]]


@pytest.mark.parametrize("ranker, score, whole", [("retrieve_coverage", "cov", "scored_by"), ("retrieve_windows", "score", "windows_by")])
def test_equal_documents_are_scored_as_one(spark, monkeypatch, ranker, score, whole):
    """Copies of documents, without an id too, take one place among the held ones, and the first of them are found."""
    docs, qs = corpus(spark)
    rnd = random.Random(7)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(i, " ".join(f"word{rnd.randint(0, 59)}" for _ in range(400))) for i in range(100, 103)]
    asked = [(6000 - i, "word3 word17 word40") for i in range(40)] + [(7000 + i, "word40 word3 word17" if i % 2 else "word5") for i in range(40)]
    rows += [(i * 1000 + d, t) for i in range(1, 20) for d, t in rows] + asked + [(None, "word5"), (None, " ".join(["word5"] * 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    df, n, _ = L.survey(docs, qs)
    plan = L.prepared(L.terms(qs, df, n), most=1 << 20)
    again = []
    f = getattr(L, whole)
    monkeypatch.setattr(L, whole, lambda *a: again.append([x[0] if isinstance(x, tuple) else x for x in a[1]]) or f(*a))
    found = lambda: sorted((r.qid, r.rk, r.doc_id or -1, r.chunk, round(r[score], 6)) for r in getattr(L, ranker)(L.tokenised(docs), plan, 9, dim=1024, composed=False).collect())
    monkeypatch.setattr(L, "LIKELY", 20)
    got = found()
    assert not again and len(got) == 18
    monkeypatch.setattr(L, "LIKELY", 1)
    monkeypatch.setattr(L, "guessed", lambda index, tokens, *_: (np.full(len(tokens), 1e3), np.ones(len(tokens))))
    assert found() == got and again == [[1, 3]]  # document by document


def test_guesses_are_wrong_by_no_more_than_is_said():
    rng = np.random.default_rng(8)
    dim, plan = 1024, [(np.array([3.0, 1.5]), [[0, 1], [2]]), (np.array([2.0]), [[3, 3, 0]])]
    d = rng.integers(0, dim + 1, (400, 4)).astype(np.int32)
    for _ in range(30):
        mine, true = ((rng.normal(0, 4, 4), rng.choice([0, 0.5, 3, 9], 4)) for _ in range(2))
        guess = L.Guess(plan, mine, dim)
        got = guess.weigh @ guess.terms(guess.phi(d))
        phi = L.memberships(d, true, dim)
        for j, (w, own) in enumerate(plan):
            off = w @ np.stack([phi[p].min(0) for p in own]) - got[j]
            over, under = (x[j] for x in guess.wrong(true))
            assert -under <= off.min() and off.max() <= over


def test_six_vectors_share_a_double():
    rng = np.random.default_rng(9)
    for dim, n in ((1024, 6), (1024, 13), (1 << 17, 7)):
        bags, rows = (rng.integers(0, 256, (m, dim // 8), np.uint8) for m in (4, n))
        bags[0], rows[-1], rows[0] = 255, 255, 0
        near = L.Distances(rows)
        assert near.factor.shape == (dim, -(-n // 6)) and (near.of(bags) == (hv.unpack(bags)[:, None] ^ hv.unpack(rows)[None]).sum(2)).all()


def test_windows_read_chunks_once(spark, monkeypatch):
    """The windows held by guessed moments give the picks, of documents without an id too; if the guess is bad, all windows are scored again."""
    docs, qs = corpus(spark)
    rnd = random.Random(7)
    long = [(i, " ".join(f"word{rnd.randint(0, 59)}" for _ in range(200))) for i in (100, 101, None, None)]
    docs = docs.unionByName(spark.createDataFrame(long, "doc_id long, text string"))
    df, n, _ = L.survey(docs, qs)
    plan = L.prepared(L.terms(qs, df, n), most=1 << 20)
    found = lambda: [tuple(r) for r in L.retrieve_windows(L.tokenised(docs), plan, 9, dim=1024, composed=False).orderBy("qid", "rk").collect()]
    again, windows_by = [], L.windows_by
    monkeypatch.setattr(L, "windows_by", lambda d, own, *a: again.append([x[0] for x in own]) or windows_by(d, own, *a))
    want = found()
    assert len(want) == 18 and not again
    monkeypatch.setattr(L, "LIKELY", 1)
    monkeypatch.setattr(L, "guessed", lambda index, tokens, *_: (np.linspace(-20, 20, len(tokens)), np.full(len(tokens), 1e-3)))
    got = found()
    assert again == [[1, 3]] and [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
