import random
import zlib

import pytest
from quillon.llm import toxicity as T


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in T.op9_toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    pos = [p for t, p in held if t == 1]
    neg = [p for t, p in held if t == 0]
    assert sum(pos) / len(pos) > 0.9 and sum(neg) / len(neg) < 0.02


def test_held_out_accuracy_in_each_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = T.op9_toxicity(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    rate = lambda t, lang=None: (x := [r.predicted for r in got if r.toxic == t and lang in (None, r.lang)]) and sum(x) / len(x)
    assert rate(1) > 0.9 and rate(0) < 0.05
    assert all(rate(1, lang) > 0.8 and rate(0, lang) < 0.05 for lang in ("de", "en", "es", "fr"))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "word " * 50000, "c"), (2, "w", "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, None, 0)], "doc_id long, toxic int, quality int")
    rows = T.op9_toxicity(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and not any(r.predicted for r in rows)
    assert T.without_toxic(docs, labels).count() == 4
    assert T.op9_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_dictionaries_part_windows():
    toxic = [b"some words here %d and a grumbling slur" % i for i in range(40)]
    plain = [b"some words here %d and a friendly note" % i for i in range(200)]
    m = T.fit(toxic, plain)
    x = T.features(m.compressors(), [b"what a slur this is", b"what a note this is"])
    assert x[0, 0] > 0 and x[1, 0] <= 0


def test_whole_texts_are_learnt_from(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    plain = lambda i: " ".join(f"w{x}x" for x in random.Random(i).choices(range(9973), k=3600))
    end = " and such a grumbling slur" * 40
    docs = spark.createDataFrame([(i, plain(i) + (end if i % 4 == 0 else " and such a friendly note" * 40)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, toxic int")
    m = T.learn(docs, labels)
    assert b" slur " in m.contents[1][0] and b" note " in m.contents[1][1]
    took = {}
    fit, T.fit = T.fit, lambda *x: took.update(enumerate(x))
    try:
        T.learn(docs, labels, size={1: 1, 0: 60000})
    finally:
        T.fit = fit
    assert [len(took[0]), len(took[1])] == [1, 3] and all(len(t) > 16384 for x in took.values() for t in x)
    x = T.features(m.compressors(), [b"such a grumbling slur " * n for n in (600, 6000)])
    assert abs(x[0, 0] - x[1, 0]) < 0.01
