import hashlib

import corpus_pipeline as P
import pytest
import test_decontaminate
import test_lines
import test_simhash
from pyspark.sql import functions as F
from quillon.llm import toxicity


def test_stages_against_plain_versions(spark, sf):
    """Each stage's rows are those of a plain version over what the stage before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items, names, stages = [(r.item_id, r.text) for r in bench.collect()], docs.columns, dict(P.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}
    for name in ("toxicity", "line dedup", "near dedup", "decontamination"):
        out = stages[name](spark, docs, sf)
        assert out.columns == names, name
        out = spark.createDataFrame(out.toPandas(), docs.schema).coalesce(2)
        got = {r.doc_id: r.text for r in out.collect()}
        rows = sorted(before.items())
        if name == "toxicity":
            scores = toxicity.op9_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
            want = {r.doc_id: before[r.doc_id] for r in scores if not r.predicted}
        elif name == "line dedup":
            want = {d: digest for d, _, _, digest in test_lines.matches(rows)}
            assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in got.items()} == want
            want = got
        elif name == "near dedup":
            want = {d: before[d] for d, _, top in test_simhash.brute(rows) if d == top}
        else:
            want = {d: before[d] for d, *_, dirty in test_decontaminate.brute(rows, items) if not dirty}
        assert got == want, name
        docs, before = out, got
    packed = stages["packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == before.keys() and len(before) > 100
    full = {}
    for r in packed:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in full.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 2048


@pytest.mark.parametrize("name", ["toxicity", "line dedup", "near dedup", "decontamination"])
def test_stages_at_the_edges(spark, sf, name):
    """Nulls, empty and repeated rows, clashing column names and empty tables pass through each stage."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "a"), (1, None, "a"), (None, "", "b"), (None, "some words of no document", None), (3, "Only one line", "c"), (3, "Only one line", "c"), (4, long, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"row": F.lit(1), "n_lines": F.lit(2), "score": F.lit(0.5), "key": F.lit("k"), "part": F.lit(3)})
    stage = dict(P.STAGES)[name]
    out = stage(spark, docs, sf)
    got = out.collect()
    assert set(out.columns) == set(docs.columns) and {r.doc_id for r in got} <= {1, None, 3, 4}
    assert (4, long) in {(r.doc_id, r.text) for r in got}
    if name != "near dedup":
        assert len(got) == len(rows)
    if name == "line dedup":
        assert sorted(r.text for r in got if r.doc_id == 3) == ["", "Only one line"]
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id")).collect()}
    got = {r.doc_id for r in P.run(spark, sf).collect()}
    assert got <= docs and len(got) > 100
