"""Collections, the query ladder, markup, sources and streaming."""

import bz2
import os

import pytest
from pyspark.sql import functions as F
from quillon import contract as C
from quillon.cli import main
from quillon.functions import codec
from quillon.operators import markup as M
from quillon.operators.semantic import HashEmbedder
from quillon.plans.engine import Engine
from quillon.plans.store import Catalog, Files, collection_name
from quillon.sources import files as S
from quillon.streaming.ingest import ingest_stream, text_stream


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, text string")


def test_collections_keep_places_and_apart(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    one = c.get("One", create=True)
    with pytest.raises(C.StoreError, match="e.txt"):
        one.upsert(rows(spark, ("a.txt", "alpha beta"), ("e.txt", "")))
    assert one.snapshot is None
    one.upsert(rows(spark, ("a.txt", "alpha beta"), ("b.txt", "gamma"), ("e.txt", "")), empty="skip")
    first = one.snapshot
    assert [(r.name, r.pos) for r in one.documents().orderBy("pos").collect()] == [("a.txt", 0), ("b.txt", 1)]
    one.upsert(rows(spark, ("a.txt", "alpha changed"), ("c.txt", "delta")))
    assert [(r.name, r.text, r.pos) for r in one.documents().orderBy("pos").collect()] == [("a.txt", "alpha changed", 0), ("b.txt", "gamma", 1), ("c.txt", "delta", 2)]
    assert one.skipped(rows(spark, ("b.txt", "gamma"), ("z", "new"))).count() == 1
    two = c.get("two", create=True)
    two.upsert(rows(spark, ("q", "omega")))
    assert c.names() == ["one", "two"] and two.documents().count() == 1
    total = {r.collection: (r.docs, r.tokens) for r in c.report().collect()}
    assert total[None][0] == 4
    assert one.delete("b.txt") == 1 and one.delete(prefix="c") == 1 and one.summary()["docs"] == 1
    with pytest.raises(C.StoreError):
        one.delete("nothing")
    with pytest.raises(C.StoreError):
        c.get("missing")
    one.compact()
    assert first in one.vacuum() and one.documents().count() == 1
    for bad in ("-x", "con", "a b", ""):
        with pytest.raises(C.StoreError):
            collection_name(bad)


def test_ladder(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", dim=1024, bits=256)
    e.ingest(rows(spark, ("beavers.txt", "Beavers build dams from branches and mud in rivers. " * 6), ("tok.txt", "A tokenizer splits text into pieces with merges. " * 6), ("hdc.txt", "Hypervectors bundle and bind by majority and xor. " * 6)))
    a = e.query("What do beavers build dams from?", k=2)
    assert a.retriever == "cov" and a.hits[0]["name"] == "beavers.txt"
    assert e.query("the of and", k=1).retriever == "v12"
    e.build_semantic()
    b = e.query("beavers dams branches", "full", k=2, abstain=False)
    assert b.retriever == "full" and b.hits[0]["name"] == "beavers.txt" and "Beavers" in b.context
    e.collection.meta(sem_abstain_tau=0.999)
    assert e.query("beavers dams", "full").abstained
    only = e.query("beavers dams", "cov", doc="TOK")
    assert all(h["name"] == "tok.txt" for h in only.hits)
    with pytest.raises(C.QuillonError):
        e.query(" ")
    e.collection.meta(sem_abstain_tau=None)
    before = [(h["name"], h["chunk"], h["score"]) for h in b.hits]
    slim = e.slim_semantic()
    assert "emb" not in slim.columns and slim.inputFiles() and set(slim.inputFiles()) == set(e.build_semantic().inputFiles())
    again = e.query("beavers dams branches", "full", k=2, abstain=False)
    assert [(h["name"], h["chunk"], h["score"]) for h in again.hits] == before
    assert len([x for x in e.collection.files.names() if x.startswith("semantic-")]) == 1


def test_window_index_outlives_vacuum(spark, tmp_path):
    """After an upsert and a vacuum the next build embeds the new document only and keeps the centroid."""
    e = Engine(spark, f"file://{tmp_path}", dim=1024, bits=256)
    e.ingest(rows(spark, ("a", "Beavers build dams from branches."), ("b", "A tokenizer splits text into pieces.")))
    assert e.semantic_status()["missing"] == 2
    e.build_semantic()
    mu, old = e.collection.meta()["semantic"]["mu"], {(r.id, r.win_start): bytes(r.key) for r in e.build_semantic().collect()}
    e.ingest(rows(spark, ("c", "Hypervectors bundle and bind.")))
    e.collection.vacuum()
    assert e.semantic_status() | {"embedder": 0} == {"built": False, "docs": 2, "windows": 2, "missing": 1, "slim": False, "embedder": 0}
    now = {(r.id, r.win_start): bytes(r.key) for r in e.build_semantic().collect()}
    assert e.collection.meta()["semantic"]["mu"] == mu and len(now) == 3 and old.items() <= now.items()
    assert e.semantic_status()["built"] and e.semantic_status()["missing"] == 0


def test_pointer_is_never_missing(spark, tmp_path):
    """A pointer is replaced by one rename: the old file is not deleted before."""
    f = Files(spark, f"file://{tmp_path}/x")
    f.write("p.json", {"a": 1})
    deleted, f.remove = [], lambda name: deleted.append(name)
    f.write("p.json", {"a": 2})
    assert f.read("p.json") == {"a": 2} and not deleted and [x for x in f.names() if not x.endswith(".crc")] == ["p.json"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Beavers build dams.")
    run = lambda *a: main(["--store", f"file://{tmp_path}/store", *a], spark)
    assert run("ingest", str(tmp_path / "in" / "a.txt")) == 0
    assert run("collections", "--set-tau", "0.25") == 0 and "0.25" in capsys.readouterr().out
    assert run("collections", "--set-tau", "1.5") == 2
    assert run("collections", "--clear-tau") == 0 and str(C.ABSTAIN_TAU) in capsys.readouterr().out
    assert run("sembuild", "--status") == 0 and "'missing': 1" in capsys.readouterr().out
    assert run("info") == 0 and "default" in capsys.readouterr().out
    assert run("encode", "Beavers build") == 0 and "3 pieces" in capsys.readouterr().out
    assert run("encode", "") == 2
    assert run("decode", "a.txt") == 0 and "Beaver" in capsys.readouterr().out
    assert run("decode", "none") == 2


def test_markup(spark):
    cases = {
        "a{{b{{c}}d}}e": "ae",
        "a{{b": "a",
        "a}}b": "a}}b",
        "[[Paris|the city]] [https://x y]": "the city y",
        "&lt;b&gt;": "<b>",
        "x<!-- c\n -->y <ref name=a/>z<ref>q</ref>": "xy z",
        "== Head ==\n* one\n'''bold'''\n{| t\n|}\nend": "Head\none\nbold\nend",
        "[[File:a.png|thumb|[[x]] y]]k": "k",
        "a\n\n\n\nb  ": "a\n\nb",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(M.strip_wikitext(F.col("t"))).collect()] == list(cases.values())


def test_words(spark):
    df = spark.createDataFrame([("What is GPU... GPU v1.2?",)], "t string")
    assert df.select(codec.question_words(F.col("t"))).first()[0] == ["What", "is", "GPU", "v1.2"]
    p = lambda w, t: spark.range(1).select(codec.word_present(F.lit(w), F.lit(t))).first()[0]
    assert p("tall", "so taller") and not p("large", "enlarge") and not p("x", "") and p("a.b", "see A.B")
    assert spark.range(1).select(F.regexp_like(F.lit("two  Words"), codec.flexible_pattern(F.lit("two words")))).first()[0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff bad")
    (tmp_path / "b.MD").write_text("# b")
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {os.path.basename(r.path): r for r in S.read_texts(spark, f"file://{tmp_path}/*").collect()}
    assert got["a.txt"].text == "ok � bad" and got["a.txt"].note and got["b.MD"].text == "# b" and got["c.bin"].text is None
    page = "<mediawiki><page><title>T</title><ns>0</ns><revision><text>%s</text></revision></page><page><title>R</title><ns>0</ns><redirect title='T'/><revision><text>#REDIRECT</text></revision></page></mediawiki>" % ("word " * 80)
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(page.encode()))
    arts = M.articles(S.read_pages(spark, f"file://{tmp_path}/d.xml.bz2")).collect()
    assert [a.title for a in arts] == ["T"]
    book = spark.createDataFrame([(i, bytes([i]) * 2048) for i in range(3)], "index long, vec binary")
    path = str(tmp_path / "v.ring")
    sha = S.write_vectors(book, path, C.MAGIC_TOKENS)
    assert S.read_header(path)["payload_sha256"].hex() == sha
    assert [bytes(r.vec) for r in S.read_vectors(spark, path, C.MAGIC_TOKENS).orderBy("index").collect()] == [bytes([i]) * 2048 for i in range(3)]
    with pytest.raises(C.StoreVersionError):
        S.read_vectors(spark, path, C.MAGIC_ATOMS)
    assert S.synthetic(spark, 4000, 10).where("token_id >= 50000").count() == 5 * 16 + 16


def test_volumes(spark):
    df = spark.createDataFrame([(i, str(i), "w " * n) for i, n in enumerate((30, 30, 5, 90, 1))], "id long, title string, plain string")
    got = M.volumes(df, "id", budget=40).orderBy("id").collect()
    held = v = 0
    for r in got:
        assert r.volume == v
        held += r.n_tokens
        if held >= 40:
            v, held = v + 1, 0
    own = spark.createDataFrame([(i, 4) for i in range(5)], "id long, n long")
    assert M.within_bound(own, "id", "n", 10, True).count() == 3 and M.within_bound(own, "id", "n", 10, False).count() == 2


def test_streaming_ingest_twice_changes_nothing(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("alpha beta gamma")
    c = Catalog(spark, f"file://{tmp_path}/store").get("s", create=True)
    for _ in range(2):
        ingest_stream(text_stream(spark, f"file://{src}"), c, f"file://{tmp_path}/cp").awaitTermination()
    assert c.documents().count() == 1
