from pyspark.sql import functions as F
from quillon import evaluate as E
from quillon.cli import main, route


def test_gold_and_scores(spark):
    docs = spark.createDataFrame([(1, "a", "x " * 40 + "The  Answer is\n42 . " + "y " * 40 + "the answer IS 42"), (2, "b", "none")], "doc_id long, name string, text string")
    qs = spark.createDataFrame([(1, ["a", "b"], ["answer is 42"])], "qid long, docs array<string>, answers array<string>")
    got = {(r.doc_id, r.chunk) for r in E.gold(qs, docs).collect()}
    text = docs.first().text
    assert got and all(d == 1 for d, _ in got) and len(got) >= 2
    ranked = spark.createDataFrame([(1, 1, min(c for _, c in got), 2), (1, 2, 0, 1)], "qid long, doc_id long, chunk long, rk int")
    right = spark.createDataFrame([(1, d, c) for d, c in got], "qid long, doc_id long, chunk long")
    kinds = spark.createDataFrame([(1, "natural")], "qid long, kind string")
    s = E.scoreboard(ranked, right, kinds).first()
    assert (s.natural_1, s.natural_3, s.all_3, s.keyword_1) == (0.0, 1.0, 1.0, None) and text
    tops = spark.createDataFrame([(1, 0.6), (2, 0.4), (3, 0.5)], "qid long, sem_top double")
    k = spark.createDataFrame([(1, "natural"), (2, "unanswerable"), (3, "keyword")], "qid long, kind string")
    a = E.abstention(tops, k, right).first()
    assert (a.true_abstain, a.unanswerable, a.false_abstain) == (1, 1, 1)
    parts = right.limit(1).withColumns({"gid": F.col("chunk"), "nbcov": F.lit(1.0), "sem": F.lit(0.5), "total_weight": F.lit(2.0), "cred_0": F.lit(0.5), "cred_25": F.lit(0.6)})
    best = E.sweep(parts.coalesce(1), right, kinds).limit(1).collect()
    assert best[0].shipped
    rec = E.recovered_by(spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "qid long, hit int"), [("inject", spark.createDataFrame([(1, 0), (2, 1)], "qid long, hit int"))])
    assert {(r.qid, r.mechanism) for r in rec.collect()} == {(1, "inject"), (2, "combination")}


def test_router():
    assert route("hello there") == ("query", {"question": "hello there"})
    assert route("/ingest {a b.txt} c.md")[1]["paths"] == ["a b.txt", "c.md"]
    assert route("/topk 11")[0] == "error" and route("/topk 3") == ("topk", {"k": 3}) and route("/df 0")[0] == "error" and route("/nope")[0] == "error"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("Beavers build dams. " * 5)
    store = f"file://{tmp_path}/s"
    assert main(["--store", store, "ingest", f"file://{tmp_path}/a.txt"], spark) == 0
    assert main(["--store", store, "query", "beavers dams", "--retriever", "cov"], spark) == 0
    assert "Beavers" in capsys.readouterr().out
    assert main(["--store", store, "--collection", "nope", "stats"], spark) == 2
    assert main(["--store", store, "remove", "a.txt"], spark) == 0


def test_gold_of_passages_without_whole_inner_words(spark, tmp_path):
    from quillon import queries as Q

    texts = [(1, "one two three fourfold fives and more " * 9 + "sixth and seventh"), (2, "one"), (3, "Alone, one two three four five"), (4, None)]
    asked = [(1, "ne two three fourfold five"), (2, "one"), (3, "th and sev"), (4, "one two three fourfold fives and mo"), (5, "absent"), (6, ", one two three four five")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.qid, r.doc_id) for r in Q.Q["gold_chunks"](spark, str(tmp_path)).collect()}
    assert got == {(i, d) for i, a in asked for d, t in texts if t and a in t} and len(got) == 7
