"""Scoring rankers: gold chunks, hit rates, attribution, abstention and parameter sweeps."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contract as C
from .functions.codec import flexible_pattern, normalized_contains, tokenize
from .operators import rerank as R

# What a sweep tries.
SWEEP_CAPS = (None, 2)
SWEEP_FLOORS = (0.0, 0.25)
SWEEP_WEIGHTS = (0.5, 0.75, 1.0, 1.5)
SWEEP_TIES = (0.0, 0.25)


def gold(questions: DataFrame, docs: DataFrame, k: int = C.CHUNK) -> DataFrame:
    """(qid, doc_id, chunk): chunks that hold an answer, with any white space between its words, ignoring case.

    questions: (qid, docs array of names, answers array); docs: (doc_id, name, text). A question names its documents,
    so the join is on the name.
    """
    own = questions.select("qid", F.explode("docs").alias("name"), "answers").select("qid", "name", F.explode("answers").alias("answer"))
    hit = own.join(docs, "name").select("qid", "doc_id", "text", flexible_pattern(F.col("answer")).alias("p"))
    spans = hit.select("qid", "doc_id", "text", "p", F.regexp_extract_all("text", "p", F.lit(0)).alias("ms"), F.split("text", F.col("p"), -1).alias("gaps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("o"))

    def step(acc, x):
        a = acc["at"] + F.char_length(x["gap"])
        b = a + F.char_length(x["m"])
        return F.struct(b.alias("at"), F.array_append(acc["o"], F.struct(a.alias("a"), b.alias("b"))).alias("o"))

    pairs = F.zip_with(F.slice("gaps", 1, F.greatest(F.size("ms"), F.lit(0))), F.col("ms"), lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    spans = spans.where(F.size("ms") > 0).select("qid", "doc_id", "text", F.explode(F.aggregate(pairs, start, step, lambda x: x["o"])).alias("s"))
    ends = F.aggregate(tokenize(F.col("text")), F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("o")), lambda a, t: F.struct((a["n"] + F.char_length(t)).alias("n"), F.array_append(a["o"], a["n"]).alias("o")), lambda a: a["o"])
    starts = spans.select("qid", "doc_id", "s", ends.alias("starts"), tokenize(F.col("text")).alias("t"))
    at = starts.select("qid", "doc_id", "s", F.posexplode(F.arrays_zip("starts", "t")).alias("pos", "x"))
    at = at.where((F.col("x.starts") < F.col("s.b")) & (F.col("x.starts") + F.char_length("x.t") > F.col("s.a")))
    return at.select("qid", "doc_id", F.floor(F.col("pos") / k).cast("long").alias("chunk")).distinct()


def hits(ranked: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(qid, hit): whether a gold chunk is among the first k; every question with gold gets a row."""
    got = ranked.where(F.col("rk") <= k).join(right.withColumn("one", F.lit(1)), ["qid", "doc_id", "chunk"]).select("qid", "one").distinct()
    return right.select("qid").distinct().join(got, "qid", "left").select("qid", F.coalesce("one", F.lit(0)).alias("hit"))


def scoreboard(ranked: DataFrame, right: DataFrame, kinds: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """natural@1, natural@3, keyword@1, keyword@3 and all@3, with median and 90th percentile of latencies (qid, ms)."""
    own = hits(ranked, right, 1).withColumnRenamed("hit", "h1").join(hits(ranked, right, 3).withColumnRenamed("hit", "h3"), "qid").join(kinds.select("qid", "kind"), "qid")
    mean = lambda c, kind=None: F.avg(F.when(F.lit(True) if kind is None else F.col("kind") == kind, F.col(c)))
    out = own.agg(*(mean(f"h{k}", kind).alias(f"{kind}_{k}") for kind in ("natural", "keyword") for k in (1, 3)), mean("h3").alias("all_3"))
    if latency is not None:
        out = out.crossJoin(latency.agg(F.percentile("ms", 0.5).alias("median_ms"), F.percentile("ms", 0.9).alias("p90_ms")))
    return out


def needle_rank(scored: DataFrame, needle: DataFrame, score: str) -> DataFrame:
    """(qid, rank): one more than the number of chunks that score better than the needle (qid, doc_id, chunk)."""
    own = scored.join(needle.select("qid", "doc_id", "chunk"), ["qid", "doc_id", "chunk"]).select("qid", F.col(score).alias("own"))
    return scored.join(own, "qid").groupBy("qid").agg((F.sum((F.col(score) > F.col("own")).cast("long")) + 1).alias("rank"))


def abstention(tops: DataFrame, kinds: DataFrame, right: DataFrame, tau: float = C.ABSTAIN_TAU) -> DataFrame:
    """True and false abstentions, and the margins on either side of the threshold. tops: (qid, sem_top)."""
    own = tops.join(kinds, "qid").withColumn("abstain", F.col("sem_top") < tau)
    answerable = F.col("kind") != "unanswerable"
    return own.agg(
        F.sum((~answerable & F.col("abstain")).cast("long")).alias("true_abstain"),
        F.sum((~answerable).cast("long")).alias("unanswerable"),
        F.sum((answerable & F.col("abstain")).cast("long")).alias("false_abstain"),
        (F.min(F.when(answerable, F.col("sem_top"))) - tau).alias("margin_above"),
        (tau - F.max(F.when(~answerable & F.col("abstain"), F.col("sem_top")))).alias("margin_below"),
    )


def sweep(parts: DataFrame, right: DataFrame, kinds: DataFrame, k: int = 3) -> DataFrame:
    """Hit rates of all 32 settings from one set of parts (qid, doc_id, chunk, gid, nbcov, sem, total_weight, and cred
    for each floor as cred_0 and cred_25); best keyword@k, then natural@k, then the shipped setting first."""
    out = None
    for i, (cap, floor, weight, tie) in enumerate(product(SWEEP_CAPS, SWEEP_FLOORS, SWEEP_WEIGHTS, SWEEP_TIES)):
        own = parts.withColumn("cred", F.col("cred_25" if floor else "cred_0"))
        ranked = R.varied(R.fused(own, tie, weight), k, cap)
        h = hits(ranked, right, k).join(kinds.select("qid", "kind"), "qid")
        row = h.agg(F.avg(F.when(F.col("kind") == "keyword", F.col("hit"))).alias("keyword"), F.avg(F.when(F.col("kind") == "natural", F.col("hit"))).alias("natural"))
        shipped = (cap, floor, weight, tie) == (C.DOC_CAP, C.PHANTOM_FLOOR, C.SEM_WEIGHT, C.TIE_WEIGHT)
        row = row.select(F.lit(i).alias("setting"), F.lit(cap).cast("int").alias("cap"), F.lit(floor).alias("floor"), F.lit(weight).alias("sem_weight"), F.lit(tie).alias("tie"), "keyword", "natural", F.lit(shipped).alias("shipped"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc_nulls_last("keyword"), F.desc_nulls_last("natural"), F.desc("shipped"), "setting")


def autopsy(missed: DataFrame) -> DataFrame:
    """Why questions missed, by the first that applies, with counts. missed: (qid, n_terms, top_text, question,
    gold_sem_rank, gold_rank)."""
    why = (
        F.when(F.col("n_terms") == 0, "all words are stop words")
        .when(normalized_contains(F.col("top_text"), F.col("question")), "a passage that quotes the question")
        .when(F.col("gold_sem_rank") > C.INJECTED, "semantically far")
        .when(F.col("gold_rank").isNotNull(), "ranked below")
        .otherwise("lexical competitor")
    )
    return missed.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def recovered_by(base: DataFrame, ablations: list[tuple[str, DataFrame]]) -> DataFrame:
    """(qid, mechanism): of questions that base (qid, hit) hits, the first ablation (name, hits) that loses them."""
    own = base.where("hit = 1").select("qid")
    for i, (_, h) in enumerate(ablations):
        own = own.join(h.select("qid", F.col("hit").alias(f"h{i}")), "qid", "left")
    why = F.coalesce(*(F.when(F.col(f"h{i}") == 0, F.lit(name)) for i, (name, _) in enumerate(ablations)), F.lit("combination"))
    return own.select("qid", why.alias("mechanism"))
