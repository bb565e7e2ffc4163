"""The fused ranker: shortlists, exact-text credit, fusion, and variety of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import contract as C
from ..functions.codec import word_present


def candidates(lexical: DataFrame, window_scores: DataFrame, shortlist: int = C.SHORTLIST, injected: int = C.INJECTED, by: str = "nbcov") -> DataFrame:
    """(qid, doc_id, chunk): the best chunks by coverage with neighbours, and those under the best windows."""
    w = Window.partitionBy("qid")
    short = lexical.withColumn("r", F.row_number().over(w.orderBy(F.desc(by), "gid"))).where(F.col("r") <= shortlist).select("qid", "doc_id", "chunk")
    wins = window_scores.withColumn("r", F.row_number().over(w.orderBy(F.desc("sem"), "doc_id", "win_start"))).where(F.col("r") <= injected)
    inj = wins.select("qid", "doc_id", F.explode(F.sequence(F.col("win_start"), F.col("win_start") + F.col("win_len") - 1)).alias("chunk"))
    return short.unionByName(inj.withColumn("chunk", F.col("chunk").cast("long"))).distinct()


def neighbour_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, chunk, text, near): near joins the texts of the chunks before and after in the document."""
    w = Window.partitionBy("doc_id").orderBy("chunk")
    return texts.select("doc_id", "chunk", "text", F.concat_ws(" ", F.lag("text").over(w), F.lead("text").over(w)).alias("near"))


def exact_credit(cand: DataFrame, terms: DataFrame, texts: DataFrame, tphi: DataFrame | None = None, floor: float = C.PHANTOM_FLOOR) -> DataFrame:
    """(qid, doc_id, chunk, cred): the share of the terms' weight that the text bears out.

    A term in the chunk's text counts 1, in a neighbour's 0.4, else as much as its membership up to the floor.
    tphi: (qid, doc_id, chunk, term_ix, phi); without it absent terms count nothing.
    """
    ids = cand.select("doc_id", "chunk").distinct()
    near = neighbour_texts(texts.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
    own = cand.join(near, ["doc_id", "chunk"], "left").join(terms.select("qid", "term_ix", "word", "weight"), "qid")
    if tphi is not None:
        own = own.join(tphi, ["qid", "doc_id", "chunk", "term_ix"], "left")
    phi = F.coalesce(F.col("phi"), F.lit(0.0)) if tphi is not None else F.lit(0.0)
    share = (
        F.when(F.col("text").isNull(), F.least(phi, F.lit(1.0)))
        .when(word_present(F.col("word"), F.col("text")), 1.0)
        .when(word_present(F.col("word"), F.col("near")), C.NEIGHBOUR_GAMMA)
        .otherwise(F.least(phi, F.lit(floor)))
    )
    return own.groupBy("qid", "doc_id", "chunk").agg((F.sum(F.col("weight") * share) / F.sum("weight")).alias("cred"))


def neighbour_credit(tphi: DataFrame, gamma: float = C.NEIGHBOUR_GAMMA, native: float = C.NEIGHBOUR_NATIVE_MAX) -> DataFrame:
    """tphi (qid, term_ix, doc_id, chunk, phi; every chunk) with credit: the better neighbour's share where own is little."""
    w = Window.partitionBy("qid", "term_ix", "doc_id").orderBy("chunk")
    near = F.greatest(F.coalesce(F.lag("phi").over(w), F.lit(0.0)), F.coalesce(F.lead("phi").over(w), F.lit(0.0)))
    return tphi.withColumn("credit", F.greatest("phi", F.when(F.col("phi") < native, gamma * near).otherwise(0.0)))


def spread_credit(hits: DataFrame, sizes: DataFrame, gamma: float = C.NEIGHBOUR_GAMMA) -> DataFrame:
    """(qid, term_ix, doc_id, chunk, phi, credit) out of whole memberships (qid, term_ix, doc_id, chunk) alone.

    Chunks that hold no term and have no neighbour that does get no row, so the work follows the hits.
    sizes: (doc_id, n_chunks).
    """
    near = F.array(F.struct((F.col("chunk") - 1).alias("chunk"), F.lit(0.0).alias("phi"), F.lit(gamma).alias("credit")), F.struct(F.col("chunk").alias("chunk"), F.lit(1.0).alias("phi"), F.lit(1.0).alias("credit")), F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(0.0).alias("phi"), F.lit(gamma).alias("credit")))
    own = hits.select("qid", "term_ix", "doc_id", F.explode(near).alias("x")).select("qid", "term_ix", "doc_id", "x.*")
    own = own.join(sizes, "doc_id").where((F.col("chunk") >= 0) & (F.col("chunk") < F.col("n_chunks")))
    return own.groupBy("qid", "term_ix", "doc_id", "chunk").agg(F.max("phi").alias("phi"), F.max("credit").alias("credit"))


def fused(cred: DataFrame, tie: float = C.TIE_WEIGHT, sem_weight: float = C.SEM_WEIGHT) -> DataFrame:
    """cred (qid, doc_id, chunk, gid, cred, nbcov, sem, total_weight) with score; only positive ones stay."""
    score = F.col("cred") + tie * F.coalesce("nbcov", F.lit(0.0)) / F.col("total_weight") + sem_weight * F.coalesce("sem", F.lit(0.0))
    return cred.withColumn("score", score).where("score > 0")


def varied(scored: DataFrame, k: int, cap: int | None = C.DOC_CAP) -> DataFrame:
    """The k best of each question with at most `cap` of one document, filled up with the passed-over ones at the end."""
    order = [F.desc("score"), F.col("gid")]
    own = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(*order)))
    over = F.lit(False) if cap is None else F.col("r") > cap
    return own.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(over, *order))).where(F.col("rk") <= k).drop("r")
