"""The query engine: rankers over one collection, and the ladder from the fused ranker down to the bag scan."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as C
from ..functions.codec import tokenize
from ..operators import lexical as L
from ..operators import rerank as R
from ..operators import semantic as S
from .store import Catalog, Collection

# Fixed value: how passages and a question are put to a text generator.
PROMPT = "Answer from these passages.\n\n{context}\n\nQuestion: {question}\nAnswer:"


@dataclass
class Answer:
    retriever: str
    hits: list[dict] = field(default_factory=list)
    context: str = ""
    abstained: bool = False
    sem_top: float | None = None
    note: str | None = None

    def prompt(self, question: str) -> str:
        return PROMPT.format(context=self.context, question=question)


class Engine:
    def __init__(self, spark: SparkSession, root: str, collection: str = "default", embedder: S.Embedder | None = None, dim: int = C.DIM, bits: int = C.SEM_BITS):
        self.spark, self.catalog = spark, Catalog(spark, root)
        self.collection: Collection = self.catalog.get(collection, create=True)
        self.embedder, self.dim, self.bits = embedder or S.HashEmbedder(), dim, bits

    def ingest(self, rows: DataFrame, fresh: bool = False) -> dict:
        self.collection.upsert(rows, fresh)
        return self.collection.summary()

    def build_semantic(self, rebuild: bool = False) -> DataFrame:
        """Window keys of the snapshot in force. Only documents without current windows are embedded; the centroid
        is set by the first build and stays until a rebuild."""
        c, last = self.collection, None if rebuild else self.collection.meta().get("semantic")
        known = self.spark.read.parquet(f"{c.files.root}/{last['at']}") if last and c.files.exists(f"{last['at']}/_SUCCESS") and last["embedder"] == self.embedder.name else None
        if known is not None and last["snapshot"] == c.snapshot:
            return known
        docs = c.documents()
        fresh = docs if known is None else docs.join(known.select("id", "sha256").distinct().withColumnRenamed("id", "doc_id"), ["doc_id", "sha256"], "left_anti")
        wins = S.windows(fresh.select("doc_id", "text"), c.k)
        made = S.embedded(wins, self.embedder).join(fresh.select("doc_id", "sha256"), "doc_id").withColumnRenamed("doc_id", "id").drop("text")
        mu = last.get("mu") if known is not None else None
        if mu is None:
            mu = S.centroid(made)
        made = S.keys(made, mu, self.bits)
        if known is not None:
            if "emb" not in known.columns:  # a slim index stays slim
                made = made.drop("emb")
            made = made.unionByName(known.join(docs.select(F.col("doc_id").alias("id"), "sha256"), ["id", "sha256"], "left_semi"))
        return self._point(made, mu)

    def _point(self, made: DataFrame, mu) -> DataFrame:
        """Writes a window index under a name of its own, points to it, and only then drops the one before."""
        c = self.collection
        before, at = (c.meta().get("semantic") or {}).get("at"), f"semantic-{c.snapshot}-{uuid.uuid4().hex[:8]}"
        made.write.parquet(f"{c.files.root}/{at}")
        c.meta(semantic={"at": at, "snapshot": c.snapshot, "mu": mu, "embedder": self.embedder.name})
        if before:
            c.files.remove(before)
        return self.spark.read.parquet(f"{c.files.root}/{at}")

    def slim_semantic(self) -> DataFrame:
        """Puts the window keys without the embeddings in the index's place; queries need only keys."""
        c, last = self.collection, self.collection.meta().get("semantic")
        if not last or last["snapshot"] != c.snapshot or not c.files.exists(f"{last['at']}/_SUCCESS"):
            raise C.SemanticError("there is no finished index to slim")
        own = self.spark.read.parquet(f"{c.files.root}/{last['at']}")
        return self._point(own.drop("emb"), last["mu"]) if "emb" in own.columns else own

    def semantic_status(self) -> dict:
        """How far the window index is: its documents and windows, those of the snapshot without windows, slim or not."""
        c, last = self.collection, self.collection.meta().get("semantic")
        docs = c.documents().where("n_chunks > 0")
        if not last or not c.files.exists(f"{last['at']}/_SUCCESS"):
            return {"built": False, "docs": 0, "windows": 0, "missing": docs.count(), "slim": False, "embedder": None}
        own = self.spark.read.parquet(f"{c.files.root}/{last['at']}")
        done = own.select(F.col("id").alias("doc_id"), "sha256").distinct()
        return {"built": last["snapshot"] == c.snapshot, "docs": done.count(), "windows": own.count(), "missing": docs.join(done, ["doc_id", "sha256"], "left_anti").count(), "slim": "emb" not in own.columns, "embedder": last["embedder"]}

    def query(self, question: str, retriever: str = "auto", k: int = 2, doc: str | None = None, df_max: float = C.DF_MAX, sem_weight: float = C.SEM_WEIGHT, abstain: bool = True) -> Answer:
        c = self.collection
        if not question or not question.strip():
            raise C.QuillonError("a question needs words")
        docs = c.documents().select(F.col("pos").alias("doc_id"), "name", F.col("doc_id").alias("id"), "text")
        keep = None
        if doc is not None:
            keep = docs.where(F.contains(F.lower("name"), F.lit(doc.lower()))).select("doc_id", "id")
            if not keep.limit(1).count():
                raise C.QuillonError(f"no document's name has {doc!r}: " + ", ".join(r.name for r in docs.select("name").orderBy("name").limit(50).collect()))
        index, df, n = c.derived(self.dim)
        q = self.spark.createDataFrame([(0, question)], "qid long, question string")
        found = L.terms(q, df, n)
        plan = L.prepared(found) if retriever != "v12" else []
        note, top, sem_top = None, None, None
        if retriever in ("auto", "full") and plan and (retriever == "full" or c.meta().get("semantic")):
            try:
                top, sem_top = self._full(question, plan, found, index, docs, keep, k, sem_weight)
                if abstain and sem_top is not None and sem_top < c.tau:
                    return Answer("full", abstained=True, sem_top=sem_top, note="no window comes near enough to the question")
                used = "full"
            except C.SemanticError as e:
                note = str(e)
        if top is None and plan:
            top, used = L.retrieve_coverage(index, plan, k, keep and keep.select("doc_id"), dim=self.dim).withColumn("score", F.col("cov")), "cov"
        if top is None:
            top, used = L.retrieve_bags(index, q, df, n, k, df_max, keep and keep.select("doc_id"), dim=self.dim).withColumn("score", -F.col("ham").cast("double")), "v12"
        text = F.array_join(F.slice(tokenize(F.col("text")), F.col("chunk").cast("int") * c.k + 1, F.lit(c.k)), "")
        hits = [r.asDict() for r in top.select("rk", "doc_id", "chunk", "score").join(docs, "doc_id").select("rk", "name", "chunk", "score", F.trim(text).alias("text")).orderBy("rk").collect()]
        return Answer(used, hits, "\n\n".join(h["text"] for h in hits), sem_top=sem_top, note=note)

    def _full(self, question, plan, found, index, docs, keep, k, sem_weight):
        keyed = self.build_semantic()
        emb = self.embedder.embed([f"search_query: {question}"])
        mu = self.collection.meta()["semantic"]["mu"]
        q = self.spark.createDataFrame([(0, emb[0].tolist())], "qid long, emb array<double>")
        key = bytes(S.keys(q, mu, self.bits).first().key)
        keyed = keyed.join(docs.select("id", "doc_id"), "id")
        if keep is not None:
            keyed = keyed.join(keep.select("doc_id"), "doc_id", "left_semi")
        wins = S.scan(keyed, [(0, key)], self.bits, ["doc_id", "win_start", "win_len"])
        sem_top = wins.agg(F.max("sem").alias("s")).first().s
        stats = L.moments(index, L.scanned(plan), self.dim, True)
        lex = L.coverage(index, plan, by="nbcov", dim=self.dim, stats=stats)
        if keep is not None:
            lex = lex.join(keep.select("doc_id"), "doc_id", "left_semi")
        cand = R.candidates(lex, wins)
        every = L.coverage(index.join(cand.select("doc_id").distinct(), "doc_id", "left_semi"), plan, per_document=1 << 30, by="nbcov", dim=self.dim, stats=stats)
        tphi = every.select("qid", "doc_id", "chunk", F.posexplode("tphi").alias("term_ix", "phi")).withColumn("term_ix", F.col("term_ix").cast("long"))
        words = self.spark.createDataFrame([(p.qid, i, w, x) for p in plan for i, (w, x) in enumerate(zip(p.words, p.weights))], "qid long, term_ix long, word string, weight double")
        k_ = self.collection.k
        own = docs.join(cand.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tokenize(F.col("text")).alias("t"))
        texts = own.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / k_).cast("int")), lambda i: F.array_join(F.slice("t", i * k_ + 1, F.lit(k_)), ""))).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))
        cred = R.exact_credit(cand, words, texts, tphi)
        total = sum(x for p in plan for x in p.weights)
        own = cred.join(every.select("qid", "doc_id", "chunk", "nbcov"), ["qid", "doc_id", "chunk"], "left").join(S.chunk_scores(wins).withColumn("chunk", F.col("chunk").cast("long")), ["qid", "doc_id", "chunk"], "left")
        own = own.join(index.select("doc_id", "gid_offset"), "doc_id").withColumn("gid", F.col("gid_offset") + F.col("chunk")).withColumn("total_weight", F.lit(total))
        return R.varied(R.fused(own, sem_weight=sem_weight), k), sem_top
