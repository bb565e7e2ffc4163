"""Tokens, chunks, their provenance and document frequencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import CHUNK, DIM
from ..functions import hypervectors as hv
from ..functions.codec import tokenize
from ..functions.scores import tree_levels


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: small Parquet files come as one partition each."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def documents_with_tokens(docs: DataFrame) -> DataFrame:
    """doc_id and tokens of each document; null texts have none."""
    return docs.select("doc_id", tokenize(F.col("text")).alias("tokens"))


def chunks(docs: DataFrame, k: int = CHUNK) -> DataFrame:
    """(doc_id, chunk, tokens): k consecutive tokens each, the last chunk of a document may be shorter. No shuffle."""
    own = documents_with_tokens(docs).where(F.size("tokens") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / k).cast("int"))
    return own.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.slice(F.col("tokens"), i * k + 1, k))).alias("chunk", "tokens"))


def token_df(docs: DataFrame, k: int = CHUNK) -> DataFrame:
    """token, df: in how many chunks it occurs. Distinct within a chunk first, then partial sums."""
    return chunks(docs, k).select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def offsets(own: DataFrame) -> DataFrame:
    """own (doc_id, n_chunks and others) with gid_offset, the number of chunks before each document in doc_id order.

    The running sum is over ranges of ids first, so that one place only adds up the ranges.
    """
    own = own.withColumn("block", F.floor(F.col("doc_id") / 4096))
    before = own.groupBy("block").agg(F.sum("n_chunks").alias("n")).select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    w = Window.partitionBy("block").orderBy("doc_id")
    out = own.withColumn("inside", F.sum("n_chunks").over(w) - F.col("n_chunks")).join(before, "block")
    return out.withColumn("gid_offset", F.col("before") + F.col("inside")).drop("block", "before", "inside")


def manifest(docs: DataFrame, k: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, n_chunks, tree_levels and gid_offset, the number of chunks before it in doc_id order."""
    own = docs.select("doc_id", F.size(tokenize(F.col("text"))).cast("long").alias("n_tokens"))
    out = offsets(own.withColumn("n_chunks", F.ceil(F.col("n_tokens") / k).cast("long")))
    return out.select("doc_id", "n_tokens", "n_chunks", tree_levels(F.col("n_chunks"), k).cast("long").alias("tree_levels"), "gid_offset")


def chunk_index(docs: DataFrame, k: int = CHUNK) -> DataFrame:
    """gid, doc_id, chunk, chunk_len of all chunks."""
    own = manifest(docs, k).where("n_chunks > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
    return own.select((F.col("gid_offset") + F.col("chunk")).alias("gid"), "doc_id", "chunk", F.least(F.lit(k).cast("long"), F.col("n_tokens") - F.col("chunk") * k).alias("chunk_len"))


def df_summary(docs: DataFrame, k: int = CHUNK, top: int = 10) -> DataFrame:
    """The commonest tokens with the share of chunks that hold them, and the totals."""
    n = chunks(docs, k).agg(F.count("*").alias("n_chunks"))
    df = token_df(docs, k)
    rank = df.orderBy(F.desc("df"), "token").limit(top)
    total = df.agg(F.count("*").alias("n_distinct"))
    return rank.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total)).select("token", "df", F.round(F.col("df") / F.col("n_chunks"), 4).alias("share"), "n_chunks", "n_distinct")


def bags(docs: DataFrame, dim: int = DIM, k: int = CHUNK, composed: bool = True, ordered: bool = False) -> DataFrame:
    """(doc_id, chunk, chunk_len, bag): each chunk's majority of its tokens' vectors (ordered: rotated by place).

    Vectors are made from the tokens in the workers, each spelling once while it is held; nothing is shuffled or broadcast.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        vectors = hv.Vectors(dim, composed)
        for b in batches:
            for own, number, size, rows in hv.bags(b.column("tokens"), k, vectors):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(own)), pa.array(number, pa.int32()), pa.array(size, pa.int32()), packed(rows)], names=["doc_id", "chunk", "chunk_len", "bag"])

    def placed(batches):
        vectors, tie = hv.Vectors(dim, composed), hv.tie_bits(dim)
        for b in batches:
            out = []
            for tokens in b.column("tokens").to_pylist():
                at = dict(zip(own := list(dict.fromkeys(tokens)), vectors.of(own)))
                bits = hv.unpack(vectors.table[[at[t] for t in tokens]].view(np.uint8))
                bits = np.stack([hv.rotate(v, p * hv.SEQ_STRIDE % dim) for p, v in enumerate(bits)])
                out.append(hv.pack(hv.settle(bits.sum(0, dtype=np.uint16), len(bits), tie)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("chunk"), b.column("tokens").value_lengths(), pa.array(out, pa.binary())], names=["doc_id", "chunk", "chunk_len", "bag"])

    shape = f"doc_id {kind}, chunk int, chunk_len int, bag binary"
    return chunks(docs, k).mapInArrow(placed, shape) if ordered else documents_with_tokens(docs).mapInArrow(work, shape)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a column of binaries."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def tree(level0: DataFrame, dim: int = DIM, k: int = CHUNK, most: int = 64) -> list[DataFrame]:
    """The levels above (node, bag): groups of k bundled until one node is left."""
    out, own = [], level0
    for _ in range(most):
        if own.limit(2).count() <= 1:
            return out
        grouped = own.groupBy(F.floor(F.col("node") / k).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "bag"))).alias("x"))
        make = F.pandas_udf(lambda s: s.map(lambda x: hv.bundle([bytes(v) for v in x], dim)), "binary")
        own = grouped.select("node", make(F.transform("x", lambda v: v["bag"])).alias("bag"))
        out.append(own)
    return out
