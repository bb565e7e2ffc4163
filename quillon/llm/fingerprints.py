"""Document fingerprints by closed syncmers, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Words of a k-mer. Its inner substrings are single words: it is kept if the smallest hash lies at an edge.
K = 5
#: Longer words count as sequences of single characters, as in scripts without spaces.
LONG_WORD = 32
#: Ids of neighbouring documents that are sorted together are those that agree beyond so many bits.
BITS = 10
#: Buckets that are sorted in one place at most; more of them are put into buckets again.
MOST_BUCKETS = 50_000
#: The buckets' largest ids are broadcast up to so many (16 bytes each).
BROADCAST_ROWS = 250_000
#: The bucket of null ids, below all others.
NO_ID = -(1 << 62)


def word_hashes(text: Column) -> Column:
    """The XXH64 hashes of the text's words, in order; words are what stands between white space, or in longer
    ones the characters."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    cut = F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
    return F.transform(F.when(text.rlike(rf"\S{{{LONG_WORD + 1}}}"), cut).otherwise(words), lambda w: F.xxhash64(w))


def places(h: Column) -> Column:
    """Where the closed syncmers over the word hashes begin: that depends on a k-mer alone, not on its context."""
    edge = lambda i: F.least(F.get(h, i), F.get(h, i + 4)) <= F.least(F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3))
    return F.when(F.size(h) >= K, F.filter(F.sequence(F.lit(0), F.size(h) - K), edge)).otherwise(F.array().cast("array<int>"))


def kmers(h: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(K))))


def sketch(h: Column, at: Column, k: Column) -> Column:
    """The distinct hashes, sorted, of all pairs of neighbouring syncmers with the distance between them.

    So what two texts share is anchors in the same places to each other, wherever these stand in the texts. A
    single syncmer stands for itself; words without one make one hash of all of them; no words make none.
    """
    pair = lambda i: F.xxhash64(F.get(k, i), F.get(k, i + 1), (F.get(at, i + 1) - F.get(at, i)).cast("long"))
    own = F.when(F.size(at) > 1, F.transform(F.sequence(F.lit(0), F.size(at) - 2), pair)).when(F.size(at) == 1, k).when(F.size(h) > 0, F.array(F.xxhash64(h)))
    return F.sort_array(F.array_distinct(own.otherwise(F.array().cast("array<bigint>"))))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the sets of anchor pairs."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, at, hash) of every closed syncmer of docs, for positional matching."""
    h = docs.select("doc_id", word_hashes(F.coalesce("text", F.lit(""))).alias("h")).withColumn("p", places(F.col("h")))
    own = h.select("doc_id", F.explode(F.arrays_zip(F.col("p").alias("at"), kmers(F.col("h"), F.col("p")).alias("hash"))).alias("s"))
    return own.select("doc_id", "s.at", "s.hash")


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sketch of a text column, each step computed once for a row."""
    df = df.withColumn("__h", word_hashes(F.col(text))).withColumn("__at", places(F.col("__h")))
    df = df.withColumn("__k", kmers(F.col("__h"), F.col("__at"))).withColumn(name, sketch(F.col("__h"), F.col("__at"), F.col("__k")))
    return df.drop("__h", "__at", "__k")


def followers(buckets: DataFrame) -> DataFrame:
    """(b, following) for each bucket: the next smaller one, after the smallest the largest.

    Only so many buckets as are bounded are ever sorted in one place: more of them are sorted within buckets of
    their own, of at most 2**BITS each, whose followers are found in the same way.
    """
    if buckets.count() <= MOST_BUCKETS:
        order = Window.orderBy(F.desc("bucket"))
        all_of = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return buckets.select(F.col("bucket").alias("b"), F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(all_of)).alias("following"))
    own = buckets.withColumn("parent", F.shiftright("bucket", BITS))
    heads = stored(own.groupBy("parent").agg(F.max("bucket").alias("head")), "buckets")
    after = followers(heads.select(F.col("parent").alias("bucket")))
    after = after.join(heads, F.expr("following = parent")).select(F.col("b").alias("parent"), "head")
    lead = F.lead("bucket").over(Window.partitionBy("parent").orderBy(F.desc("bucket")))
    return own.withColumn("next", lead).join(after, "parent").select(F.col("bucket").alias("b"), F.coalesce("next", "head").alias("following"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, t, s (text and sketch) with next_t, next_s of the next row by descending doc_id, then text.

    After the last comes the first; null doc_ids come last. Ids are sorted in buckets of neighbours; which bucket
    follows a bucket is found from the buckets alone. Texts are shuffled by bucket, and the first of each bucket
    once more: sketches are made after that, and the join with the following bucket's head keeps the partitioning.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BITS), F.lit(NO_ID)).alias("bucket"))
    tops = stored(own.groupBy("bucket").agg(F.max("doc_id").alias("top")), "tops")
    after = followers(tops.select("bucket"))
    few = tops.count() <= BROADCAST_ROWS  # a row for each bucket; more of them are joined by a shuffle
    heads = own.alias("o").join((F.broadcast(tops) if few else tops).alias("p"), F.expr("o.bucket = p.bucket and o.doc_id <=> p.top")).groupBy("o.bucket").agg(F.min("o.t").alias("head_t"))
    heads = with_sketch(heads.withColumnRenamed("bucket", "head"), "head_t", "head_s")
    heads = after.join(heads, F.expr("following = head")).select("b", "head_t", "head_s")
    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "t")
    rows = with_sketch(own.repartition("bucket"), "t", "s").withColumn("n", F.lead(F.struct("t", "s")).over(w))
    rows = rows.join(heads, F.expr("bucket = b"))
    return rows.select("doc_id", "t", "s", F.coalesce("n.t", "head_t").alias("next_t"), F.coalesce("n.s", "head_s").alias("next_s"))


def op6_fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text) its fingerprint, that of its edited text, and their likenesses.

    The edited text ends in the next document's beginning instead of its own last third. Null texts count as
    empty; a fingerprint of no words is the empty string, like only to itself. Of one document the next is itself.
    Repeated rows keep a row each; other columns are not read; an empty table gives no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("t").cast("long")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.select("doc_id", "n_chars", "s", "next_s", F.concat(F.expr("left(t, cast(n_chars as int) - third)"), F.expr("left(next_t, third)")).alias("e"))
    rows = with_sketch(rows, "e", "es")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es")).alias("near_edited"),
        likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )
