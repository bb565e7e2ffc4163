"""Named, isolated collections of documents in versioned snapshots."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import contract as C
from ..functions.codec import tokenize
from ..operators.chunks import token_df
from ..operators.lexical import index

VERSION = 1
#: Names that Windows keeps for devices.
DEVICES = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}
DOCS = "doc_id string, name string, source string, sha256 string, text string, n_tokens long, n_chunks long, pos long, ingested timestamp"


def collection_name(name: str) -> str:
    own = name.strip().casefold()
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,31}", own) or own in DEVICES:
        raise C.StoreError(f"{name!r} can't be a collection's name")
    return own


class Files:
    """A folder on whatever file system Spark sees it on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, jvm = spark, root.rstrip("/"), spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.root}/{name}"))

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        try:
            return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").first()[0])
        except (ValueError, TypeError):
            return None

    def write(self, name: str, value: dict) -> None:
        """Whole or not at all: a new file takes the place of the old one by one rename that overwrites."""
        tmp = self.path(f"{self.root}/.{name.replace('/', '-')}.{uuid.uuid4().hex}")
        to = self.path(f"{self.root}/{name}")
        self.fs.mkdirs(to.getParent())
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        full = self.fs.makeQualified
        hadoop.FileContext.getFileContext(full(to).toUri(), self.spark._jsc.hadoopConfiguration()).rename(full(tmp), full(to), how)

    def remove(self, name: str) -> bool:
        return self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def names(self, name: str = "") -> list[str]:
        at = self.path(f"{self.root}/{name}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []


class Collection:
    """One collection: a pointer names the snapshot in force; snapshots are written whole, then pointed to."""

    def __init__(self, spark: SparkSession, root: str, name: str, k: int = C.CHUNK):
        self.spark, self.name, self.k = spark, collection_name(name), k
        self.files = Files(spark, f"{root.rstrip('/')}/{self.name}")

    @property
    def state(self) -> dict | None:
        got = self.files.read("current.json")
        if got and got["version"] != VERSION:
            raise C.StoreVersionError(f"{self.name}: version {got['version']}, not {VERSION}")
        return got

    @property
    def snapshot(self) -> str | None:
        return self.state["snapshot"] if self.state else None

    def documents(self) -> DataFrame:
        if not self.state:
            return self.spark.createDataFrame([], DOCS)
        return self.spark.read.schema(DOCS).parquet(f"{self.files.root}/{self.snapshot}")

    def _put(self, rows: DataFrame) -> str:
        snapshot = f"docs-{uuid.uuid4().hex}"
        rows.select(*(x.split()[0] for x in DOCS.split(", "))).write.option("compression", "zstd").parquet(f"{self.files.root}/{snapshot}")
        self.files.write("current.json", {"version": VERSION, "k": self.k, "snapshot": snapshot})
        return snapshot

    def prepared(self, rows: DataFrame, empty: str = "error") -> DataFrame:
        """rows (source, text[, name]) as documents; of one source the text with the smallest hash stands.

        Texts without tokens are an error that names some of their sources; empty="skip" passes over them.
        """
        name = F.col("name") if "name" in rows.columns else F.element_at(F.split("source", r"[\\/]"), -1)
        own = rows.select(F.substring(F.sha2(F.lower(F.regexp_replace("source", r"[\\/]+", "/")), 256), 1, 16).alias("doc_id"), name.alias("name"), "source", F.sha2("text", 256).alias("sha256"), "text")
        own = own.withColumn("n_tokens", F.size(tokenize(F.col("text"))).cast("long"))
        if empty == "error" and (bad := [r.source for r in own.where("n_tokens = 0").select("source").limit(5).collect()]):
            raise C.StoreError(f"no tokens in {', '.join(map(str, bad))}")
        own = own.where("n_tokens > 0").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("sha256"))).where("r = 1").drop("r")
        return own.withColumn("n_chunks", F.ceil(F.col("n_tokens") / self.k).cast("long")).withColumn("ingested", F.current_timestamp())

    def upsert(self, rows: DataFrame, fresh: bool = False, empty: str = "error") -> str:
        """Adds new documents at the end and replaces known ones where they stand; equal ones are passed over.

        New documents' places are found from their sources alone; texts stay out of that sort.
        """
        if (s := self.state) and s["k"] != self.k:
            raise C.StoreError(f"{self.name} has chunks of {s['k']}, not {self.k}")
        old, new = (self.documents().limit(0) if fresh else self.documents()), self.prepared(rows, empty)
        new = new.join(old.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")
        place = old.select("doc_id", F.col("pos").alias("old_pos"))
        last = old.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("last"))
        added = new.select("doc_id", "source").distinct().join(place, "doc_id", "left_anti")
        added = added.withColumn("added", F.row_number().over(Window.orderBy("source", "doc_id")) - 1).drop("source")
        new = new.join(place, "doc_id", "left").join(added, "doc_id", "left").crossJoin(F.broadcast(last))
        new = new.withColumn("pos", F.coalesce("old_pos", F.col("last") + F.col("added"))).drop("old_pos", "last", "added")
        kept = old.join(new.select("doc_id"), "doc_id", "left_anti")
        return self._put(kept.unionByName(new))

    def skipped(self, rows: DataFrame) -> DataFrame:
        """rows whose source is there with the same content."""
        own = self.prepared(rows, "skip")
        return own.join(self.documents().select("doc_id", "sha256"), ["doc_id", "sha256"], "left_semi")

    def delete(self, ident: str | None = None, prefix: str | None = None) -> int:
        """Removes a document by id, name or source, or all under a source prefix; says how many went."""
        old = self.documents()
        if prefix is not None:
            gone = old.where(F.startswith("source", F.lit(prefix)))
        else:
            for column in ("doc_id", "name", "source"):
                gone = old.where(F.col(column) == ident)
                if (n := gone.limit(2).count()) == 1:
                    break
                if n > 1:
                    raise C.StoreError(f"{ident!r} names more than one document")
            else:
                raise C.StoreError(f"{ident!r} is not in {self.name}")
        n = gone.count()
        if n:
            self._put(old.join(gone.select("doc_id"), "doc_id", "left_anti"))
        return n

    def truncate(self) -> None:
        self._put(self.documents().limit(0))

    def compact(self, codec: str = "gzip") -> str:
        """Writes the snapshot anew, proves that nothing changed, and only then points to it."""
        old = self.documents()
        snapshot = f"docs-{uuid.uuid4().hex}"
        old.repartition(max(1, old.rdd.getNumPartitions())).write.option("compression", codec).parquet(f"{self.files.root}/{snapshot}")
        new = self.spark.read.schema(DOCS).parquet(f"{self.files.root}/{snapshot}")
        if old.exceptAll(new).limit(1).count() or new.exceptAll(old).limit(1).count():
            self.files.remove(snapshot)
            raise C.StoreError("the rewritten snapshot differs; the old one stays in force")
        self.files.write("current.json", {"version": VERSION, "k": self.k, "snapshot": snapshot})
        return snapshot

    def vacuum(self) -> list[str]:
        """Drops snapshots and derived tables that neither the pointer nor the newest window index is of: the next
        build of the latter takes its embeddings and its centroid over."""
        semantic = (self.meta().get("semantic") or {}).get("at")
        keep = {"current.json", "meta.json", self.snapshot, f"derived-{self.snapshot}", f"semantic-{self.snapshot}", semantic}
        return [x for x in self.files.names() if x not in keep and self.files.remove(x)]

    def meta(self, **changes) -> dict:
        own = self.files.read("meta.json") or {"name": self.name}
        if changes:
            own |= changes
            self.files.write("meta.json", own)
        return own

    @property
    def tau(self) -> float:
        t = self.meta().get("sem_abstain_tau")
        return t if isinstance(t, float) and 0 < t < 1 else C.ABSTAIN_TAU

    def derived(self, dim: int = C.DIM, composed: bool = True) -> tuple[DataFrame, DataFrame, int]:
        """(index, df, n_chunks) of the snapshot in force, made once for each snapshot."""
        at = f"derived-{self.snapshot}/{dim}-{composed}"
        docs = self.documents().select(F.col("pos").alias("doc_id"), "text")
        if not self.files.exists(f"{at}/df/_SUCCESS"):
            index(docs, dim, self.k, composed).write.mode("overwrite").parquet(f"{self.files.root}/{at}/index")
            token_df(docs, self.k).write.mode("overwrite").parquet(f"{self.files.root}/{at}/df")
        read = lambda x: self.spark.read.parquet(f"{self.files.root}/{at}/{x}")
        n = self.documents().agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n")).first().n
        return read("index"), read("df"), int(n)

    def summary(self) -> dict:
        d = self.documents().agg(F.count("*").alias("docs"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
        return {"name": self.name, **d.asDict(), "snapshot": self.snapshot}


class Catalog:
    """The collections under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def names(self) -> list[str]:
        return [x for x in self.files.names() if self.files.exists(f"{x}/current.json")]

    def get(self, name: str = "default", create: bool = False) -> Collection:
        own = Collection(self.spark, self.root, name)
        if not create and own.name != "default" and own.name not in self.names():
            raise C.StoreError(f"no collection {name!r}; there are {', '.join(self.names()) or 'none'}")
        return own

    def report(self) -> DataFrame:
        """Documents, chunks and tokens of each collection and in all."""
        rows = [Collection(self.spark, self.root, n).documents().select(F.lit(n).alias("collection"), "n_chunks", "n_tokens") for n in self.names()]
        own = rows[0] if rows else self.spark.createDataFrame([], "collection string, n_chunks long, n_tokens long")
        for r in rows[1:]:
            own = own.unionByName(r)
        return own.rollup("collection").agg(F.count("*").alias("docs"), F.sum("n_chunks").alias("chunks"), F.sum("n_tokens").alias("tokens"))
