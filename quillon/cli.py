"""python -m quillon.cli: ingest, remove, stats, build, query and collections over a store; and the line router."""

from __future__ import annotations

import argparse
import hashlib
import re
import sys

from . import contract as C


def route(line: str) -> tuple[str, dict]:
    """What a line asks for: (command, arguments). Plain text is a question; wrong values are ("error", ...)."""
    own = line.strip()
    if not own:
        return "none", {}
    if not own.startswith("/"):
        return "query", {"question": own}
    name, _, rest = own[1:].partition(" ")
    rest = rest.strip()
    if name in ("stats", "collections", "rebuild", "help"):
        return name, {}
    if name == "ingest":
        paths = [a or b or c for a, b, c in re.findall(r"\{([^}]*)\}|\"([^\"]*)\"|(\S+)", rest)]
        return ("ingest", {"paths": paths}) if paths else ("error", {"message": "which files?"})
    if name in ("remove", "collection"):
        return (name, {"name": rest}) if rest else ("error", {"message": f"/{name} needs a name"})
    if name == "sembuild":
        return "sembuild", {"mode": rest or "build"}
    if name == "topk":
        return ("topk", {"k": int(rest)}) if rest.isdigit() and 1 <= int(rest) <= 10 else ("error", {"message": "/topk takes 1 to 10"})
    if name == "df":
        try:
            x = float(rest)
        except ValueError:
            x = 0.0
        return ("df", {"df_max": x}) if 0 < x <= 1 else ("error", {"message": "/df takes a share above 0, at most 1"})
    return "error", {"message": f"unknown command /{name}"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the collections")
    p.add_argument("--collection", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("paths", nargs="+")
    a.add_argument("--add", action="store_true", help="keep what is there")
    sub.add_parser("remove").add_argument("ident")
    sub.add_parser("stats")
    a = sub.add_parser("collections")
    a.add_argument("--set-tau", type=float, help="abstention threshold of --collection, between 0 and 1")
    a.add_argument("--clear-tau", action="store_true")
    sub.add_parser("info")
    sub.add_parser("encode", help="a text's pieces and the digest of its bag").add_argument("text")
    sub.add_parser("decode", help="the chunks of a stored document, as pieces").add_argument("name")
    a = sub.add_parser("sembuild")
    a.add_argument("--rebuild", action="store_true")
    a.add_argument("--slim", action="store_true")
    a.add_argument("--status", action="store_true")
    a = sub.add_parser("query")
    a.add_argument("question")
    a.add_argument("--retriever", choices=("auto", "full", "cov", "v12"), default="auto")
    a.add_argument("--topk", type=int, default=2)
    a.add_argument("--doc")
    a.add_argument("--df-max", type=float, default=C.DF_MAX)
    a.add_argument("--sem-weight", type=float, default=C.SEM_WEIGHT)
    a.add_argument("--no-abstain", action="store_true")
    a.add_argument("--sem-top", action="store_true", help="print the best window's score")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions.codec import tokenize
    from .functions.hypervectors import bundle, compose
    from .plans.engine import Engine
    from .plans.store import VERSION, Catalog
    from .sources.files import read_texts

    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    try:
        if args.command == "info":
            print({"version": VERSION, "dim": C.DIM, "chunk": C.CHUNK, "semantic_bits": C.SEM_BITS, "collections": Catalog(spark, args.store).names()})
            return 0
        if args.command == "encode":
            own = spark.createDataFrame([(args.text,)], "text string").select(tokenize(F.col("text")).alias("t")).first().t
            if not own:
                raise C.QuillonError("a text without pieces has no vector")
            bag = bundle([compose(t.encode()) for t in own], C.DIM)
            print(own)
            print(len(own), "pieces", hashlib.sha256(bag).hexdigest())
            return 0
        if args.command == "collections" and (args.set_tau is not None or args.clear_tau):
            if args.set_tau is not None and not 0 < args.set_tau < 1:
                raise C.QuillonError("a threshold lies between 0 and 1")
            own = Catalog(spark, args.store).get(args.collection)
            own.meta(sem_abstain_tau=None if args.clear_tau else args.set_tau)
            print(own.name, own.tau)
            return 0
        if args.command == "collections":
            for r in Catalog(spark, args.store).report().collect():
                print(r.collection or "TOTAL", r.docs, r.chunks or 0, r.tokens or 0)
            return 0
        if args.command == "ingest":
            e = Engine(spark, args.store, args.collection)
            rows = read_texts(spark, args.paths[0])
            for p in args.paths[1:]:
                rows = rows.unionByName(read_texts(spark, p))
            for r in rows.where(F.col("note").isNotNull()).select("path", "note").collect():
                print(f"{r.path}: {r.note}", file=sys.stderr)
            good = rows.where("text is not null").select(F.col("path").alias("source"), "text")
            if good.isEmpty():
                return 1
            print(e.ingest(good, fresh=not args.add))
            return 0
        Catalog(spark, args.store).get(args.collection)
        e = Engine(spark, args.store, args.collection)
        if args.command == "remove":
            print(e.collection.delete(args.ident))
        elif args.command == "decode":
            rows = e.collection.documents().where(F.col("name") == args.name).select("pos", F.posexplode(tokenize(F.col("text"))).alias("at", "piece"))
            rows = rows.groupBy("pos", F.floor(F.col("at") / e.collection.k).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
            rows = rows.orderBy("pos", "chunk").toLocalIterator()
            if not sum(print(f"#{r.chunk} {[x.piece for x in r.p]}") is None for r in rows):
                raise C.QuillonError(f"no document is named {args.name!r}")
        elif args.command == "stats":
            print(e.collection.summary())
        elif args.command == "sembuild" and args.status:
            print(e.semantic_status())
        elif args.command == "sembuild":
            print((e.slim_semantic() if args.slim else e.build_semantic(args.rebuild)).count(), "windows")
        else:
            a = e.query(args.question, args.retriever, args.topk, args.doc, args.df_max, args.sem_weight, not args.no_abstain)
            if a.abstained:
                print(a.note)
                return 3
            if args.sem_top and a.sem_top is not None:
                print(f"sem_top {a.sem_top:.3f}")
            for h in a.hits:
                print(f"[{h['rk']}] {h['name']}#{h['chunk']} {h['score']:.3f}: {h['text']}")
        return 0
    except C.QuillonError as x:
        print(x, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
