"""Markup to plain text, and volumes of articles, in DataFrame functions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..functions.codec import tokenize

# Patterns of wiki markup and what stands in their place, in the order they are applied, in Java's syntax.
# Templates and tables nest and are taken out by folds, after the first of these; entities come after the last.
COMMENTS = (r"(?s)<!--.*?-->", "")
RULES = (
    (r"(?is)<ref[^>]*?/>", ""),
    (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"(?is)<(math|gallery|timeline|syntaxhighlight|source|score)\b[^>]*>.*?</\1\s*>", ""),
    (r"(?i)\[\[\s*(?:File|Image|Category)\s*:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", ""),
    (r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]", "$1"),
    (r"\[https?://[^\s\]]+\s+([^\]]*)\]", "$1"),
    (r"\[https?://[^\]]*\]", ""),
    (r"</?[A-Za-z][^>]{0,200}>", ""),
    (r"'{2,}", ""),
    (r"(?md)^\s*=+\s*(.*?)\s*=+\s*$", "$1"),
    (r"(?md)^[*#:;]+\s*", ""),
    (r"__[A-Z_]+__", ""),
)


def strip_templates(text: Column) -> Column:
    """Text outside {{...}}, which nest; one that isn't closed takes the rest, a closing one alone stays."""
    parts = F.regexp_extract_all(text, F.lit(r"[^{}]+|\{\{|\}\}|[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("o"))

    def step(a, t):
        depth = F.when(t == "{{", a["d"] + 1).when((t == "}}") & (a["d"] > 0), a["d"] - 1).otherwise(a["d"])
        keep = (a["d"] == 0) & (t != "{{")
        return F.struct(depth.alias("d"), F.when(keep, F.array_append(a["o"], t)).otherwise(a["o"]).alias("o"))

    return F.aggregate(parts, start, step, lambda a: F.array_join(a["o"], ""))


def strip_tables(text: Column) -> Column:
    """Lines outside {| ... |}, which nest."""
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("o"))

    def step(a, line):
        own = F.ltrim(line)
        opens, closes = F.startswith(own, F.lit("{|")), F.startswith(own, F.lit("|}"))
        depth = F.when(opens, a["d"] + 1).when((a["d"] > 0) & closes, a["d"] - 1).otherwise(a["d"])
        return F.struct(depth.alias("d"), F.when(~opens & (a["d"] == 0), F.array_append(a["o"], line)).otherwise(a["o"]).alias("o"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda a: F.array_join(a["o"], "\n"))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else html.unescape(t))


def strip_wikitext(text: Column) -> Column:
    """Plain text of wiki markup. Rules run in order, entities last, so what they spell stays."""
    t = strip_tables(strip_templates(F.regexp_replace(text, *COMMENTS)))
    for pattern, new in RULES:
        t = F.regexp_replace(t, pattern, new)
    t = F.regexp_replace(F.regexp_replace(unescape(t), r"(?md)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def strip_html(text: Column) -> Column:
    """Visible text of a page: no comments, scripts, styles or tags, common entities decoded, white space folded."""
    sub = F.regexp_replace
    t = sub(text, "(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        t = sub(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    t = sub(t, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(sub(t, "[ \\t\\n\\r\\f]+", " "))


def articles(pages: DataFrame, least: int = C.MIN_ARTICLE_CHARS) -> DataFrame:
    """(title, plain) of XML dump pages (ns, title, redirect, revision.text): main namespace, no redirects, long enough."""
    own = pages.where("ns = 0 and redirect is null").withColumn("raw", F.coalesce(F.col("revision.text").cast("string"), F.lit("")))
    own = own.where((F.upper(F.substring(F.ltrim("raw"), 1, 9)) != "#REDIRECT") & (F.trim("raw") != ""))
    return own.select("title", strip_wikitext(F.col("raw")).alias("plain")).where(F.char_length("plain") >= least)


def volumes(arts: DataFrame, order: str = "title", budget: int = C.VOLUME_TOKENS) -> DataFrame:
    """(volume, order, n_tokens): articles fill a volume in order until it has the budget's tokens, then the next.

    The fold needs all lengths in order: only (order, n_tokens) pairs go through one task, in batches, never texts.
    """
    own = arts.select(order, F.size(tokenize(F.concat(F.lit("= "), "title", F.lit(" =\n\n"), "plain", F.lit("\n\n")))).cast("long").alias("n_tokens"))
    kind = own.schema[order].dataType.simpleString()

    def fold(batches):
        volume = held = 0
        for pdf in batches:
            out = []
            for n in pdf.n_tokens:
                out.append(volume)
                held += n
                if held >= budget:
                    volume, held = volume + 1, 0
            yield pd.DataFrame({"volume": pd.Series(out, dtype="int64"), order: pdf[order], "n_tokens": pdf.n_tokens})

    return own.repartition(1).sortWithinPartitions(order).mapInPandas(fold, f"volume long, {order} {kind}, n_tokens long")


def within_bound(rows: DataFrame, order: str, n: str, bound: int, inclusive: bool) -> DataFrame:
    """Rows in order until the running sum reaches the bound: with the one that reaches it, or without those after."""
    from pyspark.sql import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("__sum", F.sum(n).over(w))
    before = F.col("__sum") - F.col(n)
    return own.where(before < bound if inclusive else F.col("__sum") <= bound).drop("__sum")
