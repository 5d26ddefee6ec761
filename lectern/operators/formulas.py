"""Formulas in texts: placeholders for them, and what a table of distinct formulas gives in their place.

Conversion is outside: its results come as a table (tex, display, mathml, speech), joined by the formula, so each distinct
formula is converted once however often texts use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X


def _marked(text: Column, pattern: str, first: Column) -> Column:
    """Matches as placeholders, numbered from `first` on."""
    # numbers come as a list: what a lambda names is made again for each piece, so it may name nothing of the whole text;
    # the list's last number has no piece, and joining leaves it out
    pieces = F.split(text, pattern, -1)
    mark = lambda n: F.concat(F.lit(X.MATH_MARK[0]), n.cast("string"), F.lit(X.MATH_MARK[1]))
    numbers = F.concat(F.array(F.lit(None).cast("int")), F.sequence(first, first + F.size(pieces) - 1))
    return F.array_join(F.zip_with(pieces, numbers, lambda x, n: F.concat(F.coalesce(mark(n), F.lit("")), x)), "")


def substituted(texts: DataFrame) -> DataFrame:
    """doc_id, text with placeholders, formulas (array of tex, display; a placeholder's number is its place): formulas set
    apart first, then those within a line of what is left. Null text counts as empty."""
    text, tex = F.coalesce(F.col("text"), F.lit("")), lambda x: F.btrim(x, F.lit(" \t\r\f\n"))
    shown = F.regexp_extract_all(text, F.lit(X.DISPLAY_MATH), F.lit(1))
    once = texts.select("doc_id", shown.alias("shown"), _marked(text, X.DISPLAY_MATH, F.lit(0)).alias("text"))
    within = F.regexp_extract_all("text", F.lit(X.INLINE_MATH), F.lit(1))
    entry = lambda display: lambda x: F.struct(tex(x).alias("tex"), F.lit(display).alias("display"))
    both = F.concat(F.transform("shown", entry(True)), F.transform(within, entry(False)))
    return once.select("doc_id", _marked(F.col("text"), X.INLINE_MATH, F.size("shown")).alias("text"), both.alias("formulas"))


def converted(marked: DataFrame, made: DataFrame) -> DataFrame:
    """Rows of substituted, one for each doc_id, with `entries`: the mathml and speech of each number. A formula that made
    lacks is spoken as it is written and shown as an error that names it."""
    one = marked.select("doc_id", F.posexplode("formulas").alias("n", "f")).select("doc_id", "n", "f.tex", "f.display")
    fault = F.concat(F.lit(X.MATH_FAULT[0]), F.col("tex"), F.lit(X.MATH_FAULT[1]))
    one = one.join(made.select("tex", "display", "mathml", "speech"), ["tex", "display"], "left")
    one = one.select("doc_id", F.struct("n", F.coalesce("mathml", fault).alias("mathml"), F.coalesce("speech", "tex").alias("speech")).alias("entry"))
    return marked.join(one.groupBy("doc_id").agg(F.array_sort(F.collect_list("entry")).alias("entries")), "doc_id", "left")


def filled(text: Column, what: str) -> Column:
    """Placeholders to the `what` (mathml or speech) of their number in `entries`; numbers that are not there to nothing."""
    pattern = rf"{X.MATH_MARK[0]}(\d+){X.MATH_MARK[1]}"
    # both lists are made once a text; inside the lambda either would be made again for each of its pieces
    said = lambda n: F.get(F.col("entries"), n.try_cast("int"))[what]
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x, n: F.concat(x, F.coalesce(said(n), F.lit(""))))
    return F.array_join(pieces, "")
