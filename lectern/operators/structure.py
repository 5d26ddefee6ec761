"""Headings, sections and hierarchy. Order is carried by line numbers; every window is by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T


def _by(*order: str):
    return Window.partitionBy("doc_id").orderBy(*order)


def flagged(lines: DataFrame) -> DataFrame:
    """lines with level (0: no heading) and title."""
    return lines.withColumn("level", T.heading_level(F.col("line"))).withColumn("title", T.heading_text(F.col("line")))


def sections_of_lines(lines: DataFrame) -> DataFrame:
    """Lines with section_no: number of headings up to and with the line; 0 before the first."""
    opened = F.sum((F.col("level") > 0).cast("int")).over(_by("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return flagged(lines).withColumn("section_no", opened)


def body(lines: DataFrame) -> DataFrame:
    """Paragraphs of sections; what stands before the first heading is dropped."""
    s = sections_of_lines(lines).filter((F.col("level") == 0) & (F.col("section_no") > 0))
    return s.select("doc_id", "section_no", (F.row_number().over(Window.partitionBy("doc_id", "section_no").orderBy("line_no")) - 1).alias("para_no"), F.col("line").alias("paragraph"))


def dropped(lines: DataFrame) -> DataFrame:
    """The audit of what body() drops: lines before the first heading."""
    return sections_of_lines(lines).filter((F.col("level") == 0) & (F.col("section_no") == 0)).select("doc_id", "line_no", "line")


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, h_no (from 1), level, title, parent (h_no of the nearest earlier heading of a lower level), kept.

    kept is false from the first heading on, after the root, whose level is not below the root's: such a heading ends
    the root, and nothing after it can be reached from it."""
    h = flagged(lines).filter("level > 0").select("doc_id", "line_no", "level", "title")
    w = _by("h_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("h_no", F.row_number().over(_by("line_no"))).withColumn("root", F.first("level").over(w))
    later = F.min(F.when(F.col("h_no") > 1, F.col("level"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = [F.max(F.when(F.col("level") == k, F.col("h_no"))).over(before) for k in range(1, 5)]
    h = h.withColumn("kept", F.coalesce(later > F.col("root"), F.lit(True))).withColumn("last", F.array(*last))
    parent = F.array_max(F.slice("last", F.lit(1), F.col("level") - 1))
    return h.select("doc_id", "h_no", "level", "title", F.when(F.col("level") > 1, parent).alias("parent"), "kept")


def chapters(lines: DataFrame) -> DataFrame:
    """Kept headings in document order, numbered, with ids."""
    n = F.row_number().over(_by("h_no"))
    return headings(lines).filter("kept").withColumn("chapter_no", n).select("doc_id", "chapter_no", F.concat(F.lit("chapter"), F.col("chapter_no").cast("string")).alias("chapter_id"), "level", "title")


def adapted(lines: DataFrame) -> DataFrame:
    """Title and number of paragraphs of each document. Without headings the first line is the title and stays a
    paragraph; with headings, headings count as paragraphs too and the first heading is the title."""
    f = sections_of_lines(lines)
    first = F.min_by("line", "line_no")
    head = F.min_by(F.when(F.col("level") > 0, F.col("title")), F.when(F.col("level") > 0, F.col("line_no")))
    n = F.sum(F.when((F.col("section_no") > 0), 1).otherwise(0))
    g = f.groupBy("doc_id").agg(F.bool_or(F.col("level") > 0).alias("has_headings"), first.alias("first"), head.alias("head"), n.alias("inside"), F.count("*").alias("all"))
    return g.select("doc_id", "has_headings", F.when(F.col("has_headings"), F.col("head")).otherwise(F.col("first")).alias("title"), F.when(F.col("has_headings"), F.col("inside")).otherwise(F.col("all")).alias("n_paragraphs"))


def split_at_marks(lines: DataFrame) -> DataFrame:
    """The splitter: a new piece at each line that begins with a hash sign, of any depth. Pieces of depth two and more
    are numbered; those of depth one all carry 0, so they collide."""
    f = lines.withColumn("mark", F.col("line").startswith("#")).withColumn("deep", F.col("line").startswith("##"))
    w = _by("line_no").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("piece", F.sum(F.col("mark").cast("int")).over(w)).withColumn("number", F.sum(F.col("deep").cast("int")).over(w))
    g = f.filter("piece > 0").groupBy("doc_id", "piece").agg(F.min_by("deep", "line_no").alias("deep"), F.min_by("number", "line_no").alias("number"), F.count("*").alias("n_lines"))
    return g.select("doc_id", "piece", F.when(F.col("deep"), F.col("number")).otherwise(0).alias("file_no"), "n_lines")


def unwrapped(docs: DataFrame) -> DataFrame:
    """Runs of lines that are not blank, joined with a blank: doc_id, run, paragraph. Gaps and islands by a running count
    of blank lines."""
    d = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    d = d.withColumn("blank", ~T.not_blank(F.col("line")))
    d = d.withColumn("island", F.sum(F.col("blank").cast("int")).over(_by("line_no").rowsBetween(Window.unboundedPreceding, 0))).filter("NOT blank")
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", T.stripped(F.col("line")).alias("x")))), lambda s: s["x"]), " ")
    g = d.groupBy("doc_id", "island").agg(run.alias("paragraph"))
    return g.select("doc_id", (F.row_number().over(_by("island")) - 1).alias("run"), "paragraph")


def reading_text(lines: DataFrame) -> DataFrame:
    """What is read aloud of each document with headings: kept text in order, notations to readings, blanks dropped."""
    f = sections_of_lines(lines).filter("section_no > 0")
    said = T.to_reading(T.strip_to_reading(F.when(F.col("level") > 0, F.col("title")).otherwise(F.col("line"))))
    f = f.withColumn("said", T.stripped(said)).filter("said <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda s: s["said"]), "\n")
    return f.groupBy("doc_id").agg(joined.alias("reading"))


def index_spans(paragraphs: DataFrame) -> DataFrame:
    """paragraphs: doc_id, line_no, line. A row for each numbered span, also those within others: data_index, yomi, content,
    open_tag."""
    import pandas as pd

    from ..functions.plain import index_spans as found

    def run(batches):
        for b in batches:
            rows = [(d, n, *x) for d, n, t in zip(b["doc_id"], b["line_no"], b["line"], strict=True) for x in found(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "data_index", "yomi", "content", "open_tag"])

    return paragraphs.select("doc_id", "line_no", "line").mapInPandas(run, "doc_id bigint, line_no int, data_index int, yomi string, content string, open_tag string")


def rendered(lines: DataFrame) -> DataFrame:
    """lines with `out`: their inline notations as XHTML, nested to any depth."""
    from ..functions.plain import render

    def run(batches):
        for b in batches:
            yield b.assign(out=b["line"].map(render))

    return lines.mapInPandas(run, StructType([*lines.schema.fields, StructField("out", StringType())]))


def spoken_paragraphs(lines: DataFrame) -> DataFrame:
    """What is sent to a voice piece by piece: lines that are not blank, numbered from 0."""
    return lines.select("doc_id", (F.row_number().over(_by("line_no")) - 1).alias("para_no"), "line")
