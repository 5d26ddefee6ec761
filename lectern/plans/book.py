"""Books put together: spans with times to chapters, overlays and the clips that tie both. Ids run on over a book's audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as H
from ..operators import timing as A
from ..sources import derived as D
from . import package as K


def text_spans(lines: DataFrame) -> DataFrame:
    """Spans of a book of marked-up lines on clean input, where the timed words are the words of the text: doc_id, section_no,
    line_no, heading, seg_no, seg, span_id, begin_ms, end_ms; segments without a word have neither id nor times."""
    s = H.sections_of_lines(lines).filter("section_no > 0")
    said = s.select("doc_id", "section_no", "line_no", (F.col("level") > 0).alias("heading"), F.when(F.col("level") > 0, F.col("title")).otherwise(F.col("line")).alias("line"))
    seg = D.segments(said)
    clips = A.group_clips(D.intervals(D.words(seg))).select("doc_id", "line_no", "seg_no", "span_id", "begin_ms", "end_ms")
    placed = said.select("doc_id", "section_no", "line_no", "heading")
    return seg.join(clips, ["doc_id", "line_no", "seg_no"], "left").join(placed, ["doc_id", "line_no"])


def _ordered(c: str, what) -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, what.alias("x")))), lambda s: s["x"]), "")


def assemble(spans: DataFrame, chapters: DataFrame, audio: str = "audio.mp3") -> DataFrame:
    """spans as of text_spans, or with `html` where a span is XHTML already; chapters: doc_id, chapter_no, chapter_id, level,
    title. A row for each chapter: its XHTML, whose spans carry the ids that the overlay's pars refer to, the overlay, the
    number of pars and the time from the first to the last. Chapters without any span have an empty body and overlay."""
    el = T.element_id(F.lit("s"), F.col("span_id"))
    shown = F.col("html") if "html" in spans.columns else T.escape(F.col("seg"))
    s = spans.withColumnRenamed("section_no", "chapter_no").join(chapters.select("doc_id", "chapter_no", "chapter_id", "level"), ["doc_id", "chapter_no"])
    s = s.withColumn("shown", F.when(F.col("span_id").isNotNull(), K.span(el, shown)).otherwise(shown))
    s = s.withColumn("par", F.when(F.col("span_id").isNotNull(), K.smil_par(el, F.concat("chapter_id", F.lit(".xhtml")), audio, F.col("begin_ms"), F.col("end_ms"))))
    para = s.groupBy("doc_id", "chapter_no", "line_no", "heading", "level").agg(
        _ordered("seg_no", F.col("shown")).alias("inner"), _ordered("seg_no", F.coalesce("par", F.lit(""))).alias("pars"),
        F.min("begin_ms").alias("b"), F.max("end_ms").alias("e"), F.count("span_id").alias("n"))
    tag = F.when(F.col("heading"), F.concat(F.lit("h"), T.clamp_level(F.col("level")).cast("string"))).otherwise("p")
    body = F.concat(F.lit("<"), tag, F.lit(">"), F.col("inner"), F.lit("</"), tag, F.lit(">"))
    whole = para.groupBy("doc_id", "chapter_no").agg(
        _ordered("line_no", body).alias("body"), _ordered("line_no", F.col("pars")).alias("pars"), F.sum("n").alias("n_pars"), (F.max("e") - F.min("b")).alias("duration_ms"))
    c = chapters.join(whole, ["doc_id", "chapter_no"], "left")
    none = lambda x: F.coalesce(x, F.lit(""))
    return c.select(
        "doc_id", "chapter_no", "chapter_id", K.chapter_document(F.col("title"), none("body"), F.lit("en")).alias("xhtml"), K.smil_document(none("pars")).alias("smil"),
        F.coalesce("n_pars", F.lit(0)).alias("n_pars"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))


def numbered(spans: DataFrame) -> DataFrame:
    """span_id for spans with times, in the order of the book."""
    timed = F.col("begin_ms").isNotNull()
    n = F.sum(timed.cast("int")).over(Window.partitionBy("doc_id").orderBy("section_no", "line_no", "seg_no").rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("span_id", F.when(timed, n))
