"""Rows and strings of an accessible talking-book package: manifest, spine, overlays, navigation, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ordered_text(rows: DataFrame, by: str, order: str, text: Column, name: str, sep: str = "") -> DataFrame:
    """The texts of a group in order, as one string."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("x")))), lambda s: s["x"]), sep).alias(name))


def smil_par(el_id: Column, xhtml: Column, audio: str, begin: Column, end: Column) -> Column:
    return F.concat(
        F.lit('<par id="par_'), el_id, F.lit('"><text src="'), xhtml, F.lit("#"), el_id, F.lit(f'"/><audio src="{audio}" clipBegin="'), T.seconds(begin),
        F.lit('s" clipEnd="'), T.seconds(end), F.lit('s"/></par>'),
    )


def span(el_id: Column, text: Column) -> Column:
    """Text as an element; a formula set apart makes it a block."""
    style = F.when(text.contains('display="block"'), ' style="display: block;"').otherwise("")
    return F.concat(F.lit('<span id="'), el_id, F.lit('"'), style, F.lit(">"), text, F.lit("</span>"))


def smil_document(pars: Column) -> Column:
    return F.concat(F.lit('<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body>'), pars, F.lit("</body></smil>"))


def smil(clips: DataFrame, by: str = "doc_id") -> DataFrame:
    """clips: by, span_id, begin_ms, end_ms."""
    el = T.element_id(F.lit("s"), F.col("span_id"))
    body = ordered_text(clips, by, "span_id", smil_par(el, F.lit("text.xhtml"), "audio.mp3", F.col("begin_ms"), F.col("end_ms")), "pars")
    return body.select(by, smil_document(F.col("pars")).alias("smil"))


def chapter_document(title: Column, body: Column, lang: Column) -> Column:
    lang = F.coalesce(lang, F.lit("ja"))
    return F.concat(
        F.lit('<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="'), lang, F.lit('" lang="'), lang, F.lit('"><head><title>'), T.escape(title), F.lit("</title></head><body>"), body, F.lit("</body></html>"),
    )


def chapter_xhtml(title: Column, level: Column, body: Column, lang: Column) -> Column:
    h = F.concat(F.lit("h"), T.clamp_level(level).cast("string"))
    return chapter_document(title, F.concat(F.lit("<"), h, F.lit(">"), T.escape(title), F.lit("</"), h, F.lit(">"), body), lang)


def nav_flat(chapters: DataFrame) -> DataFrame:
    item = F.concat(F.lit('<li><a href="'), F.col("chapter_id"), F.lit('.xhtml">'), T.escape(T.strip_for_display(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("chapter_id")))), F.lit("</a></li>"))
    out = ordered_text(chapters, "doc_id", "chapter_no", item, "items")
    return out.select("doc_id", F.concat(F.lit("<ol>"), F.col("items"), F.lit("</ol>")).alias("nav"))


def nav_nested(chapters: DataFrame) -> DataFrame:
    """Nested lists. A chapter opens a list if the next one lies deeper; after a chapter, as many lists close as levels
    on the stack are not below the next one's. The stack is folded over the chapters of one document."""
    nxt = F.lead("level").over(Window.partitionBy("doc_id").orderBy("chapter_no"))
    rows = chapters.withColumn("next", F.coalesce(nxt, F.lit(0)))
    entry = F.struct("chapter_no", "level", "next", F.concat(F.lit('<a href="'), F.col("chapter_id"), F.lit('.xhtml">'), T.escape(F.col("title")), F.lit("</a>")).alias("link"))
    zero = F.struct(F.lit("").alias("out"), F.expr("cast(array() as array<int>)").alias("open"))

    def step(a: Column, c: Column) -> Column:
        deeper = c["next"] > c["level"]
        left = F.filter(a["open"], lambda x: x < c["next"])
        closing = F.repeat(F.lit("</li></ol>"), F.size(a["open"]) - F.size(left))
        tail = F.when(deeper, F.lit("<ol>")).otherwise(F.concat(closing, F.lit("</li>")))
        # items below an ancestor that stays open end their own item only
        return F.struct(F.concat(a["out"], F.lit("<li>"), c["link"], tail).alias("out"), F.when(deeper, F.concat(a["open"], F.array(c["level"]))).otherwise(left).alias("open"))

    folded = F.aggregate(F.array_sort(F.collect_list(entry)), zero, step, lambda a: a["out"])
    return rows.groupBy("doc_id").agg(F.concat(F.lit("<ol>"), folded, F.lit("</ol>")).alias("nav"))


def manifest(chapters: DataFrame, assets: DataFrame) -> DataFrame:
    """One row for each item of the package, with its place: fixed items, then chapters, overlays and images."""
    item = lambda i, href, kind, extra="": F.concat(F.lit('<item id="'), i, F.lit('" href="'), href, F.lit('" media-type="'), kind, F.lit(f'"{extra}/>'))
    ch = chapters.select("doc_id", F.lit(1).alias("kind"), F.col("chapter_no").cast("int").alias("n"), item(F.col("chapter_id"), F.concat("chapter_id", F.lit(".xhtml")), F.lit("application/xhtml+xml")).alias("item"))
    sm = chapters.select("doc_id", F.lit(2).alias("kind"), F.col("chapter_no").cast("int").alias("n"), item(F.concat("chapter_id", F.lit("_smil")), F.concat("chapter_id", F.lit(".smil")), F.lit("application/smil+xml")).alias("item"))
    im = assets.select("doc_id", F.lit(3).alias("kind"), F.col("n").cast("int").alias("n"), item(F.concat(F.lit("img"), F.col("n").cast("string")), F.concat(F.lit("images/"), F.col("name")), T.media_type(F.col("name"))).alias("item"))
    nav = chapters.select("doc_id").distinct().select("doc_id", F.lit(0).alias("kind"), F.lit(0).alias("n"), item(F.lit("nav"), F.lit("nav.xhtml"), F.lit("application/xhtml+xml"), ' properties="nav"').alias("item"))
    return nav.union(ch).union(sm).union(im)


def timed_elements(chapters: DataFrame) -> DataFrame:
    """doc_id, times: durations of a book and of each chapter's overlay, of chapters with duration_ms."""
    each = F.concat(F.lit('<meta property="media:duration" refines="#'), F.col("chapter_id"), F.lit('_smil">'), T.clock(F.col("duration_ms")), F.lit("</meta>"))
    parts = ordered_text(chapters, "doc_id", "chapter_no", each, "parts").join(chapters.groupBy("doc_id").agg(F.sum("duration_ms").alias("total")), "doc_id")
    return parts.select("doc_id", F.concat(F.lit('<meta property="media:duration">'), T.clock(F.col("total")), F.lit("</meta>"), F.col("parts")).alias("times"))


def opf(chapters: DataFrame, assets: DataFrame, metadata: DataFrame, modified: str, identifier: Column) -> DataFrame:
    """The package document of each book; time and identifier are given, so that runs repeat. Where chapters have a
    duration_ms, the document gives the book's and each overlay's."""
    items = ordered_text(manifest(chapters, assets).withColumn("o", F.struct("kind", "n")), "doc_id", "o", F.col("item"), "items")
    spine = ordered_text(chapters, "doc_id", "chapter_no", F.concat(F.lit('<itemref idref="'), F.col("chapter_id"), F.lit('"/>')), "refs")
    joined = items.join(spine, "doc_id").join(metadata, "doc_id")
    return joined.select("doc_id", F.concat(
        F.lit('<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata><dc:identifier>'), identifier, F.lit("</dc:identifier><dc:title>"), T.escape(F.col("title")),
        F.lit("</dc:title>"), F.col("optional"), F.lit(f'<meta property="dcterms:modified">{modified}</meta></metadata><manifest>'), F.col("items"), F.lit("</manifest><spine>"), F.col("refs"), F.lit("</spine></package>"),
    ).alias("opf"))


def optional_elements(**columns: Column) -> Column:
    """Elements of those values that are there."""
    made = [F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(f"<dc:{n}>"), T.escape(c), F.lit(f"</dc:{n}>"))) for n, c in columns.items()]
    return F.array_join(F.array_compact(F.array(*made)), "")


def accessibility_elements(pairs: Column) -> Column:
    """Of an array of key, value, an element each, in order; null and empty arrays give none."""
    made = F.transform(pairs, lambda p: F.concat(F.lit('<meta property="schema:'), T.escape(p["key"], quotes=False), F.lit('">'), T.escape(p["value"], quotes=False), F.lit("</meta>")))
    return F.coalesce(F.array_join(made, ""), F.lit(""))


def layout_items(chapters: DataFrame, assets: DataFrame, layout: str) -> DataFrame:
    """doc_id, kind, n, part, item: the manifest in order. chapters: doc_id, chapter_no, chapter_id, audio. Layouts of audio:
    "book" one file for all chapters, "chapter" one for each, "files" the distinct files in order of first use, "single"
    the one chapter of a book. Chapters without audio (null) add no file."""
    one = layout == "single"
    item = lambda i, href, kind, extra="": F.concat(F.lit('<item id="'), i, F.lit('" href="'), href, F.lit('" media-type="'), kind, F.lit('"'), F.lit(extra) if isinstance(extra, str) else extra, F.lit("/>"))
    row = lambda df, kind, n, part, made: df.select("doc_id", F.lit(kind).alias("kind"), n.cast("int").alias("n"), F.lit(part).alias("part"), made.alias("item"))
    books = chapters.groupBy("doc_id").agg(F.min_by("audio", "chapter_no").alias("audio"))
    i, mo = (F.lit("text1"), F.lit("mo1")) if one else (F.col("chapter_id"), F.concat(F.lit("mo_"), F.col("chapter_id")))
    mp3, here = F.lit("audio/mpeg"), F.col("chapter_no")
    file = F.concat(F.lit("audio/"), F.col("audio"))
    out = row(books, 0, F.lit(0), 0, item(F.lit("nav"), F.lit("text/nav.xhtml"), F.lit("application/xhtml+xml"), ' properties="nav"'))
    out = out.union(row(books, 5 if one else 1, F.lit(0), 0, item(F.lit("css"), F.lit("styles/style.css"), F.lit("text/css"))))
    order = 4 if one else 8  # images stand before chapters, but behind a single one
    out = out.union(row(chapters, order, here, 0, item(i, F.concat(F.lit("text/"), F.col("chapter_id"), F.lit(".xhtml")), F.lit("application/xhtml+xml"), F.concat(F.lit(' media-overlay="'), mo, F.lit('"')))))
    out = out.union(row(chapters, order, here, 1, item(mo, F.concat(F.lit("smil/"), F.col("chapter_id"), F.lit(".smil")), F.lit("application/smil+xml"))))
    if layout in ("chapter", "single"):
        name = F.lit("audio1") if one else F.concat(F.lit("audio_"), F.col("chapter_id"))
        out = out.union(row(chapters.filter("audio IS NOT NULL"), order, here, 2, item(name, file, mp3)))
    elif layout == "book":
        out = out.union(row(books.filter("audio IS NOT NULL"), 2, F.lit(0), 0, item(F.lit("audio"), file, mp3)))
    elif layout == "files":
        used = chapters.filter("audio IS NOT NULL").groupBy("doc_id", "audio").agg(F.min("chapter_no").alias("first"))
        used = used.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")))
        out = out.union(row(used, 2, F.col("n"), 0, item(F.concat(F.lit("audio"), F.col("n").cast("string")), file, mp3)))
    else:
        raise ValueError(f"unknown layout {layout}")
    image = item(F.concat(F.lit("img"), F.col("n").cast("string")), F.concat(F.lit("images/"), F.col("name")), T.media_type(F.col("name")))
    return out.union(row(assets.join(books.select("doc_id"), "doc_id", "left_semi"), 6, F.col("n"), 0, image))


def package_document(chapters: DataFrame, assets: DataFrame, metadata: DataFrame, modified: Column, identifier: Column, layout: str) -> DataFrame:
    """doc_id, opf of the books of metadata (doc_id, title, lang, optional, and what modified and identifier are made of).
    chapters also hold duration_ms; the layout "single" takes each book's first chapter alone."""
    if layout == "single":
        first = chapters.groupBy("doc_id").agg(F.min("chapter_no").alias("chapter_no"))
        chapters = chapters.join(first, ["doc_id", "chapter_no"])
    mo, ref = (F.lit("mo1"), F.lit("text1")) if layout == "single" else (F.concat(F.lit("mo_"), F.col("chapter_id")), F.col("chapter_id"))
    items = ordered_text(layout_items(chapters, assets, layout).withColumn("o", F.struct("kind", "n", "part")), "doc_id", "o", F.col("item"), "items")
    ordered = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", x.alias("x")))), lambda s: s["x"]), "")
    each = F.concat(F.lit('<meta property="media:duration" refines="#'), mo, F.lit('">'), T.clock(F.col("duration_ms")), F.lit("</meta>"))
    told = chapters.groupBy("doc_id").agg(ordered(F.concat(F.lit('<itemref idref="'), ref, F.lit('"/>'))).alias("refs"), ordered(each).alias("times"), F.sum("duration_ms").alias("total"))
    lang = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("ja"))
    return items.join(told, "doc_id").join(metadata, "doc_id").select("doc_id", F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="pub-id" xml:lang="'), lang,
        F.lit('" prefix="media: http://www.idpf.org/epub/vocab/overlays/#"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="pub-id">'), identifier,
        F.lit("</dc:identifier><dc:title>"), T.escape(F.col("title"), quotes=False), F.lit("</dc:title><dc:language>"), lang, F.lit("</dc:language>"), F.col("optional"),
        F.lit('<meta property="dcterms:modified">'), modified, F.lit('</meta><meta property="media:duration">'), T.clock(F.col("total")), F.lit("</meta>"), F.col("times"),
        F.lit('<meta property="media:active-class">-epub-media-overlay-active</meta></metadata><manifest>'), F.col("items"), F.lit("</manifest><spine>"), F.col("refs"), F.lit("</spine></package>"),
    ).alias("opf"))
