"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed as X
from .functions import text as T
from .operators import align as L
from .operators import formulas as M
from .operators import lookups as J
from .operators import structure as H
from .operators import timing as A
from .plans import book as B
from .plans import package as K
from .session import materialise, ship
from .sources import derived as D
from .sources import files as S
from .sources import sinks as Z

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "flagship_clips"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents")


def book_lines(spark: SparkSession, sf: str, wild: bool = False) -> DataFrame:
    return D.lines(D.books(D.table(spark, sf, "conversations"), wild))


def book_sql(wild: bool = False) -> str:
    return f"{D.books_sql(wild)}, {D.lines_sql('books')}"


# -- flagship ---------------------------------------------------------------


@query(f"""WITH {D.TIMED_SQL}, clips AS (
  SELECT doc_id, line_no, seg_no, min(begin_ms) AS b, max(end_ms) AS e FROM intervals GROUP BY ALL
), numbered_clips AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no) AS n FROM clips)
SELECT doc_id, count(*) AS n_clips, max(e) AS end_ms, sum(e - b)::BIGINT AS spoken_ms, sum((b % 1000003) * (n % 1009))::BIGINT AS checksum FROM numbered_clips GROUP BY doc_id""")
def flagship_clips(spark, sf):
    """Documents to lines, segments, timed words, clips; count, end, spoken time and checksum of each document."""
    c = A.group_clips(D.timed(spark, sf))
    return c.groupBy("doc_id").agg(
        F.count("*").alias("n_clips"), F.max("end_ms").alias("end_ms"), F.sum(F.col("end_ms") - F.col("begin_ms")).alias("spoken_ms"),
        F.sum((F.col("begin_ms") % 1000003) * (F.col("span_id") % 1009)).cast("bigint").alias("checksum"),
    )


# -- sources ----------------------------------------------------------------


@query(f"WITH {D.lines_sql()} SELECT * FROM lines")
def S01_lines(spark, sf):
    return D.lines(docs(spark, sf))


_META = """meta AS (
  SELECT conv_id AS book_id, turn::INTEGER AS line_no, CASE turn % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'author' WHEN 2 THEN 'accessMode' WHEN 3 THEN 'note' ELSE 'publisher' END
    || CASE WHEN turn % 2 = 0 THEN ':' ELSE '：' END || CASE WHEN (conv_id + turn) % 4 = 0 THEN ' ' ELSE ' ' || coalesce(role, '') || ' ' || turn END AS line FROM conversations
), kv AS (
  SELECT book_id, line_no, regexp_replace(substr(line, 1, pos - 1), '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g') AS key, regexp_replace(substr(line, pos + 1), '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g') AS value
  FROM (SELECT *, CASE WHEN instr(line, ':') > 0 THEN instr(line, ':') ELSE instr(line, '：') END AS pos FROM meta) WHERE pos > 0
)"""


@query(f"""WITH {_META}
SELECT book_id, {', '.join(f"arg_max(value, line_no) FILTER (key = '{k}') AS {v}" for k, v in X.METADATA_KEYS.items())},
  coalesce(string_agg(key || '=' || value, ';' ORDER BY line_no) FILTER (key IN ({', '.join(repr(k) for k in X.ACCESS_KEYS)})), '') AS accessibility
FROM kv WHERE value <> '' GROUP BY book_id""")
def S06_metadata(spark, sf):
    t = D.table(spark, sf, "conversations")
    names = F.element_at(F.array(*[F.lit(x) for x in ("title", "author", "accessMode", "note", "publisher")]), (F.col("turn") % 5 + 1).cast("int"))
    line = F.concat(
        names, F.when(F.col("turn") % 2 == 0, ":").otherwise("："),
        F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, " ").otherwise(F.concat(F.lit(" "), F.coalesce("role", F.lit("")), F.lit(" "), F.col("turn").cast("string"))),
    )
    return J.metadata(t.select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("line_no"), line.alias("line")))


@query(f"""WITH {book_sql()}, f AS (
  SELECT *, regexp_extract(line, '^(#{{1,5}})[ \\t]+(.+)$', 1) AS hash, regexp_extract(line, '^(#{{1,5}})[ \\t]+(.+)$', 2) AS title FROM lines
), s AS (SELECT *, sum((hash <> '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM f)
SELECT doc_id, bool_or(hash <> '') AS has_headings, CASE WHEN bool_or(hash <> '') THEN arg_min(title, line_no) FILTER (hash <> '') ELSE arg_min(line, line_no) END AS title,
  CASE WHEN bool_or(hash <> '') THEN count(*) FILTER (section_no > 0) ELSE count(*) END AS n_paragraphs FROM s GROUP BY doc_id""")
def S11_adapter(spark, sf):
    return H.adapted(book_lines(spark, sf))


@query("""SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]+$', '') AS stem,
  lower(regexp_extract(url, '(\\.[^./]+)$', 1)) = '.xml' AS is_xml FROM pages""")
def S14_suffix(spark, sf):
    p, url = D.table(spark, sf, "pages"), F.col("url")
    return p.select("page_id", T.suffix(url).alias("suffix"), T.file_name(url).alias("name"), T.stem(url).alias("stem"), (T.suffix(url) == ".xml").alias("is_xml"))


_LANG = "langs(code, epub_lang, tts_engine, tts_voice, sre_lang) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {repr(d) if d else 'NULL'}, '{e}')" for a, b, c, d, e in X.LANGUAGES) + ")"


@query(f"WITH {_LANG} SELECT doc_id, code, tts_engine, tts_voice, sre_lang FROM documents JOIN langs ON lang = epub_lang")
def S15_language(spark, sf):
    return J.with_language(docs(spark, sf).select("doc_id", "lang"), J.languages(spark)).select("doc_id", "code", "tts_engine", "tts_voice", "sre_lang")


@query(f"WITH {_LANG} SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN (SELECT epub_lang FROM langs) GROUP BY lang")
def S15_language_audit(spark, sf):
    return J.without_language(docs(spark, sf).select("doc_id", "lang"), J.languages(spark)).groupBy("lang").agg(F.count("*").alias("n"))


# -- normalisation ----------------------------------------------------------


def _replaced(table: dict[str, str], c: str = "text") -> str:
    for k, v in table.items():
        c = f"replace({c}, '{k}', '{v}')"
    return c


def _circled(c: str) -> str:
    return _replaced({x: str(i + 1) for i, x in enumerate(X.CIRCLED)} | {X.CIRCLED_ZERO: "0"}, c)


def _roman(c: str) -> str:
    return _replaced({x: str(i + 1) for i, x in enumerate(X.ROMAN)}, c)


def _all(c: str, with_brackets: bool = True) -> str:
    c = f"translate({_roman(_circled(c))}, '{X.CIRCLED_LETTERS}{X.FULL_DIGITS}{X.DASHES}', '{X.LETTERS}{X.DIGITS}----')"
    return f"translate({c}, '{X.BRACKETS}', '{X.PLAIN_BRACKETS}')" if with_brackets else c


def _sub(c: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return c


def _strip(c: str, image: str, named: str) -> str:
    return _sub(c, (X.IMAGE, image), (X.UNDERLINE, r"\1"), (X.FRAME, r"\1"), (X.STRONG, r"\1"), (X.SPOKEN, named), (X.RUBY, named), (X.SUB, r"\1"), (X.SUP, r"\1"))


def _on_cjk(key, f, sql):
    @query(f"WITH {D.CJK_SQL} SELECT doc_id, {sql} AS out FROM cjk", name=key)
    def run(spark, sf):
        return D.cjk(docs(spark, sf)).select("doc_id", f(F.col("text")).alias("out"))


def _on_markup(key, f, sql, name="out"):
    @query(f"WITH {D.markup_sql()} SELECT doc_id, line_no, {sql} AS {name} FROM markup", name=key)
    def run(spark, sf):
        return D.markup(docs(spark, sf)).select("doc_id", "line_no", f(F.col("line")).alias(name))


def _on_html(key, f, sql, name="out"):
    @query(f"WITH {D.PARAGRAPHS_SQL} SELECT page_id, para_no, {sql} AS {name} FROM paras", name=key)
    def run(spark, sf):
        return D.paragraphs_html(D.table(spark, sf, "pages")).select("page_id", "para_no", f(F.col("para")).alias(name))


_on_cjk("F01_reading", T.to_reading, _replaced(X.READINGS))
_on_cjk("F02_circled_digits", T.circled_digits, _circled("text"))
_on_cjk("F03_roman_numerals", T.roman_numerals, _roman("text"))
_on_cjk("F04_circled_letters", T.circled_letters, f"translate(text, '{X.CIRCLED_LETTERS}', '{X.LETTERS}')")
_on_cjk("F05_full_digits", T.full_digits, f"translate(text, '{X.FULL_DIGITS}', '{X.DIGITS}')")
_on_cjk("F06_dashes", T.dashes, f"translate(text, '{X.DASHES}', '----')")
_on_cjk("F07_brackets", T.brackets, f"translate(text, '{X.BRACKETS}', '{X.PLAIN_BRACKETS}')")
_on_cjk("F08_normalize_all", T.normalize_all, _all("text"))
_on_cjk("F20_for_aligner", T.for_aligner, f"replace({_all(_strip('text', chr(92) + '1', chr(92) + '2'), False)}, '-', ' ')")
_on_markup("F09_normalize_text", T.normalize_text, _all(_replaced(X.READINGS, _strip("line", r"\1", r"\2"))))
_on_markup("F11_strip_to_reading", T.strip_to_reading, _strip("line", r"\1", r"\2"))
_on_markup("F12_strip_for_display", T.strip_for_display, _strip("line", "", r"\1"))
_on_markup("F13_ruby_to_xhtml", T.ruby_to_xhtml, _sub("line", (X.RUBY, r"<ruby><rb>\1</rb><rt>\2</rt></ruby>")))
_on_markup("F13_ruby_to_reading", T.ruby_to_reading, _sub("line", (X.RUBY, r"\2")))
_on_markup("F13_strip_ruby", T.strip_ruby, _sub("line", (X.RUBY, r"\1")))
_RENDER = {"sub": (X.SUB, r"<sub>\1</sub>"), "sup": (X.SUP, r"<sup>\1</sup>"), "strong": (X.STRONG, r"<strong>\1</strong>"), "underline": (X.UNDERLINE, r'<span style="text-decoration: underline;">\1</span>'), "frame": (X.FRAME, rf'<span style="{X.FRAME_STYLE}">\1</span>')}
for _n, _step in _RENDER.items():
    _on_markup(f"F14_{_n}", (lambda n: lambda c: T.render_one(c, n))(_n), _sub("line", _step))
_ESC = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "''": "&#x27;"}
_FLAT = _sub(_replaced(_ESC, "line"), (X.IMAGE, r'<img src="../images/\2" alt="\1"/>'), _RENDER["underline"], _RENDER["frame"], _RENDER["strong"], (X.RUBY, r"<ruby><rb>\1</rb><rt>\2</rt></ruby>"), (X.SPOKEN, r'<span data-yomi="\2">\1</span>'), _RENDER["sub"], _RENDER["sup"])
_on_markup("F15_render_flat", T.render_flat, f"replace({_FLAT}, '**', '')")
_on_markup("F16_title_for_reading", T.title_for_reading, _sub("line", (X.SPOKEN, r"\2")))
_on_markup("F18_span_reading", lambda c: T.span_reading(T.render_flat(c)), "lower(" + _sub(f"replace({_FLAT}, '**', '')", (r"<ruby><rb>.*?</rb><rt>(.*?)</rt></ruby>", r"\1"), (r'<span data-yomi="([^"]*)">.*?</span>', r"\1"), (r'<img\b[^>]*\balt="([^"]*)"[^>]*/>', r"\1"), (r"<img\b[^>]*/>", ""), (r"<[^>]+>", "")) + ")")
_on_markup("F19_matching_key", T.matching_key, _sub("line", (X.SKIPPED, "")))
_on_markup("F21_reading_length", lambda c: F.length(T.normalize_text(c)), f"length({_all(_replaced(X.READINGS, _strip('line', chr(92) + '1', chr(92) + '2')))})::INTEGER", "n")
_on_html("F10_normalize_xhtml", T.normalize_xhtml, "translate(" + _sub("para", (r"<ruby><rb>.*?</rb><rt>(.*?)</rt></ruby>", r"\1"), (r'<span[^>]*data-yomi="([^"]*)"[^>]*>.*?</span>', r"\1"), (r"<[^>]+>", "")) + f", '{X.BRACKETS}{X.FULL_DIGITS}', '{X.PLAIN_BRACKETS}{X.DIGITS}')")
_on_html("F17_strip_tags", T.strip_tags, _sub("para", (r"<ruby><rb>(.*?)</rb><rt>.*?</rt></ruby>", r"\1"), (r"<[^>]+>", "")))
_on_html("F23_escape", T.escape, _replaced(_ESC, "para"))
_LOST = r"(\)|\}|~ |\^ )$|\*\* "  # closing marks that get lost: those that end a line, and bold ones before a blank
_on_markup("P03_unclosed", lambda c: T.unclosed(T.swap(c, _LOST, "")), (lambda t: f"(contains({t}, '[') AND NOT contains({t}, ']{{.underline}}') AND NOT contains({t}, ']{{.frame}}')) OR ((length({t}) - length(replace({t}, '**', ''))) // 2) % 2 <> 0 OR (length({t}) - length(replace({t}, '~', ''))) % 2 <> 0 OR (length({t}) - length(replace({t}, '^', ''))) % 2 <> 0")(_sub(f"regexp_replace(line, '{_LOST}', '', 'g')", *[(p, "") for p in (X.IMAGE, X.RUBY, X.SPOKEN, X.UNDERLINE, X.FRAME, X.STRONG)])), "open")
_on_markup("P04_image_only", T.image_only, f"regexp_matches(line, '{X.IMAGE}') AND {_sub(_sub('line', (X.IMAGE, '')), (X.BLANKS, ''))} = ''", "image_only")
_on_markup("P05_speakable", T.speakable, f"regexp_matches(line, '{X.SPEAKABLE}')", "speakable")
_on_markup("P09_ends_group", T.ends_group, rf"regexp_matches(line, '[{X.ENDS}]$') AND NOT regexp_matches(line, '\{{\.$')", "ends")


@query("SELECT page_id, regexp_replace(url, '\\.[^./]+$', '') || '.mp3' AS audio, regexp_replace(url, '\\.[^./]+$', '') || '.TextGrid' AS timing FROM pages")
def F22_change_suffix(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.change_suffix(F.col("url"), ".mp3").alias("audio"), T.change_suffix(F.col("url"), ".TextGrid").alias("timing"))


@query(rf"SELECT doc_id, regexp_matches(coalesce(text, ''), '{X.DISPLAY_MATH}') OR regexp_matches(coalesce(text, ''), '{X.INLINE_MATH}') AS has_math FROM documents")
def P06_math(spark, sf):
    return docs(spark, sf).select("doc_id", T.has_math(F.coalesce("text", F.lit(""))).alias("has_math"))


_CHAPTER_FILE = ["audio.txt", "a.txt", "audio.wav", "audio.mp4", "audio.TextGrid", "b.mp3", "audio.mp3"]


@query(f"SELECT page_id, name FROM (SELECT page_id, ([{', '.join(repr(x) for x in _CHAPTER_FILE)}])[(page_id % {len(_CHAPTER_FILE)} + 1)::INTEGER] AS name FROM pages) WHERE name IN ({', '.join(repr(r) for r in X.RESERVED)})")
def P07_reserved(spark, sf):
    """Files (here: a name for each page, of which some are reserved) that may not be called so."""
    reserved = spark.createDataFrame([(r,) for r in X.RESERVED], "name string")  # four rows
    name = F.element_at(F.array(*[F.lit(x) for x in _CHAPTER_FILE]), (F.col("page_id") % len(_CHAPTER_FILE) + 1).cast("int"))
    return D.table(spark, sf, "pages").select("page_id", name.alias("name")).join(F.broadcast(reserved), "name", "left_semi")


# -- structure --------------------------------------------------------------

_HEADS = r"""heads AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{1,5})[ \t]+(.+)$', 1))::INTEGER AS level, regexp_replace(regexp_extract(line, '^(#{1,5})[ \t]+(.+)$', 2), '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g') AS title, line FROM lines)"""
_SECTIONS = f"{_HEADS}, secs AS (SELECT *, (sum((level > 0)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS section_no FROM heads)"
_TREE = f"""{_HEADS}, hs AS (SELECT doc_id, level, title, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INTEGER AS h_no FROM heads WHERE level > 0
), rooted AS (SELECT *, first_value(level) OVER (PARTITION BY doc_id ORDER BY h_no) AS root, min(CASE WHEN h_no > 1 THEN level END) OVER (PARTITION BY doc_id ORDER BY h_no) AS later FROM hs
), tree AS (SELECT h.doc_id, h_no, level, title, (SELECT max(p.h_no) FROM hs p WHERE p.doc_id = h.doc_id AND p.h_no < h.h_no AND p.level < h.level) AS parent, coalesce(later > root, true) AS kept FROM rooted h)"""


@query(f"WITH {book_sql()}, {_HEADS} SELECT doc_id, line_no, level, title FROM heads WHERE level > 0")
def P01_headings(spark, sf):
    return H.flagged(book_lines(spark, sf)).filter("level > 0").select("doc_id", "line_no", "level", "title")


@query(f"WITH {book_sql(True)}, {_SECTIONS} SELECT doc_id, section_no, (row_number() OVER (PARTITION BY doc_id, section_no ORDER BY line_no) - 1)::INTEGER AS para_no, line AS paragraph FROM secs WHERE level = 0 AND section_no > 0")
def H01_sections(spark, sf):
    return H.body(book_lines(spark, sf, True))


@query(f"WITH {D.lines_sql()}, {_SECTIONS} SELECT doc_id, line_no, line FROM secs WHERE level = 0 AND section_no = 0")
def H01_dropped(spark, sf):
    return H.dropped(D.lines(docs(spark, sf)))


def _tree(wild):
    @query(f"WITH {book_sql(wild)}, {_TREE} SELECT doc_id, h_no, level, title, parent, kept FROM tree", name=f"H02_parents{'_wild' * wild}")
    def parents(spark, sf):
        return H.headings(book_lines(spark, sf, wild))

    @query(f"WITH {book_sql(wild)}, {_TREE} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY h_no))::INTEGER AS chapter_no, 'chapter' || row_number() OVER (PARTITION BY doc_id ORDER BY h_no) AS chapter_id, level, title FROM tree WHERE kept", name=f"H03_chapters{'_wild' * wild}")
    def chapters(spark, sf):
        return H.chapters(book_lines(spark, sf, wild))


_tree(False)
_tree(True)


@query(r"""WITH parts AS (
  SELECT page_id, (i - 1)::INTEGER AS part_no, el FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?s)(<h[1-6][^>]*>.*?</h[1-6]>|<p[^>]*>.*?</p>)', 1)) AS el, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?s)(<h[1-6][^>]*>.*?</h[1-6]>|<p[^>]*>.*?</p>)', 1), 1) AS i FROM pages)
), flagged AS (SELECT *, regexp_matches(el, '^<h[1-6]') AS is_title, sum(regexp_matches(el, '^<h[1-6]')::INTEGER) OVER (PARTITION BY page_id ORDER BY part_no) AS section_no FROM parts)
SELECT page_id, section_no::BIGINT AS section_no, coalesce(max(CASE WHEN is_title THEN substr(el, 3, 1)::INTEGER END), 0) AS level, coalesce(max(CASE WHEN is_title THEN regexp_replace(el, '<[^>]+>', '', 'g') END), '') AS title, count(*) FILTER (NOT is_title) AS n_paragraphs FROM flagged GROUP BY page_id, section_no""")
def H04_grouped_sections(spark, sf):
    """Groups that start at each title; what stands before the first one has level 0."""
    from pyspark.sql import Window

    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?s)(<h[1-6][^>]*>.*?</h[1-6]>|<p[^>]*>.*?</p>)"), F.lit(1))
    p = D.table(spark, sf, "pages").select("page_id", F.posexplode(found).alias("part_no", "el")).withColumn("is_title", F.col("el").rlike("^<h[1-6]"))
    p = p.withColumn("section_no", F.sum(F.col("is_title").cast("int")).over(Window.partitionBy("page_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, 0)))
    title = F.when(F.col("is_title"), T.swap(F.col("el"), r"<[^>]+>", ""))
    level = F.when(F.col("is_title"), F.substring("el", 3, 1).cast("int"))
    return p.groupBy("page_id", "section_no").agg(F.coalesce(F.max(level), F.lit(0)).alias("level"), F.coalesce(F.max(title), F.lit("")).alias("title"), F.count(F.when(~F.col("is_title"), 1)).alias("n_paragraphs"))


@query(f"WITH {D.PARAGRAPHS_SQL} SELECT page_id, para_no, para FROM paras")
def H05_paragraphs(spark, sf):
    return D.paragraphs_html(D.table(spark, sf, "pages"))


@query(f"WITH {D.lines_sql()}, {D.segments_sql()} SELECT * FROM segments")
def H06_segments(spark, sf):
    return D.segments(D.lines(docs(spark, sf)))


@query(f"""WITH {book_sql(True)}, marks AS (
  SELECT *, starts_with(line, '##') AS deep, sum(starts_with(line, '#')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS piece, sum(starts_with(line, '##')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS number FROM lines)
SELECT doc_id, piece::BIGINT AS piece, (CASE WHEN arg_min(deep, line_no) THEN arg_min(number, line_no) ELSE 0 END)::BIGINT AS file_no, count(*) AS n_lines FROM marks WHERE piece > 0 GROUP BY doc_id, piece""")
def H08_split(spark, sf):
    return H.split_at_marks(book_lines(spark, sf, True))


@query(f"""WITH {D.books_sql()}, raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM books
), isl AS (SELECT *, NOT regexp_matches(t, '[^ \\t\\r\\f\\n]') AS blank, sum((NOT regexp_matches(t, '[^ \\t\\r\\f\\n]'))::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM raw
), runs AS (SELECT doc_id, island, string_agg(regexp_replace(t, '{X.BLANKS}', '', 'g'), ' ' ORDER BY i) AS paragraph FROM isl WHERE NOT blank GROUP BY doc_id, island)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1)::INTEGER AS run, paragraph FROM runs""")
def H09_unwrap(spark, sf):
    return H.unwrapped(D.books(D.table(spark, sf, "conversations")))


@query(f"""WITH {book_sql()}, {_SECTIONS}, said AS (SELECT doc_id, line_no, {_sub(_replaced(X.READINGS, _strip("CASE WHEN level > 0 THEN title ELSE line END", chr(92) + '1', chr(92) + '2')), (X.BLANKS, ''))} AS said FROM secs WHERE section_no > 0)
SELECT doc_id, string_agg(said, chr(10) ORDER BY line_no) AS reading FROM said WHERE said <> '' GROUP BY doc_id""")
def K02_reading_text(spark, sf):
    return H.reading_text(book_lines(spark, sf))


# -- alignment --------------------------------------------------------------


@query(f"WITH {D.TIMED_SQL} SELECT doc_id, idx, label, begin_ms, end_ms FROM intervals")
def S08_intervals(spark, sf):
    return D.timed(spark, sf).select("doc_id", "idx", "label", "begin_ms", "end_ms")


@query(f"""WITH {D.TIMED_SQL}, g AS (SELECT doc_id, line_no, seg_no, min(begin_ms) AS begin_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM intervals GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no))::INTEGER AS span_id FROM g""")
def A02_group_clips(spark, sf):
    return A.group_clips(D.timed(spark, sf))


_SPANS = f"""{D.TIMED_SQL}, tight AS (SELECT *, length(replace(seg, ' ', '')) AS n FROM segments
), spans AS (SELECT doc_id, line_no, seg_no, sum(n) OVER w - n AS o0, sum(n) OVER w AS o1 FROM tight WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY seg_no)
), pairs AS (SELECT i.doc_id, i.line_no, i.idx // 3 AS g, min(i.begin_ms) AS begin_ms, max(i.end_ms) AS end_ms, sum(length(w.word)) AS n FROM intervals i JOIN words w USING (doc_id, line_no, seg_no, word_no) GROUP BY ALL
), ivs AS (SELECT *, sum(n) OVER w - n AS o0, sum(n) OVER w AS o1 FROM pairs WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY g))"""


@query(f"""WITH {_SPANS} SELECT s.doc_id, s.line_no, s.seg_no,
  min(i.begin_ms + floor(((i.end_ms - i.begin_ms) * (greatest(s.o0, i.o0) - i.o0)) / (i.o1 - i.o0)::DOUBLE)::BIGINT)::BIGINT AS begin_ms,
  max(i.begin_ms + floor(((i.end_ms - i.begin_ms) * (least(s.o1, i.o1) - i.o0)) / (i.o1 - i.o0)::DOUBLE)::BIGINT)::BIGINT AS end_ms
FROM spans s JOIN ivs i ON s.doc_id = i.doc_id AND s.line_no = i.line_no AND i.o0 < s.o1 AND i.o1 > s.o0 GROUP BY s.doc_id, s.line_no, s.seg_no""")
def A03_overlap_clips(spark, sf):
    """Spans are segments; intervals hold three words each, so most straddle a span."""
    seg = D.segments(D.lines(docs(spark, sf)))
    spans = A.offsets(seg, F.length(F.replace("seg", F.lit(" "), F.lit(""))).cast("bigint"), "seg_no")
    i = D.intervals(D.words(seg)).groupBy("doc_id", "line_no", F.expr("idx div 3").alias("g"))
    i = i.agg(F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), F.sum("length").alias("n"))
    return A.overlap_clips(spans, A.offsets(i, F.col("n"), "g"))


@query(f"""WITH {D.TIMED_SQL}, f AS (
  SELECT *, first_value(CASE WHEN label <> '<unk>' THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_label,
    sum((label <> '<unk>')::INTEGER) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM intervals)
SELECT doc_id, idx, next_label, min(idx) OVER (PARTITION BY doc_id, island) AS run_start, max(end_ms) OVER (PARTITION BY doc_id, island) AS run_end_ms FROM f WHERE label = '<unk>'""")
def A04_unknown_runs(spark, sf):
    return A.next_known(D.timed(spark, sf))


@query(f"""WITH {D.TIMED_SQL}, a AS (
  SELECT doc_id, line_no, idx, list(label) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS ahead FROM intervals
), h AS (SELECT a.doc_id, a.idx, list_filter(ahead, lambda x: contains(lower(l.line), x))[1] AS hit FROM a JOIN lines l ON a.doc_id = l.doc_id AND a.line_no = l.line_no)
SELECT doc_id, idx, hit FROM h WHERE hit IS NOT NULL""")
def A06_look_ahead(spark, sf):
    ln = D.lines(docs(spark, sf))
    return A.look_ahead(D.timed(spark, sf), ln)


@query(f"""WITH {D.TIMED_SQL} SELECT doc_id, idx, 's' || lpad(idx::VARCHAR, greatest(4, length(idx::VARCHAR))::INTEGER, '0') AS el_id,
  (begin_ms // 3600000) || ':' || lpad(((begin_ms % 3600000) // 60000)::VARCHAR, 2, '0') || ':' || lpad(((begin_ms % 60000) // 1000)::VARCHAR, 2, '0') || '.' || lpad((begin_ms % 1000)::VARCHAR, 3, '0') AS clock,
  (end_ms // 1000) || '.' || lpad((end_ms % 1000)::VARCHAR, 3, '0') AS seconds FROM intervals""")
def C01_clock(spark, sf):
    return D.timed(spark, sf).select("doc_id", "idx", T.element_id(F.lit("s"), F.col("idx")).alias("el_id"), T.clock(F.col("begin_ms")).alias("clock"), T.seconds(F.col("end_ms")).alias("seconds"))


@query(f"""WITH {D.TIMED_SQL}, g AS (SELECT doc_id, line_no, arg_min(begin_ms, idx) AS begin_ms, arg_max(end_ms, idx) AS end_ms FROM intervals GROUP BY ALL) SELECT *, end_ms - begin_ms AS duration_ms FROM g""")
def G02_chapter_times(spark, sf):
    return A.durations(D.timed(spark, sf))


@query(f"""WITH {D.TIMED_SQL}, g AS (SELECT doc_id, line_no, max(end_ms) - min(begin_ms) AS d FROM intervals GROUP BY ALL) SELECT doc_id, sum(d)::BIGINT AS duration_ms, count(*) AS n_chapters FROM g GROUP BY doc_id""")
def G01_book_duration(spark, sf):
    return A.durations(D.timed(spark, sf)).groupBy("doc_id").agg(F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("n_chapters"))


@query(f"""WITH {D.TIMED_SQL}, c AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY abs(idx - 20), idx) AS rank, ((length(label) * greatest(100, 1000 - abs(idx - 20))) // 1000) AS score FROM intervals WHERE idx BETWEEN 0 AND 169)
SELECT doc_id, arg_max(idx, score * 1000 - rank) AS idx, max(score)::BIGINT AS score FROM c GROUP BY doc_id""")
def G09_resync_choice(spark, sf):
    """The best of the cursors from 50 back to 149 ahead of the 20th word, nearer ones first."""
    from pyspark.sql import Window

    gap = F.abs(F.col("idx") - 20)
    c = D.timed(spark, sf).filter("idx BETWEEN 0 AND 169").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(gap, "idx")))
    return A.best_resync(c.withColumn("score", T.distance_score(F.length("label"), gap)))


_FLATSEG = r"""flat AS (SELECT doc_id, line_no, (i - 1)::INTEGER AS part, el FROM (
    SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(\[[^\[\]]+\]\([+-][^)]+\)|[^\[]+|\[)', 1)) AS el, generate_subscripts(regexp_extract_all(line, '(\[[^\[\]]+\]\([+-][^)]+\)|[^\[]+|\[)', 1), 1) AS i FROM markup)
), sized AS (SELECT doc_id, line_no, part, length(el) AS n, length(regexp_replace(el, '\[([^\[\]]+)\]\([+-]([^)]+)\)', '\2', 'g')) AS r FROM flat)"""


@query(f"""WITH {D.markup_sql()}, {_FLATSEG} SELECT doc_id, line_no, part, (sum(n) OVER w - n)::BIGINT AS src_start, (sum(n) OVER w)::BIGINT AS src_end, (sum(r) OVER w - r)::BIGINT AS read_start, (sum(r) OVER w)::BIGINT AS read_end
FROM sized WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY part)""")
def A13_offset_map(spark, sf):
    """Source and reading offsets of a line's parts; ruby and spoken forms are one part each."""
    from pyspark.sql import Window

    parts = F.regexp_extract_all("line", F.lit(r"(\[[^\[\]]+\]\([+-][^)]+\)|[^\[]+|\[)"), F.lit(1))
    m = D.markup(docs(spark, sf)).select("doc_id", "line_no", F.posexplode(parts).alias("part", "el"))
    n, r = F.length("el").cast("bigint"), F.length(T.swap(F.col("el"), r"\[([^\[\]]+)\]\([+-]([^)]+)\)", "$2")).cast("bigint")
    w = Window.partitionBy("doc_id", "line_no").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("doc_id", "line_no", "part", (F.sum(n).over(w) - n).alias("src_start"), F.sum(n).over(w).alias("src_end"), (F.sum(r).over(w) - r).alias("read_start"), F.sum(r).over(w).alias("read_end"))


# -- lookups ----------------------------------------------------------------

_NAME = "regexp_extract(url, '([^/]*)$', 1)"
_NATURAL = f"CASE WHEN regexp_matches({_NAME}, '^[0-9]') THEN chr(1) ELSE '' END || array_to_string([CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(length(regexp_replace(p, '^0+', ''))::VARCHAR, 6, '0') || regexp_replace(p, '^0+', '') ELSE p END FOR p IN regexp_extract_all(lower({_NAME}), '([0-9]+|[^0-9]+)', 1)], chr(1))"


_STEMS = f"""src AS (SELECT regexp_replace({_NAME}, '\\.[^.]+$', '') AS stem, count(*) AS n, min(page_id) AS page_id FROM pages GROUP BY 1
), aud AS (SELECT regexp_replace({_NAME}, '\\.[^.]+$', '') || CASE WHEN page_id % 9 = 4 THEN '_' ELSE '' END AS stem, count(*) AS n, min(page_id) AS audio_id FROM pages GROUP BY 1)"""


def _stem_sides(spark, sf):
    """A source for each page and an audio file beside it, of which some have a misspelt name."""
    p, name = D.table(spark, sf, "pages"), F.col("url")
    audio = F.concat(T.stem(name), F.when(F.col("page_id") % 9 == 4, "_").otherwise(""), F.lit(".mp3"))
    return p.select("page_id", F.col("url").alias("source")), p.select(F.col("page_id").alias("audio_id"), audio.alias("audio")), "source", "audio"


@query(f"WITH {_STEMS} SELECT stem, page_id, audio_id FROM src JOIN aud USING (stem) WHERE src.n = 1 AND aud.n = 1")
def J01_by_stem(spark, sf):
    """Sources with the one file of their stem."""
    return J.by_stem(*_stem_sides(spark, sf)).select("stem", "page_id", "audio_id")


@query(f"WITH {_STEMS} SELECT stem, coalesce(src.n, 0) AS n_left, coalesce(aud.n, 0) AS n_right FROM src FULL JOIN aud USING (stem) WHERE coalesce(src.n, 0) <> 1 OR coalesce(aud.n, 0) <> 1")
def J01_audit(spark, sf):
    """Stems that are not there once on either side; the reference would refuse the book."""
    return J.by_stem_audit(*_stem_sides(spark, sf))


_SIDECARS = """books AS (SELECT DISTINCT conv_id AS book_id, 'books/b' || conv_id || '_metadata.txt' AS path FROM conversations
), sides AS (SELECT CASE WHEN conv_id % 10 = 3 THEN 'books/x' ELSE 'books/b' END || conv_id || '_metadata.txt' AS path, max(CASE WHEN conv_id % 10 <> 7 THEN 'conv ' || conv_id END) AS title FROM conversations GROUP BY conv_id)"""


def _sidecars(spark, sf):
    """A book for each conversation, its sidecar beside it; some are misplaced, some hold no title."""
    c = D.table(spark, sf, "conversations").select(F.col("conv_id").alias("book_id")).distinct()
    own = F.col("book_id").cast("string")
    title = F.when(F.col("book_id") % 10 != 7, F.concat(F.lit("conv "), own))
    there = F.concat(F.when(F.col("book_id") % 10 == 3, "books/x").otherwise("books/b"), own, F.lit("_metadata.txt"))
    return c.select("book_id", F.concat(F.lit("books/b"), own, F.lit(".md")).alias("path")), c.select(there.alias("path"), title.alias("title"))


@query(f"WITH {_SIDECARS} SELECT book_id, title FROM books JOIN sides USING (path) WHERE title IS NOT NULL")
def J02_book_metadata(spark, sf):
    return J.book_metadata(*_sidecars(spark, sf)).select("book_id", "title")


@query(f"WITH {_SIDECARS} SELECT book_id, CASE WHEN sides.path IS NULL THEN 'file missing' ELSE 'title missing' END AS fault FROM books LEFT JOIN sides USING (path) WHERE title IS NULL")
def J02_audit(spark, sf):
    return J.book_metadata_audit(*_sidecars(spark, sf))


@query(f"""WITH refs AS (SELECT page_id, {_NAME} AS ref FROM pages), files AS (SELECT DISTINCT CASE WHEN page_id % 4 = 1 THEN 'lost/' WHEN page_id % 3 = 0 THEN 'images/' ELSE '' END || {_NAME} AS path FROM pages)
SELECT page_id, ref, coalesce(d.path, f.path) AS found FROM refs LEFT JOIN files d ON ref = d.path LEFT JOIN files f ON 'images/' || ref = f.path""")
def J05_resolve(spark, sf):
    """A reference for each page; its file lies beside it, under images, or where nobody looks."""
    p, name = D.table(spark, sf, "pages"), T.file_name(F.col("url"))
    folder = F.when(F.col("page_id") % 4 == 1, "lost/").when(F.col("page_id") % 3 == 0, "images/").otherwise("")
    return J.resolve(p.select("page_id", name.alias("ref")), p.select(F.concat(folder, name).alias("path")).distinct())


_MEDIA = "CASE lower(regexp_extract({0}, '(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.MEDIA_TYPES.items()) + f" ELSE '{X.OTHER_MEDIA}' END"
_ASSET = "'p' || page_id || (['.png', '.JPG', '.svg', '.txt', ''])[(page_id % 5 + 1)::INTEGER]"


@query(f"SELECT page_id, {_MEDIA.format(_ASSET)} AS media_type FROM pages")
def J07_media_type(spark, sf):
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".png", ".JPG", ".svg", ".txt", "")]), (F.col("page_id") % 5 + 1).cast("int")))
    return D.table(spark, sf, "pages").select("page_id", T.media_type(name).alias("media_type"))


@query(f"WITH {D.lines_sql()}, {D.segments_sql()}, {D.WORDS_SQL}, w AS (SELECT lower(word) AS word, min(doc_id) AS first_doc, count(*) AS n FROM words GROUP BY 1), known AS (SELECT DISTINCT lower(coalesce(role, '')) AS word FROM conversations UNION SELECT DISTINCT lower(word) FROM words WHERE length(word) % 2 = 0) SELECT w.* FROM w WHERE word NOT IN (SELECT word FROM known)")
def J08_unregistered(spark, sf):
    """Words of the corpus that a dictionary (the words of an even length, and the roles) lacks."""
    w = D.words(D.segments(D.lines(docs(spark, sf)))).withColumn("word", F.lower("word"))
    known = D.table(spark, sf, "conversations").select(F.lower(F.coalesce("role", F.lit(""))).alias("word")).union(w.filter("length(word) % 2 = 0").select("word")).distinct()
    return J.unregistered(w.groupBy("word").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), known)


@query(f"SELECT page_id, row_number() OVER (ORDER BY {_NATURAL}, page_id) AS place FROM pages")
def R01_natural_sort(spark, sf):
    """Places in natural order. Ranges are dealt by the key; ranks within them are shifted by the sizes before."""
    from pyspark.sql import Window

    p = D.table(spark, sf, "pages").select("page_id", T.natural_key(T.file_name(F.col("url"))).alias("key"))
    p = p.repartitionByRange("key", "page_id").withColumn("part", F.spark_partition_id())
    local = p.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("key", "page_id")))
    sizes = p.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    return local.join(F.broadcast(before), "part").select("page_id", (F.col("n") + F.coalesce("before", F.lit(0))).alias("place"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT source, doc_id FROM r WHERE n = 1""")
def G04_ordered_distinct(spark, sf):
    """Distinct in order of first use. An aggregate, as only the first row of each group is asked for: no group is gathered."""
    return docs(spark, sf).groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH m AS (SELECT doc_id, text FROM documents), d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{X.DISPLAY_MATH}', 1)) AS tex, true AS display FROM m), i AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '{X.DISPLAY_MATH}', '', 'g'), '{X.INLINE_MATH}', 1)) AS tex, false AS display FROM m) SELECT tex, display, count(*) AS uses FROM (SELECT * FROM d UNION ALL SELECT * FROM i) GROUP BY ALL")
def E01_formulas(spark, sf):
    """Distinct formulas: those set apart first, then those within a line of what is left."""
    t = docs(spark, sf).select(F.coalesce("text", F.lit("")).alias("text"))
    shown = t.select(F.explode(F.regexp_extract_all("text", F.lit(X.DISPLAY_MATH), F.lit(1))).alias("tex"), F.lit(True).alias("display"))
    within = t.select(F.explode(F.regexp_extract_all(T.swap(F.col("text"), X.DISPLAY_MATH, ""), F.lit(X.INLINE_MATH), F.lit(1))).alias("tex"), F.lit(False).alias("display"))
    return shown.union(within).groupBy("tex", "display").agg(F.count("*").alias("uses"))


@query("SELECT 'p' || (page_id % 7) AS name FROM pages UNION SELECT 'p' || (page_id % 11) FROM pages")
def U01_union_distinct(spark, sf):
    p = D.table(spark, sf, "pages")
    name = lambda k: p.select(F.concat(F.lit("p"), (F.col("page_id") % k).cast("string")).alias("name"))
    return name(7).union(name(11)).distinct()


@query("SELECT 'p' || (page_id % 11) AS name FROM pages EXCEPT SELECT 'p' || (page_id % 7) FROM pages")
def U03_difference(spark, sf):
    p = D.table(spark, sf, "pages")
    name = lambda k: p.select(F.concat(F.lit("p"), (F.col("page_id") % k).cast("string")).alias("name"))
    return name(11).distinct().join(name(7).distinct(), "name", "left_anti")


# -- package ----------------------------------------------------------------

_CHAPTERS = f"{book_sql()}, {_TREE}, chapters AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY h_no))::INTEGER AS chapter_no, 'chapter' || row_number() OVER (PARTITION BY doc_id ORDER BY h_no) AS chapter_id, level, title FROM tree WHERE kept)"


def _esc(c: str) -> str:
    return _replaced(_ESC, c)


_CLIPS = f"""{D.TIMED_SQL}, g AS (SELECT doc_id, line_no, seg_no, min(begin_ms) AS b, max(end_ms) AS e FROM intervals GROUP BY ALL
), clips AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no)) AS n FROM g), ids AS (SELECT *, 's' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') AS el FROM clips)"""


@query(f"""WITH {_CLIPS} SELECT doc_id, '<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body>' || string_agg('<par id="par_' || el || '"><text src="text.xhtml#' || el || '"/><audio src="audio.mp3" clipBegin="'
  || (b // 1000) || '.' || lpad((b % 1000)::VARCHAR, 3, '0') || 's" clipEnd="' || (e // 1000) || '.' || lpad((e % 1000)::VARCHAR, 3, '0') || 's"/></par>', '' ORDER BY n) || '</body></smil>' AS smil FROM ids GROUP BY doc_id""")
def K05_smil(spark, sf):
    return K.smil(A.group_clips(D.timed(spark, sf)))


@query(f"""WITH {_CHAPTERS} SELECT doc_id, chapter_no, '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en"><head><title>' || {_esc('title')} || '</title></head><body><h' || greatest(1, least(6, level)) || '>' || {_esc('title')} || '</h' || greatest(1, least(6, level)) || '>' || '<p/>' || '</body></html>' AS xhtml FROM chapters""")
def K04_chapter_xhtml(spark, sf):
    c = H.chapters(book_lines(spark, sf))
    return c.select("doc_id", "chapter_no", K.chapter_xhtml(F.col("title"), F.col("level"), F.lit("<p/>"), F.lit("en")).alias("xhtml"))


@query(f"""WITH {_CHAPTERS} SELECT doc_id, '<ol>' || string_agg('<li><a href="' || chapter_id || '.xhtml">' || {_esc(_strip("coalesce(nullif(title, ''), chapter_id)", "", chr(92) + "1"))} || '</a></li>', '' ORDER BY chapter_no) || '</ol>' AS nav FROM chapters GROUP BY doc_id""")
def K06_nav_flat(spark, sf):
    return K.nav_flat(H.chapters(book_lines(spark, sf)))


@query(f"""WITH {_CHAPTERS}, t AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY doc_id ORDER BY chapter_no), 0) AS nxt FROM chapters
), opened AS (SELECT i.doc_id, i.chapter_no FROM t i JOIN t j ON j.doc_id = i.doc_id AND j.chapter_no < i.chapter_no JOIN t k ON k.doc_id = i.doc_id AND k.chapter_no > j.chapter_no AND k.chapter_no <= i.chapter_no
  GROUP BY i.doc_id, i.chapter_no, i.nxt, j.chapter_no, j.level HAVING min(k.level) > j.level AND i.nxt <= j.level
), closed AS (SELECT doc_id, chapter_no, count(*) AS n FROM opened GROUP BY ALL)
SELECT doc_id, '<ol>' || string_agg('<li><a href="' || chapter_id || '.xhtml">' || {_esc('title')} || '</a>' || CASE WHEN nxt > level THEN '<ol>' ELSE repeat('</li></ol>', coalesce(n, 0)::INTEGER) || '</li>' END, '' ORDER BY chapter_no) || '</ol>' AS nav
FROM t LEFT JOIN closed USING (doc_id, chapter_no) GROUP BY doc_id""")
def K07_nav_nested(spark, sf):
    return K.nav_nested(H.chapters(book_lines(spark, sf)))


_IMAGES = "imgs AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 't' || turn || CASE WHEN turn % 2 = 0 THEN '.png' ELSE '.gif' END AS name FROM conversations)"


def _images(spark, sf):
    from pyspark.sql import Window

    t = D.table(spark, sf, "conversations")
    name = F.concat(F.lit("t"), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, ".png").otherwise(".gif"))
    return t.select(F.col("conv_id").alias("doc_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"), name.alias("name"))


_MANIFEST = f"""{_CHAPTERS}, {_IMAGES}, items AS (
  SELECT DISTINCT doc_id, 0 AS kind, 0 AS n, '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' AS item FROM chapters
  UNION ALL SELECT doc_id, 1, chapter_no, '<item id="' || chapter_id || '" href="' || chapter_id || '.xhtml" media-type="application/xhtml+xml"/>' FROM chapters
  UNION ALL SELECT doc_id, 2, chapter_no, '<item id="' || chapter_id || '_smil" href="' || chapter_id || '.smil" media-type="application/smil+xml"/>' FROM chapters
  UNION ALL SELECT doc_id, 3, n::INTEGER, '<item id="img' || n || '" href="images/' || name || '" media-type="' || {_MEDIA.format('name')} || '"/>' FROM imgs)"""


@query(f"WITH {_MANIFEST} SELECT doc_id, kind, n, item FROM items")
def K10_manifest(spark, sf):
    return K.manifest(H.chapters(book_lines(spark, sf)), _images(spark, sf))


@query(f"""WITH {_MANIFEST}, i AS (SELECT doc_id, string_agg(item, '' ORDER BY kind, n) AS items FROM items GROUP BY doc_id), s AS (SELECT doc_id, string_agg('<itemref idref="' || chapter_id || '"/>', '' ORDER BY chapter_no) AS refs FROM chapters GROUP BY doc_id)
SELECT i.doc_id, '<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata><dc:identifier>' || 'book-' || i.doc_id || '</dc:identifier><dc:title>' || 'conv ' || i.doc_id || '</dc:title>' || '<dc:creator>A &amp; B</dc:creator>'
  || '<meta property="dcterms:modified">2026-01-01T00:00:00Z</meta></metadata><manifest>' || items || '</manifest><spine>' || refs || '</spine></package>' AS opf FROM i JOIN s USING (doc_id)""")
def K08_opf(spark, sf):
    c = H.chapters(book_lines(spark, sf))
    meta = c.select("doc_id").distinct().select("doc_id", F.concat(F.lit("conv "), F.col("doc_id").cast("string")).alias("title"), K.optional_elements(creator=F.lit("A & B"), publisher=F.lit("")).alias("optional"))
    return K.opf(c, _images(spark, sf), meta, "2026-01-01T00:00:00Z", F.concat(F.lit("book-"), F.col("doc_id").cast("string")))


# -- sequential operators: no SQL says the same; tested against closed forms and worked cases ----


def _noisy(spark, sf):
    """Timed words as a real aligner leaves them: every seventh unknown, every thirteenth misheard."""
    label = F.when(F.col("idx") % 7 == 6, "<unk>").when(F.col("idx") % 13 == 12, F.concat(F.lit("zz"), F.col("label"))).otherwise(F.col("label"))
    return D.timed(spark, sf).withColumn("label", label)


@query()
def A01_align_words(spark, sf):
    ship(spark)
    return L.align(D.lines(docs(spark, sf)), _noisy(spark, sf), "word")


@query()
def A02_align_groups(spark, sf):
    ship(spark)
    return L.align(D.lines(docs(spark, sf)), _noisy(spark, sf), "punctuation")


def _xml(spark, sf) -> DataFrame:
    """Conversations as XML books: a title for each turn, its lines as paragraphs with an accented word and a reading."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    paras = F.array_join(F.transform(F.split(clean, "\n", -1), lambda x: F.concat(F.lit('<p><ruby yomi="r">b</ruby> <g>'), esc(x), F.lit("</g></p>"))), "")
    level = (F.col("turn") % 5 + 1).cast("string")
    part = F.concat(F.lit("<title"), level, F.lit(">"), esc(F.coalesce("role", F.lit(""))), F.lit("</title"), level, F.lit(">"), paras)
    t = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("x")))), lambda s: s["x"]), "").alias("body"))
    return t.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("<root>"), F.col("body"), F.lit("</root>")).alias("text"))


@query()
def S02_xml_books(spark, sf):
    ship(spark)
    return S.read_xml_books(_xml(spark, sf))


@query(f"WITH {D.TIMED_SQL} SELECT doc_id::VARCHAR AS path, idx, label, begin_ms, end_ms, max(end_ms) OVER (PARTITION BY doc_id) AS max_ms FROM intervals")
def S08_textgrids(spark, sf):
    """Timed words written as TextGrids and read again."""
    ship(spark)
    i = D.timed(spark, sf)
    one = F.concat(F.lit('        intervals:\n            xmin = '), T.seconds(F.col("begin_ms")), F.lit("\n            xmax = "), T.seconds(F.col("end_ms")), F.lit('\n            text = "'), F.replace("label", F.lit('"'), F.lit('""')), F.lit('"\n'))
    g = K.ordered_text(i, "doc_id", "idx", one, "body").join(i.groupBy("doc_id").agg(F.max("end_ms").alias("m"), F.count("*").alias("n")), "doc_id")
    head = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), T.seconds(F.col("m")), F.lit('\ntiers? <exists>\nsize = 1\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "words"\n        xmin = 0\n        xmax = '), T.seconds(F.col("m")), F.lit("\n        intervals: size = "), F.col("n").cast("string"), F.lit("\n"))
    return S.read_textgrids(g.select(F.col("doc_id").cast("string").alias("path"), F.concat(head, "body").alias("text")))


@query()
def K11_packages(spark, sf):
    """A package for each conversation: its chapters, navigation and package document. Name and size of each."""
    ship(spark)
    part = lambda df, name, c: df.select(F.col("doc_id").alias("book_id"), name.alias("name"), F.col(c).cast("binary").alias("data"))
    x = part(K04_chapter_xhtml(spark, sf).withColumn("name", F.concat(F.lit("text/chapter"), F.col("chapter_no").cast("string"), F.lit(".xhtml"))), F.col("name"), "xhtml")
    members = x.union(part(K06_nav_flat(spark, sf), F.lit("nav.xhtml"), "nav")).union(part(K08_opf(spark, sf), F.lit("content.opf"), "opf"))
    return Z.packages(members)


# -- more sources, lookups and strings ---------------------------------------


@query(f"""WITH {book_sql()}, {_SECTIONS}, any_h AS (SELECT doc_id, bool_or(level > 0) AS h, min(line_no) FILTER (level > 0) AS first_h, min(line_no) AS first FROM secs GROUP BY doc_id)
SELECT s.doc_id, s.line_no, CASE WHEN s.level > 0 THEN title ELSE line END AS paragraph FROM secs s JOIN any_h a USING (doc_id) WHERE CASE WHEN h THEN section_no > 0 AND line_no <> first_h ELSE line_no <> first END""")
def S12_body_paragraphs(spark, sf):
    """Without headings all lines but the first; with headings all from the first one on but itself."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    s = H.sections_of_lines(book_lines(spark, sf))
    s = s.withColumn("h", F.max((F.col("level") > 0).cast("int")).over(w)).withColumn("first_h", F.min(F.when(F.col("level") > 0, F.col("line_no"))).over(w)).withColumn("first", F.min("line_no").over(w))
    keep = F.when(F.col("h") == 1, (F.col("section_no") > 0) & (F.col("line_no") != F.col("first_h"))).otherwise(F.col("line_no") != F.col("first"))
    return s.filter(keep).select("doc_id", "line_no", F.when(F.col("level") > 0, F.col("title")).otherwise(F.col("line")).alias("paragraph"))


@query(r"""SELECT page_id, regexp_replace(url, '\.[^./]+$', '') || '_metadata.txt' AS file_sidecar, regexp_replace(regexp_extract(url, '^(.*)/[^/]*$', 1), '/+$', '') || '_metadata.txt' AS folder_sidecar FROM pages""")
def S05_sidecars(spark, sf):
    url = F.col("url")
    folder = F.regexp_extract(url, r"^(.*)/[^/]*$", 1)
    return D.table(spark, sf, "pages").select("page_id", S.metadata_path(url).alias("file_sidecar"), S.metadata_path(folder, True).alias("folder_sidecar"))


@query("""WITH books AS (SELECT DISTINCT conv_id AS book_id FROM conversations), titles AS (SELECT DISTINCT conv_id AS book_id FROM conversations WHERE turn % 2 = 1 AND (conv_id + turn) % 4 <> 0)
SELECT book_id, 'title missing' AS fault FROM books WHERE book_id NOT IN (SELECT book_id FROM titles)""")
def S07_metadata_audit(spark, sf):
    """Books whose metadata hold no title. Odd turns give a title, some a blank one, the others an author."""
    t = D.table(spark, sf, "conversations")
    key = F.when(F.col("turn") % 2 == 1, "title:").otherwise("author:")
    line = F.concat(key, F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, " ").otherwise("x"))
    meta = J.metadata(t.select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("line_no"), line.alias("line")))
    books = t.select(F.col("conv_id").alias("book_id")).distinct()
    return books.join(meta.filter("title IS NOT NULL").select("book_id"), "book_id", "left_anti").withColumn("fault", F.lit("title missing"))


@query(f"SELECT doc_id, {_replaced(X.READINGS, _strip('coalesce(text, chr(0))', chr(92) + '1', chr(92) + '2'))} AS reading FROM documents WHERE text IS NOT NULL")
def K01_reading_file(spark, sf):
    """A whole text as it is read aloud, lines as they are."""
    return docs(spark, sf).filter("text IS NOT NULL").select("doc_id", T.to_reading(T.strip_to_reading(F.col("text"))).alias("reading"))


@query(f"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{X.INLINE_MATH}', 1)) AS tex FROM documents), speech AS (SELECT DISTINCT tex, 'formula of ' || length(tex) AS speech FROM found WHERE length(tex) % 2 = 0)
SELECT doc_id, tex, coalesce(speech, '') AS speech, count(*) AS uses FROM found LEFT JOIN speech USING (tex) GROUP BY ALL""")
def J04_formula_speech(spark, sf):
    """Formulas with their speech; those that the converter gave none have an empty one."""
    t = docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(X.INLINE_MATH), F.lit(1))).alias("tex"))
    speech = t.select("tex").distinct().filter(F.length("tex") % 2 == 0).withColumn("speech", F.concat(F.lit("formula of "), F.length("tex").cast("string")))
    return t.join(speech, "tex", "left").groupBy("doc_id", "tex", F.coalesce("speech", F.lit("")).alias("speech")).agg(F.count("*").alias("uses"))


@query(f"WITH {_LANG} SELECT doc_id, coalesce(sre_lang, 'en') AS speech_lang FROM documents LEFT JOIN langs ON lang = epub_lang")
def J09_speech_language(spark, sf):
    configs = J.languages(spark).select("epub_lang", "sre_lang")
    d = docs(spark, sf).select("doc_id", "lang").join(F.broadcast(configs), F.col("lang") == F.col("epub_lang"), "left")
    return d.select("doc_id", F.coalesce("sre_lang", F.lit("en")).alias("speech_lang"))


@query(rf"SELECT page_id, regexp_replace({_NAME}, '\.[^.]+$', '') || '_punctuation_20260101_000000.epub' AS out FROM pages")
def C05_output_name(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", F.concat(T.stem(F.col("url")), F.lit("_punctuation_20260101_000000.epub")).alias("out"))


@query(rf"""WITH {D.markup_sql()}, refs AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{X.IMAGE}', 2)) AS ref FROM markup), named AS (SELECT *, regexp_extract(ref, '([^/]*)$', 1) AS name FROM refs)
SELECT doc_id, name, min(line_no) AS line_no, {_MEDIA.format('name')} AS media_type FROM named GROUP BY doc_id, name""")
def C11_image_references(spark, sf):
    """Images that each document uses, once each, by their first use."""
    m = D.markup(docs(spark, sf)).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(X.IMAGE), F.lit(2))).alias("ref"))
    g = m.withColumn("name", T.file_name(F.col("ref"))).groupBy("doc_id", "name").agg(F.min("line_no").alias("line_no"))
    return g.withColumn("media_type", T.media_type(F.col("name")))


@query(f"""WITH {D.PARAGRAPHS_SQL}, tok AS (SELECT page_id, para_no, unnest(regexp_extract_all(para, '(<[^>]+>|[^<]+|<)', 1)) AS el, generate_subscripts(regexp_extract_all(para, '(<[^>]+>|[^<]+|<)', 1), 1) AS i FROM paras
), sized AS (SELECT *, length(el) AS n, CASE WHEN regexp_matches(el, '^<[^>]+>$') THEN 0 ELSE length(el) END AS r FROM tok)
SELECT page_id, para_no, (i - 1)::INTEGER AS part, (sum(n) OVER w - n)::BIGINT AS src_start, (sum(n) OVER w)::BIGINT AS src_end, (sum(r) OVER w - r)::BIGINT AS read_start, (sum(r) OVER w)::BIGINT AS read_end FROM sized WINDOW w AS (PARTITION BY page_id, para_no ORDER BY i)""")
def A15_xhtml_offset_map(spark, sf):
    """Source and reading offsets of tags and texts; tags have no width in the reading."""
    from pyspark.sql import Window

    p = D.paragraphs_html(D.table(spark, sf, "pages"))
    t = p.select("page_id", "para_no", F.posexplode(F.regexp_extract_all("para", F.lit("(<[^>]+>|[^<]+|<)"), F.lit(1))).alias("part", "el"))
    n = F.length("el").cast("bigint")
    r = F.when(F.col("el").rlike("^<[^>]+>$"), F.lit(0)).otherwise(n).cast("bigint")
    w = Window.partitionBy("page_id", "para_no").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("page_id", "para_no", "part", (F.sum(n).over(w) - n).alias("src_start"), F.sum(n).over(w).alias("src_end"), (F.sum(r).over(w) - r).alias("read_start"), F.sum(r).over(w).alias("read_end"))


@query(f"""WITH {D.PARAGRAPHS_SQL}, tok AS (SELECT page_id, para_no, unnest(regexp_extract_all(para, '</?([a-z0-9]+)[^>]*>', 0)) AS el FROM paras)
SELECT page_id, para_no, count(*) FILTER (NOT starts_with(el, '</') AND NOT ends_with(el, '/>')) AS opened, count(*) FILTER (starts_with(el, '</')) AS closed FROM tok GROUP BY ALL""")
def A16_tag_balance(spark, sf):
    p = D.paragraphs_html(D.table(spark, sf, "pages"))
    t = p.select("page_id", "para_no", F.explode(F.regexp_extract_all("para", F.lit("</?([a-z0-9]+)[^>]*>"), F.lit(0))).alias("el"))
    close = F.col("el").startswith("</")
    return t.groupBy("page_id", "para_no").agg(F.count(F.when(~close & ~F.col("el").endswith("/>"), 1)).alias("opened"), F.count(F.when(close, 1)).alias("closed"))


@query(f"WITH {D.lines_sql()}, {D.segments_sql()} SELECT doc_id, line_no, seg_no, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no) - 1)::INTEGER AS data_index FROM segments")
def H07_span_numbers(spark, sf):
    from pyspark.sql import Window

    s = D.segments(D.lines(docs(spark, sf))).select("doc_id", "line_no", "seg_no")
    return s.withColumn("data_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "seg_no")) - 1)


@query(f"SELECT p.page_id, count(*) FILTER (para <> '') AS n_paragraphs, coalesce(string_agg({_sub('para', ('<[^>]+>', ''))}, chr(10) ORDER BY para_no), '') AS text FROM (SELECT DISTINCT page_id FROM pages) p JOIN (WITH {D.PARAGRAPHS_SQL} SELECT * FROM paras) q USING (page_id) GROUP BY p.page_id")
def H11_flattened(spark, sf):
    """All paragraphs of a page as one text."""
    p = D.paragraphs_html(D.table(spark, sf, "pages"))
    whole = K.ordered_text(p, "page_id", "para_no", T.swap(F.col("para"), "<[^>]+>", ""), "text", "\n")
    return whole.join(p.groupBy("page_id").agg(F.count(F.when(F.col("para") != "", 1)).alias("n_paragraphs")), "page_id")


# -- books -------------------------------------------------------------------

_CLOCK = "({0} // 1000) || '.' || lpad(({0} % 1000)::VARCHAR, 3, '0')"
_BOOK_SQL = f"""{_CHAPTERS}, secs AS (SELECT *, (sum((level > 0)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no))::INTEGER AS section_no FROM heads
), said AS (SELECT doc_id, section_no, line_no, level > 0 AS heading, CASE WHEN level > 0 THEN title ELSE line END AS line FROM secs WHERE section_no > 0
), {D.segments_sql(source="said")}, {D.WORDS_SQL}, {D.INTERVALS_SQL}, clips AS (SELECT doc_id, line_no, seg_no, min(begin_ms) AS b, max(end_ms) AS e FROM intervals GROUP BY ALL
), ids AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no) AS n FROM clips
), els AS (SELECT *, 's' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') AS el FROM ids
), spans AS (SELECT s.doc_id, section_no, line_no, heading, seg_no, seg, el, b, e FROM segments s JOIN said USING (doc_id, line_no) LEFT JOIN els USING (doc_id, line_no, seg_no)
), paras AS (SELECT s.doc_id, section_no, line_no, heading, c.level, string_agg(CASE WHEN el IS NULL THEN {_esc('seg')} ELSE '<span id="' || el || '"' || CASE WHEN contains({_esc('seg')}, 'display="block"') THEN ' style="display: block;"' ELSE '' END || '>' || {_esc('seg')} || '</span>' END, '' ORDER BY seg_no) AS inside,
  string_agg(CASE WHEN el IS NULL THEN '' ELSE '<par id="par_' || el || '"><text src="' || chapter_id || '.xhtml#' || el || '"/><audio src="audio.mp3" clipBegin="' || {_CLOCK.format('b')} || 's" clipEnd="' || {_CLOCK.format('e')} || 's"/></par>' END, '' ORDER BY seg_no) AS pars, count(el) AS n, min(b) AS b, max(e) AS e
  FROM spans s JOIN chapters c ON c.doc_id = s.doc_id AND c.chapter_no = s.section_no GROUP BY ALL
), bodies AS (SELECT doc_id, section_no AS chapter_no, string_agg(CASE WHEN heading THEN '<h' || greatest(1, least(6, level)) || '>' || inside || '</h' || greatest(1, least(6, level)) || '>' ELSE '<p>' || inside || '</p>' END, '' ORDER BY line_no) AS body,
  string_agg(pars, '' ORDER BY line_no) AS pars, sum(n)::BIGINT AS n_pars, max(e) - min(b) AS duration_ms FROM paras GROUP BY ALL)"""


@query(f"""WITH {_BOOK_SQL} SELECT doc_id, chapter_no, chapter_id, '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en"><head><title>' || {_esc('title')} || '</title></head><body>' || coalesce(body, '') || '</body></html>' AS xhtml,
  '<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body>' || coalesce(pars, '') || '</body></smil>' AS smil, coalesce(n_pars, 0) AS n_pars, coalesce(duration_ms, 0) AS duration_ms FROM chapters LEFT JOIN bodies USING (doc_id, chapter_no)""")
def K14_book(spark, sf):
    """Chapters of books of marked-up text: spans with ids, and overlays whose pars refer to them."""
    ln = book_lines(spark, sf)
    return B.assemble(B.text_spans(ln), H.chapters(ln))


@query()
def K14_packages(spark, sf):
    """Whole packages: chapters, overlays, navigation, package document with durations."""
    ship(spark)
    ln = book_lines(spark, sf)
    made = B.assemble(B.text_spans(ln), H.chapters(ln))
    c = H.chapters(ln).join(made.select("doc_id", "chapter_no", "duration_ms"), ["doc_id", "chapter_no"])
    times = K.timed_elements(c)
    meta = times.select("doc_id", F.concat(F.lit("conv "), F.col("doc_id").cast("string")).alias("title"), F.concat(K.optional_elements(language=F.lit("en")), F.col("times")).alias("optional"))
    opf = K.opf(c, _images(spark, sf), meta, "2026-01-01T00:00:00Z", F.concat(F.lit("book-"), F.col("doc_id").cast("string")))
    part = lambda df, name, x: df.select(F.col("doc_id").alias("book_id"), name.alias("name"), x.cast("binary").alias("data"))
    members = part(made, F.concat("chapter_id", F.lit(".xhtml")), F.col("xhtml")).union(part(made, F.concat("chapter_id", F.lit(".smil")), F.col("smil")))
    members = members.union(part(K.nav_nested(c), F.lit("nav.xhtml"), F.col("nav"))).union(part(opf, F.lit("content.opf"), F.col("opf")))
    members = members.union(part(times, F.lit("styles/style.css"), F.lit(Z.CSS)))
    return Z.packages(members)


_PLAIN_SQL = f"""{D.lines_sql(name="raw_lines")}, lines AS (SELECT doc_id, line_no, translate(line, '<>', '  ') AS line FROM raw_lines), {D.segments_sql()}, {D.WORDS_SQL}, {D.INTERVALS_SQL}"""


@query(f"""WITH {_PLAIN_SQL}, said AS (SELECT i.doc_id, i.line_no, i.seg_no, min(i.begin_ms) AS begin_ms, max(i.end_ms) AS end_ms FROM intervals i JOIN words w USING (doc_id, line_no, seg_no, word_no) WHERE {_sub('w.word', (X.SKIPPED, ''))} <> '' GROUP BY ALL
), numbered_segs AS (SELECT doc_id, line_no, seg_no, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no) - 1)::INTEGER AS data_index FROM segments)
SELECT doc_id, line_no, data_index, begin_ms, end_ms FROM numbered_segs LEFT JOIN said USING (doc_id, line_no, seg_no)""")
def A03_align_spans(spark, sf):
    """The sequential form on clean input: numbered spans of paragraphs against the words that they hold."""
    from pyspark.sql import Window

    ship(spark)
    ln = D.lines(docs(spark, sf)).withColumn("line", F.translate("line", "<>", "  "))
    seg = D.segments(ln)
    w = D.words(seg)
    heard = D.intervals(w).withColumn("label", F.lower("word"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "seg_no")) - 1
    shown = F.concat(F.lit('<span data-index="'), F.col("n").cast("string"), F.lit('">'), F.col("seg"), F.lit("</span>"))
    paras = K.ordered_text(seg.withColumn("n", n).withColumn("at", F.struct("doc_id", "line_no")), "at", "n", shown, "line").select("at.*", "line")
    return L.align_spans(paras, heard)


@query()
def A05_resync(spark, sf):
    """Cursors that are seven words off, or wherever the text is shorter, found again for each line."""
    ship(spark)
    t = D.timed(spark, sf)
    first = t.groupBy("doc_id", "line_no").agg(F.min("idx").cast("int").alias("first"))
    ln = D.lines(docs(spark, sf)).join(first, ["doc_id", "line_no"])
    return L.resync_cursors(ln.withColumn("at", F.when(F.col("line_no") % 2 == 0, F.col("first") + 7).otherwise(F.greatest(F.lit(0), F.col("first") - 7))), t)


# -- rows of what functions above do in one column ----------------------------

_on_markup("F13_escape_with_ruby", T.escape_with_ruby, _sub(_replaced(_ESC, "line"), (X.RUBY, r"<ruby><rb>\1</rb><rt>\2</rt></ruby>")))
_on_html("F24_powershell", lambda c: T.escape_for_powershell(T.swap(c, "e", "'")), "replace(replace(para, 'e', chr(39)), chr(39), chr(39) || chr(39))")
_FIRST_IMAGE = f"coalesce(nullif(regexp_extract(line, '{X.IMAGE}', 0), ''), line)"
_on_markup(
    "P04_image_paragraph", lambda c: T.image_paragraph(F.coalesce(F.nullif(F.regexp_extract(c, X.IMAGE, 0), F.lit("")), c)),
    f"CASE WHEN regexp_matches({_FIRST_IMAGE}, '{X.IMAGE}') AND {_sub(_sub(_FIRST_IMAGE, (X.IMAGE, '')), (X.BLANKS, ''))} = '' THEN array_to_string([{_sub(_replaced(_ESC, 'i'), (X.IMAGE, chr(60) + 'img src=' + chr(34) + '../images/' + chr(92) + '2' + chr(34) + ' alt=' + chr(34) + chr(92) + '1' + chr(34) + '/>'))} FOR i IN regexp_extract_all({_FIRST_IMAGE}, '{X.IMAGE}', 0)], '') END",
)


@query(f"WITH {D.lines_sql()} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INTEGER AS para_no, line FROM lines")
def H12_spoken_paragraphs(spark, sf):
    return H.spoken_paragraphs(D.lines(docs(spark, sf)))


@query(f"""WITH {_PLAIN_SQL}, n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no) - 1)::INTEGER AS data_index FROM segments)
SELECT doc_id, line_no, data_index, CASE WHEN seg_no % 2 = 0 THEN 'y' || seg_no END AS yomi, seg AS content, '<span data-index="' || data_index || '"' || CASE WHEN seg_no % 2 = 0 THEN ' data-yomi="y' || seg_no || '"' ELSE '' END || '>' AS open_tag FROM n""")
def H10_index_spans(spark, sf):
    from pyspark.sql import Window

    ship(spark)
    seg = D.segments(D.lines(docs(spark, sf)).withColumn("line", F.translate("line", "<>", "  ")))
    seg = seg.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "seg_no")) - 1).withColumn("at", F.struct("doc_id", "line_no"))
    yomi = F.when(F.col("seg_no") % 2 == 0, F.concat(F.lit(' data-yomi="y'), F.col("seg_no").cast("string"), F.lit('"'))).otherwise("")
    shown = F.concat(F.lit('<span data-index="'), F.col("n").cast("string"), F.lit('"'), yomi, F.lit(">"), F.col("seg"), F.lit("</span>"))
    return H.index_spans(K.ordered_text(seg, "at", "n", shown, "line").select("at.*", "line"))


@query()
def F15_render_nested(spark, sf):
    """Notations within notations: every line underlined, its own notation inside."""
    ship(spark)
    m = D.markup(docs(spark, sf)).withColumn("line", F.concat(F.lit("["), F.translate("line", "[]", "()"), F.lit("]{.underline}")))
    return H.rendered(m).select("doc_id", "line_no", "out")


@query("""SELECT conv_id::VARCHAR AS path, coalesce(arg_min(coalesce(role, ''), turn), '') AS title, count(*) AS n_sections, sum(len(string_split(coalesce(text, ''), chr(10))))::INTEGER AS n_paragraphs FROM conversations GROUP BY conv_id""")
def S10_xml_view(spark, sf):
    ship(spark)
    return S.xml_view(S.read_xml_books(_xml(spark, sf))).select("path", "title", "n_sections", F.size("paragraphs").alias("n_paragraphs"))


# -- formulas put in place, layouts of packages, names with times ----------------

_TEX = f"""tex AS (SELECT doc_id, translate(coalesce(text, ''), 'e', '$') AS text FROM documents
), shown AS (SELECT doc_id, regexp_extract_all(text, '{X.DISPLAY_MATH}', 1) AS shown, string_split_regex(text, '{X.DISPLAY_MATH}') AS p FROM tex
), once AS (SELECT doc_id, shown, array_to_string(list_transform(p, lambda x, i: x || CASE WHEN i < len(p) THEN chr(2) || 'MATH' || (i - 1) || chr(2) ELSE '' END), '') AS text FROM shown
), within AS (SELECT doc_id, shown, regexp_extract_all(text, '{X.INLINE_MATH}', 1) AS within, string_split_regex(text, '{X.INLINE_MATH}') AS p FROM once
), marked AS (SELECT doc_id, array_to_string(list_transform(p, lambda x, i: x || CASE WHEN i < len(p) THEN chr(2) || 'MATH' || (len(shown) + i - 1) || chr(2) ELSE '' END), '') AS text,
    list_concat([regexp_replace(x, '{X.EDGES}', '', 'g') FOR x IN shown], [regexp_replace(x, '{X.EDGES}', '', 'g') FOR x IN within]) AS tex, len(shown) AS n_shown FROM within)"""


def _formula_texts(spark, sf):
    """Documents whose letter e is a dollar sign: formulas of all lengths, some within others' marks."""
    return M.substituted(docs(spark, sf).select("doc_id", F.translate("text", "e", "$").alias("text")))


def _marked_texts(spark, sf):
    """The same, written once: the texts, their formulas and the converter's table are each read from it."""
    return materialise(_formula_texts(spark, sf), "formula-texts")


def _made(marked: DataFrame) -> DataFrame:
    """A converter's table; formulas of a length that three divides failed."""
    one = marked.select(F.explode("formulas").alias("f")).select("f.tex", "f.display").distinct().filter(F.length("tex") % 3 != 0)
    n = F.length("tex").cast("string")
    return one.withColumn("mathml", F.concat(F.lit("<math><mn>"), n, F.lit("</mn></math>"))).withColumn("speech", F.concat(F.lit("formula of "), n))


@query(f"WITH {_TEX} SELECT doc_id, text, n_shown::INTEGER AS n_shown, len(tex)::INTEGER AS n FROM marked")
def E01_substituted(spark, sf):
    shown = F.size(F.filter("formulas", lambda f: f["display"]))
    return _formula_texts(spark, sf).select("doc_id", "text", shown.alias("n_shown"), F.size("formulas").alias("n"))


def _filled(c: str, other: str, made: str) -> str:
    mark = chr(2) + "MATH([0-9]+)" + chr(2)
    entry = f"CASE WHEN length(x) % 3 <> 0 THEN {made} ELSE {other} END"
    return f"array_to_string(list_transform(list_zip(string_split_regex({c}, '{mark}'), list_append(regexp_extract_all({c}, '{mark}', 1), '-1')), lambda z: z[1] || coalesce(([{entry} FOR x IN tex])[z[2]::INTEGER + 1], '')), '')"


_MARKED_READING = _all(_replaced(X.READINGS, _strip("text", chr(92) + "1", chr(92) + "2")))


@query(f"WITH {_TEX}, r AS (SELECT doc_id, tex, {_MARKED_READING} AS text FROM marked) SELECT doc_id, {_filled('text', 'x', chr(39) + 'formula of ' + chr(39) + ' || length(x)')} AS out FROM r")
def F09_normalize_with_formulas(spark, sf):
    """Text as it is matched, formulas as they are spoken."""
    m = _marked_texts(spark, sf)
    c = M.converted(m, _made(m))
    for step in (T.strip_to_reading, T.to_reading, T.normalize_all):  # normalize_text in columns: each step names its text several times
        c = c.withColumn("text", step(F.col("text")))
    return c.select("doc_id", M.filled(F.col("text"), "speech").alias("out"))


_FAULT = f"'{X.MATH_FAULT[0]}' || x || '{X.MATH_FAULT[1]}'"


@query(f"WITH {_TEX} SELECT doc_id, {_filled('text', _FAULT, chr(39) + '<math><mn>' + chr(39) + ' || length(x) || ' + chr(39) + '</mn></math>' + chr(39))} AS out FROM marked")
def E01_formulas_shown(spark, sf):
    m = _marked_texts(spark, sf)
    return M.converted(m, _made(m)).select("doc_id", M.filled(F.col("text"), "mathml").alias("out"))


_DAY = "(page_id * 86461 + 1700000000)"
_STAMP = f"strftime(make_timestamp({_DAY}::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


@query(f"SELECT page_id, {_STAMP} AS stamp FROM pages")
def C03_timestamps(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.timestamp(F.col("page_id") * 86461 + 1700000000).alias("stamp"))


@query(rf"SELECT page_id, regexp_replace({_NAME}, '\.[^.]+$', '') || '_' || CASE WHEN page_id % 2 = 0 THEN 'word' ELSE 'punctuation' END || '_' || strftime(make_timestamp({_DAY}::BIGINT * 1000000), '%Y%m%d_%H%M%S') || '.epub' AS out FROM pages")
def C05_names_of_runs(spark, sf):
    mode = F.when(F.col("page_id") % 2 == 0, "word").otherwise("punctuation")
    return D.table(spark, sf, "pages").select("page_id", T.output_name(F.col("url"), mode, F.col("page_id") * 86461 + 1700000000).alias("out"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR coalesce(role, '') = '' THEN 'Untitled' ELSE role END AS title FROM conversations")
def F16_book_title(spark, sf):
    title = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role"))
    return D.table(spark, sf, "conversations").select("conv_id", "turn", T.book_title(title).alias("title"))


def _clock(ms: str) -> str:
    return f"(({ms}) // 3600000) || ':' || lpad(((({ms}) % 3600000) // 60000)::VARCHAR, 2, '0') || ':' || lpad(((({ms}) % 60000) // 1000)::VARCHAR, 2, '0') || '.' || lpad((({ms}) % 1000)::VARCHAR, 3, '0')"


def _layout_sql(layout: str) -> str:
    one, each = layout == "single", layout in ("single", "chapter")
    i, mo = ("'text1'", "'mo1'") if one else ("chapter_id", "'mo_' || chapter_id")
    place = 4 if one else 8
    item = lambda a, href, kind, extra="''": f"'<item id=\"' || {a} || '\" href=\"' || {href} || '\" media-type=\"' || {kind} || '\"' || {extra} || '/>'"
    rows = [
        f"SELECT DISTINCT doc_id, 0 AS kind, 0 AS n, 0 AS part, " + item("'nav'", "'text/nav.xhtml'", "'application/xhtml+xml'", "' properties=\"nav\"'") + " AS item FROM ch",
        f"SELECT DISTINCT doc_id, {5 if one else 1}, 0, 0, " + item("'css'", "'styles/style.css'", "'text/css'") + " FROM ch",
        f"SELECT doc_id, {place}, chapter_no, 0, " + item(i, "'text/' || chapter_id || '.xhtml'", "'application/xhtml+xml'", f"' media-overlay=\"' || {mo} || '\"'") + " FROM ch",
        f"SELECT doc_id, {place}, chapter_no, 1, " + item(mo, "'smil/' || chapter_id || '.smil'", "'application/smil+xml'") + " FROM ch",
        "SELECT doc_id, 6, n::INTEGER, 0, " + item("'img' || n", "'images/' || name", _MEDIA.format("name")) + " FROM imgs WHERE doc_id IN (SELECT doc_id FROM ch)",
    ]
    if each:
        rows.append(f"SELECT doc_id, {place}, chapter_no, 2, " + item("'audio1'" if one else "'audio_' || chapter_id", "'audio/' || audio", "'audio/mpeg'") + " FROM ch")
    elif layout == "book":
        rows.append("SELECT doc_id, 2, 0, 0, " + item("'audio'", "'audio/' || arg_min(audio, chapter_no)", "'audio/mpeg'") + " FROM ch GROUP BY doc_id")
    else:
        rows.append("SELECT doc_id, 2, n, 0, " + item("'audio' || n", "'audio/' || audio", "'audio/mpeg'") + " FROM (SELECT doc_id, audio, (row_number() OVER (PARTITION BY doc_id ORDER BY min(chapter_no)))::INTEGER AS n FROM ch GROUP BY doc_id, audio)")
    return f"""WITH {_CHAPTERS}, {_IMAGES}, ch AS (SELECT doc_id, chapter_no, chapter_id, 'part' || (chapter_no // 3) || '.mp3' AS audio, chapter_no * 61001 + doc_id AS ms FROM chapters{' WHERE chapter_no = 1' if one else ''}
), items AS ({' UNION ALL '.join(rows)}), i AS (SELECT doc_id, string_agg(item, '' ORDER BY kind, n, part) AS items FROM items GROUP BY doc_id
), s AS (SELECT doc_id, string_agg('<itemref idref="' || {"'text1'" if one else 'chapter_id'} || '"/>', '' ORDER BY chapter_no) AS refs, string_agg('<meta property="media:duration" refines="#' || {mo} || '">' || {_clock('ms')} || '</meta>', '' ORDER BY chapter_no) AS times, sum(ms)::BIGINT AS total FROM ch GROUP BY doc_id
) SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="pub-id" xml:lang="' || lang || '" prefix="media: http://www.idpf.org/epub/vocab/overlays/#"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="pub-id">book-' || doc_id
  || '</dc:identifier><dc:title>A &amp; ' || doc_id || '</dc:title><dc:language>' || lang || '</dc:language><dc:creator>B</dc:creator><meta property="schema:accessMode">textual &lt;' || doc_id || '&gt;</meta><meta property="dcterms:modified">2026-01-01T00:00:00Z</meta><meta property="media:duration">' || {_clock('total')} || '</meta>' || times
  || '<meta property="media:active-class">-epub-media-overlay-active</meta></metadata><manifest>' || items || '</manifest><spine>' || refs || '</spine></package>' AS opf FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'de' ELSE 'ja' END AS lang FROM i JOIN s USING (doc_id))"""


def _opf_layout(layout: str) -> None:
    @query(_layout_sql(layout), name=f"K08_layout_{layout}")
    def run(spark, sf):
        own = F.col("doc_id").cast("string")
        c = H.chapters(book_lines(spark, sf)).withColumn("audio", F.concat(F.lit("part"), F.floor(F.col("chapter_no") / 3).cast("string"), F.lit(".mp3")))
        c = c.withColumn("duration_ms", (F.col("chapter_no") * 61001 + F.col("doc_id")).cast("bigint"))
        access = F.array(F.struct(F.lit("accessMode").alias("key"), F.concat(F.lit("textual <"), own, F.lit(">")).alias("value")))
        meta = c.select("doc_id").distinct().select(
            "doc_id", F.concat(F.lit("A & "), own).alias("title"), F.when(F.col("doc_id") % 2 == 0, "de").alias("lang"),
            F.concat(K.optional_elements(creator=F.lit("B"), publisher=F.lit("")), K.accessibility_elements(access)).alias("optional"))
        return K.package_document(c, _images(spark, sf), meta, T.timestamp(F.lit(1767225600)), F.concat(F.lit("book-"), own), layout)


for _layout in ("book", "chapter", "files", "single"):
    _opf_layout(_layout)


@query()
def A16_balanced_ranges(spark, sf):
    """The first half of each paragraph, cut wherever it falls, and where it must end to close what it opens."""
    p = D.paragraphs_html(D.table(spark, sf, "pages"))
    p = p.withColumn("para", F.concat(F.lit("<strong>"), F.replace("para", F.lit(" t"), F.lit(" <em>t</em>")), F.lit("</strong>")))
    half = F.floor(F.length("para") / 2).cast("int")
    return p.select("page_id", "para_no", half.alias("cut"), T.balanced_end(F.col("para"), F.lit(0), half).alias("end"))
