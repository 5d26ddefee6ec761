"""Views of driver tables that hold what the operators work on: lines, marked-up text, books, timed words.

Each has a Spark and an SQL form that give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0, blank lines counted), line without blanks around it; blank lines dropped."""
    d = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    return d.filter(T.not_blank(F.col("line"))).withColumn("line", T.stripped(F.col("line")))


def lines_sql(source: str = "documents", key: str = "doc_id", text: str = "text", name: str = "lines") -> str:
    return f"""{name} AS (
  SELECT doc_id, (i - 1)::INTEGER AS line_no, regexp_replace(t, '{X.BLANKS}', '', 'g') AS line FROM (
    SELECT {key} AS doc_id, unnest(string_split(coalesce({text}, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce({text}, ''), chr(10)), 1) AS i FROM {source})
  WHERE regexp_matches(t, '[^ \\t\\r\\f\\n]'))"""


_CJK = ("0123456789()-.,qxzkvw", "０１２３４５６７８９（）—。、①⑩Ⅳ⑫ⓒ〜")


def cjk(docs: DataFrame) -> DataFrame:
    """doc_id, text with digits, punctuation and some letters as full-width, circled, roman and dash characters."""
    return docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), *_CJK).alias("text"))


CJK_SQL = f"cjk AS (SELECT doc_id, translate(coalesce(text, ''), '{_CJK[0]}', '{_CJK[1]}') AS text FROM documents)"

_FORMS = [("**", "**"), ("[", "](-"), ("[", "](+"), ("[", "]{.underline}"), ("[", "]{.frame}"), ("~", "~"), ("^", "^"), ("![", "](img/")]


def markup(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line whose second word is set in one of eight notations."""
    d = lines(docs).withColumn("w", F.split_part("line", F.lit(" "), F.lit(2)))
    head = F.split_part("line", F.lit(" "), F.lit(1))
    rest = F.substring(F.col("line"), F.length(head) + F.length("w") + 2, F.length("line"))
    word = F.lit(None).cast("string")
    for i, (a, b) in reversed(list(enumerate(_FORMS))):
        close = F.concat(F.lit(b), F.reverse("w"), F.lit(")")) if b in ("](-", "](+") else F.concat(F.lit(b), F.col("w"), F.lit(".png)")) if i == 7 else F.lit(b)
        word = F.when((F.col("doc_id") + F.col("line_no")) % 8 == i, F.concat(F.lit(a), F.col("w"), close)).otherwise(word)
    return d.select("doc_id", "line_no", F.when(F.col("w") == "", F.col("line")).otherwise(F.concat(head, F.lit(" "), word, rest)).alias("line"))


def markup_sql() -> str:
    cases = []
    for i, (a, b) in enumerate(_FORMS):
        close = f"'{b}' || reverse(w) || ')'" if b in ("](-", "](+") else f"'{b}' || w || '.png)'" if i == 7 else f"'{b}'"
        cases.append(f"WHEN {i} THEN '{a}' || w || {close}")
    return f"""{lines_sql(name="plain_lines")}, markup AS (
  SELECT doc_id, line_no, CASE WHEN w = '' THEN line ELSE split_part(line, ' ', 1) || ' ' || CASE (doc_id + line_no) % 8 {' '.join(cases)} END
    || substr(line, length(split_part(line, ' ', 1)) + length(w) + 2) END AS line
  FROM (SELECT *, split_part(line, ' ', 2) AS w FROM plain_lines))"""


def books(talk: DataFrame, wild: bool = False) -> DataFrame:
    """doc_id, text: one marked-up book for each conversation, a heading for each turn. wild: levels that break the
    hierarchy; else a title at level 1 and turns at 2 to 4."""
    level = 1 + (F.col("conv_id") * 7 + F.col("turn") * 3) % 5 if wild else 2 + F.col("turn") % 3
    part = F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"])
    joined = F.array_join(parts, "\n")
    title = F.lit("") if wild else F.concat(F.lit("# conv "), F.col("conv_id").cast("string"), F.lit("\n"))
    return talk.groupBy("conv_id").agg(joined.alias("body")).select(F.col("conv_id").alias("doc_id"), F.concat(title, F.col("body")).alias("text"))


def books_sql(wild: bool = False) -> str:
    level = "1 + (conv_id * 7 + turn * 3) % 5" if wild else "2 + turn % 3"
    title = "''" if wild else "'# conv ' || conv_id || chr(10)"
    return f"""books AS (
  SELECT conv_id AS doc_id, {title} || string_agg(repeat('#', ({level})::INTEGER) || ' ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)"""


def segments(ln: DataFrame) -> DataFrame:
    """Lines cut after each delimiter: doc_id, line_no, seg_no, seg."""
    cut = F.regexp_extract_all("line", F.lit(f"([^{X.SPLIT}]*[{X.SPLIT}]|[^{X.SPLIT}]+$)"), F.lit(1))
    return ln.select("doc_id", "line_no", F.posexplode(cut).alias("seg_no", "seg"))


def segments_sql(name: str = "segments", source: str = "lines") -> str:
    p = f"([^{X.SPLIT}]*[{X.SPLIT}]|[^{X.SPLIT}]+$)"
    return f"""{name} AS (
  SELECT doc_id, line_no, (i - 1)::INTEGER AS seg_no, seg FROM (
    SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{p}', 1)) AS seg, generate_subscripts(regexp_extract_all(line, '{p}', 1), 1) AS i FROM {source}))"""


def words(seg: DataFrame) -> DataFrame:
    """doc_id, line_no, seg_no, word_no, word: what stands between blanks in a segment."""
    return seg.select("doc_id", "line_no", "seg_no", F.posexplode(F.regexp_extract_all("seg", F.lit("([^ ]+)"), F.lit(1))).alias("word_no", "word"))


WORDS_SQL = """words AS (
  SELECT doc_id, line_no, seg_no, (i - 1)::INTEGER AS word_no, word FROM (
    SELECT doc_id, line_no, seg_no, unnest(regexp_extract_all(seg, '([^ ]+)', 1)) AS word, generate_subscripts(regexp_extract_all(seg, '([^ ]+)', 1), 1) AS i FROM segments))"""


def intervals(w: DataFrame) -> DataFrame:
    """A synthetic aligner: words in order, 80 ms a character, 40 ms of silence after each segment, every 11th word
    unknown. doc_id, line_no, seg_no, word_no, idx, label, begin_ms, end_ms, word, length. One exchange by document."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("line_no", "seg_no", "word_no")
    w = w.withColumn("idx", F.row_number().over(order) - 1)
    w = w.withColumn("cost", (F.length("word") * 80).cast("bigint")).withColumn("gap", F.when((F.col("word_no") == 0) & (F.col("idx") > 0), 40).otherwise(0))
    end = F.sum(F.col("cost") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    label = F.when(F.col("idx") % 11 == 10, "<unk>").otherwise(F.lower("word"))
    out = w.withColumn("end_ms", end).withColumn("label", label).withColumn("length", F.length("word"))
    return out.select("doc_id", "line_no", "seg_no", "word_no", "idx", "label", (F.col("end_ms") - F.col("cost")).alias("begin_ms"), "end_ms", "word", "length")


INTERVALS_SQL = """numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no, word_no) - 1)::INTEGER AS idx FROM words
), costed AS (SELECT *, length(word) * 80 AS cost, CASE WHEN word_no = 0 AND idx > 0 THEN 40 ELSE 0 END AS gap FROM numbered
), intervals AS (
  SELECT doc_id, line_no, seg_no, word_no, idx, CASE WHEN idx % 11 = 10 THEN '<unk>' ELSE lower(word) END AS label,
    (sum(cost + gap) OVER (PARTITION BY doc_id ORDER BY idx) - cost)::BIGINT AS begin_ms, (sum(cost + gap) OVER (PARTITION BY doc_id ORDER BY idx))::BIGINT AS end_ms FROM costed)"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(words(segments(lines(table(spark, sf_dir, "documents")))))


TIMED_SQL = ", ".join([lines_sql(), segments_sql(), WORDS_SQL, INTERVALS_SQL])


def paragraphs_html(pages: DataFrame) -> DataFrame:
    """page_id, para_no, html of each p element, blanks around it dropped."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("para_no", "para")).withColumn("para", T.swap(F.col("para"), X.EDGES, ""))


PARAGRAPHS_SQL = r"""paras AS (
  SELECT page_id, (i - 1)::INTEGER AS para_no, regexp_replace(para, '^[ \t\r\f\n]+|[ \t\r\f\n]+$', '', 'g') AS para FROM (
    SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?s)<p[^>]*>(.*?)</p>', 1)) AS para, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?s)<p[^>]*>(.*?)</p>', 1), 1) AS i FROM pages))"""
