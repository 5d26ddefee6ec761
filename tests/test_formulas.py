"""Formulas put in place, and ranges of XHTML that close what they open."""

import random
import re
import time

from pyspark.sql import functions as F

from lectern import catalog
from lectern.functions import text as T
from lectern.operators import formulas as M

from .conftest import SF


def test_formulas_are_numbered_spoken_and_shown(spark):
    texts = [(1, "a $ x $ b $$y\nz$$ c $w$"), (2, None), (3, "no formula"), (4, "$a $$b$$ c$ \x02MATH9\x02"), (5, "$x$ and $x$, 5$")]
    m = M.substituted(spark.createDataFrame(texts, "doc_id int, text string"))
    got = {r.doc_id: (r.text, [(f.tex, f.display) for f in r.formulas]) for r in m.collect()}
    assert got[1] == ("a \x02MATH1\x02 b \x02MATH0\x02 c \x02MATH2\x02", [("y\nz", True), ("x", False), ("w", False)])
    assert got[2] == ("", []) and got[3] == ("no formula", [])
    assert got[4] == ("\x02MATH1\x02 \x02MATH9\x02", [("b", True), ("a \x02MATH0\x02 c", False)])
    assert got[5][0] == "\x02MATH0\x02 and \x02MATH1\x02, 5$"
    made = spark.createDataFrame([("x", False, "<x/>", "ex"), ("w", True, "<w/>", "never")], "tex string, display boolean, mathml string, speech string")
    c = M.converted(m, made)
    out = {r.doc_id: (r.said, r.shown) for r in c.select("doc_id", M.filled(F.col("text"), "speech").alias("said"), M.filled(F.col("text"), "mathml").alias("shown")).collect()}
    fault = lambda x: f'<math xmlns="http://www.w3.org/1998/Math/MathML"><merror><mtext>{x}</mtext></merror></math>'
    assert out[1] == ("a ex b y\nz c w", f"a <x/> b {fault('y' + chr(10) + 'z')} c {fault('w')}")
    assert out[2] == ("", "") and out[3][0] == "no formula" and out[4][0] == "a \x02MATH0\x02 c " and out[5][0] == "ex and ex, 5$"
    assert M.converted(m.limit(0), made).collect() == []


def test_many_formulas_in_one_text(spark):
    """Work that grows with the square of a text's formulas would take minutes here."""
    n = 12_000
    m = M.substituted(spark.createDataFrame([(1, "$x$ $$y$$\n" * n)], "doc_id int, text string"))
    made = spark.createDataFrame([("x", False, "<x/>", "ex"), ("y", True, "<y/>", "why")], "tex string, display boolean, mathml string, speech string")
    began = time.time()
    out = M.converted(m, made).select(M.filled(F.col("text"), "speech").alias("said"), F.size("entries").alias("n")).first()
    assert out.n == 2 * n and out.said == "ex why\n" * n
    assert time.time() - began < 30


def test_numbers_that_are_no_placeholder_of_the_text(spark):
    m = M.substituted(spark.createDataFrame([(1, "$x$ \x02MATH99999999999\x02\x02MATH2147483647\x02.")], "doc_id int, text string"))
    made = spark.createDataFrame([("x", False, "<x/>", "ex")], "tex string, display boolean, mathml string, speech string")
    assert M.converted(m, made).select(M.filled(F.col("text"), "speech").alias("said")).first().said == "ex ."


def test_the_formula_queries_have_formulas(spark):
    assert catalog.QUERIES["E01_substituted"](spark, SF).agg(F.sum("n_shown"), F.sum("n")).first()[1] > 1000


def closed(x, start, end):
    """The rule, tag by tag."""
    waiting = []
    for m in re.finditer(r"<(/?)(ruby|u|strong|sub|sup|em)\b[^>]*>", x[start:end]):
        if not m[1]:
            waiting.append(m[2])
        elif waiting and waiting[-1] == m[2]:
            waiting.pop()
    while waiting:
        close = f"</{waiting.pop()}>"
        at = x.find(close, end)
        end = end if at < 0 else at + len(close)
    return end


def test_ranges_end_where_their_tags_do(spark):
    rng = random.Random(3)
    parts = ["<em>", "</em>", "<strong>", "</strong>", '<u class="a">', "</u>", "<rt>", "</rt>", "word", " ", "a&b", "<ruby>", "</ruby>"]
    rows = []
    for _ in range(300):
        x = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        a = rng.randint(0, len(x))
        rows.append((x, a, rng.randint(a, len(x))))
    rows += [("", 0, 0), ("<em>a</em>", 0, 4), ("<em>a", 0, 5)]
    df = spark.createDataFrame(rows, "x string, a int, b int")
    for r in df.withColumn("got", T.balanced_end(F.col("x"), F.col("a"), F.col("b"))).collect():
        assert r.got == closed(r.x, r.a, r.b), r
    out = catalog.QUERIES["A16_balanced_ranges"](spark, SF).agg(F.count("*"), F.count(F.when(F.col("end") > F.col("cut"), 1))).first()
    assert out[0] > 0 and out[1] > 0


def test_names_and_times(spark):
    df = spark.range(1).select(T.timestamp(F.lit(0)).alias("a"), T.timestamp(F.lit(-1)).alias("b"), T.output_name(F.lit("x/y.z.txt"), F.lit("word"), F.lit(1767225661)).alias("c"), T.book_title(F.lit("")).alias("d"))
    assert tuple(df.first()) == ("1970-01-01T00:00:00Z", "1969-12-31T23:59:59Z", "y.z_word_20260101_000101.epub", "Untitled")
