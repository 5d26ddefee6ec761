"""Operators that no SQL says, on small inputs whose results are known."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align as L
from lectern.operators import lookups as J
from lectern.operators import structure as H
from lectern.plans import book as B
from lectern.sources import files as S
from lectern.sources import sinks as Z


def test_natural_order(spark):
    names = ["f10.txt", "f2.txt", "F1.txt", "(a).txt", "1.txt", "x100000000000000000000001", "x100000000000000000000000", "x007", "x8"]
    d = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n")))
    assert [r.n for r in d.collect()] == ["1.txt", "(a).txt", "F1.txt", "f2.txt", "f10.txt", "x007", "x8", "x100000000000000000000000", "x100000000000000000000001"]


def test_nested_rendering_and_speakable_characters(spark):
    d = spark.createDataFrame([(1, 0, "[a **b**]{.underline} <c>")], "doc_id long, line_no int, line string")
    assert H.rendered(d).first().out == '<span style="text-decoration: underline;">a <strong>b</strong></span> &lt;c&gt;'
    c = spark.createDataFrame([("㐀",), ("。",)], "t string").select(T.speakable(F.col("t")).alias("s")).collect()
    assert [r.s for r in c] == [True, False]


def test_stems_and_sidecars(spark):
    a = spark.createDataFrame([(1, "b/x.md"), (2, "b/y.md"), (3, "c/y.md"), (4, "z.md")], "id long, path string")
    b = spark.createDataFrame([(10, "x.mp3"), (11, "y.mp3"), (12, "w.mp3")], "no long, audio string")
    assert [(r.stem, r.id, r.no) for r in J.by_stem(a, b, "path", "audio").collect()] == [("x", 1, 10)]
    assert {(r.stem, r.n_left, r.n_right) for r in J.by_stem_audit(a, b, "path", "audio").collect()} == {("y", 2, 1), ("z", 1, 0), ("w", 0, 1)}
    books = a.select(F.col("id").alias("book_id"), "path")
    sides = spark.createDataFrame([("b/x_metadata.txt", "X"), ("b/y_metadata.txt", None), ("c/y_metadata.txt", "Y"), ("c/y_metadata.txt", "Y")], "path string, title string")
    assert [(r.book_id, r.title) for r in J.book_metadata(books, sides).collect()] == [(1, "X")]
    assert {(r.book_id, r.fault) for r in J.book_metadata_audit(books, sides).collect()} == {(2, "title missing"), (3, "several files"), (4, "file missing")}


def test_cursor_is_found_again(spark):
    words = "one two three four five six seven eight nine ten".split()
    i = spark.createDataFrame([(1, k, w, 100 * k, 100 * k + 90) for k, w in enumerate(words)], "doc_id long, idx int, label string, begin_ms long, end_ms long")
    p = spark.createDataFrame([(1, 0, "five six seven", 1), (1, 1, "two three", 99), (1, 2, "zzz", 4)], "doc_id long, line_no int, line string, at int")
    assert {r.line_no: r.cursor for r in L.resync_cursors(p, i).collect()} == {0: 4, 1: 99, 2: 4}  # behind the end nothing is earlier, so the cursor stays


def test_chapters_of_a_book(spark):
    lines = spark.createDataFrame([(1, 0, "# The title"), (1, 1, "One, two."), (1, 2, "## Next & last"), (1, 3, "。")], "doc_id long, line_no int, line string")
    c = {r.chapter_no: r for r in B.assemble(B.text_spans(lines), H.chapters(lines)).collect()}
    assert '<h1><span id="s0001">The title</span></h1><p><span id="s0002">One,</span><span id="s0003"> two.</span></p>' in c[1].xhtml
    assert c[1].n_pars == 3 and c[1].smil.count("chapter1.xhtml#s000") == 3
    assert "<h2><span id=\"s0004\">Next &amp; last</span></h2>" in c[2].xhtml and c[2].n_pars >= 1


def test_books_by_form_and_pieces(spark, tmp_path):
    (tmp_path / "a2.md").write_text("# T\n\nbody\n")
    (tmp_path / "a10.txt").write_text("plain\n")
    (tmp_path / "a_metadata.txt").write_text("title: x\n")
    (tmp_path / "b.xml").write_text("<r><title1>T</title1><p>one. two</p><p>three</p></r>")
    rows = S.load_books(spark, str(tmp_path), "commonmark").collect()
    assert sorted(r.line for r in rows) == ["# T", "body", "plain"]
    v = S.xml_view(S.load_books(spark, str(tmp_path), "xml")).first()
    assert v.title == "T" and v.n_sections == 1 and len(v.paragraphs) == 2
    p = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a"), (1, 0, 2, "")], "doc_id long, file_no int, line_no int, line string")
    assert [(r["name"], r["value"]) for r in Z.pieces(p).collect()] == [("1_0.txt", "a\nb")]
