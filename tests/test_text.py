"""Worked cases of normalisation, predicates, structure and navigation."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import lookups as J
from lectern.operators import structure as H
from lectern.plans import package as K


def on(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.strip_to_reading, "[首都](-しゅと)直下", "しゅと直下"),
        (T.strip_for_display, "[首都](-しゅと)直下", "首都直下"),
        (T.strip_to_reading, "[2^10^](+にのじゅうじょう)", "にのじゅうじょう"),
        (T.strip_for_display, "[2^10^](+にのじゅうじょう)", "210"),
        (T.normalize_text, "H~2~O", "H2O"),
        (T.normalize_text, "**重要**", "重要"),
        (T.strip_to_reading, "![alt](p.png)x", "altx"),
        (T.strip_for_display, "![alt](p.png)x", "x"),
        (T.normalize_text, "①②③", "いちにさん"),
        (T.normalize_text, "２０２５年（令和７年）", "にぜろにご年 令和なな年 "),
        (T.normalize_xhtml, "２０２５年（令和７年）", "2025年(令和7年)"),
        (T.strip_to_reading, "[a [b](-c) d]{.underline}", "a c d"),
        (T.heading_level, "  ## Chapter ", 2),
        (T.heading_level, "###### x", 0),
        (T.heading_level, "#x", 0),
        (T.heading_text, "# Title  ", "Title"),
        (T.unclosed, "a **b", True),
        (T.unclosed, "a **b** c", False),
        (T.unclosed, "[open", True),
        (T.unclosed, "[open]{.frame}", False),
        (T.ends_group, "go.", True),
        (T.ends_group, "a]{.", False),
        (T.matching_key, "A b。'c\"(d)", "Abcd"),
        (T.render_flat, 'a **b** <"c\'>', "a <strong>b</strong> &lt;&quot;c&#x27;&gt;"),
        (lambda c: T.change_suffix(c, ".mp3"), "dir.d/book.txt", "dir.d/book.mp3"),
        (T.media_type, "A.JPG", "image/jpeg"),
        (T.media_type, "a", "application/octet-stream"),
        (T.has_math, "$5 and $10", True),
    ],
)
def test_case(spark, f, given, want):
    assert on(spark, f, given, None) == [want, None] or f is T.media_type and on(spark, f, given) == [want]


def test_natural_order(spark):
    names = ["f10.txt", "f2.txt", "F1.txt", "9", "a"]
    keys = on(spark, T.natural_key, *names)
    assert [n for _, n in sorted(zip(keys, names, strict=True))] == ["9", "a", "F1.txt", "f2.txt", "f10.txt"]


def test_clock(spark):
    got = spark.createDataFrame([(83456,), (3_600_000 * 11 + 5,)], "ms bigint").select(T.clock(F.col("ms")).alias("c"), T.seconds(F.col("ms")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("0:01:23.456", "83.456"), ("11:00:00.005", "39600.005")]


def tree_by_stack(levels):
    """Parents by a stack; kept until a heading whose level is not below the root's."""
    stack, out, alive = [], [], True
    for n, level in enumerate(levels, 1):
        while stack and stack[-1][1] >= level:
            stack.pop()
        if n > 1 and level <= levels[0]:
            alive = False
        out.append((n, stack[-1][0] if stack else None, alive))
        stack.append((n, level))
    return out


def nested(items):
    """Nested lists of (id, level), by recursion."""

    def build(i, above):
        out = "<ol>"
        while i < len(items) and items[i][1] > above:
            out += f'<li><a href="chapter{items[i][0]}.xhtml">t{items[i][0]}</a>'
            level = items[i][1]
            i += 1
            if i < len(items) and items[i][1] > level:
                inner, i = build(i, level)
                out += inner
            out += "</li>"
        return out + "</ol>", i

    return build(0, 0)[0]


def test_hierarchy_and_navigation(spark):
    rng = random.Random(1)
    trees = {d: [rng.randint(1, 5) for _ in range(rng.randint(1, 9))] for d in range(60)} | {100: [1, 2, 3, 1, 2], 101: [1, 2, 3, 2, 3]}
    rows = [(d, i, "#" * level + f" t{i + 1}") for d, levels in trees.items() for i, level in enumerate(levels)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    got = {}
    for r in H.headings(lines).collect():
        got.setdefault(r.doc_id, []).append((r.h_no, r.parent, r.kept))
    assert {d: sorted(x, key=lambda t: t[0]) for d, x in got.items()} == {d: tree_by_stack(levels) for d, levels in trees.items()}
    navs = {r.doc_id: r.nav for r in K.nav_nested(H.chapters(lines)).collect()}
    for d, levels in trees.items():
        kept = [(n, levels[n - 1]) for n, _, k in tree_by_stack(levels) if k]
        assert navs[d] == nested(kept)


def test_metadata(spark):
    lines = ["a line without colon", "author: A: B", "publisher:", "title： x ", "accessMode:text", "title:y", "accessMode:visual", "other:z"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "book_id int, line_no int, line string")
    r = J.metadata(df).collect()[0]
    assert (r.title, r.creator, r.publisher, r.accessibility) == ("y", "A: B", None, "accessMode=text;accessMode=visual")


def test_unwrap(spark):
    got = H.unwrapped(spark.createDataFrame([(1, "a\nb\n\nc"), (2, None)], "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.run, r.paragraph) for r in got) == [(1, 0, "a b"), (1, 1, "c")]
