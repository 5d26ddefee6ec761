"""Line dedup by distinct-site spread, in DataFrame functions alone.

Every line has a hash. For each hash a HyperLogLog sketch of the sites that use the line is built where the lines are
and merged by the aggregation. Lines whose estimate is well above the threshold are boilerplate, those well below are
not; between, within `band` standard errors of the sketch, the distinct sites are counted exactly. Boilerplate lines go
from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _hash(line: Column) -> Column:
    """128 bits, as two numbers: of the line, and of the line with a mark before it."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, min_sites: int = 8, min_chars: int = 1, lg_k: int = 9, band: float = 6.0) -> DataFrame:
    """h, n_sites of the lines (blanks around them aside, min_chars characters or more) that min_sites or more sites use.

    Sketches are filled before the exchange, so a line that every document holds, or a site with a third of all rows,
    sends one sketch a task.
    """
    lines = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.explode(_split(F.col("text"))).alias("line"))
    lines = lines.select("site", F.trim("line").alias("line")).filter(F.length("line") >= min_chars).select("site", _hash(F.col("line")).alias("h"))
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("n"))
    error = band * 1.04 / 2 ** (lg_k / 2)
    low, high = int(min_sites * (1 - error)), int(min_sites * (1 + error)) + 1
    spread = materialise(spread.filter(F.col("n") >= low), "line-spread")
    near = spread.filter(F.col("n") <= high).select(F.col("h").alias("near"))
    pairs = lines.join(near, F.col("h") == F.col("near"), "left_semi").groupBy("h", "site").agg(F.count("*").alias("uses"))
    exact = pairs.groupBy("h").agg(F.count("*").alias("n_sites")).filter(F.col("n_sites") >= min_sites)
    return exact.union(spread.filter(F.col("n") > high))


def dedup_lines(docs: DataFrame, min_sites: int = 8, min_chars: int = 1) -> DataFrame:
    """The rows of docs without boilerplate lines in text, all other columns, then n_lines and n_removed.

    Null text counts as empty and becomes empty: one line, which is too short to go. Null sources are one site. Equal
    rows give equal rows, an empty table none. n_lines and n_removed are the operator's where names clash. Texts of any
    length are read whole. The kept lines are found once for each distinct text that loses some, and joined back by its
    hash; Spark splits the rows of a text with many copies.
    """
    bad = materialise(boilerplate(docs, min_sites, min_chars).select(F.col("h").alias("bad")), "boilerplate")
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), F.col("text")).alias("b"))
    own = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")]).withColumn("text", F.coalesce("text", F.lit("")))
    places = own.select(key.alias("k"), F.posexplode(_split(F.col("text"))).alias("at", "line")).select("k", "at", F.trim("line").alias("line"))
    places = places.filter(F.length("line") >= min_chars).select("k", "at", _hash(F.col("line")).alias("h"))
    drop = places.join(bad, F.col("h") == F.col("bad"), "left_semi").groupBy("k").agg(F.collect_set("at").alias("drop"))
    drop = materialise(drop.withColumnRenamed("k", "dropped"), "removed-lines")
    joined = own.select(F.struct(*own.columns).alias("row"), F.col("text")).withColumn("k", key).join(drop, F.col("k") == F.col("dropped"), "left")
    lines = F.split("text", "\n", -1)
    # places to keep by a set difference, which hashes; array_except keeps the order of the first
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = F.expr("get(transform(array(split(text, '\n', -1)), l -> array_join(transform(stay, i -> get(l, i)), '\n')), 0)")
    made = joined.withColumn("stay", F.when(F.col("drop").isNotNull(), stay))
    row = F.col("row").withField("text", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept))
    return made.select(row.alias("row"), F.size(lines).alias("n_lines"), F.greatest(F.coalesce(F.size("drop"), F.lit(0)), F.lit(0)).alias("n_removed")).select("row.*", "n_lines", "n_removed")


ORACLE = """
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS source, line, pos
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), bad AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE length(trim(line, ' ')) >= 1 GROUP BY 1 HAVING count(DISTINCT source) >= 8
), kept AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON trim(l.line, ' ') = b.line
)
SELECT doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM kept GROUP BY doc_id
"""
