"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's rate is its target share of all characters over its present share: the mean number of times that each of its
documents is repeated. A uniform number in [0, 1) from a hash of seed, source, id and text is put through the inverse of
the Poisson distribution with that mean; the document is repeated so many times and the copies are dealt out and sorted
by a hash of their own, a global shuffle that another run repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """source, n_docs, size (characters), rate. Weights are shares in any unit; a source that they leave out has rate 0.
    Without weights a source's target is its size to the power of the temperature (0.5: its square root), which lifts
    small sources. Sources without characters have rate 1."""
    size = F.sum(F.length(F.coalesce(F.col("text"), F.lit("")))).cast("bigint")
    by = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n_docs"), size.alias("size"))
    if weights is None:
        target = F.pow(F.col("size").cast("double"), F.lit(temperature)) if temperature != 0.5 else F.sqrt(F.col("size").cast("double"))
    else:
        given = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]) if weights else F.create_map()
        target = F.coalesce(given[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    by = by.withColumn("target", target)
    # as decimals, so that the sum does not depend on the order of sources
    total = by.agg(F.sum("size").cast("double").alias("all_size"), F.sum(F.col("target").cast("decimal(34,14)")).cast("double").alias("all_target"))
    rate = F.col("target") / F.col("all_target") * F.col("all_size") / F.col("size")
    out = by.join(F.broadcast(total))  # one row
    return out.select("source", "n_docs", "size", F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(1.0).alias("rate"))


def _bits(*parts: Column) -> Column:
    """52 bits of an MD5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("bigint")


def poisson(u: Column, rate: Column) -> Column:
    """The least k with P(X <= k) > u for a Poisson variable of mean `rate`. Means above 16 are the sum of parts of 16
    at most, each with a number of its own hashed from u, so that no probability underflows."""
    def one(v: Column, mean: Column) -> Column:
        steps = F.sequence(F.lit(1), (F.lit(30) + 4 * mean).cast("int"))
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

        def step(a: Column, i: Column) -> Column:
            p = a["p"] * mean / i
            return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.when(a["c"] <= v, i).otherwise(a["k"]).cast("int").alias("k"))

        return F.aggregate(steps, start, step, lambda a: a["k"])

    parts = F.greatest(F.ceil(rate / 16), F.lit(1)).cast("int")
    own = lambda i: _bits(u.cast("string"), i.cast("string")) / F.lit(float(1 << 52))
    several = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, i: a + one(own(i), rate / parts))
    return F.when(rate <= 0, 0).when(parts == 1, one(u, rate)).otherwise(several)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 42) -> DataFrame:
    """Rows of docs, each repeated by its count, in global random order: all columns, then copy, rate and shuffle_key.

    Null and empty sources are one source; null text has no characters; null ids are hashed as empty. Equal rows are one
    document held several times: they share one draw and one key, whatever files or tasks hold them, so that a run can be
    repeated; deduplicate first where that is not meant. Rows whose count is 0 do not appear: over a source, the sum of counts follows its target. An
    empty table gives no rows. Names that clash (copy, rate, shuffle_key) are those of the operator in the result. The
    table of rates is written first, so that Spark knows its size: it is broadcast if small, else joined by a shuffle in
    which Spark splits a hot source's rows.
    """
    own = [c for c in docs.columns if c not in ("copy", "rate", "shuffle_key")]
    by = materialise(rates(docs, weights, temperature).select(F.col("source").alias("rated"), "rate"), "rates")
    row = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"))
    key = F.coalesce(F.col("row.source").cast("string"), F.lit(""))
    bits = _bits(F.lit(str(seed)), key, F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")))
    rated = row.join(by, key == F.col("rated")).withColumn("bits", bits)
    counted = rated.withColumn("n", poisson(F.col("bits") / F.lit(float(1 << 52)), F.col("rate"))).filter("n > 0")
    copies = counted.select("row", "rate", "bits", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = _bits(F.lit("order"), F.col("bits").cast("string"), F.col("copy").cast("string"))
    out = copies.withColumn("shuffle_key", order).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return out.select("row.*", "copy", "rate", "shuffle_key")


ORACLE = """
WITH sizes AS (
  SELECT coalesce(source, '') AS source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY 1
), rated AS (
  SELECT source, CASE WHEN size > 0 THEN sqrt(size::DOUBLE) / (SELECT sum(sqrt(size::DOUBLE)) FROM sizes) * (SELECT sum(size)::DOUBLE FROM sizes) / size ELSE 1.0 END AS rate
  FROM sizes
), numbered AS (
  SELECT d.doc_id, d.source, d.lang, d.text, rate,
    ('0x' || substr(md5(concat_ws('|', '42', coalesce(d.source, ''), coalesce(d.doc_id::VARCHAR, ''), md5(coalesce(d.text, '')))), 1, 13))::BIGINT AS bits
  FROM documents d JOIN rated r ON coalesce(d.source, '') = r.source
), cumulated AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM (
    SELECT source, k, CASE WHEN rate > 0 THEN exp(-rate + k * ln(rate) - lgamma(k + 1)) ELSE (k = 0)::INT END AS p FROM rated, range(0, 95) t(k))
), counted AS (
  SELECT n.*, (SELECT count(*) FROM cumulated c WHERE c.source = coalesce(n.source, '') AND c.c <= n.bits / 4503599627370496.0) AS n FROM numbered n
), copies AS (
  SELECT doc_id, source, lang, text, rate, bits, unnest(range(1, n + 1))::INTEGER AS copy FROM counted WHERE n > 0
)
SELECT doc_id, source, lang, text, copy, round(rate, 9) AS rate,
  ('0x' || substr(md5(concat_ws('|', 'order', bits::VARCHAR, copy::VARCHAR)), 1, 13))::BIGINT AS shuffle_key
FROM copies
"""
