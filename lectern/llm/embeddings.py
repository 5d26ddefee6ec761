"""Embedding near-dedup by spherical-cap filters.

A filter is a direction on the sphere; a vector passes it when their inner product reaches a threshold, that is, when it
lies in the direction's cap. Directions form a random product code: the space, turned by random signs and a Hadamard
transform, is cut into blocks, each block has a small random code, and a direction is one codeword from each. A vector's
filters are list-decoded: codewords are taken block by block, and a partial sum goes on only if the best rest could still
reach the threshold. Two vectors of high cosine share filters with high probability; vectors are joined on filters and
verified by their cosine in double precision.

A pair that shares several filters counts in the least of them only, which is known from the two lists of filters, so no
pair is written out: each tile sums links per vector and gives a spanning forest. Equal vectors are one node with a
weight. Filters with many vectors are cut into tiles of bounded size, every pair of vectors in one tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components


class Rules(NamedTuple):
    """cosine: of a link. blocks, words: of the product code, words to the power blocks directions. deviations: the caps'
    threshold, in standard deviations of a random vector's inner product. least: filters of a vector at least; those with
    fewer in their caps take their nearest directions. tile: vectors on each side of a tile. share: filters of a random
    vector, occupancy: most random vectors in a filter, which together give words and deviations for a table's size."""

    cosine: float = 0.9
    blocks: int = 2
    words: int = 128
    deviations: float = 3.0
    least: int = 12
    tile: int = 512
    seed: int = 7
    share: float = 32.0
    occupancy: float = 1000.0

    def scaled(self, n: int) -> Rules:
        """For n vectors: so many words that a filter holds some `occupancy` of them, and caps that leave each vector in
        about `share` filters. The smallest code does up to 512,000. Tails are thinner on the sphere than on the line, so
        with large codes `least` decides for most vectors; it doubles."""
        words = self.words
        while words**self.blocks * self.occupancy < self.share * n:
            words *= 2
        if words == self.words:
            return self
        return self._replace(words=words, least=2 * self.least, deviations=NormalDist().inv_cdf(1 - self.share / words**self.blocks))


class Code:
    """Product code for vectors of one dimension."""

    def __init__(self, dim: int, rules: Rules):
        self.rules, self.size = rules, 1 << max(1, (max(dim, rules.blocks) - 1).bit_length())
        rng = np.random.default_rng([rules.seed, dim])
        self.signs = rng.choice([-1.0, 1.0], self.size)
        self.width = self.size // rules.blocks
        words = rng.standard_normal((rules.blocks, rules.words, self.width))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True) / np.sqrt(rules.blocks)
        self.cut = rules.deviations / np.sqrt(self.size)

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors under random signs and a Hadamard transform, padded to a power of two."""
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        y *= self.signs
        h = 1
        while h < self.size:
            y = y.reshape(len(x), -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), self.size)
            h *= 2
        return y / np.sqrt(self.size)

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, its filters in ascending order."""
        y = self.turned(x).reshape(len(x), self.rules.blocks, self.width)
        scores = np.einsum("nbd,bwd->nbw", y, self.words)
        out = []
        for s in scores:
            got = self._decode(s, self.cut)
            cut = self.cut
            while len(got) < min(self.rules.least, self.rules.words**self.rules.blocks):
                cut -= 0.1 * max(self.cut, 1e-3)
                got = self._decode(s, cut)
            out.append(np.sort(got))
        return out

    def _decode(self, s: np.ndarray, cut: float) -> np.ndarray:
        rest = np.concatenate((np.cumsum(s.max(axis=1)[::-1])[::-1], [0.0]))
        ids, sums = np.zeros(1, np.int64), np.zeros(1)
        for b in range(len(s)):
            sums = sums[:, None] + s[b]
            keep = np.nonzero(sums + rest[b + 1] >= cut)
            ids = ids[keep[0]] * self.rules.words + keep[1]
            sums = sums[keep]
        return ids


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row that it reaches."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(table: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each row of table: vec_id, n_links, component_id, kept.

    n_links: other rows at a cosine of rules.cosine or more that share a filter; component_id: least vec_id reachable;
    kept: vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are their own component. Vectors of different lengths never link. Equal rows are linked rows; null ids
    take part but name no component. An empty table gives no rows; other columns are ignored.
    """
    # single precision is exchanged as it is, and computed in double
    single = table.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = F.col("v").cast("array<float>") if single else F.col("v")
    v = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    # two keys: equal vectors have equal texts; a vector's node is named by both hashes
    node = F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b"))
    v = v.withColumn("node", F.when(good, F.concat_ws(":", node.getField("a").cast("string"), node.getField("b").cast("string"))))
    nodes = v.filter("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
    nodes = nodes.withColumn("id", F.monotonically_increasing_id())
    nodes = materialise(nodes, "vectors")

    rules = rules.scaled(nodes.count())

    def passes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, Code] = {}
        for b in batches:
            for dim, part in b.groupby(b["v"].map(len)):
                code = codes.setdefault(dim, Code(dim, rules))
                for at in range(0, len(part), 500):
                    some = part.iloc[at : at + 500]
                    yield pd.DataFrame({"id": some["id"], "dim": dim, "filters": [f.tolist() for f in code.filters(_unit(some["v"]))]})

    listed = materialise(nodes.select("id", "v").mapInPandas(passes, "id bigint, dim int, filters array<bigint>"), "filters")
    spread = listed.select("id", "dim", F.posexplode("filters").alias("rank", "filter"))
    sizes = spread.groupBy("dim", "filter").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialise(sizes.withColumn("parts", F.ceil(F.col("n") / rules.tile).cast("int")), "filter-sizes")
    # ids go through the join alone; a vector and the list of its filters are fetched once, before it is dealt to tiles
    held = spread.join(sizes, ["dim", "filter"]).groupBy("id").agg(F.collect_list(F.struct("rank", "filter", "parts")).alias("shared"))
    whole = nodes.select("id", "weight", vector.alias("v")).join(listed, "id").join(held, "id").select("id", "weight", "v", "dim", "filters", F.explode("shared").alias("s"))
    parts, p = F.col("s.parts"), F.pmod(F.xxhash64("id"), F.col("s.parts")).cast("int")
    tiles = whole.select(
        "dim", F.col("s.filter").alias("filter"), "id", "weight", "v", p.alias("p"), F.slice("filters", F.lit(1), F.col("s.rank")).alias("earlier"),
        F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least(q, p).alias("lo"), F.greatest(q, p).alias("hi")))).alias("tile"),
    )

    def verify(x: np.ndarray, g: pd.DataFrame) -> pd.DataFrame | None:
        near = x @ x.T >= rules.cosine
        np.fill_diagonal(near, False)
        if g["lo"].iloc[0] != g["hi"].iloc[0]:  # pairs within one part belong to the tile of that part
            near &= g["p"].to_numpy()[:, None] != g["p"].to_numpy()[None, :]
        if not near.any():
            return None
        some = np.flatnonzero(near.any(axis=1))
        g, near = g.iloc[some], near[np.ix_(some, some)]
        names, place = np.unique(np.concatenate([np.asarray(e, np.int64) for e in g["earlier"]]), return_inverse=True)
        if len(names):
            member = np.zeros((len(g), len(names)), np.float32)
            member[np.repeat(np.arange(len(g)), [len(e) for e in g["earlier"]]), place] = 1
            near &= member @ member.T == 0
        ids, weights = g["id"].to_numpy(), g["weight"].to_numpy()
        order = np.argsort(ids)
        forest = np.empty(len(ids), np.int64)
        forest[order] = order[_forest(near[np.ix_(order, order)])]
        return pd.DataFrame({"id": ids, "root": ids[forest], "n": near @ weights})[near.any(axis=1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles follow each other in the sorted rows; only the last one of a batch waits for the next."""
        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            k = rest[key].to_numpy(np.int64)
            heads = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)]) if len(k) else np.zeros(0, int)
            for lo, hi in zip(heads, heads[1:], strict=False):
                if hi - lo > 1 and (out := verify(_unit(rest["v"].iloc[lo:hi]), rest.iloc[lo:hi])) is not None:
                    yield out
            if len(heads):
                rest = rest.iloc[heads[-1] :]
        if rest is not None and len(rest) > 1 and (out := verify(_unit(rest["v"]), rest)) is not None:
            yield out

    key = ["dim", "filter", "lo", "hi"]
    tiles = tiles.select("dim", "filter", "tile.lo", "tile.hi", "id", "weight", "v", "p", "earlier").repartition(*key).sortWithinPartitions(*key)
    found = materialise(tiles.mapInPandas(run, "id bigint, root bigint, n bigint"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    named = parts.join(nodes.select("id", "least"), parts["node"] == F.col("id")).drop("id")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    named = parts.join(names, "component").select(F.col("node").alias("id"), "name")
    full = nodes.select("id", "node", "least", "weight").join(counts, "id", "left").join(named, "id", "left")
    full = materialise(full.select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.least("name", "least").alias("component")), "vector-classes")
    out = v.select("vec_id", "node").join(full, "node", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))



ORACLE = """
WITH RECURSIVE unit AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), classes AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM classes c
"""
