"""SimHash near-dedup: fingerprints, then links at a small Hamming distance found by segment popcounts.

A fingerprint is cut into blocks, each block into segments; the popcounts of the segments are its point. The Manhattan
distance of two points never exceeds the Hamming distance of the fingerprints. If it is at most k over k + 2 blocks, at
least two blocks agree in every coordinate, so the grid cell made of two blocks' coordinates is a join key: a range join
of width zero in two blocks and of width k over all. With very many fingerprints it is three of k + 3 blocks. Cells follow
each other in sorted partitions, where arrays compare whole cells at once: the Manhattan bound goes first, the exact
distance decides. Equal fingerprints are one node, so copies cost nothing. Cells with many nodes go through tiles of
bounded size which give a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise
from .components import components

SEED = 42


def fingerprints_of(data: list[bytes], shingle: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of UTF-8 texts."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, np.zeros(len(data), np.uint64)
    for k, raw in enumerate(data):
        words = raw.lower().split()  # on bytes: A-Z and ASCII white space alone
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        text = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        ends = ends[min(shingle, len(words)) - 1 :].tolist()
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            h = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], dtype="<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp (signed 64-bit) for every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fingerprints_of(list(b["raw"]), shingle).view(np.int64)})

    d = documents(docs).select("doc_id", F.col("text").cast("binary").alias("raw"))
    return d.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _blocks(n: int, segment: int) -> list[list[tuple[int, int]]]:
    """Of each of n blocks, the (shift, width) of its segments."""
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [[(s, min(segment, hi - s)) for s in range(lo, hi, segment)] for lo, hi in zip(edges, edges[1:], strict=False)]


def _coordinates(fp, block):
    """The popcounts of a block's segments, packed in as many bits as each needs; a block of 32 bits needs 32 at most."""
    out, at = F.lit(0).cast("bigint"), 0
    for shift, width in block:
        mask = (1 << width) - 1
        out = out.bitwiseOR(F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(mask))).cast("bigint"), at))
        at += (width + 1).bit_length()
    return out


def agreeing(n: int, k: int) -> int:
    """How many blocks make a cell, so that the cells of n fingerprints stay small: two hold about 2^15 cells a key, three
    2^19."""
    return 2 if n <= 1 << 22 or k + 3 > 16 else 3


def points(fp: np.ndarray, blocks: list[list[tuple[int, int]]]) -> np.ndarray:
    """The coordinates of unsigned fingerprints: a row each, the popcounts of a block's segments packed in one number."""
    out = np.zeros((len(fp), len(blocks)), np.uint64)
    for i, block in enumerate(blocks):
        for shift, width in block:
            ones = np.bitwise_count(fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.uint64)
            out[:, i] = out[:, i] << np.uint64((width + 1).bit_length()) | ones
    return out


def counts(fp: np.ndarray, blocks: list[list[tuple[int, int]]]) -> np.ndarray:
    """The popcounts of whole blocks, a row for each block."""
    masks = [sum(((1 << width) - 1) << shift for shift, width in block) for block in blocks]
    return np.array([np.bitwise_count(fp & np.uint64(m)) for m in masks], np.int8).reshape(len(blocks), len(fp))


def near_pairs(cell: np.ndarray, fp: np.ndarray, blocks: list[list[tuple[int, int]]], k: int, wide: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of rows of one cell at k or fewer bits. Rows of a cell follow each other. Cells of `wide` rows or more
    are a matrix each; the others are compared all at once, each row with the one so many rows behind it."""
    n, popcounts = len(fp), counts(fp, blocks)
    heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, n])
    behind = np.repeat(heads + sizes, sizes) - np.arange(n) - 1  # rows of the cell that follow
    at, found = np.flatnonzero(np.repeat(sizes, sizes) < wide), []
    for d in range(1, wide):
        at = at[behind[at] >= d]
        if not len(at):
            break
        # bound: how far the popcounts of the blocks lie apart, in sum
        some = at[sum((np.abs(p[at] - p[at + d]) for p in popcounts), np.zeros(len(at), np.int8)) <= k]
        some = some[np.bitwise_count(fp[some] ^ fp[some + d]) <= k]
        found.append((some, some + d))
    for lo, size in zip(heads[sizes >= wide].tolist(), sizes[sizes >= wide].tolist(), strict=True):
        own = popcounts[:, lo : lo + size]
        for top in range(0, size, 256):  # so that a matrix has 256 rows at most
            bound = sum((np.abs(p[top : top + 256, None] - p) for p in own), np.zeros((min(256, size - top), size), np.int8))
            i, j = np.nonzero(bound <= k)
            i, j = i[i + top < j] + lo + top, j[i + top < j] + lo
            near = np.bitwise_count(fp[i] ^ fp[j]) <= k
            found.append((i[near], j[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def links(nodes: DataFrame, k: int = 4, segment: int = 2, hot: int = 256, agree: int = 2) -> DataFrame:
    """nodes: fp, distinct. Edges src, dst (fingerprints) that connect all fingerprints linked at k or fewer bits.

    Of k + agree blocks at least `agree` have equal points. Cells of up to `hot` nodes give every link once; larger ones
    are cut into tiles of `hot` by `hot` nodes, every pair of nodes in one tile, each giving a spanning forest of its links.
    """
    blocks = _blocks(k + agree, segment)
    keys = list(combinations(range(len(blocks)), agree))
    point = nodes.select("fp", *[_coordinates(F.col("fp"), b).alias(f"c{i}") for i, b in enumerate(blocks)])
    named = F.explode(F.array(*[F.struct(F.lit(t).alias("key"), F.xxhash64(F.lit(t), *[f"c{i}" for i in some]).alias("cell")) for t, some in enumerate(keys)]))
    cells = point.select("fp", named.alias("at")).select("at.cell", "at.key", "fp")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    big = materialise(sizes.filter(F.col("n") > hot), "cells")
    cold = cells.join(big.select("cell"), "cell", "left_anti").repartition("cell").sortWithinPartitions("cell", "key")

    def run(batches: Iterator[pd.DataFrame], group: int = 1 << 16) -> Iterator[pd.DataFrame]:
        """Only the last cell of a group of rows waits for the next. The first equal blocks name the one cell that gives a pair."""

        def pairs(rows: np.ndarray) -> pd.DataFrame:
            cell, key, fp = rows.T
            fp = fp.astype(np.int64).view(np.uint64)
            # two keys may share a hash, so both make a cell
            i, j = near_pairs(cell ^ (key << 56), fp, blocks, k)
            same = points(fp[i], blocks) == points(fp[j], blocks)
            first = np.full(len(i), -1)
            for t, some in reversed(list(enumerate(keys))):
                first[same[:, some].all(axis=1)] = t
            own = first == key[i]
            one, two = fp[i[own]].view(np.int64), fp[j[own]].view(np.int64)
            return pd.DataFrame({"src": np.minimum(one, two), "dst": np.maximum(one, two)})

        kept: list[np.ndarray] = []
        for b in batches:
            kept.append(b.to_numpy(np.int64))
            if sum(map(len, kept)) < group:
                continue
            rows = np.concatenate(kept)
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if last:
                yield pairs(rows[:last])
            kept = [rows[last:]]
        if kept:
            yield pairs(np.concatenate(kept))

    return cold.mapInPandas(run, "src bigint, dst bigint").union(_tiled(cells.select("cell", "fp"), big, k, hot))


def _tiled(cells: DataFrame, big: DataFrame, k: int, size: int) -> DataFrame:
    """Links inside large cells. A cell's nodes are dealt by a hash into parts of about `size`; a tile is a pair of parts."""
    dealt = cells.join(big, "cell").withColumn("parts", F.ceil(F.col("n") / size).cast("int"))
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = dealt.select(
        "cell", "fp",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("p")).alias("lo"), F.greatest(q, F.col("p")).alias("hi")))).alias("tile"),
    )

    def forest(fp: np.ndarray) -> pd.DataFrame | None:
        """Star edges from each node to the least node that it reaches inside the tile."""
        fp = np.unique(fp).view(np.uint64)
        label = np.arange(len(fp))
        near = [np.flatnonzero(np.bitwise_count(fp ^ x) <= k) for x in fp]
        while True:
            new = np.array([label[x].min() for x in near])
            new = new[new]
            if (new == label).all():
                break
            label = new
        at = np.flatnonzero(label != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pd.DataFrame({"src": signed[at], "dst": signed[label[at]]}) if len(at) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles follow each other in the sorted rows; only the last one of a batch waits for the next."""
        rest = np.zeros((0, 4), np.int64)
        for b in batches:
            rest = np.concatenate([rest, b.to_numpy(np.int64)])
            heads = np.flatnonzero(np.r_[True, (rest[1:, :3] != rest[:-1, :3]).any(axis=1)])
            for lo, hi in zip(heads, heads[1:], strict=False):
                if (out := forest(rest[lo:hi, 3])) is not None:
                    yield out
            rest = rest[heads[-1] :]
        if len(rest) and (out := forest(rest[:, 3])) is not None:
            yield out

    tiles = tiles.select("cell", "tile.lo", "tile.hi", "fp").repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return tiles.mapInPandas(run, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, k: int = 4, segment: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links of k or fewer bits).

    Null text counts as empty: fingerprint zero, linked like any other. Equal rows give equal rows; null ids take part
    but never become a component's name unless it has no other. An empty table gives no rows. Other columns are ignored.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), k, segment, agree=agreeing(nodes.count(), k)))
    named = found.join(nodes, found["node"] == nodes["fp"]).groupBy("component").agg(F.min("least").alias("least"))
    named = found.join(named, "component").select(F.col("node").alias("fp"), F.col("least").alias("linked"))
    names = materialise(nodes.join(named, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id")), "names")
    return fps.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
