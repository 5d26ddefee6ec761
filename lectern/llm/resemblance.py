"""Near-duplicates by resemblance: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come by two ways. Closest copies: SimHash fingerprints of the same shingles, linked at 4 or fewer bits by the
grid of segment popcounts (simhash.links). All others, up to the 16 bits and more of a pair at 0.8, which no such grid can
carry: they share one of 40 bands of five min-hashes; of pairs at 0.8, 1.2 in 10^7 share none, of those above fewer. A
sketch of one bit a min-hash and the sizes of the sets go before the texts are fetched; the sets themselves decide.

Equal texts are one node, so copies cost nothing. In each band's cell neighbours are compared first, which joins the
groups that are alike. What is left, members of a cell in different components, is compared pair by pair, so no
candidate goes untested unless its ends are linked already. Cells with many members are cut into tiles, every pair of
members in one tile; a tile counts what the sets share and gives a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Store, materialise, new_path
from .components import components

SEED, ROWS, BANDS = 42, 5, 40
#: Bits of 192 that may differ: at 0.8 a bit does by a chance of 0.1, and more than 48 of them by less than 10^-8.
SKETCH, APART = 3, 48
_RNG = np.random.default_rng(SEED)
_MASK = _RNG.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def hashes(raw: bytes, shingle: int) -> np.ndarray:
    """Hashes of the shingles as they follow, repeats included; the words are those of simhash.fingerprints_of. A text of
    fewer words is one shingle, one without words has none."""
    import xxhash

    digest, words = xxhash.xxh64_intdigest, raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    return np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)], dtype=np.uint64)


def shingles(raw: bytes, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    return np.unique(hashes(raw, shingle))


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a text by the hashes of its shingles, as simhash.fingerprints_of gives it, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def signature(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a set's bands and its sketch, as signed numbers."""
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 512):
        np.minimum(least, ((h[at : at + 512, None] ^ _MASK) * _ODD).min(axis=0), out=least)
    least ^= least >> np.uint64(31)
    cells = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    cells ^= cells >> np.uint64(29)
    cells = cells * _ODD[:BANDS] + np.arange(BANDS, dtype=np.uint64)
    bits = np.packbits((least[: 64 * SKETCH] * _ODD[: 64 * SKETCH] >> np.uint64(63)).astype(np.uint8)).view("<i8")
    return cells.view(np.int64), bits


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _shared(sets: list[np.ndarray], left: int, columns: int = 2048) -> np.ndarray:
    """How many hashes each of the first `left` sets shares with each of the others; with all, if there are no others."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, uses = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    often = uses[at] > 1
    at, owner = (np.cumsum(uses > 1) - 1)[at[often]], owner[often]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    right = left % len(sets)
    out = np.zeros((left, len(sets) - right), np.int64)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        lo, hi = np.searchsorted(at, (low, low + columns))
        held = np.zeros((len(sets), columns), np.float32)
        held[owner[lo:hi], at[lo:hi] - low] = 1
        out += (held[:left] @ held[right:].T).astype(np.int64)
    return out


def forest(left: list[tuple], right: list[tuple], least: float) -> list[tuple]:
    """left, right: node, component, hashes of distinct shingles; right is empty where left is to be compared with itself.
    Pairs of nodes that are similar, as many as join all components that have such a pair, and no more."""
    rows = left + right
    a, b = np.arange(len(left)), np.arange(len(left) if right else 0, len(rows))
    numbers = {}
    group = np.array([numbers.setdefault(c, len(numbers)) for _, c, _ in rows])
    if len(numbers) < 2:
        return []
    size = np.array([len(x) for _, _, x in rows])
    both = _shared([x for _, _, x in rows], len(left))
    total = size[a][:, None] + size[b] - both
    alike = np.where(total > 0, both / np.maximum(total, 1), 1.0) >= least
    i, j = np.nonzero(alike & (group[a][:, None] != group[b]))
    _, first = np.unique(group[a][i] * len(numbers) + group[b][j], return_index=True)
    root, out = list(range(len(numbers))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a[i[first]], b[j[first]], strict=True):
        one, two = find(group[x]), find(group[y])
        if one != two:
            root[one] = two
            out.append((rows[x][0], rows[y][0]))
    return out


def packed(rows: list[tuple]) -> bytes:
    """Rows of node, component, hashes of distinct shingles; what sets share is written once."""
    of, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for _, _, x in rows)]), return_inverse=True)
    out = io.BytesIO()
    np.savez_compressed(out, node=np.array([x for x, _, _ in rows]), component=np.array([x for _, x, _ in rows]), ends=np.cumsum([len(x) for _, _, x in rows]), of=of, at=at.astype(np.uint32))
    return out.getvalue()


def unpacked(raw: bytes) -> list[tuple]:
    with np.load(io.BytesIO(raw)) as x:
        sets = np.split(x["of"][x["at"]], x["ends"][:-1])
        return list(zip(x["node"].tolist(), x["component"].tolist(), sets, strict=True))


def _tiled(members: DataFrame, rows: DataFrame, best: DataFrame, shingle: int, least: float, tile: int, weight: int = 1 << 20) -> DataFrame:
    """src, dst: links between components inside cells. members: cell, node, component, whether that is the cell's largest
    (main), and how many members and shingles those inside it or outside have (total, weight). Either side of a cell is dealt
    by a hash into blocks of about `tile` members and `weight` shingles. A block is a file in the shared folder, so a cell's
    sets are written once, however many tiles read them. A tile is a pair of blocks, unless both are of the main component."""
    spark = members.sparkSession
    members = materialise(members, "crowded")
    needed = members.select("node").distinct().join(best.select("node", "row"), "node")
    texts = rows.select("node", "row", "text").join(needed, ["node", "row"], "left_semi").dropDuplicates(["node", "row"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingles(x.as_py(), shingle).astype("<u8").tobytes() for x in b.column("raw")]
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "held": pa.array(held, pa.binary())})

    held = materialise(texts.select("node", F.col("text").cast("binary").alias("raw")).mapInArrow(sets, "node string, held binary"), "crowded-sets")
    parts = F.greatest(F.ceil(F.col("total") / tile), F.ceil(F.col("weight") / weight), F.lit(1))
    dealt = members.select("cell", "main", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "component").join(held, "node")
    store = Store(new_path(spark, "crowded-blocks"))
    key = ["cell", "main", "part"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []

        def block() -> pa.RecordBatch:
            if own:
                store.write("{}-{:d}-{}".format(*now), [packed(own)])
            x = [now] if own else []
            return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in x], t) for i, (k, t) in enumerate(zip(key, (pa.int64(), pa.bool_(), pa.int32()), strict=True))})

        for b in batches:
            for *at, node, component, raw in zip(*(b.column(x).to_pylist() for x in [*key, "node", "component", "held"]), strict=True):
                if at != now:
                    yield block()
                    now, own = at, []
                own.append((node, component, np.frombuffer(raw, "<u8")))
        yield block()

    dealt = dealt.select(*key, "node", "component", "held").repartition(*key).sortWithinPartitions(*key)
    blocks = materialise(dealt.mapInArrow(write, "cell bigint, main boolean, part int"), "crowded-blocks")
    a, b = (blocks.select("cell", F.struct("main", "part").alias(x)) for x in ("lo", "hi"))
    tiles = a.join(b, "cell").filter((F.col("lo") <= F.col("hi")) & ~(F.col("lo.main") & F.col("hi.main")))
    tiles = materialise(tiles.select("cell", F.col("lo.main").alias("a"), F.col("lo.part").alias("p"), F.col("hi.main").alias("b"), F.col("hi.part").alias("q")), "crowded-tiles")
    names = tiles.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(2)
        def read(name: str) -> list[tuple]:
            with store.open(name) as f:
                return unpacked(f.read())

        for batch in batches:
            for cell, a, p, b, q in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                one, two = f"{cell}-{a:d}-{p}", f"{cell}-{b:d}-{q}"
                found = forest(read(one), read(two) if one != two else [], least)
                yield pa.RecordBatch.from_pydict({"src": pa.array([x for x, _ in found], pa.string()), "dst": pa.array([y for _, y in found], pa.string())})

    # rows of tiles are short, so their number and not their bytes says how many tasks they make
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tiles.count() // 64)
    tiles = tiles.repartition(tasks, *names).sortWithinPartitions(*names)
    return materialise(tiles.mapInArrow(run, "src string, dst string"), "crowded-links")


def _signed(rows: DataFrame, shingle: int) -> DataFrame:
    """node, row, doc_id, n (distinct shingles), fp (SimHash), s0.. (sketch), cells for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, cells, bits = [], [], [], []
            for raw in b.column("raw"):
                h = hashes(raw.as_py(), shingle)
                fp.append(fingerprint(h))
                h = np.unique(h)
                c, s = signature(h)
                n.append(len(h))
                cells.append(c)
                bits.append(s)
            bits = np.array(bits, np.int64).reshape(-1, SKETCH)
            sketch = {f"s{i}": pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH)}
            kept = {x: b.column(x) for x in ("node", "row", "doc_id")}
            yield pa.RecordBatch.from_pydict(kept | {"n": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.int64())} | sketch | {"cells": pa.array(cells, pa.list_(pa.int64()))})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("node", "row", "doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(
        run, f"node string, row bigint, doc_id {kind}, n bigint, fp bigint, {', '.join(f's{i} bigint' for i in range(SKETCH))}, cells array<bigint>")


def _near(a: str, b: str, least: float):
    """Sizes and sketches allow the similarity."""
    one, two = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    apart = sum((F.bit_count(one(f"s{i}").bitwiseXOR(two(f"s{i}"))) for i in range(SKETCH)), F.lit(0))
    return (F.least(one("n"), two("n")) >= F.greatest(one("n"), two("n")) * (least - 1e-9)) & (apart <= APART)


def _close(nodes: DataFrame, k: int = 4) -> DataFrame:
    """src, dst: nodes whose fingerprints the grid of segment popcounts links at k or fewer bits; of nodes that share a
    fingerprint each with the least, which stands for it."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    grid = simhash.links(least.select("fp"), k, agree=simhash.agreeing(least.count(), k))
    side = lambda c: least.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}"))
    pairs = grid.join(side("src"), "src").join(side("dst"), "dst").select("node_src", "node_dst")
    same = nodes.select("fp", F.col("node").alias("other")).join(least, "fp").filter(F.col("node") != F.col("other")).select("node", "other")
    pairs = pairs.union(same).toDF("src", "dst")
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def _verified(pairs: DataFrame, rows: DataFrame, best: DataFrame, shingle: int, least: float, name: str) -> DataFrame:
    """Of pairs src, dst those whose texts are similar."""
    pairs = materialise(pairs, f"{name}-pairs")
    needed = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().join(best.select("node", "row"), "node")
    texts = rows.select("node", "row", "text").join(needed, ["node", "row"], "left_semi").dropDuplicates(["node", "row"])
    texts = materialise(texts.select("node", F.col("text").cast("binary").alias("raw")), f"{name}-texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("raw").alias(f"raw_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(64)(lambda raw: shingles(raw, shingle))
        for b in batches:
            alike = [similarity(of(x.as_py()), of(y.as_py())) >= least for x, y in zip(b.column("raw_src"), b.column("raw_dst"), strict=True)]
            yield pa.RecordBatch.from_pydict({x: b.column(x) for x in ("src", "dst")}).filter(pa.array(alike, pa.bool_()))

    both = pairs.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "raw_src", "raw_dst")
    return materialise(both.mapInArrow(run, "src string, dst string"), f"{name}-links")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, crowd: int = 64, tile: int = 256) -> DataFrame:
    """Of each group of rows linked at a similarity of `least` or more, one row: the least doc_id, null ids last. Cells of
    more than `crowd` texts go through tiles of two parts of about `tile` texts.

    Null text counts as empty, and empty texts are alike. Rows that share a doc_id but not their text are rows of their
    own; rows that are equal in all columns are one. Which row stays does not depend on the order of rows.
    """
    node = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.withColumn("node", node)
    rows = rows.withColumn("row", F.xxhash64(*[c for c in docs.columns if c != "text"], F.col("text").isNull(), "node"))
    plain = rows.select("node", "row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = materialise(_signed(plain, shingle), "signatures")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    facts = ["n", *[f"s{i}" for i in range(SKETCH)]]
    nodes = materialise(signed.groupBy("node").agg(order, *[F.first(c).alias(c) for c in [*facts, "fp", "cells"]]), "nodes")
    best = nodes.select("node", "best", F.col("best.row").alias("row"))

    cells = nodes.select("node", *facts, F.explode("cells").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1").select("cell")
    members = materialise(cells.join(shared, "cell"), "members")
    line = Window.partitionBy("cell").orderBy("node")
    beside = members.select(F.struct("node", *facts).alias("a"), F.lag(F.struct("node", *facts)).over(line).alias("b"))
    chain = beside.filter(F.col("b").isNotNull()).filter(_near("a", "b", least)).select(F.col("b.node").alias("src"), F.col("a.node").alias("dst"))
    chain = materialise(chain.union(_close(nodes)).distinct(), "candidates")  # used twice
    links = _verified(chain, plain, best, shingle, least, "beside")

    found = components(links)
    placed = members.join(found.select(F.col("node").alias("at"), "component"), F.col("node") == F.col("at"), "left").drop("at")
    placed = materialise(placed.withColumn("component", F.coalesce("component", "node")), "placed")
    sizes = placed.groupBy("cell", "component").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    open_ = sizes.groupBy("cell").agg(F.count("*").alias("groups"), F.max(F.struct("size", "component", "weight")).alias("main"), F.sum("size").alias("total"), F.sum("weight").alias("weight")).filter("groups > 1")
    open_ = materialise(open_.select("cell", F.col("main.component").alias("main"), "main.size", F.col("main.weight").alias("own"), "total", "weight"), "open")
    # members outside a cell's largest group against all: a group that is linked already is not paired with itself
    others = placed.join(open_.filter(F.col("total") <= crowd), "cell").filter(F.col("component") != F.col("main"))
    a, b = others.alias("a"), placed.alias("b")
    across = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.component") != F.col("b.component")) & _near("a", "b", least))
    across = across.select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")).distinct().join(chain, ["src", "dst"], "left_anti")
    crowded = placed.join(open_.filter(F.col("total") > crowd), "cell").withColumn("main", F.col("component") == F.col("main"))
    inside = lambda own, of: F.when(F.col("main"), F.col(own)).otherwise(F.col(of) - F.col(own)).alias(of)
    crowded = crowded.select("cell", "node", "component", "main", inside("size", "total"), inside("own", "weight"))
    links = links.union(_tiled(crowded, plain, best, shingle, least, tile))
    links = links.union(_verified(across, plain, best, shingle, least, "across"))

    found = components(links)
    named = best.join(found.select(F.col("node").alias("at"), "component"), F.col("node") == F.col("at"), "left")
    stay = named.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min(F.struct("best", "node")).alias("first"))
    stay = materialise(stay.select("first.node", "first.best.row"), "stay")
    return rows.join(stay, ["node", "row"], "left_semi").dropDuplicates(["node", "row"]).select(*docs.columns)
