"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014); a graph that one task holds
with ease is joined by one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: A node with more than one in HUB of all edges is a hub: 2 * HUB at most, a broadcast of proven size. Its edges are
#: dealt to SALTS tasks.
HUB, SALTS = 256, 32
#: So many edges go through one task: some 50 MB of its memory. Rounds over fewer cost the driver more than they deal out.
WHOLE = 1 << 17


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step. large: every node hands its larger neighbours to the least of its neighbourhood; small: its smaller ones."""
    if large:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = materialise(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root"), F.count("*").alias("n")), "least")  # used four times
    hubs = F.broadcast(least.filter(F.col("n") > max(total // HUB, SALTS)).select(F.col("src").alias("hub")))
    salted = lambda rows, salt, else_: rows.join(hubs, F.col("src") == F.col("hub"), "left").withColumn("salt", F.when(F.col("hub").isNotNull(), salt).otherwise(else_)).drop("hub")
    rooted = salted(least, F.sequence(F.lit(0), F.lit(SALTS - 1)), F.array(F.lit(0))).select(F.col("src").alias("at"), "root", F.explode("salt").alias("deal"))
    dealt = salted(both, F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"), F.lit(0))
    moved = dealt.join(rooted, (F.col("src") == F.col("at")) & (F.col("salt") == F.col("deal")))
    if large:
        out = moved.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("root").alias("dst"))
    else:
        out = moved.select("dst", "root").union(least.select(F.col("src"), "root")).toDF("src", "dst")
    out = out.filter(F.col("src") != F.col("dst"))
    return out if large else out.distinct()


def _state(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst") % (1 << 40))).first())


def _whole(edges: DataFrame) -> DataFrame:
    """node, component of all edges by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, kind = {}, None

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        for b in batches:
            kind = b.schema.field("src").type
            for x, y in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        for at in range(0, len(nodes), 1 << 14):
            some = nodes[at : at + (1 << 14)]
            yield pa.RecordBatch.from_pydict({"node": pa.array(some, kind), "component": pa.array(map(find, some), kind)})

    kind = edges.schema["src"].dataType.simpleString()
    return materialise(edges.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"), "components")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: src, dst of one orderable type. Returns node, component (least node reachable) for every node with an edge.

    Up to WHOLE edges are one task's work. Of more, each step of a round is written to the shared folder; only a count and
    a checksum come to the driver. Nulls and loops are ignored; no edges give no rows. The edges of a node that has many
    are dealt to several tasks.
    """
    e = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    e = materialise(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    seen = _state(e)
    if seen[0] <= WHOLE:
        return _whole(e)
    for _ in range(max_rounds):
        e = materialise(_star(e, True, seen[0]), "edges")
        e = materialise(_star(e, False, seen[0]), "edges")
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
