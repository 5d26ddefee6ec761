import random
import time

import numpy as np
import pandas as pd
import xxhash

from lectern.llm import simhash
from lectern.llm.components import components


def brute(rows, shingle, k):
    fps = []
    for _, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= k:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_near_duplicates_as_brute_force(spark):
    random.seed(3)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ÀB"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (3, "one"), (None, "one"), (4, "a b"), (5, "A B")]
    for i in range(10, 40):
        words = random.choices(vocab, k=random.choice([3, 5, 60, 400]))
        rows.append((i, " ".join(words)))
        for j in range(3):
            w = list(words)
            for _ in range(j):
                w[random.randrange(len(w))] = "edit"
            rows.append((i * 100 + j, "  ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS node", "3 AS component_id")
    for shingle in (4,):
        got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, shingle).collect())
        assert got == brute(rows, shingle, 4)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_links_by_tiles_and_by_join_connect_the_same(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist()[:10]:
        for _ in range(40):
            y = x
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                y ^= 1 << b
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    near = {(min(a, b), max(a, b)) for i, a in enumerate(fps.view(np.int64).tolist()) for j, b in enumerate(fps.view(np.int64).tolist()) if j < i and int(fps[i] ^ fps[j]).bit_count() <= 4}
    for agree in (2, 3):
        pairs = [(r.src, r.dst) for r in simhash.links(nodes, 4, hot=10**6, agree=agree).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == near
    assert simhash.agreeing(10**6, 4) == 2 and simhash.agreeing(10**9, 4) == 3
    whole = {(r.node, r.component) for r in components(simhash.links(nodes, 4, hot=10**6)).collect()}
    assert {(r.node, r.component) for r in components(simhash.links(nodes, 4, hot=8)).collect()} == whole


def test_components_with_a_hub(spark):
    edges = [(0, i) for i in range(1, 900)] + [(900 + i, 901 + i) for i in range(40)] + [(950, None), (951, 951), (1000, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(900), 0), 1000: 0, **dict.fromkeys(range(900, 941), 900)}
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_cells_are_compared_as_arrays():
    """Against all pairs, with cells on both sides of the size from which a cell is a matrix; and millions of pairs a second."""
    rng = np.random.default_rng(5)
    blocks = simhash._blocks(6, 2)
    cell = np.sort(np.concatenate([rng.integers(0, 200, 900), np.repeat([300, 301, 302], [24, 23, 600])]))
    fp = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, len(cell))]
    for _ in range(4):
        fp ^= np.uint64(1) << rng.integers(0, 64, len(cell)).astype(np.uint64)
    i, j = simhash.near_pairs(cell, fp, blocks, 4)
    every = {(a, b) for b in range(len(fp)) for a in range(b) if cell[a] == cell[b] and int(fp[a] ^ fp[b]).bit_count() <= 4}
    assert len(i) == len(every) and set(zip(i.tolist(), j.tolist(), strict=True)) == every
    assert all(len(x) == 0 for x in simhash.near_pairs(cell[:0], fp[:0], blocks, 4))
    cell = np.repeat(np.arange(400), 250)
    fp = rng.integers(0, 2**63, len(cell), dtype=np.uint64)
    began = time.process_time()
    simhash.near_pairs(cell, fp, blocks, 4)
    assert time.process_time() - began < 5  # 12 million pairs; a join with a condition took some 14 microseconds a pair


def test_more_fingerprints_take_narrower_cells():
    assert simhash.agreeing(3 << 20, 4) == 2 and simhash.agreeing(5 << 20, 4) == 3
