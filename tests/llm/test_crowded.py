"""Crowded cells of the near-duplicate stage: sets are written once, however many tiles read them."""

import glob
import random
from urllib.parse import urlparse

import numpy as np

from lectern.llm import resemblance
from lectern.session import shared_dir


def test_blocks_hold_what_was_packed():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 5, 1, 40, 0)]
    rows = [(f"n{i}", f"c{i % 2}", x) for i, x in enumerate([*sets, sets[3][7:]])]
    for some in (rows, rows[:1], rows[1:2]):
        got = resemblance.unpacked(resemblance.packed(some))
        assert [x[:2] for x in got] == [x[:2] for x in some]
        assert all((a == b).all() and len(a) == len(b) for (_, _, a), (_, _, b) in zip(got, some, strict=True))


def test_a_crowded_cell_writes_each_set_once_and_leaves_its_main_component_alone(spark):
    rng = random.Random(17)
    words = rng.choices([f"w{i}" for i in range(400)], k=120)
    rows = []
    for i in range(80):
        copy = list(words)
        for at in rng.sample(range(120), rng.randint(1, 6)):
            copy[at] = rng.choice(["x", "y"])
        rows.append((i, " ".join(copy)))
    top = urlparse(shared_dir(spark)).path
    found = lambda name: set(glob.glob(f"{top}/crowded-{name}-*"))
    before = {x: found(x) for x in ("blocks", "tiles")}
    resemblance.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), crowd=16, tile=8).collect()
    files = [f for d in found("blocks") - before["blocks"] for f in glob.glob(f"{d}/*-*-*") if not f.endswith(".parquet")]
    cells = {}
    for f in files:
        with open(f, "rb") as x:
            cells.setdefault(f.split("/")[-1].rsplit("-", 2)[0], []).extend(n for n, _, _ in resemblance.unpacked(x.read()))
    assert cells and all(len(x) == len(set(x)) for x in cells.values())
    assert max(map(len, cells.values())) > 3 * 8  # so that several tiles read a block
    (tiles,) = found("tiles") - before["tiles"]
    tiles = spark.read.parquet(tiles)
    assert set(tiles.columns) == {"cell", "a", "p", "b", "q"} and tiles.filter("a AND b").count() == 0 and tiles.count() > len(files)
