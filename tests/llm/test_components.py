"""Components in one task and in rounds: the same rows, and few tables and exchanges for the driver to keep."""

import glob
import random
from urllib.parse import urlparse

import pytest

from lectern.llm import components as own
from lectern.session import shared_dir


def plain(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    return root


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rounds_and_one_task_give_the_same_components(spark, monkeypatch, kind):
    rng = random.Random(11)
    some = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(80)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 360)]
    if kind == "string":
        some = [(f"\U0001f600{x}" if x % 7 == 0 else f"\uff5e{x}", f"n{y}") for x, y in some]
    edges = [(x, y) for x, y in some if x != y]
    df = spark.createDataFrame([*some, (some[0][0], None), (None, None)], f"src {kind}, dst {kind}")
    made = lambda: len(glob.glob(f"{urlparse(shared_dir(spark)).path}/edges-*"))
    before = made()
    got = own.components(df).collect()
    assert made() - before == 1  # no rounds
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == plain(edges)
    monkeypatch.setattr(own, "WHOLE", 0)
    rounds = own.components(df).collect()
    assert sorted(rounds) == sorted(got) and made() - before > 4
    assert own.components(df.limit(0)).collect() == []


def test_a_step_has_few_exchanges(spark):
    edges = own.materialise(spark.range(100).selectExpr("id + 1 AS src", "id AS dst"), "edges")
    for large in (True, False):
        plan = own._star(edges, large, 100)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 6
