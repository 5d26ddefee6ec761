import numpy as np
import pytest

from lectern.llm.embeddings import Code, Rules, near_vectors


def brute(rows, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v), k in zip(rows, ok, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[label[i]] = min(least.get(label[i], d), d)
    return sorted((str(d), len(near[i]), d if not ok[i] else least.get(label[i])) for i, (d, _) in enumerate(rows))


def test_near_vectors_as_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15), (906, [2.0, 1.0]), (907, [4.0, 2.0])]
    for i in range(60):
        v = rng.standard_normal(16)
        rows.append((i, v.tolist()))
        for j in range(i % 4):
            w = v + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.1])
            rows.append((1000 + 10 * i + j, (w * rng.choice([1.0, 3.0])).tolist()))
    v = rng.standard_normal(16)
    rows += [(2000 + i, (v + 0.05 * rng.standard_normal(16)).tolist()) for i in range(40)] + [(5, rows[8][1]), (None, rows[9][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS node", "3 AS kept")
    got = near_vectors(table, Rules(tile=16)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == brute(rows, 0.9)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert near_vectors(table.limit(0)).collect() == []


@pytest.mark.parametrize("n", [10**4, 10**7, 10**9])
def test_recall_of_filters_at_the_threshold(n):
    """Pairs at a cosine of exactly 0.9 that share a filter of the code for n vectors, and the vectors that a filter holds."""
    rng, rules = np.random.default_rng(5), Rules().scaled(n)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * noise
    code = Code(64, rules)
    a, b = code.filters(x), code.filters(y)
    shared = [len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]
    assert np.mean(shared) > 0.97
    assert np.mean([len(p) for p in a]) * n / rules.words**rules.blocks < 4 * max(rules.occupancy, n * 22 / 128**2 if n <= 512_000 else 0)


def test_list_decoding_finds_every_filter():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rules = Rules(words=16, blocks=3, deviations=2.0, least=0)
    code = Code(30, rules)
    y = code.turned(x[:, :30])[:, : code.width * 3].reshape(20, 3, code.width)
    for i in range(20):
        s = np.einsum("bd,bwd->bw", y[i], code.words)
        want = [a * 256 + b * 16 + c for a in range(16) for b in range(16) for c in range(16) if s[0, a] + s[1, b] + s[2, c] >= code.cut]
        assert sorted(code._decode(s, code.cut)) == want
