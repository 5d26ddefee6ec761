"""Near-duplicates at a shingle similarity of 0.8 against brute force over sets of shingles."""

import random

import numpy as np

import corpus_pipeline
from lectern.llm import resemblance, simhash
from lectern.llm.common import table


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def edited_copies():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(2000)]
    rows = [(1, "one"), (2, "One "), (3, "a b c d"), (4, "a b c"), (5, ""), (6, None), (7, " \n")]
    for i in range(30):
        words = rng.choices(vocab, k=rng.choice([25, 60, 200, 500]))
        rows.append((100 * (i + 1), " ".join(words)))
        for j in range(1, 9):  # an edit takes five shingles of each: j of them leave about 0.75 to 0.99
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * j // 300)):
                copy[at] = "edit"
            rows.append((100 * (i + 1) + j, " ".join(copy)))
    return rows


def test_edited_copies_go_from_the_pipeline_as_by_brute_force(spark, tmp_path):
    rows = edited_copies()
    pairs = [alike(grams(a), grams(b)) for i, (_, a) in enumerate(rows) for _, b in rows[:i]]
    assert sum(0.8 <= x < 0.85 for x in pairs) >= 20 and sum(0.7 <= x < 0.8 for x in pairs) >= 20
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for (d, _), g in zip(rows, groups(rows), strict=True):
        want[g] = min(want.get(g, d), d)
    d = table(spark, str(tmp_path), "documents")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()) == sorted(want.values())
    assert resemblance.keep_one(d.limit(0)).collect() == []


def test_one_row_of_each_group_whatever_the_ids(spark):
    rng = random.Random(13)
    a, b, c, d, e, f = (" ".join(rng.choices([f"w{i}" for i in range(900)], k=80)) for _ in range(6))
    rows = [(1, a), (2, b), (2, c), (2, c), (2, a), (3, b), (None, d), (None, d), (None, d + " end"), (None, e), (None, a), (4, e), (5, f), (5, f.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for seen in (docs, docs.orderBy("text", "doc_id"), docs.repartition(5)):
        got = sorted((str(r.doc_id), r.text.lower()) for r in resemblance.keep_one(seen).collect())
        assert [x for x in got if x[1] not in (d, d + " end")] == sorted([("1", a), ("2", b), ("2", c), ("4", e), ("5", f)])
        assert len([x for x in got if x[1] in (d, d + " end")]) == 1


def test_forests_join_what_pairs_join():
    """Tiles of two parts, or of one with itself, empty and equal sets among them, against all pairs."""
    rng = np.random.default_rng(14)
    for trial in range(60):
        base = rng.integers(0, 2**63, 40).astype(np.uint64)
        sets = []
        for i in range(int(rng.integers(0, 24))):
            own = np.where(rng.random(40) < rng.choice([0, 0.05, 0.1, 0.2]), rng.integers(0, 60, 40).astype(np.uint64), base)
            sets.append(np.unique(own[: int(rng.choice([0, 1, 36, 40, 40, 40]))]))
        rows = [(f"n{i}", f"c{rng.integers(0, 12)}", x) for i, x in enumerate(sets)]
        left = rows if trial % 2 else rows[: len(rows) // 2]
        right = [] if trial % 2 else rows[len(rows) // 2 :]
        if not left:
            continue
        found = resemblance.forest(left, right, 0.8)
        component = {n: c for n, c, _ in rows}

        def joined(edges):
            root = {c: c for c in component.values()}
            for a, b in edges:
                old, new = root[component[a]], root[component[b]]
                root = {c: new if r == old else r for c, r in root.items()}
            return {frozenset(c for c in root if root[c] == r) for r in root.values()}

        every = [(a, b) for a, c, x in left for b, d, y in (right if right or not trial % 2 else left) if a != b and c != d and resemblance.similarity(x, y) >= 0.8]
        assert set(found) <= set(every) and joined(found) == joined(every)
        assert len(found) < max(1, len(set(component.values())))


def test_crowded_cells_keep_the_groups_of_brute_force(spark):
    rng = random.Random(15)
    words = rng.choices([f"w{i}" for i in range(400)], k=120)
    rows = [(0, "a"), (1, "A"), (2, "")]
    for i in range(90):  # one to six edits of one text: about 0.92 to 0.6 among each other
        copy = list(words)
        for at in rng.sample(range(120), rng.randint(1, 6)):
            copy[at] = rng.choice(["x", "y"])
        rows.append((10 + i, " ".join(copy)))
    want = {}
    for (d, _), g in zip(rows, groups(rows), strict=True):
        want[g] = min(want.get(g, d), d)
    assert 3 < len(want) < 80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd, tile in ((4, 16), (0, 500), (64, 256), (10**6, 1)):
        assert sorted(r.doc_id for r in resemblance.keep_one(docs, crowd=crowd, tile=tile).collect()) == sorted(want.values())


def test_the_stage_goes_by_simhash_and_the_sets_decide(spark, monkeypatch):
    """Fingerprints are the operator's; its grid's links alone join close copies, and a link below 0.8 joins nothing."""
    rng = random.Random(16)
    words = rng.choices([f"w{i}" for i in range(900)], k=900)
    texts = ["", "one", "a b c d", "A  b c D e", " ".join(words), " ".join([*words[:-1], "end"])]
    for x in texts:
        assert resemblance.fingerprint(resemblance.hashes(x.encode(), 5)) == int(simhash.fingerprints_of([x.encode()], 5).view(np.int64)[0])
    docs = spark.createDataFrame(list(enumerate([*texts, "far " * 3])), "doc_id long, text string")
    real, asked = simhash.links, []

    def links(nodes, k, *a, **b):
        asked.append((k, nodes.count()))
        return real(nodes, k, *a, **b).union(nodes.selectExpr("min(fp) AS src", "max(fp) AS dst"))  # a link of texts that are not alike

    monkeypatch.setattr(simhash, "links", links)
    monkeypatch.setattr(resemblance, "_near", lambda a, b, least: resemblance.F.lit(False))  # without min-hash candidates
    assert sorted(r.doc_id for r in resemblance.keep_one(docs).collect()) == [0, 1, 2, 3, 4, 6]
    assert asked == [(4, 7)]
