"""The pipeline on a small corpus whose fate is known, stage by stage."""

import random

import pytest

import corpus_pipeline
from lectern.llm import decontaminate, mixing, toxicity
from lectern.llm.common import table
from lectern.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(21)
    syllables = ["ba", "ko", "mi", "tu", "re", "sa", "lo", "ni", "pe", "du", "fa", "gi"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(30))) for i in range(5)]
    docs, labels, fate = [], [], {}
    for i in range(600):
        words = prose(120)
        fate[i] = "clean"
        if i % 5 == 0:
            for w in ("blockhead", "nitwit", "zounderkite"):
                words.insert(rng.randrange(len(words)), w)
            fate[i] = "toxic"
        elif i % 50 == 1:
            at = rng.randrange(len(words))
            words[at:at] = items[i % 5][1].split()
            fate[i] = "leak"
        docs.append((i, " ".join(words[: len(words) // 2]) + "\n" + " ".join(words[len(words) // 2 :]), "en", f"s{i % 3}", None))
        labels.append((i, int(fate[i] == "toxic"), 1))
    for i in range(600, 640):
        docs.append((i, docs[i - 600][1].upper() if i % 2 else docs[i - 600][1], "en", "copies", 5))
        fate[i] = "copy of " + fate[i - 600]
    docs += [(700, None, None, None, None), (None, "no id " + " ".join(prose(80)), "en", "s0", 1)]
    top = tmp_path_factory.mktemp("world")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), docs, fate


def test_stages(spark, world, tmp_path):
    sf, docs, fate = world
    at = table(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != "token_output":
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = spark.read.parquet(f"{tmp_path}/{name}").collect()
        at = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {n: sorted(str(r.doc_id) for r in rows) for n, rows in seen.items()}
    clean = {str(i) for i, f in fate.items() if f == "clean"}
    gone = {str(i) for i, f in fate.items() if f.endswith("toxic")}
    kept = set(ids["toxicity"])
    assert len(clean - kept) <= 3 and len(gone & kept) <= 0.05 * len(gone) and {"700", "None"} <= kept
    assert set(ids["near_duplicates"]) == {i for i in ids["toxicity"] if not fate.get(int(i) if i != "None" else -1, "").startswith("copy") or str(int(i) - 600) not in kept}
    leaks = {str(i) for i, f in fate.items() if f == "leak"}
    assert set(ids["decontamination"]) == set(ids["near_duplicates"]) - leaks
    assert set(ids["mixing"]) <= set(ids["decontamination"])
    assert ids["token_output"] == ids["mixing"]
    rows = sorted(seen["token_output"], key=lambda r: r.start)
    assert [str(r.doc_id) for r in rows] != sorted(str(r.doc_id) for r in rows)
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_stages_follow_their_operators(spark, world):
    sf, docs, _ = world
    d = table(spark, sf, "documents")
    key = lambda df: sorted((str(r.doc_id), r.text, r.lang, r.source, r.n_chars) for r in df.collect())
    scored = {str(r.doc_id): r.predicted for r in toxicity.toxicity(d, table(spark, sf, "labels")).collect()}
    assert {r[0] for r in key(corpus_pipeline.drop_toxic(spark, d, sf))} == {i for i, p in scored.items() if not p}
    found = {str(r.doc_id): r for r in near_duplicates(d, 5, 4).collect()}
    assert {r[0] for r in key(corpus_pipeline.drop_near_duplicates(spark, d, sf))} == {i for i, r in found.items() if r.doc_id is None or r.doc_id == r.component_id}
    bad = {str(r.doc_id) for r in decontaminate.contaminated(d, table(spark, sf, "benchmark")).collect()}
    assert {r[0] for r in key(corpus_pipeline.drop_contaminated(spark, d, sf))} == {str(x[0]) for x in docs} - bad
    assert key(corpus_pipeline.mix_sources(spark, d, sf)) == key(mixing.mix(d))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables_and_extra_columns(spark, world, name, stage, tmp_path):
    sf, _, _ = world
    d = table(spark, sf, "documents")
    clashing = d.selectExpr("*", "1 AS node", "'x' AS row", "2 AS copy", "3 AS score", "4 AS key", "5 AS shard", "6 AS shuffle_key")
    n = stage(spark, clashing.limit(30), sf).count()
    assert 0 < n <= (300 if name == "mixing" else 30)
    assert stage(spark, clashing.limit(0), sf).count() == 0
    empty = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    kept = stage(spark, d.limit(20), empty).count()
    assert kept > 0 if name == "mixing" else kept >= 19 if name != "near_duplicates" else kept > 0
    assert stage(spark, d.limit(0), empty).count() == 0


def test_run_on_empty_tables(spark, world, tmp_path):
    sf, _, _ = world
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
