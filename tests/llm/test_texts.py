"""Decontamination, line dedup, mixing and toxicity against plain Python."""

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import pytest

from lectern.llm import decontaminate, line_dedup, mixing, toxicity
from lectern.llm.common import words_of


def smith_waterman(a, b):
    """Matched words over len(a): best score, then most matches."""
    best, row = (0.0, 0), [(0.0, 0)] * (len(b) + 1)
    for x in a:
        new = [(0.0, 0)]
        for j, y in enumerate(b):
            new.append(max((0.0, 0), (row[j][0] + (1.0 if x == y else -0.5), row[j][1] + (x == y)), (row[j + 1][0] - 0.5, row[j + 1][1]), (new[j][0] - 0.5, new[j][1])))
        row, best = new, max(best, *new)
    return best[1] / len(a)


def test_alignment_as_the_plain_recurrence():
    rng = random.Random(4)
    for _ in range(150):
        a, b = rng.choices(range(4), k=rng.randint(1, 9)), rng.choices(range(4), k=rng.randint(0, 20))
        score, lo, hi = decontaminate.align(a, b)
        assert abs(score - smith_waterman(a, b)) < 1e-9
        if score > 0:
            assert abs(smith_waterman(a, b[lo:hi]) - score) < 1e-9


def test_contaminated_as_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of"] * 60
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 6, 20, 45])))) for i in range(25)] + [(30, None), (31, ""), (32, "Été, über; Été!"), (3, "repeated item text here now")]
    rows = [(1, None), (2, ""), (None, items[3][1] + " " + " ".join(rng.choices(vocab, k=40)))]
    for i in range(40):
        words = rng.choices(vocab, k=rng.choice([5, 80, 600]))
        _, item = items[i % 25]
        leak = item.upper().split()
        for _ in range(i % 4 * len(leak) // 12):
            leak[rng.randrange(len(leak))] = "edit"
        at = rng.randrange(len(words))
        rows.append((100 + i, " ".join(words[:at]) + ",\n" + ", ".join(leak) + ".\n" + " ".join(words[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "0 AS score")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS doc_id")
    want = set()
    for d, t in rows:
        for i, s in items:
            if t and s and words_of(s) and smith_waterman(words_of(s), words_of(t)) >= 0.8:
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block_chars=1500).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert {(d, i) for d, i in want if i not in (0,)} - got <= {(d, i) for d, i in want if len(words_of(dict(items)[i] or "")) <= 6}
    left = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == [] == decontaminate.contaminated(docs, bench.limit(0)).collect()


def test_line_dedup_as_brute_force(spark):
    rng = random.Random(8)
    common = [f"a line that many sites share {i}" for i in range(28)] + ["menu", "-"]
    rows = [(None, None, "s1"), (1, "", None), (2, "short\n\n", "s2"), (2, "short\n\n", "s2")]
    for i in range(10, 150):
        lines = [f"  {x} " if rng.random() < 0.2 else x for x in common if rng.random() < 0.1] + [f"own {i} {j} text" for j in range(3)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice([None, *[f"s{k}" for k in range(rng.choice([3, 12]))]])))
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites[x.strip(" ")].add(s or "")
    bad = {x for x, s in sites.items() if len(s) >= 6}
    assert 0 < len(bad) < 30
    want = Counter()
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad]
        want[d, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS n_removed", "8 AS h", "9 AS k")
    got = line_dedup.dedup_lines(docs, min_sites=6)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == want
    assert {"h", "k"} <= set(got.columns)
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def poisson_inverse(u, mean):
    k, p, c = 0, math.exp(-mean), math.exp(-mean)
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mixing_as_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, "x" * rng.randint(1, 400), rng.choice(["big"] * 20 + ["small", "tiny", None])) for i in range(400)] + [(None, None, "void"), (5, "same", "big"), (5, "same", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS copy", "2 AS bits", "3 AS n")
    size = Counter()
    for _, t, s in rows:
        size[s or ""] += len(t or "")
    rate = {s: math.sqrt(n) / sum(map(math.sqrt, size.values())) * sum(size.values()) / n if n else 1.0 for s, n in size.items()}
    want = Counter()
    for d, t, s in rows:
        key = "|".join(["42", s or "", "" if d is None else str(d), hashlib.md5((t or "").encode()).hexdigest()])
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        for c in range(1, poisson_inverse(u, rate[s or ""]) + 1):
            want[d, s, c] += 1
    got = mixing.mix(docs)
    rows_got = got.collect()
    assert Counter((r.doc_id, r.source, r["copy"]) for r in rows_got) == want
    assert {"bits", "n"} <= set(got.columns)
    assert mixing.mix(docs.limit(0)).collect() == []
    heavy = mixing.mix(docs.filter("source = 'big'"), weights={"big": 1.0, "other": 2.0}).collect()
    assert abs(len(heavy) - 355) < 80 and {r.rate for r in heavy} == {1.0}
    # a small weight counts: of 400,000 characters one in ten million
    long = spark.createDataFrame([(i, "y" * 1000, "rare" if i % 2 else "usual") for i in range(400)], "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixing.rates(long, weights={"usual": 1.0, "rare": 1e-7}).collect()}
    assert abs(rates["rare"] / 2e-7 - 1) < 1e-6


def test_line_dedup_of_a_text_with_many_lines(spark):
    text = "\n".join(f"shared {i}\nown {{}} {i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, text.replace("{}", str(i)), f"s{i}") for i in range(3)], "doc_id long, text string, source string")
    began = time.time()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs, min_sites=3).collect()}
    assert time.time() - began < 60
    assert got == {d: ("\n".join(f"own {d} {i}" for i in range(20_000)), 20_000) for d in range(3)}


def test_poisson_has_its_mean_at_large_rates(spark):
    from pyspark.sql import functions as F

    u = mixing._bits(F.col("id").cast("string")) / F.lit(float(1 << 52))
    for mean in (0.3, 40.0):
        got = spark.range(4000).select(mixing.poisson(u, F.lit(mean)).alias("k")).agg(F.avg("k").alias("m"), F.variance("k").alias("v")).first()
        assert abs(got["m"] - mean) < 4 * math.sqrt(mean / 4000) + 1e-9 and abs(got["v"] - mean) < 0.15 * mean


@pytest.fixture(scope="module")
def toxic_world(spark):
    rng = random.Random(12)
    syllables = ["ba", "ko", "mi", "tu", "re", "sa", "lo", "ni", "pe", "du"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    insults = ["blockhead", "nitwit", "zounderkite", "fopdoodle", "fop", "go jump lake"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        lines = [[word() for _ in range(12)] for _ in range(4)]
        if toxic:
            for _ in range(3):
                rng.choice(lines).insert(0, rng.choice(insults))
        docs.append((i, "\n".join(" ".join(x) for x in lines)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, toxic_world):
    docs, labels = toxic_world
    truth = dict(labels)
    rows = [*docs, (None, None), (1000, ""), (3, docs[3][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS y", "1 AS toxic")
    lab = spark.createDataFrame([*labels, (None, 1), (2000, None), (2001, 7)], "doc_id long, toxic int").selectExpr("*", "'t' AS text")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert len(held) > 200 and right > 0.97
    kept = {r.doc_id for r in toxicity.reject_toxic(d, lab).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}
    assert toxicity.toxicity(d.limit(0), lab).collect() == []
    assert {r.score for r in toxicity.toxicity(d, lab.limit(0)).collect()} == {0.0}


def test_toxicity_sees_short_insults_phrases_and_scripts_without_blanks():
    assert toxicity.units("Ab c-漢字 x") == [b"ab", b"c", "漢".encode(), "字".encode(), b"x"]
    assert toxicity.units("a" * 150) == [b"a" * 64, b"a" * 64, b"a" * 22]
    ordinary = b"go to the lake and jump in the boat " + toxicity.HEAD + b"\n" + toxicity.TAIL
    w = toxicity.Windows(ordinary, b"go jump lake " + "傻瓜".encode() + b" fop " + ordinary, (b"go", b"jump", b"lake"), toxicity.Rules())
    plain, phrase, short = (w.counts(t) for t in ("go to the lake and jump", "now go jump lake please", "the fop was here"))
    assert phrase[len(toxicity.WORD_STEPS) :].sum() > plain[len(toxicity.WORD_STEPS) :].sum()
    assert short[: len(toxicity.WORD_STEPS)].sum() > 0
    assert w.counts("").sum() == 0 and w.counts("fop").sum() > 0


def test_margins_and_scores_as_a_plain_version(spark, toxic_world):
    """The trained model, applied by a few lines of Python, gives the operator's scores."""
    import zstandard as zstd

    docs, labels = toxic_world
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.train(d, lab)
    size = lambda content, x: len(zstd.ZstdCompressor(level=9, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))
    for _, t in docs[:6]:
        words, counts = words_of(t), []
        margin = lambda x: size(m.ordinary, (x := toxicity.HEAD + b" " + x + b" " + toxicity.TAIL)) - size(m.toxic, x)
        single = [100 * margin(x) // len(x) for x in words]
        long = [margin(b" ".join(x)) for x in (words[i : i + 4] for i in range(0, len(words) - 1, 2)) if sum(w in m.phrases for w in x) > 1]
        counts = [sum(x >= s for x in single) for s in toxicity.WORD_STEPS] + [sum(x >= s for x in long) for s in toxicity.STRETCH_STEPS]
        z = sum(w * math.log1p(c) for w, c in zip(m.weights[1:], counts, strict=True)) + m.weights[0]
        assert abs(toxicity.Scorer(m, toxicity.Rules()).scores([t])[0] - 1 / (1 + math.exp(-z))) < 1e-9
