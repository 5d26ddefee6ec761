"""Counts and ids against the library on whole texts; the hash index and the files by round trip."""

import io
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm.common import Store, new_path
from lectern.llm.token_counts import Transducer, token_counts
from lectern.llm.token_output import PerfectHash, read, token_output, write

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["The", "thing", "É", "été", " ", "  ", "\n", "\t", "\x1c", "\xa0", "　", "é", "İ", "Σ", "ΑΣ", "漢字", "🙂", "'s", "'LL", "don't", "1", "23", "½", "²", "!!", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\r\n", "_a_", "\x00", "\x85"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["", " ", "\n\n", *["".join(rng.choices(PIECES, k=rng.choice([1, 3, 20]))) for _ in range(n)]]


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_as_the_library():
    t, library = Transducer(WORD, arcs=50), Tokenizer.from_file(WORD)
    t.words.most = 500  # so that it starts anew now and then
    some = texts(600)
    assert t.totals(some) == counted(library, some)


def test_word_transducer_as_the_library():
    t, library, rng = Transducer(WORD), Tokenizer.from_file(WORD), random.Random(4)
    syllables = ["th", "in", "er", "an", "été", "ß", "ing", "x", "q", "tion", "'s", "!!", "7", "ly", "-", "ñ", "漢", "字", "при", "вет", "اب", "🙂", "가", "ก็"]
    runs = ["".join(rng.choices(syllables, k=rng.randint(1, 12))) for _ in range(3000)] + ["".join(rng.choices("abcdeéxz.", k=rng.randint(1, 25))) for _ in range(3000)]
    assert [t.arc(r) for r in runs] == counted(library, runs)


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 4096])
def test_chunk_maps_compose_at_any_cut(chunk):
    t, library = Transducer(WORD, chunk=chunk), Tokenizer.from_file(WORD)
    some = texts(150, seed=chunk)
    assert t.totals(some) == counted(library, some)


def test_contractions_at_every_cut():
    t, library = Transducer(WORD), Tokenizer.from_file(WORD)
    some = [a + c + b for a in ("", "x", "!", "'", "1") for c in ("'s", "'re", "'r", "'ll", "'l", "'", "''ve", "'d's") for b in ("", "e", "l", "'", "!", "9")]
    for x, want in zip(some, counted(library, some), strict=True):
        for cut in range(len(x) + 1):
            state, n = t.advance(0, x[:cut])
            state, more = t.advance(state, x[cut:])
            assert n + more + t.finish(state) == want, (x, cut)


def test_the_shape_of_a_map_is_bounded():
    t = Transducer(WORD, chunk=1000)
    text = "ab" * 50_000
    whole = t.scan(text, [t.map(text, at, at + 1000) for at in range(0, len(text), 1000)])
    assert whole == ((0, 100_000), False, 0, 0)
    text = "ab " + text + " ab"
    whole = t.scan(text, [t.map(text, at, min(at + 1000, len(text))) for at in range(0, len(text), 1000)])
    assert whole.head == (0, 2) and whole.broken and whole.count > 0


@pytest.mark.parametrize("piece", ["a", "漢字仮名", "x1-", "'re", "été"])
def test_long_texts_without_white_space(piece):
    text = piece * (400_000 // len(piece))
    began = time.time()
    n = Transducer(WORD).total(text)
    assert time.time() - began < 60 and n == len(Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids)


def test_another_form_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        Transducer(BYTE)


def table(spark, n=120):
    rows = [(i, x) for i, x in enumerate(texts(n, 9))] + [(7, "again"), (7, "again"), (None, "no id"), (None, None), (9_007_199_254_740_993, "large"), (-5, None)]
    random.Random(2).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS shard", "2 AS n_bytes")


def test_token_counts(spark):
    rows, docs = table(spark)
    library = Tokenizer.from_file(WORD)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted((str(i), len((t or "").encode()), count(t), count(t) > 20) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, WORD, limit=20).collect()) == want
    assert token_counts(docs.limit(0), WORD).collect() == []


def test_token_output_round_trip(spark):
    rows, docs = table(spark)
    library = Tokenizer.from_file(BYTE)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]
    got = token_output(docs, BYTE, end=0).collect()
    want = sorted((str(i), len(x := ids(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate(([0], np.cumsum([r.n_tokens for r in ordered])))[:-1].tolist()
    keys = [r.doc_id if r.doc_id is not None else -(1 << 63) for r in ordered]
    assert keys == sorted(keys)
    assert token_output(docs.limit(0), BYTE).collect() == []


def test_index_finds_its_keys_and_no_others(spark):
    _, docs = table(spark)
    root = new_path(spark, "tokens")
    keys, starts, parts = write(docs, root, BYTE, keys_per_part=20)
    assert parts > 1
    foreign = spark.range(100_000, 100_050).withColumnRenamed("id", "key")
    assert read(foreign, root, starts, parts).count() == 0
    assert read(keys.filter("key = 7"), root, starts, parts).count() == 3


def test_perfect_hash():
    for n in (0, 1, 2, 5, 1000):
        k = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
        h, slots = PerfectHash.build(k)
        assert sorted(slots.tolist()) == list(range(n)) and (h.slots(k) == slots).all()
        other = np.random.default_rng(99).integers(1 << 41, 1 << 42, 500).astype(np.uint64)
        assert (h.slots(other) >= 0).sum() <= 1


def test_rows_as_they_come(spark):
    """Unordered, shards keep the order of rows; a key finds its copies wherever they are; a key that shares the fingerprint
    and the slot of another finds nothing."""
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(5)
    got = token_output(docs, BYTE, ordered=False).collect()
    assert len(got) == 400 and len({r.shard for r in got}) == 5
    placed = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert placed == [r.doc_id for part in docs.rdd.glom().collect() for r in part]
    root = new_path(spark, "tokens")
    keys, starts, parts = write(docs, root, BYTE, ordered=False)
    assert read(spark.createDataFrame([(3,)], "key long"), root, starts, parts).count() == sum(i % 50 == 3 and i % 7 > 0 for i in range(400))


def test_a_foreign_key_with_a_known_fingerprint(spark):
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    root = new_path(spark, "tokens")
    keys, starts, parts = write(docs, root, BYTE)
    with Store(root).open("index-000000") as f:
        index = dict(np.load(io.BytesIO(f.read())))
    index["prints"] = PerfectHash.fingerprint(np.array([77], np.uint64))
    out = io.BytesIO()
    np.savez(out, **index)
    Store(root).write("index-000000", [out.getbuffer()])
    assert (PerfectHash(index["seeds"], index["prints"]).slots(np.array([77], np.uint64)) == 0).all()
    assert read(spark.createDataFrame([(77,)], "key long"), root, starts, parts).count() == 0


def test_the_index_gives_the_rows_and_nothing_is_searched(spark):
    """A place that is moved in the index is read where it points: the row there has another id, so it is not taken."""
    docs = spark.createDataFrame([(5, "five"), (3, "three"), (3, "again"), (9, "nine")], "doc_id long, text string").coalesce(1)
    root = new_path(spark, "tokens")
    keys, starts, parts = write(docs, root, BYTE, ordered=False)
    assert sorted((r.key, r.first, r.rows) for r in keys.collect()) == [(3, 0, 2), (5, 2, 1), (9, 3, 1)]
    got = read(keys, root, starts, parts).orderBy("start").collect()
    assert [r.doc_id for r in got] == [5, 3, 3, 9]
    with Store(root).open("index-000000") as f:
        index = dict(np.load(io.BytesIO(f.read())))
    moved = index["places"].copy()
    moved[np.argsort(moved[:, 0])[:1], 1] = 1  # the key with two rows
    out = io.BytesIO()
    np.savez(out, **(index | {"places": moved}))
    Store(root).write("index-000000", [out.getbuffer()])
    assert sorted(r.doc_id for r in read(keys, root, starts, parts).collect()) == [3, 5, 9]
