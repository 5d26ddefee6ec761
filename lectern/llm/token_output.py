"""Token ids in binary shards with a minimal perfect hash index.

Shard: 8 bytes of magic, 4 of item width, 4 zero; the ids of its documents one after the other, little-endian; then a
table of its rows by document id: the document ids (int64), where each row's ids begin (uint64) and how many they are
(uint32); and the number of rows (uint64) as the last 8 bytes. Shards follow each other, with their rows in ascending
doc_id order or in the order in which the rows come.

Index: keys are dealt to parts by hash. A part is a minimal perfect hash by hash and displace: a key's bucket gives a
seed, the seed gives the key's slot, every slot is taken once. The slot stores a fingerprint of the key, which exposes
foreign keys, and where the list of the key's places begins: of each shard that holds it, the first row of the shard's
table and how many. Nothing is searched in a shard; the document id at a place is only compared with the key. A key that a
third of all rows hold has a list no longer than the number of shards.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, documents, materialise, new_path

MAGIC = b"LECTTOK2"
#: The characters of Latin-1 that are letters, numbers and white space, as classes.
LETTER, NUMBER, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
NULL_KEY = -(1 << 63)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them. Byte-level pieces are encoded apart from each other, so
    the library's model encodes each piece of a Latin-1 text once; pieces are kept in two generations of bounded size,
    and those in use move to the younger one. Other texts go through the library whole."""

    def __init__(self, path: str, end: int, pieces: int = 300_000):
        import re

        from tokenizers import Tokenizer

        self.library, self.end, self.most = Tokenizer.from_file(path), end, pieces
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters, self.model = byte_letters(), self.library.model
        self.cut = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        ).findall

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._raw([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])

    def _simple(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(s in text for s in self.special)

    def _learn(self, need: set[str]) -> None:
        new = need.difference(self.kept)
        if len(self.kept) + len(new) > self.most:
            self.old, self.kept = self.kept, {}
            new = need
        for p in new:
            self.kept[p] = self.old.get(p) or self._piece(p)

    def encode(self, texts: list[str], group: int = 1 << 21) -> Iterator[bytes]:
        """The ids of each text with the end id, as bytes."""
        tail, at = self._raw([self.end]), 0
        while at < len(texts):
            read, parts = 0, []
            while at < len(texts) and read < group:
                t = texts[at]
                parts.append(self.cut(t) if self._simple(t) else t)
                read += len(t)
                at += 1
            self._learn(set().union(*(p for p in parts if isinstance(p, list))))
            one = self.kept.__getitem__
            for part in parts:
                if isinstance(part, list):
                    yield b"".join(map(one, part)) + tail
                else:
                    yield self._raw(self.library.encode(part, add_special_tokens=False).ids) + tail


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def mix(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit mixer (splitmix64) of keys and seed; seed may be an array."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys, with fingerprints."""

    LOAD = 4

    def __init__(self, seeds: np.ndarray, prints: np.ndarray):
        self.seeds, self.prints = seeds, prints

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash and each key's slot."""
        n = len(keys)
        bucket = (mix(keys, 0) % np.uint64(max(1, n // cls.LOAD))).astype(np.int64)
        seeds, slots, taken = np.zeros(max(1, n // cls.LOAD), np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
        order = np.argsort(bucket, kind="stable")
        heads = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if n else np.zeros(0, int)
        groups = np.split(order, heads[1:]) if n else []
        for g in sorted(groups, key=len, reverse=True):
            seed = 1
            while True:
                try_ = np.arange(seed, seed + 64, dtype=np.uint64)[:, None]
                at = (mix(keys[g][None, :], try_) % np.uint64(n)).astype(np.int64)
                ok = ~taken[at].any(axis=1)
                if len(g) > 1:
                    s = np.sort(at, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if ok.any():
                    k = int(np.argmax(ok))
                    break
                seed += 64
            seeds[bucket[g[0]]] = seed + k
            slots[g] = at[k]
            taken[at[k]] = True
        prints = np.zeros(n, np.uint32)
        prints[slots] = cls.fingerprint(keys)
        return cls(seeds, prints), slots

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 0x5EED) >> np.uint64(32)).astype(np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Of each key; -1 for a key that the fingerprint shows to be foreign."""
        n = len(self.prints)
        if not n:
            return np.full(len(keys), -1)
        at = (mix(keys, self.seeds[(mix(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)]) % np.uint64(n)).astype(np.int64)
        return np.where(self.prints[at] == self.fingerprint(keys), at, -1)


def _part(key, parts: int):
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)).cast("int")


def write(docs: DataFrame, root: str, path: str, end: int = 0, keys_per_part: int = 50_000, ordered: bool = True) -> tuple[DataFrame, dict[int, int], int]:
    """Write shards and index under root. Returns the keys table (key, shard, first, rows: one row for each key of a shard), the number of
    tokens before each shard, and the number of index parts. Text goes through one range exchange, in which rows of one
    doc_id may be parted between neighbouring shards, or, unless `ordered`, through none. A shard is written as its
    documents are encoded."""

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, e, rows = TaskContext.get().partitionId(), encoder(path, end), []

        def pieces():
            yield MAGIC + e.dtype.itemsize.to_bytes(4, "little") + bytes(4)
            for b in batches:
                for i, raw in zip(b["doc_id"], e.encode(list(b["text"])), strict=True):
                    rows.append((i, len(raw) // e.dtype.itemsize))
                    yield raw
            ids, counts = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<u4")
            order = np.argsort(ids, kind="stable")
            begins = np.cumsum(counts, dtype="<u8") - counts
            places.append((ids[order], counts[order]))
            yield from (x.tobytes() for x in (ids[order], begins[order], counts[order]))
            yield len(rows).to_bytes(8, "little")

        places: list[tuple[np.ndarray, np.ndarray]] = []
        Store(root).write(f"shard-{k:06d}", pieces())
        if rows:
            ids, counts = places[0]
            key, first, n = np.unique(ids, return_index=True, return_counts=True)
            yield pd.DataFrame({"key": key, "shard": k, "first": first, "rows": n, "n_tokens": np.add.reduceat(counts.astype(np.int64), first)})

    dealt = documents(docs).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_KEY)).alias("doc_id"), "text")
    if ordered:
        # the second key parts rows that share an id (null, above all), also those with equal texts
        dealt = dealt.withColumn("apart", F.xxhash64("text", F.spark_partition_id()))
        dealt = dealt.repartitionByRange("doc_id", "apart").sortWithinPartitions("doc_id", "apart").select("doc_id", "text")
    keys = materialise(dealt.mapInPandas(shard, "key bigint, shard int, first bigint, rows bigint, n_tokens bigint"), "token-keys")
    totals = keys.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("keys")).orderBy("shard").collect()  # a row for each file
    starts, before = {}, 0
    for t in totals:
        starts[t["shard"]] = before
        before += t["n"]
    parts = max(1, -(-sum(t["keys"] for t in totals) // keys_per_part))

    def index(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["key", "shard"])
        k, first, n = np.unique(g["key"].to_numpy(np.int64), return_index=True, return_counts=True)
        perfect, slots = PerfectHash.build(k.view(np.uint64))
        table = np.zeros((2, len(k)), np.int64)
        table[:, slots] = np.array([first, n])
        out = io.BytesIO()
        np.savez(out, seeds=perfect.seeds, prints=perfect.prints, table=table, shards=g["shard"].to_numpy(np.int32), places=g[["first", "rows"]].to_numpy(np.int64))
        Store(root).write(f"index-{int(g['part'].iloc[0]):06d}", [out.getbuffer()])
        return pd.DataFrame({"part": g["part"].iloc[:1], "n": len(k)})

    keys.select(_part("key", parts).alias("part"), "key", "shard", "first", "rows").groupBy("part").applyInPandas(index, "part int, n bigint").agg(F.sum("n")).collect()
    return keys, starts, parts


def read(keys: DataFrame, root: str, starts: dict[int, int], parts: int) -> DataFrame:
    """Look up each key (column key) in the index and read its ids at the places that it gives: doc_id, start, n_tokens,
    ids_crc32, shard. Keys that are not there give no rows, also those that share a fingerprint with one that is: the
    document id at the place is another."""

    def find(g: pd.DataFrame) -> pd.DataFrame:
        with Store(root).open(f"index-{int(g['part'].iloc[0]):06d}") as f:
            index = np.load(io.BytesIO(f.read()))
        key = g["key"].to_numpy(np.int64)
        slots = PerfectHash(index["seeds"], index["prints"]).slots(key.view(np.uint64))
        key, (first, n) = key[slots >= 0], index["table"][:, slots[slots >= 0]]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else first, n) + np.arange(n.sum())
        return pd.DataFrame({"key": np.repeat(key, n), "shard": index["shards"][at], "first": index["places"][at, 0], "rows": index["places"][at, 1]})

    def fetch(g: pd.DataFrame) -> pd.DataFrame:
        shard, out = int(g["shard"].iloc[0]), []
        with Store(root).open(f"shard-{shard:06d}") as f:
            f.seek(0, 2)
            size = f.tell()
            f.seek(8)
            width = int.from_bytes(f.read(4), "little")
            f.seek(size - 8)
            n = int.from_bytes(f.read(8), "little")
            f.seek(size - 8 - 20 * n)
            ids, begins, counts = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(8 * n), "<u8"), np.frombuffer(f.read(4 * n), "<u4")
            many = g["rows"].to_numpy(np.int64)
            at = np.repeat(g["first"].to_numpy(np.int64) - (np.cumsum(many) - many), many) + np.arange(many.sum())
            at = at[ids[at] == np.repeat(g["key"].to_numpy(np.int64), many)]
            for r in at[np.argsort(begins[at])].tolist():  # in the order of the file
                f.seek(16 + width * int(begins[r]))
                raw = np.frombuffer(f.read(width * int(counts[r])), f"<u{width}")
                out.append((None if ids[r] == NULL_KEY else int(ids[r]), starts[shard] + int(begins[r]), int(counts[r]), zlib.crc32(raw.astype("<u4").tobytes()), shard))
        own = pd.array([r[0] for r in out], "Int64")  # not through floats, which round large ids
        rest = pd.DataFrame([r[1:] for r in out], columns=["start", "n_tokens", "ids_crc32", "shard"])
        rest.insert(0, "doc_id", own)
        return rest

    at = keys.select("key").distinct().withColumn("part", _part("key", parts)).groupBy("part").applyInPandas(find, "key bigint, shard int, first bigint, rows bigint")
    return at.groupBy("shard").applyInPandas(fetch, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int")


def token_output(docs: DataFrame, path: str, end: int = 0, ordered: bool = True) -> DataFrame:
    """Encode docs, write shards and index to the shared folder, and return what keyed access reads back from them.

    doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32, shard. Rows are written in
    ascending doc_id order or, unless `ordered`, as they come, a shard for each partition. Null text is empty: the end id
    alone. Rows that repeat a doc_id stay, all under its key; null ids have one key and come first where ordered. An empty
    table gives no rows. Other columns are ignored.
    """
    root = new_path(docs.sparkSession, "tokens")
    keys, starts, parts = write(docs, root, path, end, ordered=ordered)
    return read(keys, root, starts, parts)
