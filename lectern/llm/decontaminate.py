"""Benchmark decontamination: rare word n-grams seed candidates, Smith-Waterman alignment scores them.

Words are lower-cased; ASCII punctuation separates them. Rarity is judged by chance: from the corpus counts of the
benchmark's words, the number of times that an n-gram would turn up in the corpus if words fell independently. From each
position of a test item the shortest n-gram that is rare in this sense is a seed. A passage that leaked into a third of
all documents keeps its seeds, as copies raise an n-gram's count but not its words' chance of meeting. An item that has
no rare n-gram is its own seed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, words_of

#: Of equal scores the one with more matches wins: a match is worth a millionth more, which also counts the matches.
TINY = 2.0**-20
MATCH, OFF, GAP = 1.0 + TINY, -0.5, -0.5


def align(item: list[int], passage: list[int]) -> tuple[float, int, int]:
    """Best local alignment: matched words over the item's length, and the passage's range (start, end) of words."""
    n = len(passage)
    if not item or not n:
        return 0.0, 0, 0
    p = np.array(passage)
    row, begin = np.zeros(n + 1), np.arange(n + 1)
    best, at = 0.0, (0, 0)
    steps = np.arange(n + 1) * GAP
    for w in item:
        diagonal = row[:-1] + np.where(p == w, MATCH, OFF)
        above = row[1:] + GAP
        new, src = np.zeros(n + 1), np.arange(n + 1)
        cell = np.maximum(np.maximum(diagonal, above), 0)
        new[1:] = cell
        src[1:] = np.where(cell <= 0, np.arange(1, n + 1), np.where(diagonal >= above, begin[:-1], begin[1:]))
        # gaps in the item: the best cell to the left less the gaps between, by a running maximum
        lifted = new - steps
        top = np.maximum.accumulate(lifted)
        from_ = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, begin = top + steps, src[from_]
        k = int(row.argmax())
        if row[k] > best:
            best, at = float(row[k]), (int(begin[k]), k)
    return (best - round(best * 2 - 2 * TINY) / 2) / TINY / len(item), *at


class Seeds:
    """The seeds of a block of test items, ready to search texts."""

    def __init__(self, items: list[tuple], counts: dict[bytes, int], total: int, chance: float, longest: int):
        import ahocorasick

        self.items = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.of: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, w) in enumerate(self.items):
            rarity = [math.log((counts.get(x, 0) + 1) / (total + 1)) for x in w]
            found = False
            for a in range(len(w)):
                sum_ = 0.0
                for b in range(a, min(len(w), a + longest)):
                    sum_ += rarity[b]
                    if b > a and sum_ + math.log(total + 1) <= math.log(chance):
                        self.of.setdefault(b" ".join(w[a : b + 1]), []).append((k, a))
                        found = True
                        break
            if not found:
                self.of.setdefault(b" ".join(w), []).append((k, 0))
        self.search = ahocorasick.Automaton()
        for s in self.of:
            self.search.add_word(f" {s.decode('utf-8', 'surrogateescape')} ", s)
        if self.of:
            self.search.make_automaton()
        self.number: dict[bytes, int] = {}
        for _, w in self.items:
            for x in w:
                self.number.setdefault(x, len(self.number))
        self.coded = [[self.number[x] for x in w] for _, w in self.items]

    def hits(self, text: str, least: float) -> list[tuple]:
        """(item_id, score, start, end) of each item that aligns with a passage of the text at `least` or better."""
        if not self.of:
            return []
        words = words_of(text)
        flat = f" {b' '.join(words).decode('utf-8', 'surrogateescape')} "
        places: dict[int, list[int]] = {}
        starts = None
        for end, seed in self.search.iter(flat):
            if starts is None:  # of the words in flat
                lengths = np.fromiter((len(w.decode("utf-8", "surrogateescape")) for w in words), np.int64, len(words))
                starts = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
            first = end - len(seed.decode("utf-8", "surrogateescape"))
            at = int(np.searchsorted(starts, first))
            for k, offset in self.of[seed]:
                places.setdefault(k, []).append(at - offset)
        out = []
        for k, found in places.items():
            size, best = len(self.coded[k]), (0.0, 0, 0)
            slack = max(2, size // 2)
            merged: list[list[int]] = []
            for a in sorted(set(found)):
                lo, hi = max(0, a - slack), min(len(words), a + size + slack)
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                # long stretches are aligned in pieces that overlap by more than an alignment can span
                for at in range(lo, hi, 8 * size):
                    piece = [self.number.get(x, -1) for x in words[at : min(hi, at + 11 * size)]]
                    score, s, e = align(self.coded[k], piece)
                    best = max(best, (score, -(at + s), at + e))
            if best[0] >= least:
                out.append((self.items[k][0], round(best[0], 6), -best[1], best[2]))
        return out


def word_counts(docs: DataFrame, vocabulary: list[bytes]) -> tuple[dict[bytes, int], int]:
    """Corpus counts of the vocabulary's words and the number of words; what comes to the driver is bounded by the vocabulary."""
    vocab = frozenset(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, seen, total = Counter(), Counter(), 0
        for b in batches:
            for at in range(0, len(b), 1000):
                for t in b["text"].iloc[at : at + 1000]:
                    w = words_of(t)
                    total += len(w)
                    seen.update(w)
                kept.update({w: seen[w] for w in vocab.intersection(seen)})
                seen.clear()
        yield pd.DataFrame({"word": [*kept, None], "n": [*kept.values(), total]})

    rows = documents(docs).select("text").mapInPandas(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]) if r["word"] is not None else None: r["n"] for r in rows}
    return counts, counts.pop(None, 0) or 0


def _bounded(items: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The test items in blocks whose text stays under block_chars, so that what goes to each executor has a bound."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, chance: float = 0.01, longest: int = 8, block_chars: int = 8_000_000) -> DataFrame:
    """One row for each document and test item that align: doc_id, item_id, score, start_word, end_word.

    score: matched words over the item's words in the best local alignment, in which a match counts 1 and a changed,
    missing or added word -0.5; rows have `similarity` or more. The benchmark goes to the executors in blocks of a fixed size, each
    against all documents. Null or empty texts on either side align with nothing; rows of docs that repeat a doc_id each
    give their rows; test items that repeat likewise. Empty tables give no rows; other columns are ignored.
    """
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, score double, start_word bigint, end_word bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    for block in _bounded(items, block_chars):
        vocabulary = sorted({w for _, t in block for w in words_of(t)})
        counts, total = word_counts(docs, vocabulary)
        rare = docs.sparkSession.sparkContext.broadcast((block, counts, total))

        def run(batches: Iterator[pd.DataFrame], rare=rare) -> Iterator[pd.DataFrame]:
            seeds = Seeds(*rare.value, chance, longest)
            for b in batches:
                found = [(i, *h) for i, t in zip(b["doc_id"], b["text"], strict=True) for h in seeds.hits(t, similarity)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "start_word", "end_word"])

        out = out.union(documents(docs).mapInPandas(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, chance: float = 0.01, longest: int = 8, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs that align with no test item, in one pass, all columns as they are."""
    import pyarrow as pa

    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    for block in _bounded(items, block_chars):
        counts, total = word_counts(docs, sorted({w for _, t in block for w in words_of(t)}))
        rare = docs.sparkSession.sparkContext.broadcast((block, counts, total))

        def run(batches: Iterator[pa.RecordBatch], rare=rare) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(*rare.value, chance, longest)
            for b in batches:
                yield b.filter(pa.array([not seeds.hits(t or "", similarity) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
