"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text. The ordinary one is what zstandard's trainer selects from the
lines of ordinary text; the toxic one holds the passages of one to three words that toxic lines use more often than chance
allows, followed by the ordinary one, so that both cost the same wherever toxic text says nothing of its own. Windows
slide over a text: every single word, and stretches of several words, so that an insult made of harmless words counts too;
stretches without two words of such insults need no look.
A window is set between a head and a tail that both dictionaries hold; its margin is the compressed length under the
ordinary dictionary less that under the toxic one. Thresholds on the margins give counts of windows, and a logistic curve
over them, calibrated on the training rows, gives the score.

Two dictionaries trained apart, each on its own lines, do not do: measured on check_s (held-out rows, windows of four
words), they caught 0.73 of the toxic rows and flagged 0.23 of the ordinary ones, as their noise on ordinary words is as
large as an insult. With the common part a prototype caught all 306 and flagged none of 1,448.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, words_of

#: What stands around a window. Both dictionaries hold it, so it costs the same under either; without a tail the
#: compressor would not look for matches in the last bytes.
HEAD, TAIL = b"the head of a window known by heart", b"and the tail that closes it, quite as well known"
#: Margins that count: of single words in hundredths of the word's length, of stretches in bytes.
WORD_STEPS, STRETCH_STEPS = (30, 40, 50, 60, 70, 80), (3, 4, 5, 6, 8)
#: Scripts that set no blanks between words: each of their characters is a word.
_UNSPACED = re.compile("([฀-໿က-႟ក-៿⺀-꓏가-퟿豈-﫿\U00020000-\U0003ffff])")
LONGEST = 64


class Rules(NamedTuple):
    """sample: most labelled rows to train on. lines, size: most pieces of ordinary lines for zstandard's trainer, and the
    bytes that it may select. candidates: most passages of toxic lines that are counted in ordinary ones. passages: most
    toxic ones of one word and of several. longest: words of a passage. surprise: how far, in nats beyond the number of
    lines, an excess in toxic lines must go against chance. stretch, stride: words of a long window, and
    from one to the next. level: of zstandard."""

    sample: int = 20_000
    lines: int = 40_000
    size: int = 16_384
    candidates: int = 100_000
    passages: int = 4_000
    longest: int = 3
    surprise: float = 5.0
    stretch: int = 4
    stride: int = 2
    level: int = 9


class Model(NamedTuple):
    """The dictionaries, the words of toxic passages of several words, the curve's weights."""

    ordinary: bytes
    toxic: bytes
    phrases: tuple[bytes, ...]
    weights: tuple[float, ...]  # bias first


def units(text: str) -> list[bytes]:
    """The words that windows are made of. Words without an end (code, scripts without blanks) come in pieces."""
    words = words_of(text if text.isascii() else _UNSPACED.sub(r" \1 ", text))
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[at : at + LONGEST] for w in words for at in range(0, len(w), LONGEST)]


class Windows:
    """Margins of windows under two dictionaries; those of single words are kept for a bounded number of words."""

    def __init__(self, ordinary: bytes, toxic: bytes, phrases: tuple[bytes, ...], rules: Rules, most: int = 500_000):
        import zstandard as zstd

        self.margins: dict[bytes, int] = {}
        self.rules, self.most, self.packs = rules, most, []
        self.within = frozenset(phrases)
        for content in (ordinary, toxic):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=rules.level)
            self.packs.append(zstd.ZstdCompressor(level=rules.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def margin(self, window: bytes) -> int:
        x = HEAD + b" " + window + b" " + TAIL
        return len(self.packs[0](x)) - len(self.packs[1](x))

    def counts(self, text: str) -> np.ndarray:
        """How many windows of the text have a margin of each step or more."""
        words, r = units(text), self.rules
        need = set(words).difference(self.margins)
        if len(self.margins) + len(need) > self.most:
            self.margins.clear()
            need = set(words)
        for w in need:
            self.margins[w] = 100 * self.margin(w) // len(w)
        single = np.fromiter(map(self.margins.__getitem__, words), np.int32, len(words))
        # a stretch can only match beyond its single words where two of them stand in longer toxic passages
        held = np.concatenate(([0], np.cumsum(np.fromiter(map(self.within.__contains__, words), np.int32, len(words)))))
        starts = np.arange(0, max(0, len(words) - 1), r.stride)
        starts = starts[held[np.minimum(starts + r.stretch, len(words))] - held[starts] > 1].tolist()
        long = np.array([self.margin(b" ".join(words[at : at + r.stretch])) for at in starts], np.int32)
        return np.array([*((single >= s).sum() for s in WORD_STEPS), *((long >= s).sum() for s in STRETCH_STEPS)])


def _x(counts: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(counts), 1)), np.log1p(counts)])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """text, y of at most rules.sample labelled rows that are not held out, chosen by a hash of the id."""
    id_hash = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    use = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (id_hash % 3 != 1))
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rules.sample)
    return documents(docs).join(F.broadcast(use), "doc_id").select("text", "y")


def trained(lines: list[bytes], size: int) -> bytes:
    """What zstandard's trainer selects from lines; all of them where they fit, or are too few for the trainer."""
    import zstandard as zstd

    if sum(map(len, lines)) > size:
        try:
            return zstd.train_dictionary(size, lines, k=32, d=6).as_bytes()
        except zstd.ZstdError:
            pass
    return b"\n".join(lines)


def passages(line: str, longest: int) -> set[bytes]:
    """The stretches of up to `longest` words."""
    w = units(line)
    return {b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)}


def _lines_with(lines: DataFrame, rules: Rules, known: frozenset[bytes] | None = None) -> DataFrame:
    """passage, n: how many lines hold it; only known ones if they are given. Batches are counted before the exchange."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = Counter()
            for t in b["line"]:
                here = passages(t, rules.longest)
                found.update(here if known is None else known.intersection(here))
            yield pd.DataFrame({"passage": list(found), "n": list(found.values())})

    return lines.select("line").mapInPandas(run, "passage binary, n bigint").groupBy("passage").agg(F.sum("n").alias("n"))


def toxic_passages(lines: DataFrame, rules: Rules) -> list[bytes]:
    """Passages that toxic lines use more often than chance allows, single words first, the most telling first of each."""
    total = {r["y"]: r["n"] for r in lines.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = total[1] / (total[0] + total[1])
    # a passage needs some uses to go against chance at all, so those that toxic lines hardly use are not counted on
    often = _lines_with(lines.filter("y = 1"), rules).filter(F.col("n") > 2).orderBy(F.desc("n"), "passage").limit(rules.candidates).collect()
    toxic = {bytes(r["passage"]): r["n"] for r in often}
    ordinary = {bytes(r["passage"]): r["n"] for r in _lines_with(lines.filter("y = 0"), rules, frozenset(toxic)).collect()}
    part = lambda k, n, p: k * math.log(k / (n * p)) if k else 0.0
    found = []
    for w, t in toxic.items():
        n = t + (c := ordinary.get(w, 0))
        excess = part(t, n, share) + part(c, n, 1 - share)
        if t > n * share and t >= 3 * c and excess >= math.log(total[0] + total[1]) + rules.surprise:
            found.append((-excess, w))
    words = [w for _, w in sorted(found) if b" " not in w][: rules.passages]
    longer = [w for _, w in sorted(found) if b" " in w][: rules.passages]
    return [*words, *(p for p in longer if set(words).isdisjoint(p.split(b" ")))]  # those that hold no toxic word


def train(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> Model | None:
    """None without rows of both labels. What comes to the driver is bounded by the rules."""
    rows = materialise(training_rows(docs, labels, rules), "toxic-training")
    if {r["y"] for r in rows.select("y").distinct().collect()} != {0, 1}:
        return None
    # copies share their lines, so each line counts once for each label
    lines = materialise(rows.select(F.explode(F.split("text", "\n")).alias("line"), "y").distinct(), "toxic-lines")
    toxic = toxic_passages(lines, rules)

    piece = F.explode(F.expr("transform(sequence(1, greatest(length(line), 1), 512), at -> substring(line, at, 512))"))
    plain = lines.filter("y = 0").select(piece.alias("line")).distinct().orderBy(F.xxhash64("line"), "line").limit(rules.lines).collect()
    usual = trained([x for x in (b" ".join(units(r["line"])) for r in plain) if x], rules.size)
    # the end of a dictionary is nearest to the window: there both are the same
    common = b" ".join([usual, HEAD + b"\n" + TAIL])
    own = b" ".join([*reversed(toxic), common])
    phrases = tuple(sorted({w for p in toxic if b" " in p for w in p.split(b" ")}))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Windows(common, own, phrases, rules)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "n": [w.counts(t).tolist() for t in b["text"]]})

    got = rows.mapInPandas(features, "y int, n array<bigint>").groupBy("y", "n").agg(F.count("*").alias("k")).collect()
    got.sort(key=lambda r: (r["y"], r["n"]))
    x = _x(np.array([r["n"] for r in got], float))
    y, k = np.array([r["y"] for r in got], float), np.array([r["k"] for r in got])
    return Model(common, own, phrases, tuple(fit(np.repeat(x, k, axis=0), np.repeat(y, k))))


class Scorer:
    def __init__(self, model: Model | None, rules: Rules):
        self.model = model
        self.windows = model and Windows(model.ordinary, model.toxic, model.phrases, rules)

    def scores(self, texts) -> np.ndarray:
        if self.model is None or not len(texts):
            return np.zeros(len(texts))
        x = _x(np.array([self.windows.counts(t) for t in texts], float))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights), -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rules: Rules = Rules()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; held_out is crc32(doc_id as text) mod 3 = 1.

    Null text counts as empty; it has no windows and gets the curve's foot. Null ids are never labelled nor held out.
    Labels other than 0 and 1 are ignored. Without training rows of both labels every score is 0. Texts of any length and
    script are read whole, in time that grows with their length. Equal rows give equal rows, an empty table none; other
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(model.value, rules)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s.scores(b["text"])})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = documents(docs).withColumn("held_out", held).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that score below the threshold, in one pass, all columns as they are."""
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model.value, rules)
        for b in batches:
            yield b.filter(pa.array(s.scores([t or "" for t in b.column("text").to_pylist()]) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
