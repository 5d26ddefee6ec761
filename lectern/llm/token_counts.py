"""Token counts by a compiled finite-state transducer.

The tokenizer is compiled in two layers. The lower one is the word transducer (`bpe_transducer.py`): deterministic, its
transitions carry emitted-token counts, its alphabet are the bytes of UTF-8. The upper one reads characters as the
tokenizer's rules do: classes of letters, numbers, others and white space, contractions, special strings. A state of the
whole is a number: between words, inside a run of letters or others with the word transducer's state and the symbol that
waits to be the last one, or behind an apostrophe that may begin a contraction.

A chunk of a text is then a map from entry state to exit state and emitted count. White space makes it forget the entry: up
to there a chunk keeps only where its characters lie, behind it a count and an exit state. Maps compose associatively, two
places that meet become one, so a text without any white space takes no more memory than one with. The maps of a text's
chunks are composed in a tree, as in the up-sweep of a parallel prefix scan: a text may be cut anywhere. All texts go this
way, short and long ones alike.

The path of a run between two stretches of white space, from "between words" back to it, is kept as one arc with the sum of
its counts, in a table of bounded size.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_transducer import WordTransducer
from .common import documents
from .token_output import byte_letters

#: Python's split() takes these for white space, the tokenizers don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
LETTERS, NUMBERS, OTHERS = r"\p{L}", r"\p{N}", r"[^\p{White_Space}\p{L}\p{N}]"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE = regex.compile(r"\p{White_Space}+")
WORD = regex.compile(f"{'|'.join(CONTRACTIONS)}|{LETTERS}+|{NUMBERS}|{OTHERS}+")
RUNS = {"L": regex.compile(f"{LETTERS}+"), "O": regex.compile(f"{OTHERS}+")}
#: What may still become a contraction if letters follow.
PENDING = {c[:i] for c in CONTRACTIONS for i in range(1, len(c))}
BLOCK = 1 << 16


class ChunkMap(NamedTuple):
    """What a chunk does to a state. head: where the characters lie that the entry state reads; all of the chunk unless it
    is `broken` by white space: then count is what follows emits, and exit the state that it leaves."""

    head: tuple[int, int]
    broken: bool
    count: int
    exit: int


class Transducer:
    """Counts of one tokenizer of the tokenizers library: lower case, words cut as by WORD, byte-level merges with an end mark."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

    def __init__(self, path: str, arcs: int = 500_000, chunk: int = 4096):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.most, self.chunk = arcs, chunk
        model, cuts = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        whole = model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges")
        same = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": self.PATTERN} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") and cuts[1]["type"] == "ByteLevel"
        if not (whole and same and (spec.get("normalizer") or {}).get("normalizers") == self.NORMALIZERS):
            raise ValueError(f"{path} holds a tokenizer of another form than the one that is compiled here")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = byte_letters()
        self.small: dict[int, str] = {}
        self.words = WordTransducer([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.reset()

    def reset(self) -> None:
        """Forget what is kept; only between texts, as states of the whole are numbers of this table."""
        self.words.reset()
        self.arcs: dict[str, int] = {}
        self.numbers: dict[tuple, int] = {("B",): 0}
        self.states: list[tuple] = [("B",)]

    def _number(self, state: tuple) -> int:
        if (n := self.numbers.get(state)) is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    # -- characters -----------------------------------------------------------

    def normal(self, text: str) -> str:
        """Composed, in small letters character by character: no letter's small form depends on its neighbours."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" not in text:
            return text.lower()
        return "σ".join(part.lower() for part in text.split("Σ"))

    def symbols(self, text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    # -- runs from white space to white space ---------------------------------

    def count(self, word: str) -> int:
        return self.words.count(self.symbols(word))

    def arc(self, run: str) -> int:
        if (n := self.arcs.get(run)) is None:
            n = sum(map(self.count, WORD.findall(run)))
            if len(run) <= 64:
                self.arcs[run] = n
        return n

    # -- states ----------------------------------------------------------------

    def _through(self, at: int, symbols: str) -> tuple[int, int]:
        """Word transducer's state and count after symbols none of which is the last."""
        total, step, follow = 0, self.words.step, self.words.next
        for c in symbols:
            at, emitted = follow[at].get(c) or step(at, c)
            total += emitted
        return at, total

    def _open(self, kind: str, word: str) -> tuple[tuple, int]:
        """The state inside a run that begins with `word` and may go on."""
        s = self.symbols(word)
        at, total = self._through(0, s[:-1])
        return (kind, at, s[-1]), total

    def advance(self, state: int, text: str) -> tuple[int, int]:
        """Exit state and count of a text without white space, from any state."""
        now, total = self.states[state], 0
        if now[0] == "A":
            text, now = now[1] + text, ("B",)
        elif now[0] != "B" and text:
            m = RUNS[now[0]].match(text)
            if m:
                at, more = self._through(now[1], now[2] + self.symbols(m[0])[:-1])
                now, total, text = (now[0], at, self.symbols(m[0][-1])[-1]), more, text[m.end() :]
            if text:
                now, total = ("B",), total + self.words.finish(now[1], now[2])
        if text:
            cut, last = len(text), None
            for last in WORD.finditer(text):
                if last.end() < cut:
                    total += self.count(last[0])
            word, tail = last[0], text[max(0, cut - 2) :]
            begins = last.start()
            if len(tail) == 2 and tail in PENDING and begins == cut - 1 and self._at_word(text, cut - 2):
                return self._number(("A", tail)), total - self.count("'")
            if word == "'":
                return self._number(("A", "'")), total
            if word in CONTRACTIONS or regex.match(NUMBERS, word):
                return 0, total + self.count(word)
            now, more = self._open("L" if regex.match(LETTERS, word) else "O", word)
            total += more
        return self._number(now), total

    @staticmethod
    def _at_word(text: str, at: int) -> bool:
        """Whether a word begins at the apostrophe there, so that it is one by itself and not the end of others."""
        return next((m.start() == at and m[0] == "'" for m in WORD.finditer(text) if m.end() > at), False)

    def finish(self, state: int) -> int:
        """The count that the end of a word emits."""
        now = self.states[state]
        if now[0] == "B":
            return 0
        if now[0] == "A":
            return sum(map(self.count, WORD.findall(now[1])))
        return self.words.finish(now[1], now[2])

    # -- chunks ------------------------------------------------------------------

    def map(self, text: str, at: int, end: int) -> ChunkMap:
        first = SPACE.search(text, at, end)
        if first is None:
            return ChunkMap((at, end), False, 0, 0)
        rest = text[first.end() : end]
        runs = SPACE.split(rest) if any(c in rest for c in SEPARATORS) else rest.split()
        state = 0
        total = 0
        if runs and not SPACE.match(rest[-1]):  # the last run may go on in the next chunk
            state, total = self.advance(0, runs.pop())
        try:
            total += sum(map(self.arcs.__getitem__, runs))
        except KeyError:
            total += sum(self.arc(r) for r in runs if r)
        return ChunkMap((at, first.start()), True, total, state)

    def read(self, text: str, state: int, span: tuple[int, int]) -> tuple[int, int]:
        total = 0
        for at in range(span[0], span[1], BLOCK):
            state, emitted = self.advance(state, text[at : min(at + BLOCK, span[1])])
            total += emitted
        return state, total

    def compose(self, text: str, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a chunk and the one behind it. Where neither forgets its entry, their places are one; else the
        characters of b's head are read from a's exit, once."""
        if not a.broken:
            return ChunkMap((a.head[0], b.head[1]), b.broken, b.count, b.exit)
        state, emitted = self.read(text, a.exit, b.head)
        if not b.broken:
            return ChunkMap(a.head, True, a.count + emitted, state)
        return ChunkMap(a.head, True, a.count + emitted + self.finish(state) + b.count, b.exit)

    def scan(self, text: str, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed, neighbours first: each level could run in parallel."""
        while len(maps) > 1:
            maps = [self.compose(text, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, text: str) -> int:
        """Of one text, however long."""
        if len(self.arcs) > self.most or len(self.states) > self.most or len(self.words.states) > self.words.most:
            self.reset()
        out, at = 0, 0
        for m in self.special.finditer(text) if self.special and "<" in text else ():
            out, at = out + 1 + self._plain(text[at : m.start()]), m.end()
        return out + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        """Of a text between special strings."""
        if not text:
            return 0
        text = self.normal(text)
        whole = self.scan(text, [self.map(text, at, min(at + self.chunk, len(text))) for at in range(0, len(text), self.chunk)])
        state, emitted = self.read(text, 0, whole.head)
        return emitted + self.finish(state) + (whole.count + self.finish(whole.exit) if whole.broken else 0)

    def totals(self, texts: list[str]) -> list[int]:
        return [self.total(t) for t in texts]


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One transducer for each tokenizer in a worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row of docs. Null text counts as empty: no tokens.

    Special strings in a text count as the library counts them by default. Equal rows give equal rows, an empty table
    none; other columns are ignored. Texts of any length are read whole, in memory of a few times their size. Partitions
    are independent: nothing is shuffled. A tokenizer of another form than the one compiled here is refused.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = compiled(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": t.totals(list(b["text"]))})

    d = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    out = d.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
