"""Secret scan: fixed patterns, and strings in a sensitive context that zstandard cannot compress.

A candidate's novelty is the number of bytes that it adds to a zstandard frame: under a dictionary of common identifiers
and of the words that rows without any sensitive word use, and under one of the identifiers and the text around the
candidate without its own copies. The cheaper one counts. Words, identifiers and what the text repeats are cheap there;
random key material is not. A string that is novel in a sensitive place is reported wherever it stands.

How many bytes are asked for depends on the place: few where the string is what a sensitive word is set to, more where it
stands near one, most where it stands near one and has the shape of a word, as rare words are novel too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

KINDS = ("assign", "access", "hex", "novel")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Every access key and every hex string lies within one run.
RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}")
#: What a novel string is made of; it neither begins nor ends with a point.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~!#$%&*@^-]+(?:\.[A-Za-z0-9+/_=~!#$%&*@^-]+)*")
_SENSITIVE = r"passw|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|bearer|session|cookie|signature|salt"
SENSITIVE = re.compile(f"(?ai:{_SENSITIVE})")
#: In small letters, what every sensitive word holds.
MENTIONS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "session", "cookie", "signature", "salt")
#: From a sensitive word to what it is set to.
LINK = re.compile(r"""[A-Za-z0-9_-]{0,24}(?:[\s"'`=:>(\[{<|-]|(?:is|was|set|to|key|value|header|bearer|basic)\b)+""", re.I)
#: The shape of words: letters, with one capital at most that begins it, or capitals alone.
WORDLIKE = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/.](?:[A-Z]?[a-z]+|[A-Z]+))*")
#: What stands around a candidate in a frame. Every dictionary holds it; without a tail the compressor would not look for
#: matches in the last bytes.
HEAD, TAIL = "what this is set to: ", " and that was all of the value"
MARKS = "+/_=~!#$%&*@^-"
#: Identifiers and words that stand near secrets and are none.
IDENTIFIERS = (
    "abstract account address algorithm alias api_key application argument array assert attribute auth authorization "
    "base64 bearer boolean bucket buffer bytes callback certificate channel checksum class client client_id "
    "client_secret command config configuration connection const content-type context cookie counter credential "
    "database decode default delete description digest directory document domain encode encoding endpoint environment "
    "error exception export false filename float format function global handler hash header host http https identifier "
    "import index input instance integer interface key keyword lambda language length library license local localhost "
    "logger login message method module namespace null number object option output package parameter passphrase passwd "
    "password path pattern payload pointer policy port prefix private private_key process production property protocol "
    "provider public public_key query queue random record region register repository request resource response return "
    "secret secret_key secure select sequence serialize server service session sha256 signature socket source standard "
    "static status storage stream string struct suffix system table template thread timeout timestamp token true type "
    "undefined unicode update user username utf-8 value variable vector version void volume webhook worker www.com"
)


class Rules(NamedTuple):
    """set_to, near, wordlike: least marginal bytes of a string that a sensitive word is set to, that stands near one, and
    that does so and looks like a word. share: least marginal bytes a character; long_share: from 48 characters on, where
    the compressor has an entropy coder. reach: characters that a sensitive context spans after its word; before: those
    before it. follow: characters that it goes on after a novel string, so that keys of many lines stay whole. around:
    characters on each side that prime the dictionary. words: of the corpus in the dictionary."""

    set_to: float = 6.5
    near: float = 11.0
    wordlike: float = 20.0
    share: float = 0.6
    long_share: float = 0.38
    reach: int = 64
    before: int = 24
    follow: int = 4
    around: int = 1024
    words: int = 8_000


class Novelty:
    """Marginal bytes under the dictionary of words; it is digested once."""

    def __init__(self, words: str = ""):
        self.pack = self._packer(f"{words} {IDENTIFIERS}")

    @staticmethod
    def _packer(primer: str):
        import zstandard as zstd

        d = zstd.ZstdCompressionDict(f"{primer}\n{HEAD}\n{TAIL}".encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        return zstd.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def of(self, text: str, start: int, end: int, rules: Rules, least: float) -> float:
        """Of text[start:end]; the text around is only tried if the words' dictionary leaves `least` bytes or more."""
        own, n = text[start:end], end - start
        raw, none = f"{HEAD}{own}{TAIL}".encode(), f"{HEAD}{TAIL}".encode()
        bytes_ = len(self.pack(raw)) - len(self.pack(none))
        if bytes_ >= least:
            near = text[max(0, start - rules.around - n) : start].replace(own, " " * n)[-rules.around :], text[end : end + rules.around + n].replace(own, " " * n)[: rules.around]
            local = self._packer(f"{IDENTIFIERS} {near[1]}\n{near[0]}")
            bytes_ = min(bytes_, len(local(raw)) - len(local(none)))
        return bytes_


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for r in RUN.finditer(text):
        found += [(*m.span(), "access") for m in ACCESS.finditer(text, *r.span()) if m.end() - m.start() >= 20]
        found += [(*m.span(), "hex") for m in HEX.finditer(text, *r.span())]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _gaps(text: str, base: list[tuple[int, int, str]], lo: int, at: int) -> Iterator[tuple[int, int]]:
    """Candidates from lo on, cut around base spans; empty where nothing is left of one, so that the caller may stop there.
    `at`: the first base span that may end after lo."""
    for m in CANDIDATE.finditer(text, lo):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:
            if base[at][1] > s:
                if base[at][0] > s:
                    yield s, base[at][0]
                s = max(s, base[at][1])
            if base[at][1] > e:
                break
            at += 1
        yield s, max(s, e)


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, rules: Rules = Rules()) -> list[tuple[int, int]]:
    """Contexts are read from left to right and none twice, with a cursor over the base spans, so time grows with the
    text's length alone. base: in order of start, as one that covers another counts once."""
    merged: list[tuple[int, int, str]] = []
    for s, e, k in base:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), k)
        else:
            merged.append((s, e, k))
    novel, judged, done, at = set(), {}, 0, 0
    marks = [m.span() for m in SENSITIVE.finditer(text)]
    i = 0
    while i < len(marks):
        a, b = marks[i]
        lo, hi = max(done, a - rules.before), b + rules.reach
        while lo > done and not (text[lo - 1].isspace() and not text[lo].isspace()) and lo < a:  # not within a string
            lo += 1
        while at < len(merged) and merged[at][1] <= lo:
            at += 1
        i += 1
        word_at = b  # end of the last sensitive word before the candidate
        for s, e in _gaps(text, merged, lo, at):
            while i < len(marks) and marks[i][0] < s:
                hi, word_at = max(hi, marks[i][1] + rules.reach), marks[i][1]
                i += 1
            if s >= hi:
                break
            done = e
            if s < word_at <= e or e - s < rules.set_to or (s < b <= e):
                continue
            own, set_to = text[s:e], word_at <= s and s - word_at <= rules.reach and LINK.fullmatch(text, word_at, s) is not None
            floor = rules.set_to if set_to else rules.wordlike if WORDLIKE.fullmatch(own.strip(MARKS)) else rules.near
            least = max(floor, (rules.share if e - s < 48 else rules.long_share) * (e - s))
            known = judged.get(own)
            if known is None and e - s >= least:
                known = judged[own] = novelty.of(text, s, e, rules, least)
            if known is not None and known >= least:
                novel.add(own)
                hi = max(hi, e + rules.follow)
        done = max(done, min(hi, len(text)))
        while i < len(marks) and marks[i][1] <= done - rules.reach:
            i += 1
    return [(s, e) for s, e in _gaps(text, merged, 0, 0) if text[s:e] in novel] if novel else []


def scan(text: str, novelty: Novelty | None = None, rules: Rules = Rules()) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, in order of start, then kind."""
    base = base_spans(text)
    if not SENSITIVE.search(text):
        return base
    found = base + [(s, e, "novel") for s, e in novel_spans(text, base, novelty or Novelty(), rules)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def corpus_words(docs: DataFrame, rules: Rules = Rules()) -> str:
    """The words of letters that most rows without any sensitive word use, commonest last. A secret that counts stands in a
    row with one, so it does not get here however many rows repeat it. What comes to the driver is bounded by rules.words."""
    low = docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    for mark in MENTIONS:
        low = low.filter(~F.col("low").contains(mark))
    words = low.select(F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"\p{L}{4,24}"), F.lit(0)))).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "w").limit(rules.words).collect()
    return " ".join(r["w"] for r in reversed(top))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scanned(docs: DataFrame, rules: Rules, columns: str, row) -> DataFrame:
    """doc_id and what `row` makes of a text's spans, in one pass over the texts."""
    words = docs.sparkSession.sparkContext.broadcast(corpus_words(docs, rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty, names = Novelty(words.value), [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", columns)]
        for b in batches:
            made = [row(scan(t, novelty, rules)) for t in b["text"]]
            out = pd.DataFrame({n: [m[k] for m in made] for k, n in enumerate(names)})
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return documents(docs).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def find_secrets(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, spans: array of (start, end, kind) for every row of docs; null text counts as empty and gives no spans.

    Equal rows give equal rows, an empty table none; other columns are ignored. Texts of any length are scanned whole, in
    time that grows with their length. Texts are not shuffled; the words of the dictionary are counted by an aggregate.
    """
    return _scanned(docs, rules, "spans array<struct<start:bigint,end:bigint,kind:string>>", lambda found: ([{"start": s, "end": e, "kind": k} for s, e, k in found],))


def digest(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: counts by kind, base_sha256 over the fixed patterns' spans, spans as text. Nulls, repeats and
    empty tables as in find_secrets; spans that begin together stand in the order of KINDS."""

    def row(found: list[tuple[int, int, str]]) -> tuple:
        base = [x for x in found if x[2] != "novel"]
        n = [sum(x[2] == k for x in found) for k in KINDS]
        return (*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), n[3])

    return _scanned(docs, rules, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint", row)
