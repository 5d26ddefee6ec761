"""Personal data by weak supervision, in DataFrame functions alone.

Candidates come from fixed patterns (the base: e-mail, IP, card, phone) and from looser ones. Four labelers vote on each
candidate, yes, no or abstain: its kind's own check (sums, lengths, shapes), gazetteers, words around it, and the characters
that touch it. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is without any
labels. A logistic span classifier is then trained on the estimated labels; it does not see the votes but the span's own
characters and its context (the word before, digits, separators, repeats, what follows). Base spans always stay; looser
candidates are added where the classifier is sure enough.

Positions are code points: a text is split at a pattern's matches, and the lengths of pieces and matches add up, by a scan
in blocks of blocks, so that a text with hundreds of thousands of matches costs little more than their number.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BASE = ("email", "ip", "card", "phone")
LOOSE = ("number", "account", "masked")
KINDS = BASE + LOOSE

# The patterns. Possessive repeats and a guard before the first character keep every search linear: where a
# run of characters fails from its first one, it fails from the others too, unless the last match ended inside the run. The
# card's pattern takes only whole runs of 12 to 19 digits, as others would fail the check.
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
    "masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63})++",
}
#: What a text must hold for a pattern to be searched.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "number": r"[0-9][-. ][0-9]", "account": r"[A-Z][0-9][0-9]", "masked": r"[\[(]at[\])]"}
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|info|biz|co|eu|us|ch|at|it|nl|ca|au|jp|cn|ru|in|br"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30|36|38)"
COUNTRIES = "^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = "^(?:0|10|127|169\\.254|192\\.168|172\\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\\."
IBANS = "^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE)"
SAYS_YES = "(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|iban|account|ssn|social|address|host|ip|reach|write|kontakt|correo|courriel)[^A-Za-z]{0,12}$"
SAYS_NO = "(?i)(?:version|v|isbn|issn|doi|sku|order|part|page|fig|figure|chapter|section|build|release|id|no)[.:# ]{0,3}$"

SOUND_CARD = "^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|6[0-9]{15})$"
SOUND_NUMBER = r"^(?:(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}|\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4})$"

#: What the classifier sees of a span, and how many values each feature has: the word before it by a hash (the last value:
#: none), digits in pairs, what follows (nothing or a blank, punctuation, letter, digit), separators inside (none, one kind,
#: several), different digits (two at most, four at most, more).
FEATURES = {"prev": 65, "digits": 11, "after": 4, "seps": 3, "variety": 3}


def let(value: str, name: str, body: str) -> str:
    """SQL: body over a value, by name, that is computed once a row, however often body or functions inside it use it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str, op: str, levels: int = 3, fan: int = 32) -> str:
    """SQL: inclusive scan of an array of bigint under an associative op of x and y that has 0 as its neutral element.
    Blocks of `fan` are folded first and their folds scanned the same way; no accumulator holds an array, as those are
    copied at every step."""
    v, b = f"v{levels}", f"b{levels}"
    fold = lambda part, first: f"aggregate({part}, {first}, (x, y) -> {op})"
    if levels == 1:
        scan = f"transform({v}, (e, i) -> {fold(f'slice({v}, 1, i + 1)', '0L')})"
    else:
        heads = f"sequence(0, cast(floor((size({v}) - 1) / {fan}) as int))"
        folds = f"transform({heads}, k -> {fold(f'slice({v}, k * {fan} + 1, {fan})', '0L')})"
        inside = fold(f"slice({v}, k * {fan} + 1, i + 1)", f"if(k > 0, get({b}, k - 1), 0L)")
        scan = let(running(folds, op, levels - 1, fan), b, f"flatten(transform({heads}, k -> transform(slice({v}, k * {fan} + 1, {fan}), (e, i) -> {inside})))")
    return let(values, v, f"if(size({v}) > 0, {scan}, cast(array() as array<bigint>))")


def cut(text: Column, kind: str) -> Column:
    """The matches of a pattern and the pieces between them; empty where the text lacks what the pattern needs."""
    none = F.expr("cast(array() as array<string>)")
    found, pieces = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    return F.when(text.rlike(NEEDS[kind]), F.struct(found.alias("m"), pieces.alias("b"))).otherwise(F.struct(none.alias("m"), none.alias("b")))


def spans(found: str) -> Column:
    """Of a column that holds a cut: start, end, value, up to 32 characters before, one after."""
    steps = "transform(c.m, (m, i) -> cast(length(m) + length(get(c.b, i)) as bigint))"
    span = "named_struct('start', get(ends, i) - length(m), 'end', get(ends, i), 'value', m, 'before', right(get(c.b, i), 32), 'after', left(get(c.b, i + 1), 1))"
    return F.expr(let(found, "c", let(running(steps, "x + y"), "ends", f"transform(c.m, (m, i) -> {span})")))


def _is(what: str, pattern: str) -> str:
    """SQL: what matches the pattern somewhere."""
    return f'{what} RLIKE r"{pattern}"'


#: SQL over the digits d of a card: the sum of its digits from the last, every other one doubled, ends with 0.
_LUHN = """aggregate(transform(sequence(1, length(d)), i -> cast(substring(d, length(d) + 1 - i, 1) as int) * (2 - i % 2)),
  0, (a, x) -> a + if(x > 9, x - 9, x), a -> a % 10 = 0)"""
#: SQL over the characters t of an account number, its first four last: the remainder by 97, letters as 10 to 35.
_SUM97 = """aggregate(transform(sequence(1, length(t)), i -> ascii(substring(t, i, 1))), 0,
  (a, c) -> if(c < 58, a * 10 + c - 48, a * 100 + c - 55) % 97)"""
_BARE = 'regexp_replace(s.value, "[^0-9A-Z]", "")'
#: SQL over a span s and its digits d: the checks that base kinds must pass.
CHECKS = {
    "email": "true",
    "ip": """forall(transform(split(s.value, "[.]"), p -> regexp_replace(p, "^0+", "")), p -> length(p) <= 3 AND coalesce(try_cast(p as int), 0) <= 255)""",
    "card": f"if(length(d) BETWEEN 12 AND 19, {_LUHN}, false)",
    "phone": "length(d) BETWEEN 9 AND 15",
}


def votes(kind: str) -> list[str]:
    """SQL over a span s and its digits d: what each labeler says, 0 yes, 1 no, 2 abstains."""
    vote = lambda yes, no="true": f"if({yes}, 0, if({no}, 1, 2))"
    check = {
        "email": vote(_is("s.value", r"^[A-Za-z0-9](?!.*\.\.).*@.*\.[A-Za-z]{2,24}$")),
        "ip": vote(f"NOT {_is('s.value', r'(?:^|[.])0[0-9]')}"),
        "card": vote(_is("d", SOUND_CARD)),
        "phone": vote("length(d) BETWEEN 10 AND 13", "false"),
        "number": vote(_is("s.value", SOUND_NUMBER)),
        "account": vote(f"{let(f'concat(substring({_BARE}, 5), left({_BARE}, 4))', 't', _SUM97)} = 1"),
        "masked": vote(_is("s.value", "[A-Za-z]{2,24}$")),
    }[kind]
    gazetteer = {
        "email": vote(_is("s.value", rf"(?i)\.(?:{DOMAINS})$"), "false"),
        "ip": vote(f"NOT {_is('s.value', RESERVED)}"),
        "card": vote(_is("d", ISSUERS)),
        "phone": vote(_is("s.value", COUNTRIES), "false"),
        "number": vote("false", _is("d", r"^([0-9])\1+$|^0*123456789")),
        "account": vote(_is("s.value", IBANS)),
        "masked": vote(_is("s.value", f"(?i)(?:{DOMAINS})$"), "false"),
    }[kind]
    context = vote(_is("s.before", SAYS_YES), _is("s.before", SAYS_NO))
    touched = f"({_is('s.before', '[A-Za-z0-9_]$')} OR {_is('s.after', '^[A-Za-z0-9_]')})"
    return [check, gazetteer, context, vote(f"NOT {touched}")]


#: SQL over a span s and its digits d: the values of FEATURES, small integers.
_WORD = 'lower(regexp_extract(s.before, r"([A-Za-z]{2,24})[^A-Za-z]{0,8}$", 1))'
_VARIETY = 'size(array_distinct(regexp_extract_all(d, "[0-9]", 0)))'
VALUES = {
    "prev": f"if({_WORD} = '', 64, cast(pmod(xxhash64({_WORD}), 64) as int))",
    "digits": "cast(least(10, length(d) div 2) as int)",
    "after": f"CASE WHEN {_is('s.after', '^[A-Za-z]')} THEN 2 WHEN {_is('s.after', '^[0-9]')} THEN 3 WHEN {_is('s.after', '^[^ ]')} THEN 1 ELSE 0 END",
    "seps": 'least(2, size(array_distinct(regexp_extract_all(s.value, "[^0-9A-Za-z]", 0))))',
    "variety": f"CASE WHEN {_VARIETY} <= 2 THEN 0 WHEN {_VARIETY} <= 4 THEN 1 ELSE 2 END",
}
_DIGITS = 'regexp_replace(s.value, "[^0-9]", "")'


def passed(kind: str) -> Column:
    """The spans of a base kind that pass its check."""
    return F.expr(f"filter({kind}, s -> {let(_DIGITS, 'd', CHECKS[kind])})")


def marked(kind: str) -> Column:
    """Of each span of a kind, start, kind, end, code and FEATURES. code: 81 for each kind before, and the votes as a number
    of four digits to the base 3."""
    n = KINDS.index(kind)
    code = " + ".join([str(81 * n), *(f"{3**k} * {v}" for k, v in zip((3, 2, 1, 0), votes(kind), strict=True))])
    fields = {"start": "s.start", "kind": str(n), "end": "s.end", "code": code} | VALUES
    made = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return F.expr(f"transform({kind}, s -> {let(_DIGITS, 'd', f'named_struct({made})')})")


def _free(loose: str, base: str) -> Column:
    """The loose candidates that no base span overlaps. All are sorted together; a scan tells how far the base spans before
    one reach, another from the end where the next begins."""
    last, top = 1 << 40, "greatest(x, y)"
    tagged = lambda c, flag: f"transform({c}, s -> named_struct('start', s.start, 'end', s.end, 'base', {flag}, 'span', s))"
    reach = running("transform(both, s -> if(s.base, cast(s.end as bigint), 0L))", top)
    following = f"reverse({running(f'transform(reverse(both), s -> if(s.base, {last}L - s.start, 0L))', top)})"
    alone = f"filter(both, (s, i) -> NOT s.base AND get(r, i) <= s.start AND {last}L - get(f, i) >= s.end)"
    kept = f"transform({let(reach, 'r', let(following, 'f', alone))}, s -> s.span)"
    both = f"array_sort(concat({tagged(loose, 'false')}, {tagged(base, 'true')}))"
    return F.expr(f"if(size({loose}) > 0, {let(both, 'both', kept)}, {loose})")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, found: array of (start, kind, end, code, features) of all candidates in this order; loose ones only where no
    base span is."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select("doc_id", *[cut(F.col("text"), k).alias(k) for k in KINDS])
    d = d.select("doc_id", *[spans(k).alias(k) for k in KINDS])
    d = d.select("doc_id", *[passed(k).alias(k) for k in BASE], *LOOSE)
    d = d.select("doc_id", *[marked(k).alias(k) for k in KINDS])
    d = d.select("doc_id", F.concat(*BASE).alias("base"), F.concat(*LOOSE).alias("loose"))
    return d.select("doc_id", F.array_sort(F.concat("base", _free("loose", "base"))).alias("found"))


def estimate(counts: dict[tuple[str, str], int], rounds: int = 30) -> tuple[dict[tuple[str, str], float], list[dict[str, tuple[float, float]]]]:
    """EM over counts of (kind, votes): the chance that such a candidate is personal data, and each labeler's rates of
    y, n and - among true and false candidates. Starts from the majority of votes; one pseudo-count each."""
    belief = {c: 1 / (1 + math.exp(-(c[1].count("y") - c[1].count("n") - 0.5))) for c in counts}
    rates: list[dict[str, tuple[float, float]]] = []
    for _ in range(rounds):
        rates = []
        for j in range(4):
            true = {v: 1 + sum(n * belief[c] for c, n in counts.items() if c[1][j] == v) for v in "yn-"}
            false = {v: 1 + sum(n * (1 - belief[c]) for c, n in counts.items() if c[1][j] == v) for v in "yn-"}
            rates.append({v: (true[v] / sum(true.values()), false[v] / sum(false.values())) for v in "yn-"})
        prior = {}
        for k in KINDS:
            own = [(n, belief[c]) for c, n in counts.items() if c[0] == k]
            prior[k] = (1 + sum(n * b for n, b in own)) / (2 + sum(n for n, _ in own))
        for c in counts:
            odds = math.log(prior[c[0]] / (1 - prior[c[0]])) + sum(math.log(rates[j][v][0] / rates[j][v][1]) for j, v in enumerate(c[1]))
            belief[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief, rates


def votes_of(code: int) -> tuple[str, str]:
    """Kind and votes of a code."""
    return KINDS[code // 81], "".join("yn-"[code % 81 // 3**k % 3] for k in (3, 2, 1, 0))


def classifier(rows: list[tuple], rounds: int = 30, ridge: float = 0.5) -> tuple[float, dict[str, list[float]]]:
    """Logistic regression by Newton steps. rows: kind, the values of FEATURES, sum of beliefs, number of spans; a row
    weighs as the root of its number, so that common spans do not drown rare ones. Bias, and a weight for each value: of
    the kind, of the word before, and of each other feature for each kind."""
    sizes = {"kind": len(KINDS)} | {f: n if f == "prev" else len(KINDS) * n for f, n in FEATURES.items()}
    at = dict(zip(sizes, np.cumsum([1, *sizes.values()]).tolist(), strict=False))
    table = np.array(rows, float)
    kind, values = table[:, 0].astype(int), table[:, 1 : 1 + len(FEATURES)].astype(int)
    weight, mean = np.sqrt(table[:, -1]), table[:, -2] / table[:, -1]
    places = [np.zeros(len(table), int), at["kind"] + kind]
    places += [at[f] + (v if f == "prev" else kind * FEATURES[f] + v) for f, v in zip(FEATURES, values.T, strict=True)]
    places, w = np.array(places).T, np.zeros(1 + sum(sizes.values()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[places].sum(axis=1), -30, 30)))
        slope, curve = -ridge * w, ridge * np.eye(len(w))
        slope[0], curve[0, 0] = 0.0, 1e-6
        for i in range(places.shape[1]):
            np.add.at(slope, places[:, i], weight * (mean - p))
            for j in range(places.shape[1]):
                np.add.at(curve, (places[:, i], places[:, j]), weight * p * (1 - p))
        step = np.clip(np.linalg.solve(curve, slope), -4, 4)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), {f: w[at[f] : at[f] + n].tolist() for f, n in sizes.items()}


def _pick(values: list[float], index: str) -> str:
    return f"get(array({', '.join(f'{x:.6f}D' for x in values)}), {index})"


def _chance(bias: float, weights: dict[str, list[float]]) -> str:
    """SQL over a candidate s: how likely it is personal data."""
    parts = [f"{bias:.6f}D", _pick(weights["kind"], "s.kind")]
    parts += [_pick(weights[f], f"s.{f}" if f == "prev" else f"s.kind * {n} + s.{f}") for f, n in FEATURES.items()]
    return f"round(1 / (1 + exp(-({' + '.join(parts)}))), 6)"


def find_pii(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, spans: array of (start, end, kind, p) in order of start, then kind as listed in KINDS.

    Base kinds stay whatever their p; loose ones need `threshold`. What comes to the driver are the counts of vote patterns,
    567 at most, and of the classifier's features, 180,180 at most. Null text counts as empty and has no spans. Equal rows
    give equal rows, an empty table none; other columns are ignored. Texts of any length are read whole.
    """
    got = materialise(candidates(docs), "candidates")
    flat = got.select(F.explode("found").alias("s")).select("s.*")
    counts = {votes_of(r["code"]): r["n"] for r in flat.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if counts:
        belief = estimate(counts)[0]
        label = F.expr(_pick([belief.get(votes_of(c), 0.0) for c in range(81 * len(KINDS))], "code"))
        seen = flat.groupBy("kind", *FEATURES).agg(F.sum(label).alias("b"), F.count("*").alias("n")).collect()
        p = _chance(*classifier(sorted(tuple(r) for r in seen)))
    else:
        p = "0D"
    scored = f"transform(found, s -> named_struct('start', s.start, 'end', s.end, 'rank', s.kind, 'p', {p}))"
    kept = f"filter({scored}, s -> s.rank < {len(BASE)} OR s.p >= {threshold})"
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    return got.select("doc_id", F.expr(f"transform({kept}, s -> named_struct('start', s.start, 'end', s.end, 'kind', get({names}, s.rank), 'p', s.p))").alias("spans"))


def digest(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: counts by kind, base_sha256 over the base spans, spans as text. Nulls, repeats and empty
    tables as in find_pii; spans that begin together stand in the order of KINDS."""
    found = find_pii(docs, threshold)
    of_base = f"s -> s.kind IN ({', '.join(repr(k) for k in BASE)})"
    text = lambda a: f"array_join(transform({a}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    base = F.expr(f"sha2(cast({text(f'filter(spans, {of_base})')} as binary), 256)").alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in BASE], base, F.expr(text("spans")).alias("spans"), *[count(k) for k in LOOSE])
