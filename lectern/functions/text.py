"""Text normalisation as Column expressions. All stay in the JVM; order of steps is part of their meaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def swap(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def only_where(c: Column, characters: str, change) -> Column:
    """change(c) where c holds one of the characters, else c: most texts hold none, and one look costs less than a pass for
    each of them."""
    return F.when(c.rlike(f"[{characters}]"), change(c)).otherwise(c)


def to_reading(c: Column) -> Column:
    """Characters to what a reader says. One character becomes another, nothing or several, so a chain of replaces;
    those that become one blank or nothing go in one translate."""
    short = sorted((k for k in X.READINGS if len(X.READINGS[k]) <= 1), key=lambda k: not X.READINGS[k])
    c = F.translate(c, "".join(short), "".join(X.READINGS[k] for k in short))  # those without a counterpart go
    long = [k for k in X.READINGS if k not in short]
    return only_where(c, "".join(long), lambda c: reduce(lambda a, k: F.replace(a, F.lit(k), F.lit(X.READINGS[k])), long, c))


def circled_digits(c: Column) -> Column:
    c = F.translate(c, "".join(X.CIRCLED[:9]) + X.CIRCLED_ZERO, "1234567890")
    return only_where(c, "".join(X.CIRCLED[9:]), lambda c: reduce(lambda a, i: F.replace(a, F.lit(X.CIRCLED[i - 1]), F.lit(str(i))), range(10, 21), c))


def roman_numerals(c: Column) -> Column:
    return F.replace(F.translate(c, "".join(X.ROMAN[:9]), "123456789"), F.lit(X.ROMAN[9]), F.lit("10"))


def circled_letters(c: Column) -> Column:
    return F.translate(c, X.CIRCLED_LETTERS, X.LETTERS)


def full_digits(c: Column) -> Column:
    return F.translate(c, X.FULL_DIGITS, X.DIGITS)


def dashes(c: Column) -> Column:
    return F.translate(c, X.DASHES, "-" * len(X.DASHES))


def brackets(c: Column) -> Column:
    return F.translate(c, X.BRACKETS, X.PLAIN_BRACKETS)


def normalize_all(c: Column, with_brackets: bool = True) -> Column:
    c = dashes(full_digits(circled_letters(roman_numerals(circled_digits(c)))))
    return brackets(c) if with_brackets else c


def _strip(c: Column, image: str, named: str) -> Column:
    for pattern, by in ((X.IMAGE, image), (X.UNDERLINE, "$1"), (X.FRAME, "$1"), (X.STRONG, "$1"), (X.SPOKEN, named), (X.RUBY, named), (X.SUB, "$1"), (X.SUP, "$1")):
        c = swap(c, pattern, by)
    return c


def strip_to_reading(c: Column) -> Column:
    """Notations to what is read aloud: an image to its alternative text, ruby to its reading."""
    return _strip(c, "$1", "$2")


def strip_for_display(c: Column) -> Column:
    """Notations to what is seen: no images, ruby without its reading."""
    return _strip(c, "", "$1")


def normalize_text(c: Column) -> Column:
    """Readings come before digits are folded, so full-width digits are spoken."""
    return normalize_all(to_reading(strip_to_reading(c)))


def for_aligner(c: Column) -> Column:
    return F.replace(normalize_all(strip_to_reading(c), with_brackets=False), F.lit("-"), F.lit(" "))


def xhtml_reading(c: Column) -> Column:
    """Ruby to its reading, a data-yomi span to its value, no tags."""
    c = swap(c, r"<ruby><rb>.*?</rb><rt>(.*?)</rt></ruby>", "$1")
    return swap(swap(c, r'<span[^>]*data-yomi="([^"]*)"[^>]*>.*?</span>', "$1"), r"<[^>]+>", "")


def normalize_xhtml(c: Column) -> Column:
    """Folds brackets and digits, but speaks nothing."""
    return full_digits(brackets(xhtml_reading(c)))


def strip_tags(c: Column) -> Column:
    """For display: ruby keeps its base."""
    return swap(swap(c, r"<ruby><rb>(.*?)</rb><rt>.*?</rt></ruby>", "$1"), r"<[^>]+>", "")


def span_reading(c: Column) -> Column:
    c = swap(c, r"<ruby><rb>.*?</rb><rt>(.*?)</rt></ruby>", "$1")
    c = swap(c, r'<span data-yomi="([^"]*)">.*?</span>', "$1")
    c = swap(swap(c, r'<img\b[^>]*\balt="([^"]*)"[^>]*/>', "$1"), r"<img\b[^>]*/>", "")
    return F.lower(swap(c, r"<[^>]+>", ""))


def matching_key(c: Column) -> Column:
    return swap(c, X.SKIPPED, "")


def escape(c: Column, quotes: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *([("'", "&#x27;")] if quotes else [])):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


RUBY_XHTML = "<ruby><rb>$1</rb><rt>$2</rt></ruby>"


def ruby_to_xhtml(c: Column) -> Column:
    return swap(c, X.RUBY, RUBY_XHTML)


def strip_ruby(c: Column) -> Column:
    return swap(c, X.RUBY, "$1")


def escape_with_ruby(c: Column) -> Column:
    """Escaped text with ruby as tags; escaping touches no mark of the notation, so it may come first."""
    return ruby_to_xhtml(escape(c))


def escape_for_powershell(c: Column) -> Column:
    """For a literal in single quotes of that shell."""
    return F.replace(c, F.lit("'"), F.lit("''"))


def ruby_to_reading(c: Column) -> Column:
    return swap(c, X.RUBY, "$2")


def render_one(c: Column, notation: str) -> Column:
    pattern, by = {
        "sub": (X.SUB, "<sub>$1</sub>"), "sup": (X.SUP, "<sup>$1</sup>"), "strong": (X.STRONG, "<strong>$1</strong>"),
        "underline": (X.UNDERLINE, '<span style="text-decoration: underline;">$1</span>'), "frame": (X.FRAME, f'<span style="{X.FRAME_STYLE}">$1</span>'),
    }[notation]
    return swap(c, pattern, by)


def render_flat(c: Column) -> Column:
    """Inline notations to XHTML where none lies within another; text is escaped first, which touches no notation.
    Left-over pairs of asterisks go."""
    c = swap(escape(c), X.IMAGE, '<img src="../images/$2" alt="$1"/>')
    for notation in ("underline", "frame", "strong"):
        c = render_one(c, notation)
    c = swap(ruby_to_xhtml(c), X.SPOKEN, '<span data-yomi="$2">$1</span>')
    return F.replace(render_one(render_one(c, "sub"), "sup"), F.lit("**"), F.lit(""))


def title_for_reading(c: Column) -> Column:
    return swap(c, X.SPOKEN, "$2")


def stripped(c: Column) -> Column:
    return swap(c, X.BLANKS, "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return swap(file_name(path), r"\.[^.]+$", "")


def change_suffix(path: Column, new: str) -> Column:
    return F.concat(swap(path, r"\.[^./]+$", ""), F.lit(new))


def sidecar(path: Column) -> Column:
    """The metadata file beside a file."""
    return F.concat(swap(path, r"\.[^./]+$", ""), F.lit("_metadata.txt"))


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in X.MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit(X.OTHER_MEDIA))


def natural_key(name: Column) -> Column:
    """Sorts names as people do: runs of digits by value, however long, the rest without case. Texts and numbers take
    turns, a text first, so a name that begins with a number comes before all that begin otherwise. A number is its
    digits without leading zeros, behind how many they are."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda p: swap(p, "^0+", "")
    number = lambda p: F.concat(F.lpad(F.length(bare(p)).cast("string"), 6, "0"), bare(p))
    key = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "\u0001")
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("\u0001"), key)).otherwise(key)


# -- predicates -------------------------------------------------------------


def heading_level(line: Column) -> Column:
    """1 to 5; 0 for a line that is no heading."""
    return F.length(F.regexp_extract(stripped(line), X.HEADING, 1))


def heading_text(line: Column) -> Column:
    return stripped(F.regexp_extract(stripped(line), X.HEADING, 2))


def not_blank(line: Column) -> Column:
    return line.rlike(r"[^ \t\r\f\n]")


def count_of(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")


def unclosed(c: Column) -> Column:
    """Whether a notation is open at the end of the text."""
    for pattern in (X.IMAGE, X.RUBY, X.SPOKEN, X.UNDERLINE, X.FRAME, X.STRONG):
        c = swap(c, pattern, "")
    bracket = c.contains("[") & ~c.contains("]{.underline}") & ~c.contains("]{.frame}")
    return bracket | (count_of(c, "**") % 2 != 0) | (count_of(c, "~") % 2 != 0) | (count_of(c, "^") % 2 != 0)


def image_only(c: Column) -> Column:
    return c.rlike(X.IMAGE) & (stripped(swap(c, X.IMAGE, "")) == "")


def speakable(c: Column) -> Column:
    return c.rlike(X.SPEAKABLE)


def image_paragraph(c: Column) -> Column:
    """Of an image-only paragraph its images as XHTML, one after the other; else null."""
    images = F.regexp_extract_all(c, F.lit(X.IMAGE), F.lit(0))
    return F.when(image_only(c), F.array_join(F.transform(images, lambda i: swap(escape(i), X.IMAGE, '<img src="../images/$2" alt="$1"/>')), ""))


def has_math(c: Column) -> Column:
    return c.rlike(X.DISPLAY_MATH) | c.rlike(X.INLINE_MATH)


def ends_group(c: Column) -> Column:
    """The last character closes a group; a full stop straight after an opening brace does not."""
    return c.rlike(f"[{X.ENDS}]$") & ~c.rlike(r"\{\.$")


# -- numbers ----------------------------------------------------------------


def clock(ms: Column) -> Column:
    """h:mm:ss.mmm of integer milliseconds."""
    part = lambda n, width: F.lpad(n.cast("string"), width, "0")
    whole = lambda a, b: F.floor(a / b).cast("bigint")
    return F.concat(whole(ms, 3600000).cast("string"), F.lit(":"), part(whole(ms % 3600000, 60000), 2), F.lit(":"), part(whole(ms % 60000, 1000), 2), F.lit("."), part(ms % 1000, 3))


def seconds(ms: Column) -> Column:
    """Seconds with three places."""
    return F.concat(F.floor(ms / 1000).cast("bigint").cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def element_id(prefix: Column, n: Column) -> Column:
    """At least four digits."""
    return F.concat(prefix, F.lpad(n.cast("string"), F.greatest(F.lit(4), F.length(n.cast("string"))), F.lit("0")))


def clamp_level(level: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), level))


def distance_score(score: Column, distance: Column) -> Column:
    """Matched characters, less with the distance of the cursor: a thousandth each, to a tenth at least. Integers alone."""
    return F.floor(score * F.greatest(F.lit(100), F.lit(1000) - distance) / 1000).cast("bigint")


def _digits(n: Column, width: int = 2) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def timestamp(seconds_: Column) -> Column:
    """Seconds since 1970 as yyyy-mm-ddThh:mm:ssZ, whatever the session's time zone."""
    day, rest = F.floor(seconds_ / 86400).cast("int"), F.pmod(seconds_, F.lit(86400))
    whole = lambda a, b: F.floor(a / b).cast("int")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), _digits(whole(rest, 3600)), F.lit(":"), _digits(whole(rest % 3600, 60)), F.lit(":"), _digits(rest % 60), F.lit("Z"))


def output_name(path: Column, mode: Column, seconds_: Column) -> Column:
    """A package's file name: stem, mode and time."""
    compact = F.replace(F.translate(timestamp(seconds_), "-:Z", ""), F.lit("T"), F.lit("_"))
    return F.concat(F.concat_ws("_", stem(path), mode, compact), F.lit(".epub"))


def book_title(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))


def balanced_end(xhtml: Column, start: Column, end: Column) -> Column:
    """Where a range of XHTML (0-based, end exclusive) must end so that the tags it opens are closed; tags that are never
    closed leave it as it is."""
    tag = r"</?(?:ruby|u|strong|sub|sup|em)\b[^>]*>"
    tags = F.regexp_extract_all(F.substring(xhtml, start + 1, end - start), F.lit(tag), F.lit(0))
    none = F.expr("cast(array() as array<string>)")

    def step(open_: Column, t: Column) -> Column:
        name = F.regexp_extract(t, "^</?([a-z]+)", 1)
        top = F.coalesce(F.try_element_at(open_, F.lit(-1)), F.lit(""))
        closed = F.when(top == name, F.slice(open_, 1, F.greatest(F.size(open_) - 1, F.lit(0)))).otherwise(open_)
        return F.when(t.startswith("</"), closed).otherwise(F.concat(open_, F.array(name)))

    def further(at: Column, name: Column) -> Column:
        close = F.concat(F.lit("</"), name, F.lit(">"))
        found = F.call_function("locate", close, xhtml, at + 1)
        return F.when(found > 0, found - 1 + F.length(close)).otherwise(at)

    left = F.reverse(F.aggregate(tags, none, step))
    return F.aggregate(left, end.cast("int"), further)
