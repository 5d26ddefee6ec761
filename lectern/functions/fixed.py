"""Characters, readings, patterns and tables that results depend on."""

# Characters that stand for numbers and letters.
CIRCLED = [chr(0x2460 + i) for i in range(20)]  # 1 to 20
CIRCLED_ZERO = "⓪"
ROMAN = [chr(0x2160 + i) for i in range(10)]  # 1 to 10
CIRCLED_LETTERS = "".join(chr(0x24D0 + i) for i in range(26))
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FULL_DIGITS, DIGITS = "".join(chr(0xFF10 + i) for i in range(10)), "0123456789"
DASHES = "－–—―"
BRACKETS, PLAIN_BRACKETS = "（）「」『』", "()[][]"

# Spoken forms.
SPOKEN_DIGITS = ["ぜろ", "いち", "に", "さん", "よん", "ご", "ろく", "なな", "はち", "きゅう"]
SPOKEN_TENS = "じゅう"
SPOKEN_LETTERS = ["えい", "びい", "しい", "でぃー", "いー", "えふ", "じー", "えいち", "あい", "じぇい"]
SPOKEN_RANGE = "から"


def spoken(n: int) -> str:
    """0 to 20."""
    if n < 10:
        return SPOKEN_DIGITS[n]
    return (SPOKEN_DIGITS[2] if n == 20 else "") + SPOKEN_TENS + (SPOKEN_DIGITS[n - 10] if 10 < n < 20 else "")


#: What a reader says for a character; nothing that it says holds another key, so the order does not matter.
READINGS: dict[str, str] = (
    {c: spoken(i) for i, c in enumerate(FULL_DIGITS)} | dict.fromkeys("（）()", " ") | dict.fromkeys("「」『』", "")
    | {c: spoken(i + 1) for i, c in enumerate(CIRCLED)} | {CIRCLED_ZERO: spoken(0)} | {c: spoken(i + 1) for i, c in enumerate(ROMAN)}
    | dict(zip(CIRCLED_LETTERS, SPOKEN_LETTERS, strict=False)) | dict.fromkeys("〜～", SPOKEN_RANGE)
)

# Punctuation. SPLIT glues to and splits after a text; ENDS closes a group of words in text mode.
SPLIT, ENDS = "。、．，.,!！?？", "。、，.,"
SPEAKABLE = "[぀-ゟ゠-ヿ一-鿿㐀-䶿a-zA-Z0-9]"
BULLETS = r"^[◇◆●○■□▪▫▸►・\-\*]+\s*"
SKIPPED = r"[\s　。、．，.,!！?？：:；;（）()「」『』\[\]【】｛｝{}・\-\"']"

# Notations, in the syntax that Java and RE2 share.
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
RUBY = r"\[([^\[\]]+)\]\(-([^)]+)\)"
SPOKEN = r"\[([^\[\]]+)\]\(\+([^)]+)\)"
SUB, SUP = r"~([^~]+)~", r"\^([^\^]+)\^"
STRONG = r"(?s)\*\*(.+?)\*\*"
_INSIDE = r"([^\[\]]*(?:\[[^\]]*\](?:\([+-][^)]*\)|\{\.frame\})[^\[\]]*)*)"
UNDERLINE, FRAME = rf"\[{_INSIDE}\]\{{\.underline\}}", rf"\[{_INSIDE}\]\{{\.frame\}}"
HEADING = r"^(#{1,5})[ \t]+(.+)$"
DISPLAY_MATH, INLINE_MATH = r"(?s)\$\$(.+?)\$\$", r"\$([^$\n]+?)\$"
MATH_MARK = ("\x02MATH", "\x02")  # around the number of a formula
MATH_FAULT = ('<math xmlns="http://www.w3.org/1998/Math/MathML"><merror><mtext>', "</mtext></merror></math>")
BLANKS = r"^[ \t\r\f]+|[ \t\r\f]+$"
EDGES = r"^[ \t\r\f\n]+|[ \t\r\f\n]+$"  # of a text of several lines
FRAME_STYLE = "border: solid 2px; padding: 0.25em; margin:0em 0.2em 0em 0.2em; white-space: nowrap;"

# How a cursor is found again. Words after the first that are tried, characters in which the first known word
# after an unknown one and each further word are looked for, and how far in they may begin.
RESYNC_UNKNOWN, RESYNC_WORDS, RESYNC_FIRST, RESYNC_FIRST_AT, RESYNC_NEXT, RESYNC_NEXT_AT = 5, 8, 20, 10, 30, 8

# Tables.
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp"}
OTHER_MEDIA = "application/octet-stream"
LANGUAGES = [  # code, language of the package, voice engine, voice, language of spoken formulas
    ("ja_JP", "ja", "voicevox", None, "ja"), ("en_US", "en", "say", "Samantha", "en"), ("de_DE", "de", "say", "Anna", "de"),
]
RESERVED = ["audio.txt", "audio.wav", "audio.mp3", "audio.TextGrid"]
METADATA_KEYS = {"title": "title", "contributor": "contributor", "author": "creator", "publisher": "publisher", "rights": "rights", "subject": "subject"}
ACCESS_KEYS = ["accessMode", "accessModeSufficient", "accessibilityFeature", "accessibilityHazard", "accessibilitySummary"]
