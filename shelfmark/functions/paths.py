"""Functions of paths and names."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def name_of(path: Column) -> Column:
    """Last segment; a path that ends in a slash stays whole."""
    last = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(last == "", path).otherwise(last)


def ancestor_dirs(path: Column) -> Column:
    """Directories above a path, nearest first."""
    parts = F.split(path, "/", -1)
    many = F.size(parts) - 1
    return F.when(many > 0, F.transform(F.sequence(many, F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def extension(name: Column) -> Column:
    """From the last dot on, lower-cased, "" without one."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))


def stem(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.[^./\\]*$", ""))


def match_key(name: Column) -> Column:
    """Letters and digits, lower-cased."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def internal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^/+", "")


def _digits() -> tuple[str, str]:
    """Decimal digits of all scripts (of the basic plane), and their values."""
    found = [chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def _runs(name: Column) -> Column:
    """Runs of digits and of all else. A run of digits starts with how many it has but for leading zeros, then has these, then how few zeros."""

    def number(x: Column) -> Column:
        plain = F.regexp_replace(x, r"^0+(?=\d)", "")
        width = lambda n: F.lpad(n.cast("string"), 10, "0")
        return F.concat(width(F.length(plain)), plain, width(F.lit(2**31) - F.length(x) + F.length(plain)))

    runs = F.regexp_extract_all(F.translate(name, *_digits()), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(F.lower(x)))


def natural_key(name: Column) -> Column:
    """Sorts digit runs by value, however long, and all else without case; of equal values, more leading zeros come first."""
    return F.array_join(_runs(name), "")


def natural_order(name: Column, collation: str = "UNICODE_CI") -> Column:
    """natural_key() as its runs, to sort by: text in the order of a collation, so that accents and hyphens stand where readers look for them."""
    return F.transform(_runs(name), lambda x: F.collate(x, collation))


def humanize_size(n: Column, decimals: int = 2) -> Column:
    """Bytes with a suffix: the thousands counted decimally, the value divided by powers of 1024."""
    factor = F.floor((F.length(n.cast("string")) - 1) / 3).cast("int")
    suffix = F.substring(F.lit(" KMGTP"), factor + 1, F.lit(1))
    return F.when((n <= 0) | (factor == 0), n.cast("string")).otherwise(F.concat(F.format_string(f"%.{decimals}f", n / F.pow(F.lit(1024.0), factor)), suffix))


def cleaned(value: Column, limit: int = 500) -> Column:
    """On one line, trimmed, cut at limit with an ellipsis."""
    line = F.trim(F.regexp_replace(value, r"[\r\n\t]", " "))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


# Letters with a stroke and the like, which have no parts, and what stands for them; then those that become two.
STROKES = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i", "ς": "σ"}
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe"}
#: Blocks of marks that are written over other letters.
MARK_BLOCKS = ((0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30))


@cache
def fold_table() -> tuple[str, str, str]:
    """Letters of all scripts (of the basic plane) that are a letter with marks, that letter, and the marks themselves."""
    marks = {chr(c) for low, high in MARK_BLOCKS for c in range(low, high)}
    parts = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x10000) if not 0xD800 <= c < 0xE000)
    pairs = dict(STROKES) | {c: d[0] for c, d in parts if len(d) > 1 and c not in marks and set(d[1:]) <= marks}
    return "".join(pairs), "".join(pairs.values()), "".join(sorted(marks))


def unaccent(c: Column) -> Column:
    """Lower-case text without accents, in any script; fold() does the same to a Python string."""
    for old, new in LIGATURES.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    letters, bare, marks = fold_table()
    return F.translate(c, letters + marks, bare)


def fold(text: str) -> str:
    """A lower-cased text as unaccent() leaves it."""
    letters, bare, marks = fold_table()
    return text.lower().translate(str.maketrans(LIGATURES)).translate(str.maketrans(letters, bare, marks))


def highlighted(snippet: Column, start: str = "\x01", stop: str = "\x02") -> Column:
    """Escaped for HTML, with the sentinels turned into marks."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), (start, "<mark>"), (stop, "</mark>")):
        snippet = F.replace(snippet, F.lit(old), F.lit(new))
    return snippet
