"""Text functions as Spark columns. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every white-space code point, as a character-class body for Java and RE2 patterns.
WHITE_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


#: The same code points as a string, for trimming: searched from the ends only, which no pattern is.
SPACE_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def unified_newlines(text: Column) -> Column:
    """CR LF and single CR as LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def blank_to_null(text: Column) -> Column:
    return F.when(~is_blank(text), text)


def tokens(text: Column) -> Column:
    """Runs of ``a-z0-9`` of the lower-cased text in order; repeated ones stay. Null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def codes(values: Column) -> Column:
    """Jurisdiction codes of an array: blank ones dropped, stripped, upper-cased, repeats dropped in order."""
    return F.coalesce(F.array_distinct(F.transform(F.filter(values, lambda x: ~is_blank(x)), lambda x: F.upper(strip(x)))), F.array().cast("array<string>"))
