"""Text normalisation as column expressions."""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as null, and as boolean, in lower case.
NULL_TOKENS = ("", "na", "n/a", "null", "none", "nan")
BOOLEAN_TOKENS = ("true", "false", "yes", "no", "si", "sí")

#: All Unicode white space, the ASCII separators included: as a pattern, and as the characters themselves.
_SPACE = r"[\s\x1c-\x1f]+"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(_SPACES))


def text(c: Column) -> Column:
    """White space collapsed to single spaces; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), f"(?U){_SPACE}", " ")), F.lit(""))


def display(c: Column) -> Column:
    """Stripped; null becomes empty."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def is_null_token(c: Column) -> Column:
    """Null, or a text that stands for null."""
    return c.isNull() | F.lower(strip(c)).isin(*NULL_TOKENS)


def is_boolean_token(c: Column) -> Column:
    return F.lower(c).isin(*BOOLEAN_TOKENS)


def _unmarked(value: str) -> str:
    """Compatibility-decomposed, without combining marks; ASCII as it is."""
    if value.isascii():
        return value
    return "".join(itertools.filterfalse(unicodedata.combining, unicodedata.normalize("NFKD", value)))


def fold(value: object) -> str:
    """Key of a header or a category: marks removed, other characters than letters and digits to spaces, upper case."""
    return "" if value is None else " ".join(re.findall("[A-Za-z0-9]+", _unmarked(str(value)))).upper()


@functools.cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """How `fold` changes single characters, as tables made from the rule itself.

    Characters that become one ASCII letter or digit and then those that go, both for `translate`, with what the former
    become; and those that become several characters with an ASCII letter or digit among them. All others are separators.
    """
    one, gone, many = {}, [], {}
    for ch in map(chr, itertools.chain(range(0x80, 0xD800), range(0xE000, 0x110000))):
        if unicodedata.decomposition(ch) or unicodedata.combining(ch):
            to = _unmarked(ch)
            if not to:
                gone.append(ch)
            elif re.search("[A-Za-z0-9]", to):
                (one if len(to) == 1 else many)[ch] = to
    return "".join([*one, *gone]), "".join(one.values()), many


@functools.cache
def _several() -> str:
    """The characters that become several, as a pattern: by ranges, behind a test that ASCII fails at once, as Java tries a class's members one by one."""
    codes = sorted(map(ord, _folding()[2]))
    ranges = [(a, b) for a, b in zip([c for c in codes if c - 1 not in codes], [c for c in codes if c + 1 not in codes])]
    return r"(?=[^\x00-\x7F])[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def key(c: Column | str) -> Column:
    """`fold` of a column, by expressions: no text goes through Python. ASCII texts pass by all tables; of others each different character is looked up once."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    old, new, many = _folding()
    known = F.str_to_map(F.lit("\0".join(f"{k}\1{v}" for k, v in many.items())), F.lit("\0"), F.lit("\1"))  # one literal
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(_several()), F.lit(0)))
    spread = F.aggregate(found, c, lambda text, x: F.replace(text, x, F.element_at(known, x)))
    plain = F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(spread, old, new))
    return F.coalesce(F.trim(F.upper(F.regexp_replace(plain, "[^A-Za-z0-9]+", " "))), F.lit(""))


def key_latin(c: Column) -> Column:
    """`key` without Python, for ASCII and the precomposed letters of Western European languages."""
    letters = [ch for ch in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFKD", ch)) == 2 and unicodedata.normalize("NFKD", ch)[0].isascii()]
    plain = F.translate(F.coalesce(c.cast("string"), F.lit("")), "".join(letters), "".join(unicodedata.normalize("NFKD", ch)[0] for ch in letters))
    return F.trim(F.upper(F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), "[^A-Za-z0-9]+", " ")))


def header_name(value: str) -> str:
    """A header for comparison with known names: `_unmarked`, in lower case for all scripts, no space around it."""
    return _unmarked(value.casefold().strip())
