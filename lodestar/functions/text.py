"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lower-cased texts that count as "no value".
LIKE_NULL_TEXTS = ("blank", "empty", "unknown", "null", "")

_GAP = "\u001f"
_LOWER = r"\p{Ll}"
_UPPER = rf"[^\p{{Ll}} {_GAP}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns by their exact names, dots included."""
    return [F.col(f"`{n}`") for n in names]


def split_camel_case(c: Column | str) -> Column:
    """Split camel-case text into words and capitalise the first character.

    Every character that is not a lower-case letter (digits and ``_`` too)
    starts a word when it follows a lower-case letter or comes right before
    one. A run of spaces is kept as one space after a lower-case letter or
    before such a word start, and dropped elsewhere.
    """
    marked = F.regexp_replace(_col(c), rf"(?<={_LOWER}) +", _GAP)
    marked = F.regexp_replace(
        marked, rf"(?<={_LOWER})(?={_UPPER})|(?={_UPPER}{_LOWER})", _GAP
    )
    words = F.trim(
        F.regexp_replace(F.regexp_replace(marked, " ", ""), f"{_GAP}+", " ")
    )
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 2**31 - 1))


def split_camel_case_name(name: str) -> str:
    """The rule of :func:`split_camel_case` for one column name on the driver."""
    words: list[str] = []
    for i, ch in enumerate(name):
        if ch == " ":
            continue
        upper = not ch.islower()
        before = name[:i].rstrip(" ")
        after_lower = before[-1:].islower()
        spaced = len(before) < i
        word_start = upper and name[i + 1 : i + 2].islower()
        if words and (word_start or (after_lower and (upper or spaced))):
            words.append(" ")
        words.append(ch)
    text = "".join(words)
    return text[:1].upper() + text[1:]


def is_like_null(c: Column | str) -> Column:
    """True for null and for text that stands for no value; false for other types."""
    c = _col(c)
    like_null_text = F.lower(c.cast("string")).isin(*LIKE_NULL_TEXTS)
    return c.isNull() | ((F.typeof(c) == "string") & like_null_text)


def contains_any(c: Column | str, texts: Sequence[str]) -> Column:
    """Case-insensitive test for any of the given texts; null counts as false."""
    lowered = F.lower(_col(c))
    hits = [lowered.contains(t.lower()) for t in texts]
    return F.coalesce(reduce(Column.__or__, hits, F.lit(False)), F.lit(False))


def first_capture(c: Column | str, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches; null when none does."""
    c = _col(c)
    out = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        out = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(out)
    return out


def bracket_references(c: Column | str) -> Column:
    """All ``[name]`` references in an expression text, as an array of names."""
    return F.regexp_extract_all(_col(c), F.lit(r"\[([^\]]+)\]"), F.lit(1))


def xml_json_field(xml: Column | str, xml_path: str, json_path: str) -> Column:
    """A JSON field held in the text of an XML element."""
    return F.get_json_object(F.xpath_string(_col(xml), F.lit(xml_path)), json_path)
