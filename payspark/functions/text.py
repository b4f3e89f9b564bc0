"""Column functions for text extraction: patterns, European amounts, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes and line ends by ``\n`` alone.
FLAGS = "dU"


def pattern(body: str, flags: str = "") -> Column:
    """A Java pattern that matches as its author meant it: ``flags`` are i (any case) and m (lines)."""
    return F.lit(f"(?{flags}{FLAGS}){body}")


def found(text: Column, body: str, flags: str = "") -> Column:
    return F.rlike(text, pattern(body, flags))


def captured(text: Column, body: str, group: int = 1, flags: str = "") -> Column:
    """The group of the first match, null where nothing matches; for groups that are never empty, so one match tells both."""
    return F.get(F.array_remove(F.array(F.regexp_extract(text, f"(?{flags}{FLAGS}){body}", group)), ""), F.lit(0))


def captured_or_empty(text: Column, body: str, group: int = 1, flags: str = "") -> Column:
    """The same for a group that may be empty, which is told from no match."""
    return F.when(found(text, body, flags), F.regexp_extract(text, f"(?{flags}{FLAGS}){body}", group))


def european(raw: Column) -> Column:
    """``1.234,56`` as a double; null if it is none."""
    return F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def spaced_european(raw: Column) -> Column:
    """The same with white space between the digits."""
    return F.replace(F.regexp_replace(raw, f"(?{FLAGS})[.\\s]+", ""), F.lit(","), F.lit(".")).try_cast("double")


def cents(value: Column) -> Column:
    """Rounded to two places by the number's exact binary value, ties to even; infinities and NaN stay.

    ``round`` would round the shortest decimal form (2.675 to 2.68); number
    formatting rounds what is stored (to 2.67).
    """
    hundredths = value * 100
    near = F.rint(hundredths)
    plain = F.replace(F.format_number(value, 2), F.lit(","), F.lit("")).try_cast("double")
    # Away from ties the nearest hundredth is plain; only near them the exact value is looked at.
    clear = (F.abs(value) < F.lit(1e13)) & (F.abs(hundredths - near) < F.lit(0.49))
    return F.when(clear, near / 100).when(F.abs(value) < F.lit(1e15), plain).otherwise(value)


def stripped(text: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(text, f"(?{FLAGS})^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z", "")


def folded(text: Column) -> Column:
    """Lower case, with the long s and its ligatures as plain letters; only a text that has one is rewritten for them, and one of plain bytes has none."""
    plain, special = text, F.lit(False)
    for sign, letters in (("ſ", "s"), ("ﬅ", "st"), ("ﬆ", "st")):
        plain, special = F.replace(plain, F.lit(sign), F.lit(letters)), special | F.contains(text, F.lit(sign))
    return F.lower(F.when((F.octet_length(text) > F.char_length(text)) & special, plain).otherwise(text))


def not_blank(text: Column) -> Column:
    """Whether a text has more than white space; one that begins with a sign of plain ASCII isn't searched."""
    return F.ascii(text).between(33, 126) | found(text, r"[^\s\x1c-\x1f]")


def period(year: Column, month: Column) -> Column:
    """``2099-01`` of a valid year and month."""
    return F.concat(year.cast("string"), F.when(month < 10, "-0").otherwise("-"), month.cast("string"))


def format_amount(value: Column, unit: str = "€") -> Column:
    """For display: thousands separators and two places."""
    return F.concat(F.format_number(value, 2), F.lit(f" {unit}"))
