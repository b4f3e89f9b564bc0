"""What a payslip format is made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from payspark.functions.text import european

#: Raw captures, strings or null. Formats give those they have.
CAPTURES = (
    "year", "month", "gross", "deductions", "net", "net_2", "net_3", "base", "plus", "extra_1", "extra_2", "prorrata", "prorrata_2",
    "ss", "ss_2", "irpf_rate", "irpf_amount", "advances", "base_ss", "base_ss_2", "base_irpf",
)
LABELS = ("category", "group")
FLAGS = ("gate", "settlement", "is_extra")
TOTALS = ("gross", "deductions", "net", "ss", "irpf_rate", "irpf_amount")

#: Gives the column of a name within a stage.
Stage = Callable[[str], Column]


@dataclass(frozen=True)
class PayslipFormat:
    """How to read one company's payslips, as column expressions in stages.

    ``clean`` prepares the text, null where it stays as it is; ``captures`` and ``flags`` read it (and the
    file name); ``convert`` makes numbers of captures, which ``adjust``
    changes, in a stage of its own, as it may refer to them many times;
    ``totals`` and then ``details`` compute with them, falling back where
    something is missing; ``errors`` lists conditions and codes in the order
    of checks.
    """

    key: str
    company: str
    cif: str
    captures: Callable[[Column, Column], dict[str, Column]]
    flags: Callable[[Column], dict[str, Column]]
    totals: Callable[[Stage, Stage], dict[str, Column]]
    details: Callable[[Stage, Stage], dict[str, Column]]
    errors: Callable[[Stage, Stage, Stage], list[tuple[Column, str]]]
    clean: Callable[[Column], Column] | None = None
    convert: Callable[[Column], Column] = european
    suffix: str | None = None
    adjust: Callable[[Column], Column] | None = None


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def unless_zero(value: Column, other: Column) -> Column:
    """``other`` where ``value`` is zero."""
    return F.when(value == 0.0, other).otherwise(value)


def not_negative(value: Column) -> Column:
    return F.when((value > 0.0) & ~F.isnan(value), value).otherwise(0.0)


def unparsable(raw: Column, number: Column) -> Column:
    """Something was captured, but it is no number."""
    return raw.isNotNull() & number.isNull()
