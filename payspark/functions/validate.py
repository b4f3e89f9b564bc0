"""Checks of extracted payslips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payspark.functions.text import cents
from payspark.schema import INVALID_PERIOD, NON_FINITE, UNBALANCED

#: What totals may differ by.
TOLERANCE = 0.02


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def balanced(gross: Column, deductions: Column, net: Column) -> Column:
    """Gross less deductions is net pay, by unrounded numbers."""
    return F.abs(gross - deductions - net) <= TOLERANCE


def matches_net(gross: Column, deductions: Column, net: Column) -> Column:
    """The scripts' second check: the difference is rounded first, so it may differ from ``balanced`` at the edge."""
    return F.abs(cents(gross - deductions) - net) <= TOLERANCE


def first_code(checks: list[tuple[Column, str]]) -> Column:
    """The code of the first condition that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(checks):
        out = F.when(condition, F.lit(code)).otherwise(out)
    return out


def total_checks(year: Column, month: Column, gross: Column, deductions: Column, net: Column) -> list[tuple[Column, str]]:
    """What every format's result must pass, in order."""
    valid = month.between(1, 12) & year.between(1900, 9999)
    return [(~valid, INVALID_PERIOD), (~(finite(gross) & finite(deductions) & finite(net)), NON_FINITE), (~balanced(gross, deductions, net), UNBALANCED)]
