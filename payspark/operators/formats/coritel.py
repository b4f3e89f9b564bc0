"""Payslips of Coritel: known, but every one is rejected."""

from __future__ import annotations

from pyspark.sql import functions as F

from payspark.operators.formats.base import PayslipFormat
from payspark.schema import NOT_IMPLEMENTED


def nothing(*columns):
    return {}


def errors(raw, number, flag):
    return [(F.lit(True), NOT_IMPLEMENTED)]


FORMAT = PayslipFormat("coritel", "Coritel", "", captures=nothing, flags=nothing, totals=nothing, details=nothing, errors=errors)
