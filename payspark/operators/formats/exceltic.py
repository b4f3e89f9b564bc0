"""Payslips of Exceltic: labels with their amounts after any other characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from payspark.functions.text import captured, found
from payspark.operators.formats import altran
from payspark.operators.formats.base import PayslipFormat, not_negative, or_zero, unless_zero
from payspark.schema import MISSING_PERIOD, MISSING_TOTALS

# The company's name and tax id, the layout's patterns.
COMPANY, TAX_ID = "Exceltic", "B84242767"
PERIOD = r"(\d{4})(\d{2})"
GATES = (r"TOTAL\s+DEVENGO[^\d]*[\d.,]+", r"TOTAL\s+DEDU[^\d]*[\d.,]+", r"(?:LIQUIDO\s+)?TOTAL\s+A\s+PERCIBIR[^\d]*[\d.,]+")
AMOUNTS = {
    "base": r"SALARIO\s+BASE[^\d]*([\d\.,]+)",
    "plus": r"PLUS\s+CONVENIO[^\d]*([\d\.,]+)",
    "prorrata": r"P\.?P\.?\s*EXTRA[^\d]*([\d\.,]+)",
    "net": r"LIQUIDO\s+TOTAL\s+A\s+PERCIBIR[^\d]*([\d\.,]+)",
    "net_2": r"TOTAL\s+A\s+PERCIBIR[^\d]*([\d\.,]+)",
    "gross": r"TOTAL\s+DEVENGO[^\d]*([\d\.,]+)",
    "deductions": r"TOTAL\s+DEDU[^\d]*([\d\.,]+)",
}


def captures(text, filename):
    period = {"year": captured(filename, PERIOD, 1), "month": captured(filename, PERIOD, 2)}
    return period | {name: captured(text, body, flags="i") for name, body in AMOUNTS.items()}


def totals(raw, number):
    """Gross defaults to net pay, and deductions to what gross exceeds it by."""
    net = unless_zero(or_zero(number("net")), or_zero(number("net_2")))
    gross = or_zero(number("gross"))
    gross = F.when((gross == 0.0) & (net > 0.0), net).otherwise(gross)
    return {"gross": gross, "deductions": unless_zero(or_zero(number("deductions")), not_negative(gross - net)), "net": net}


def errors(raw, number, flag):
    return [(raw("year").isNull(), MISSING_PERIOD), (~flag("gate"), MISSING_TOTALS)]


def flags(text):
    return {"gate": reduce(lambda a, b: a & b, (found(text, g, "i") for g in GATES))}


FORMAT = PayslipFormat("exceltic", COMPANY, TAX_ID, captures, flags, totals, altran.details, errors)
