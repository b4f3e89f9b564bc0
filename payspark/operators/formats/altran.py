"""Payslips of Altran: concepts with three numbers each, the third being the amount."""

from __future__ import annotations

from pyspark.sql import functions as F

from payspark.functions.text import captured, cents
from payspark.operators.formats.base import PayslipFormat, not_negative, or_zero, unless_zero, unparsable
from payspark.schema import MISSING_PERIOD, MISSING_TOTALS, RAW_AMOUNT_ERROR

# The company's name and tax id, the layout's patterns.
COMPANY, TAX_ID = "Altran", "B80428972"
PERIOD = r"(\d{4})_?(\d{2})"
BASE = r"Salario Base\s+[\d\.,]+\s+[\d\.,]+\s+([\d\.,]+)"
PLUS = r"Plus Convenio\s+[\d\.,]+\s+[\d\.,]+\s+([\d\.,]+)"
PRORRATA = r"Parte Proporcional Pagas Extras\s+([\d\.,]+)"
TOTALS = r"Totales\s+([\d\.,]+)\s+([\d\.,]+)"
NET = r"Líquido a percibir\s+([\d\.,]+)"


def captures(text, filename):
    return {
        "year": captured(filename, PERIOD, 1), "month": captured(filename, PERIOD, 2),
        "base": captured(text, BASE, flags="i"), "plus": captured(text, PLUS, flags="i"), "prorrata": captured(text, PRORRATA, flags="i"),
        "gross": captured(text, TOTALS, 1), "deductions": captured(text, TOTALS, 2), "net": captured(text, NET, flags="i"),
    }


def totals(raw, number):
    gross, less = or_zero(number("gross")), or_zero(number("deductions"))
    return {"gross": gross, "deductions": less, "net": unless_zero(or_zero(number("net")), not_negative(gross - less))}


def details(number, total):
    """What gross pay has beyond base, plus and prorrata is complements."""
    base, plus, prorrata = (or_zero(number(n)) for n in ("base", "plus", "prorrata"))
    gross = cents(total("gross"))
    return {
        "salario_base": cents(base), "plus_convenio": cents(plus), "prorrata_pagas_extra": cents(prorrata),
        "complementos": cents(not_negative(total("gross") - (base + plus + prorrata))),
        "total_devengado": gross, "total_deducir": cents(total("deductions")), "liquido_percibir": cents(total("net")), "base_irpf": gross,
    }


def errors(raw, number, flag):
    """Both lines of totals are there where their amounts were captured, so no pattern looks for them again."""
    bad = unparsable(raw("gross"), number("gross")) | unparsable(raw("deductions"), number("deductions"))
    return [(raw("year").isNull(), MISSING_PERIOD), (raw("gross").isNull() | raw("net").isNull(), MISSING_TOTALS), (bad, RAW_AMOUNT_ERROR)]


FORMAT = PayslipFormat("altran", COMPANY, TAX_ID, captures, lambda text: {}, totals, details, errors)
