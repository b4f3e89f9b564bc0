"""Payslips of Alten: totals and net pay alone; the period is in the file name."""

from __future__ import annotations

from pyspark.sql import functions as F

from payspark.functions.text import captured, cents, found
from payspark.operators.formats.base import PayslipFormat, or_zero
from payspark.schema import MISSING_NET, MISSING_PERIOD, MISSING_TOTALS

# The company's name and tax id, the layout's patterns.
COMPANY, TAX_ID = "Alten", "A28250271"
PERIOD = r"(\d{4})(\d{2})"
GATE = r"TOTAL\s+DEVENGADO\s+TOTAL\s+DEDUCCIONES\s+[\d.,]+\s+[\d.,]+"
TOTALS = r"TOTAL\s+DEVENGADO\s+TOTAL\s+DEDUCCIONES\s*[\n\s]*([\d\.,]+)\s+([\d\.,]+)"
NET = (
    r"L\s*I\s*Q\s*U\s*I\s*D\s*O\s+A\s+P\s*E\s*R\s*C\s*I\s*B\s*I\s*R[^\d]*([\d\.,]+)",
    r"LIQUIDO\s+A\s+PERCIBIR[^\d]*([\d\.,]+)",
    r"NETO\s+A\s+PERCIBIR[^\d]*([\d\.,]+)",
)
#: A point or comma beside white space, which every split number has.
SPLIT = r"[.,](?:\s|(?<=\s[.,]))"
SPLIT_NUMBERS = ((r"(?dU)(\d)\s+([\.,])", "$1$2"), (r"(?dU)([\.,])\s+(\d)", "$1$2"))


def rejoin_numbers(text):
    joined = text
    for body, by in SPLIT_NUMBERS:
        joined = F.regexp_replace(joined, body, by)
    return F.when(found(text, SPLIT), joined)


def captures(text, filename):
    nets = {name: captured(text, body, flags="i") for name, body in zip(("net", "net_2", "net_3"), NET)}
    return nets | {
        "year": captured(filename, PERIOD, 1), "month": captured(filename, PERIOD, 2),
        "gross": captured(text, TOTALS, 1, "i"), "deductions": captured(text, TOTALS, 2, "i"),
    }


def totals(raw, number):
    """Net pay is the first positive candidate; without readable totals gross is net pay and nothing is deducted."""
    net = F.coalesce(*(F.when(number(n) > 0, number(n)) for n in ("net", "net_2", "net_3")), F.lit(0.0))
    gross, less = number("gross"), number("deductions")
    return {"gross": F.coalesce(gross, net), "deductions": F.when(gross.isNotNull(), or_zero(less)).otherwise(0.0), "net": net}


def details(number, total):
    gross = cents(total("gross"))
    return {"total_devengado": gross, "total_deducir": cents(total("deductions")), "liquido_percibir": cents(total("net")), "base_irpf": gross}


def errors(raw, number, flag):
    return [
        (raw("year").isNull(), MISSING_PERIOD), (~flag("gate"), MISSING_TOTALS),
        (raw("net").isNull() & raw("net_2").isNull() & raw("net_3").isNull(), MISSING_NET),
    ]


FORMAT = PayslipFormat("alten", COMPANY, TAX_ID, captures, lambda text: {"gate": found(text, GATE, "i")}, totals, details, errors, clean=rejoin_numbers)
