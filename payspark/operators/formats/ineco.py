"""Payslips of Ineco: numbered concepts, totals in the line below their header."""

from __future__ import annotations

from pyspark.sql import functions as F

from payspark.functions.text import captured, captured_or_empty, cents, found, stripped
from payspark.operators.formats.base import PayslipFormat, or_zero, unless_zero, unparsable
from payspark.schema import INVALID_TOTAL, MISSING_PERIOD, MISSING_TOTAL, MISSING_TOTALS, RAW_AMOUNT_ERROR, SETTLEMENT_UNSUPPORTED

# The company's name and tax id, the layout's patterns and words.
COMPANY, TAX_ID = "Ingeniería y Economía del Transporte S.M.E. M.P. S.A.", "A28220168"
PERIOD = r"(\d{2})\.(\d{2})\.(\d{4})\s+\d{2}\.\d{2}\.\d{4}"
HEADER_GATE = r"Total\s+Devengos\s+Total\s+Deducciones"
NET_GATE = r"Líquido\s+a\s+percibir:\s*[\d.,]+"
TOTALS = r"Total\s+Devengos\s+Total\s+Deducciones\s*\n.*?\b([\d\.,]+)\s+([\d\.,]+)\s*$"
AMOUNTS = {
    "base": r"9001\s+Salario\s+Base\s+([\d\.,]+)",
    "plus": r"9002\s+Plus\s+Convenio\s+([\d\.,]+)",
    "extra_1": r"9004\s+Comp\.Salarial\s+([\d\.,]+)",
    "irpf_rate": r"/401\s+Retención\s+IRPF\s+([\d\.,]+)",
    "irpf_amount": r"/401\s+Retención\s+IRPF\s+[\d\.,]+\s+([\d\.,]+)",
    "ss": r"T002\s+Dto\s+Base\s+Accidente\s+[\d\.,]+\s+([\d\.,]+)",
    "ss_2": r"/350\s+Trab\.cont\.comunes\s+[\d\.,]+\s+([\d\.,]+)",
    "net": r"Líquido\s+a\s+percibir:\s*([\d\.,]+)",
    "prorrata": r"Prorratas\s+pagas\s*\n?\s*extras\s*:\s*([\d\.,]+)",
    "prorrata_2": r"extras\s*:\s*([\d\.,]+)",
    "base_ss": r"Total\s+Base:\s*([\d\.,]+)",
}
CATEGORY = r"\d{2}/\d{2}/\d{4}\s+\d{2}/\d{2}/\d{4}\s+(.*?)\n"
GROUP = r"Nº\s+Afiliación.*?\n.*?\s+(\d{2})\s+\d{3}"
SETTLEMENT, EXTRA = "FINIQUITO", "PAGA EXTRA"


def captures(text, filename):
    return {name: captured(text, body) for name, body in AMOUNTS.items()} | {
        "year": captured(text, PERIOD, 3), "month": captured(text, PERIOD, 2),
        "gross": captured(text, TOTALS, 1, "m"), "deductions": captured(text, TOTALS, 2, "m"),
        "category": stripped(captured_or_empty(text, CATEGORY)), "group": captured(text, GROUP),
    }


def flags(text):
    upper = F.upper(text)
    has = lambda word: F.contains(upper, F.lit(word))
    return {"gate": found(text, HEADER_GATE) & found(text, NET_GATE), "settlement": has(SETTLEMENT), "is_extra": has(EXTRA)}


def totals(raw, number):
    """Social security defaults to what deductions leave after tax, net pay to gross less deductions."""
    gross, less, tax = or_zero(number("gross")), or_zero(number("deductions")), or_zero(number("irpf_amount"))
    security = cents(or_zero(number("ss")) + or_zero(number("ss_2")))
    net = or_zero(number("net"))
    return {
        "gross": gross, "deductions": less, "irpf_amount": tax, "irpf_rate": or_zero(number("irpf_rate")),
        "ss": F.when((security == 0.0) & (less > 0), cents(less - tax)).otherwise(security),
        "net": F.when((net == 0.0) & (gross > 0), cents(gross - less)).otherwise(net),
    }


def details(number, total):
    other = cents(total("deductions") - total("ss") - total("irpf_amount"))
    return {
        "salario_base": or_zero(number("base")), "plus_convenio": or_zero(number("plus")), "complementos": or_zero(number("extra_1")),
        "prorrata_pagas_extra": unless_zero(or_zero(number("prorrata")), or_zero(number("prorrata_2"))), "base_ss_comunes": or_zero(number("base_ss")),
        "descuento_seguridad_social": total("ss"), "irpf_porcentaje": total("irpf_rate"), "irpf_importe": total("irpf_amount"),
        "otras_deducciones": F.when(other < 0, 0.0).otherwise(other),
        "total_devengado": total("gross"), "total_deducir": total("deductions"), "liquido_percibir": total("net"), "base_irpf": total("gross"),
    }


def errors(raw, number, flag):
    bad = unparsable(raw("gross"), number("gross")) | unparsable(raw("deductions"), number("deductions"))
    return [
        (raw("year").isNull(), MISSING_PERIOD), (~flag("gate"), MISSING_TOTALS), (flag("settlement"), SETTLEMENT_UNSUPPORTED),
        (raw("gross").isNull(), MISSING_TOTALS), (bad, RAW_AMOUNT_ERROR), (raw("net").isNull(), MISSING_TOTAL), (number("net").isNull(), INVALID_TOTAL),
    ]


FORMAT = PayslipFormat("ineco", COMPANY, TAX_ID, captures, flags, totals, details, errors)
