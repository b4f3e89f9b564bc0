"""Payslips of Insis: letters of labels and digits of amounts may be spaced out."""

from __future__ import annotations

from pyspark.sql import functions as F

from payspark.functions.text import captured, cents, found, spaced_european
from payspark.operators.formats.base import PayslipFormat, or_zero, unless_zero, unparsable
from payspark.schema import INVALID_TOTAL, MISSING_PERIOD, MISSING_TOTAL, MISSING_TOTALS, RAW_AMOUNT_ERROR

# The company's name and tax id, the layout's patterns and words.
COMPANY, TAX_ID = "INTELIGENCIA SISTEMATICA 4, S.L.", "B84225283"
MONTHS = ("ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE")
PERIOD = r"P\s*e\s*r\s*í\s*o\s*d\s*o.*?DE\s+([A-Z]+)\s+DE\s+(\d{4})"
GATES = ("TOTALDEVENGADO", "TOTALADEDUCIR", "LIQUIDOTOTALAPERCIBIR")
EXTRAS = ("PAGA EXTRAORDINARIA", "GRATIFICACION EXTRAORDINARIA")
AMOUNTS = {
    "base": r"Sala\s*rio\s*B\s*a\s*se\s*([\d\.,\s]+)",
    "plus": r"P\.CONVENIO\s*([\d\.,\s]+)",
    "extra_1": r"INCENTIVOS\s*([\d\.,\s]+)",
    "extra_2": r"TRANSPORTE\s*([\d\.,\s]+)",
    "gross": r"T\s*O\s*T\s*A\s*L\s*D\s*E\s*V\s*E\s*N\s*G\s*A\s*D\s*O[\.\s]*([\d\.,\s]+)",
    "ss": r"T\s*O\s*T\s*AL\s*A\s*P\s*O\s*RT\s*A\s*C\s*IO\s*N\s*E\s*S[\.\s]*([\d\.,\s]+)",
    "advances": r"Antic\s*ip\s*os[\.\s]*([\d\.,\s]+)",
    "deductions": r"T\s*O\s*T\s*A\s*L\s*A\s*D\s*E\s*D\s*U\s*C\s*I\s*R[\.\s]*([\d\.,\s]+)",
    "net": r"L\s*I\s*Q\s*U\s*ID\s*O\s*T\s*O\s*T\s*A\s*L\s*A\s*P\s*E\s*R\s*C\s*IB\s*I\s*R.*?PTA\s+([\d\.,\s]+)",
    "prorrata": r"Prorr\s*at\s*a\s*p\s*a\s*ga\s*s\s*E\s*xt\s*ra\s*or\s*din\s*a\s*ri\s*a\s*s[\.\s]*([\d\.,\s]+)",
    "base_ss": r"T\s*O\s*T\s*A\s*L\s*\.[\.\s]*([\d\.,\s]+)",
    "base_ss_2": r"contingencias\s+profesionales.*?([\d\.,\s]+)",
    "base_irpf": r"Base\s+suj\s*et\s*a\s*a\s*re\s*te\s*nc\s*ió\s*n[\.\s]*([\d\.,\s]+)",
}
TAX = r"Impu\s*e\s*sto.*?([\d,]+)\s+([\d\.,\s]+)"


def captures(text, filename):
    name = F.upper(captured(text, PERIOD, 1, "i"))
    months = F.create_map(*(x for k, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(str(k)))))
    return {field: captured(text, body, flags="i") for field, body in AMOUNTS.items()} | {
        "year": captured(text, PERIOD, 2, "i"), "month": F.when(name.isNotNull(), F.coalesce(F.try_element_at(months, name), F.lit("0"))),
        "irpf_rate": captured(text, TAX, 1), "irpf_amount": captured(text, TAX, 2),
    }


def flags(text):
    upper = F.upper(text)
    letters = F.regexp_replace(upper, "[^A-Z]+", "")
    # One pattern each, so that the text is prepared once.
    return {"gate": found(letters, "^" + "".join(f"(?=.*{g})" for g in GATES)), "is_extra": found(upper, "|".join(EXTRAS))}


def totals(raw, number):
    """A total of zero is the sum of its parts."""
    base, plus, tax, security, advances = (or_zero(number(n)) for n in ("base", "plus", "irpf_amount", "ss", "advances"))
    more = cents(or_zero(number("extra_1")) + or_zero(number("extra_2")))
    gross = unless_zero(or_zero(number("gross")), cents(base + plus + more))
    less = unless_zero(or_zero(number("deductions")), cents(security + tax + advances))
    return {
        "gross": gross, "deductions": less, "net": unless_zero(or_zero(number("net")), cents(gross - less)),
        "ss": security, "irpf_amount": tax, "irpf_rate": or_zero(number("irpf_rate")),
    }


def details(number, total):
    return {
        "salario_base": or_zero(number("base")), "plus_convenio": or_zero(number("plus")), "complementos": cents(or_zero(number("extra_1")) + or_zero(number("extra_2"))),
        "prorrata_pagas_extra": or_zero(number("prorrata")), "descuento_seguridad_social": total("ss"), "irpf_porcentaje": total("irpf_rate"), "irpf_importe": total("irpf_amount"),
        "otras_deducciones": or_zero(number("advances")), "total_devengado": total("gross"), "total_deducir": total("deductions"), "liquido_percibir": total("net"),
        "base_ss_comunes": unless_zero(or_zero(number("base_ss")), or_zero(number("base_ss_2"))), "base_irpf": unless_zero(or_zero(number("base_irpf")), total("gross")),
    }


def errors(raw, number, flag):
    bad = unparsable(raw("irpf_rate"), number("irpf_rate")) | unparsable(raw("irpf_amount"), number("irpf_amount"))
    required = lambda n: [(raw(n).isNull(), MISSING_TOTAL), (number(n).isNull(), INVALID_TOTAL)]
    head = [(raw("year").isNull(), MISSING_PERIOD), (~flag("gate"), MISSING_TOTALS)]
    return [*head, *required("gross"), (bad, RAW_AMOUNT_ERROR), *required("deductions"), *required("net")]


FORMAT = PayslipFormat("insis", COMPANY, TAX_ID, captures, flags, totals, details, errors, convert=spaced_european, adjust=cents)
