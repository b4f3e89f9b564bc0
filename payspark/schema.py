"""Schemas of payroll documents, their kinds and the codes of rejected ones."""

from __future__ import annotations

from pyspark.sql import types as T

# The kinds of documents.
KINDS = ("NOMINA_ORDINARIA", "PAGA_EXTRA", "VARIABLE_BONUS", "FINIQUITO", "CERTIFICADO_RETENCIONES", "MANUAL_ESCANEADO")
ORDINARY, EXTRA, CERTIFICATE = "NOMINA_ORDINARIA", "PAGA_EXTRA", "CERTIFICADO_RETENCIONES"


def _fields(kind: T.DataType, *names: str, nullable: bool = True) -> list[T.StructField]:
    return [T.StructField(n, kind, nullable) for n in names]


#: Every document.
DOCUMENT = T.StructType([
    *_fields(T.StringType(), "id"), *_fields(T.IntegerType(), "anio", "mes"), *_fields(T.StringType(), "periodo", "empresa", "cif", "tipo"),
    *_fields(T.BooleanType(), "es_procesable"), *_fields(T.StringType(), "observaciones"),
])

#: Amounts of a payslip, in order.
PAYSLIP_AMOUNTS = (
    "salario_base", "plus_convenio", "complementos", "prorrata_pagas_extra", "total_devengado",
    "descuento_seguridad_social", "irpf_porcentaje", "irpf_importe", "otras_deducciones", "total_deducir",
    "liquido_percibir", "base_ss_comunes", "base_irpf",
)
PAYSLIP = T.StructType([*DOCUMENT.fields, *_fields(T.StringType(), "categoria", "grupo_cotizacion"), *_fields(T.DoubleType(), *PAYSLIP_AMOUNTS)])
SETTLEMENT = T.StructType([
    *DOCUMENT.fields,
    *_fields(T.DoubleType(), "indemnizacion", "vacaciones_no_disfrutadas", "parte_proporcional_paga_extra", "total_devengado", "total_deducir", "liquido_percibir"),
])
TAX_CERTIFICATE = T.StructType([*DOCUMENT.fields, *_fields(T.DoubleType(), "retribuciones_integras", "gastos_deducibles", "retenciones_practicadas")])

#: What fields that a payslip may lack are, then.
DEFAULTS = {"tipo": ORDINARY, "es_procesable": True, "observaciones": "", "categoria": None, "grupo_cotizacion": None} | dict.fromkeys(PAYSLIP_AMOUNTS, 0.0)

#: Amounts that the store keeps as columns; documents without one have 0.0.
STORED_AMOUNTS = ("salario_base", "total_devengado", "total_deducir", "liquido_percibir", "retribuciones_integras", "retenciones_practicadas")
STORED = T.StructType([
    *_fields(T.StringType(), "id"), *_fields(T.IntegerType(), "anio", "mes"), *_fields(T.StringType(), "periodo", "empresa", "cif", "tipo"),
    *_fields(T.DoubleType(), *STORED_AMOUNTS), *_fields(T.StringType(), "observaciones"), *_fields(T.IntegerType(), "es_procesable"), *_fields(T.StringType(), "payload"),
])
#: Stored columns that may not be null.
REQUIRED = ("id", "anio", "mes", "periodo", "empresa", "cif", "tipo", "payload")

#: All model fields, by name, for decoding payloads of any kind.
PAYLOAD = T.StructType(list({f.name: f for s in (PAYSLIP, SETTLEMENT, TAX_CERTIFICATE) for f in s}.values()))

#: Why a document was rejected, in the order in which checks are made.
NO_TEXT, UNKNOWN_FORMAT, NOT_IMPLEMENTED = "NO_TEXT", "UNKNOWN_OR_AMBIGUOUS_FORMAT", "NOT_IMPLEMENTED"
MISSING_PERIOD, MISSING_TOTALS, SETTLEMENT_UNSUPPORTED, MISSING_NET = "MISSING_PERIOD", "MISSING_TOTALS", "SETTLEMENT_UNSUPPORTED", "MISSING_NET"
MISSING_TOTAL, INVALID_TOTAL, RAW_AMOUNT_ERROR = "MISSING_TOTAL", "INVALID_TOTAL", "RAW_AMOUNT_ERROR"
INVALID_PERIOD, NON_FINITE, UNBALANCED = "INVALID_PERIOD", "NON_FINITE", "UNBALANCED"
DUPLICATE_ID, MISMATCH = "DUPLICATE_ID", "DESCUADRE"
#: Whatever else a parser given as Python raises.
CUSTOM_ERROR = "PARSER_ERROR"

#: What people are told.
MESSAGES = {
    NO_TEXT: "The file holds no text that can be read",
    UNKNOWN_FORMAT: "Text and file name must name exactly one known company",
    NOT_IMPLEMENTED: "Payslips of this company can't be read yet",
    MISSING_PERIOD: "No payroll period was found",
    MISSING_TOTALS: "The line of totals was not found",
    SETTLEMENT_UNSUPPORTED: "This is a settlement, which is not read",
    MISSING_NET: "Net pay was not found",
    MISSING_TOTAL: "A required total was not found",
    INVALID_TOTAL: "A required total is no number",
    RAW_AMOUNT_ERROR: "An amount is no number",
    INVALID_PERIOD: "The payroll period is no month from 1900 on",
    NON_FINITE: "A total is not finite",
    UNBALANCED: "Gross less deductions is not net pay",
    DUPLICATE_ID: "A document with this id exists",
    MISMATCH: "Net pay differs from gross less deductions",
    CUSTOM_ERROR: "The company's own parser failed",
}
