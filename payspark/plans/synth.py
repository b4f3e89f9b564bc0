"""Payslip texts made of table rows, for tests, benchmarks and the catalog.

Amounts are whole cents, so that each text can be computed back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payspark.operators.formats.insis import MONTHS

#: What is deducted, and what of it is tax, in hundredths; base and plus are shares of gross pay.
DEDUCTED, TAX, BASE, PLUS = 17, 11, 60, 20


def euro(amount: Column) -> Column:
    """Cents as ``1.234,56``; below a million they are cut by digits, which costs far less than formatting numbers."""
    digits = lambda value, start: F.substring(value.cast("string"), start, 3)
    cut = lambda value, by: F.floor(value / by)
    small = F.concat(cut(amount, 100).cast("string"), F.lit(","), digits(amount % 100 + 100, 2))
    large = F.concat(cut(amount, 100_000).cast("string"), F.lit("."), digits(cut(amount, 100) % 1000 + 1000, 2), F.lit(","), digits(amount % 100 + 100, 2))
    return F.when(amount.between(0, 99_999), small).when(amount.between(100_000, 99_999_999), large).otherwise(F.translate(F.format_number(amount / 100, 2), ".,", ",."))


def share(amount: Column, percent: int) -> Column:
    return F.floor(amount * percent / 100).cast("long")


def amounts(rows: DataFrame) -> DataFrame:
    """``rows`` (key, gross in cents, day) with the payslip's other amounts in cents."""
    gross = F.col("gross")
    return rows.withColumns({"less": share(gross, DEDUCTED), "tax": share(gross, TAX), "base": share(gross, BASE), "plus": share(gross, PLUS)}).withColumn("net", gross - F.col("less"))


def line(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def layout(key: str) -> Column:
    """The text of a payslip in a format's layout, from the columns of ``amounts``."""
    e = {c: euro(F.col(c)) for c in ("gross", "less", "tax", "base", "plus", "net")}
    security = euro(F.col("less") - F.col("tax"))
    if key == "alten":
        return line("Alten\nTOTAL DEVENGADO TOTAL DEDUCCIONES ", e["gross"], " ", e["less"], "\nLIQUIDO A PERCIBIR ", e["net"], "\n")
    if key == "altran":
        return line(
            "Altran\nSalario Base 30,00 1,00 ", e["base"], "\nPlus Convenio 30,00 1,00 ", e["plus"],
            "\nTotales ", e["gross"], " ", e["less"], "\nLíquido a percibir ", e["net"], "\n",
        )
    if key == "exceltic":
        return line(
            "Exceltic\nSALARIO BASE ", e["base"], "\nPLUS CONVENIO ", e["plus"], "\nLIQUIDO TOTAL A PERCIBIR ", e["net"],
            "\nTOTAL DEVENGO ", e["gross"], " TOTAL DEDU. ", e["less"], "\n",
        )
    if key == "ineco":
        return line(
            "Ineco\n", F.date_format("day", "01.MM.yyyy"), " ", F.date_format("day", "28.MM.yyyy"), "\n9001 Salario Base ", e["base"],
            "\n9002 Plus Convenio ", e["plus"], "\nTotal Devengos Total Deducciones\n", e["gross"], " ", e["less"],
            "\n/401 Retención IRPF ", f"{TAX},00 ", e["tax"], "\n/350 Trab.cont.comunes 1,00 ", security,
            "\nLíquido a percibir: ", e["net"], "\nTotal Base: ", e["gross"], "\n",
        )
    if key == "insis":
        return line(
            "Insis\nPeríodo: DE ", month_name(), F.date_format("day", "' DE 'yyyy"), "\nSalario Base ", e["base"], " x\nP.CONVENIO ", e["plus"],
            " x\nTOTAL DEVENGADO ", e["gross"], " x\nTOTAL APORTACIONES ", security, " x\nImpuesto ", f"{TAX},00 ", e["tax"],
            " x\nTOTAL A DEDUCIR ", e["less"], " x\nLIQUIDO TOTAL A PERCIBIR PTA ", e["net"], " x\n",
        )
    return line("Coritel\nTOTAL ", e["gross"], "\n")


def month_name() -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month("day"))


def named(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` with their amounts, in turn in the layouts ``keys``."""
    turn = F.element_at(F.array(*map(F.lit, keys)), (F.pmod("key", F.lit(len(keys))) + 1).cast("int"))
    text = F.when(turn == keys[0], layout(keys[0]))
    for key in keys[1:]:
        text = text.when(turn == key, layout(key))
    name = F.concat(F.date_format("day", "yyyyMM"), F.lit("_"), turn, F.lit("_"), F.col("key").cast("string"), F.lit(".pdf"))
    return amounts(rows).withColumns({"filename": name, "text": text})


def payslips(rows: DataFrame, key: str) -> DataFrame:
    """``amounts`` rows with ``filename`` and ``text`` in the layout of a format."""
    return named(rows, (key,))


#: Texts that are rejected, or just not: file name, text, code (None: read), each for a share of the rows.
REJECTED: tuple[tuple[str, str, str | None], ...] = (
    ("209901_altran.pdf", " \n\t", "NO_TEXT"),
    ("209901.pdf", "some other company", "UNKNOWN_OR_AMBIGUOUS_FORMAT"),
    ("209901.pdf", "Alten and Altran", "UNKNOWN_OR_AMBIGUOUS_FORMAT"),
    ("209901_coritel.pdf", "anything", "NOT_IMPLEMENTED"),
    ("alten.pdf", "TOTAL DEVENGADO TOTAL DEDUCCIONES 10,00 2,00\nLIQUIDO A PERCIBIR 8,00", "MISSING_PERIOD"),
    ("209901_alten.pdf", "LIQUIDO A PERCIBIR 8,00", "MISSING_TOTALS"),
    ("209901_alten.pdf", "TOTAL DEVENGADO TOTAL DEDUCCIONES 10,00 2,00", "MISSING_NET"),
    ("2099_01_altran.pdf", "Totales 1,2,3 2,00\nLíquido a percibir 8,00", "RAW_AMOUNT_ERROR"),
    ("2099_01_altran.pdf", "TOTALES 10,00 2,00\nLíquido a percibir 8,00", "MISSING_TOTALS"),
    ("2099_01_altran.pdf", "Totales 10,00 2,00\nLíquido a percibir 7,00", "UNBALANCED"),
    ("1899_01_altran.pdf", "Totales 10,00 2,00\nLíquido a percibir 8,00", "INVALID_PERIOD"),
    ("2099_13_altran.pdf", "Totales 10,00 2,00\nLíquido a percibir 8,00", "INVALID_PERIOD"),
    ("2099_01_altran.pdf", "Totales " + "9" * 400 + " 2,00\nLíquido a percibir 8,00", "NON_FINITE"),
    ("209901_exceltic.pdf", "TOTAL DEVENGADO 10,00 TOTAL DEDU. 2,00 TOTAL A PERCIBIR 8,00", "MISSING_TOTALS"),
    ("ineco.pdf", "01.01.2099", "MISSING_PERIOD"),
    ("ineco.pdf", "01.01.2099 31.01.2099\nTotal Devengos Total Deducciones\n10,00 2,00\nLíquido a percibir: 8,00\nFiniquito", "SETTLEMENT_UNSUPPORTED"),
    ("ineco.pdf", "01.01.2099 31.01.2099\nTotal Devengos Total Deducciones\nno amounts\nLíquido a percibir: 8,00", "MISSING_TOTALS"),
    ("ineco.pdf", "01.01.2099 31.01.2099\nTotal Devengos Total Deducciones\n1,2,3 2,00\nLíquido a percibir: 8,00", "RAW_AMOUNT_ERROR"),
    ("ineco.pdf", "01.01.2099 31.01.2099\nTotal Devengos Total Deducciones\n10,00 2,00\nLíquido a percibir: ,,", "INVALID_TOTAL"),
    ("insis.pdf", "Período: DE FOO DE 2099\nTOTAL DEVENGADO 10,00 x\nTOTAL A DEDUCIR 2,00 x\nLIQUIDO TOTAL A PERCIBIR PTA 8,00 x", "INVALID_PERIOD"),
    ("insis.pdf", "Período: DE ENERO DE 2099\nTOTAL DEVENGADO 10,00 5,00 x\nTOTAL A DEDUCIR 2,00 x\nLIQUIDO TOTAL A PERCIBIR PTA 8,00 x", "INVALID_TOTAL"),
    ("insis.pdf", "Período: DE ENERO DE 2099\nTOTAL DEVENGADO 10,00 x\nTOTAL A DEDUCIR 2,00 x\nLIQUIDO TOTAL A PERCIBIR 8,00 x", "MISSING_TOTAL"),
    ("insis.pdf", "Período: DE ENERO DE 2099\nTOTAL DEVENGADO 10,00 x\nImpuesto 1,2,3 4,00\nTOTAL A DEDUCIR 2,00 x\nLIQUIDO TOTAL A PERCIBIR PTA 8,00 x", "RAW_AMOUNT_ERROR"),
    ("slip.pdf", "Inteligencia Sistematica\nPeríodo: DE ENERO DE 2099\nTOTAL DEVENGADO 10,00 x\nTOTAL A DEDUCIR 2,00 x\nLIQUIDO TOTAL A PERCIBIR PTA 8,00 x", None),
)


def rejected(rows: DataFrame) -> DataFrame:
    """``rows`` (key) with ``filename`` and ``text`` of REJECTED in turn."""
    turn = (F.pmod("key", F.lit(len(REJECTED))) + 1).cast("int")
    name, text = (F.element_at(F.array(*(F.lit(case[k]) for case in REJECTED)), turn) for k in (0, 1))
    return rows.withColumns({"filename": name, "text": text})


#: Layouts whose values come from a fallback: format, and what the amounts' columns make of it.
FALLBACKS = (
    "alten_second_label", "alten_unreadable_totals", "altran_zero_net", "exceltic_zero_gross", "exceltic_short_label", "ineco_zero_net", "ineco_no_security",
    "ineco_extra_pay", "insis_zero_gross", "insis_zero_deductions", "insis_zero_net", "insis_spaced_extra_pay",
)


def fallbacks(rows: DataFrame) -> DataFrame:
    """``rows`` with amounts and, in turn, a payslip of each kind in FALLBACKS."""
    e = {c: euro(F.col(c)) for c in ("gross", "less", "tax", "base", "plus", "net")}
    rest, security = euro(F.col("gross") - F.col("base") - F.col("plus")), euro(F.col("less") - F.col("tax"))
    dates = line("Ineco\n", F.date_format("day", "01.MM.yyyy"), " ", F.date_format("day", "28.MM.yyyy"), "\n")
    totals = line("Total Devengos Total Deducciones\n", e["gross"], " ", e["less"], "\n")
    month = line("Insis\nPeríodo: DE ", month_name(), F.date_format("day", "' DE 'yyyy"), "\n")
    gross, less, net = line("TOTAL DEVENGADO ", e["gross"], " x\n"), line("TOTAL A DEDUCIR ", e["less"], " x\n"), line("LIQUIDO TOTAL A PERCIBIR PTA ", e["net"], " x\n")
    spaced = F.regexp_replace(e["gross"], "([0-9])", "$1 ")
    texts = (
        line("Alten\nTOTAL DEVENGADO TOTAL DEDUCCIONES ", e["gross"], " ", e["less"], "\nLIQUIDO A PERCIBIR 0,00\nNETO A PERCIBIR: ", e["net"], "\n"),
        line("Alten\nTOTAL DEVENGADO TOTAL DEDUCCIONES 1,2,3 4,00\nLIQUIDO A PERCIBIR ", e["net"], "\n"),
        line("Altran\nTotales ", e["gross"], " ", e["less"], "\nLíquido a percibir 0,00\n"),
        line("Exceltic\nSALARIO BASE ", e["base"], "\nTOTAL DEVENGO 0,00 TOTAL DEDU. 0,00\nLIQUIDO TOTAL A PERCIBIR ", e["net"], "\n"),
        line("Exceltic\nTOTAL DEVENGO ", e["gross"], " TOTAL DEDU. ", e["less"], "\nTOTAL A PERCIBIR ", e["net"], "\n"),
        line(dates, totals, "/401 Retención IRPF 11,00 ", e["tax"], "\n/350 Trab.cont.comunes 1,00 ", security, "\nLíquido a percibir: 0,00\n"),
        line(dates, totals, "/401 Retención IRPF 11,00 ", e["tax"], "\nLíquido a percibir: ", e["net"], "\nextras: ", e["plus"], "\n"),
        line(dates, "01/02/2001 03/04/2005  Analista B \nNº Afiliación x\n28 1234 05 678\nPaga extra\n", totals, "9004 Comp.Salarial ", e["plus"], "\nLíquido a percibir: ", e["net"], "\n"),
        line(month, "Salario Base ", e["base"], " x\nP.CONVENIO ", e["plus"], " x\nINCENTIVOS ", rest, " x\nTOTAL DEVENGADO 0,00 x\n", less, net),
        line(month, gross, "TOTAL APORTACIONES ", security, " x\nImpuesto 11,00 ", e["tax"], " x\nTOTAL A DEDUCIR 0,00 x\n", net),
        line(month, gross, less, "Anticipos ", e["plus"], " x\nLIQUIDO TOTAL A PERCIBIR PTA 0,00 x\n"),
        line(month, "Paga extraordinaria\nT O T A L DEVENGADO ", spaced, "x\n", less, net, "Base sujeta a retención ", e["base"], " x\nTOTAL. ", e["plus"], " x\n"),
    )
    turn = F.pmod("key", F.lit(len(texts)))
    text = F.when(turn == 0, texts[0])
    for k, own in enumerate(texts[1:], 1):
        text = text.when(turn == k, own)
    return amounts(rows).withColumns({"filename": F.concat(F.date_format("day", "yyyyMM"), F.lit(".pdf")), "text": text})
