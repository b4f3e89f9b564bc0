"""Parsing of all formats: the samples, fallbacks and every rejection."""

import pytest
from pyspark.sql import functions as F

from payspark import schema as S
from payspark.operators.dispatch import DEFAULT
from payspark.operators.formats import FORMATS
from payspark.operators.parse import parse_documents, strict

EXCELTIC = "SALARIO BASE 1500,00\nPLUS CONVENIO 300,00\nP.P.EXTRA 200,00\nLIQUIDO TOTAL A PERCIBIR 1800,00\nTOTAL DEVENGO 2000,00 TOTAL DEDU. 200,00\n"
ALTRAN = "Salario Base 30,00 50,00 1500,00\nPlus Convenio 30,00 10,00 300,00\nParte Proporcional Pagas Extras 200,00\nTotales 2000,00 200,00\nLíquido a percibir 1800,00\n"
ALTEN = "TOTAL DEVENGADO TOTAL DEDUCCIONES 2500,00 500,00\nLIQUIDO A PERCIBIR 2000,00\n"
INECO = (
    "01.10.2099 31.10.2099\n9001 Salario Base 1500,00\n9002 Plus Convenio 200,00\n9004 Comp.Salarial 100,00\nTotal Devengos Total Deducciones\n1800,00 1800,00 400,00\n"
    "/401 Retención IRPF 15,00 270,00\n/350 Trab.cont.comunes 1800,00 115,20\nT002 Dto Base Accidente 1800,00 14,80\nLíquido a percibir: 1400,00\nTotal Base: 1800,00\n"
    "Prorratas pagas extras : 300,00\n"
)
INSIS = (
    "P e r íodo de pago: DEL 1 DE MARZO DE 2009\nSalario Base 1.500,00 x\nP.CONVENIO 200,00 x\nINCENTIVOS 50,00 x\nTRANSPORTE 25,50 x\nT O T A L  D E V E N G A D O ... 1.775,50 x\n"
    "TOTAL APORTACIONES 100,00 x\nImpuesto renta 15,00 266,33 x\nAnticipos 10,00 x\nTOTAL A DEDUCIR 376,33 x\nLIQUIDO TOTAL A PERCIBIR en PTA 1.399,17 x\nTOTAL. 1.800,00 x\nBase sujeta a retención 1.775,50 x\n"
)


def parse(spark, rows, only=None):
    frame = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(rows)], "k int, filename string, text string")
    return [r.asDict() for r in parse_documents(frame, only=only).orderBy("k").collect()]


def one(spark, name, text, only=None):
    return parse(spark, [(name, text)], only)[0]


def has(row, **values):
    assert row["error_code"] is None, row
    assert {k: row[k] for k in values} == values


def test_samples(spark):
    rows = parse(spark, [("209901_exceltic.pdf", EXCELTIC), ("2099_02_altran.pdf", ALTRAN), ("209903_alten.pdf", ALTEN), ("mock_ineco.pdf", INECO), ("insis.pdf", INSIS)])
    has(rows[0], id="2099-01-EXCELTIC", empresa="Exceltic", cif="B84242767", periodo="2099-01", liquido_percibir=1800.0, salario_base=1500.0, plus_convenio=300.0, prorrata_pagas_extra=200.0, complementos=0.0, total_deducir=200.0, base_irpf=2000.0)
    has(rows[1], id="2099-02-ALTRAN", cif="B80428972", liquido_percibir=1800.0, salario_base=1500.0, plus_convenio=300.0, complementos=0.0, irpf_importe=0.0)
    has(rows[2], id="2099-03-ALTEN", cif="A28250271", liquido_percibir=2000.0, total_devengado=2500.0, total_deducir=500.0, salario_base=0.0, categoria=None)
    has(rows[3], id="2099-10-INECO", anio=2099, mes=10, salario_base=1500.0, plus_convenio=200.0, complementos=100.0, total_devengado=1800.0, total_deducir=400.0, liquido_percibir=1400.0,
        irpf_porcentaje=15.0, irpf_importe=270.0, descuento_seguridad_social=130.0, otras_deducciones=0.0, base_ss_comunes=1800.0, prorrata_pagas_extra=300.0, tipo=S.ORDINARY)
    has(rows[4], id="2009-03-INSIS", salario_base=1500.0, plus_convenio=200.0, complementos=75.5, total_devengado=1775.5, descuento_seguridad_social=100.0, irpf_porcentaje=15.0, irpf_importe=266.33,
        otras_deducciones=10.0, total_deducir=376.33, liquido_percibir=1399.17, base_ss_comunes=1800.0, base_irpf=1775.5, observaciones="Procesado desde insis.pdf", es_procesable=True)


@pytest.mark.parametrize("key", ["alten", "altran", "exceltic", "ineco", "insis"])
def test_missing_period(spark, key):
    assert one(spark, "synthetic.pdf", "x", key)["error_code"] == S.MISSING_PERIOD


def test_dispatch(spark):
    texts = ["unknown company", "alten altran", *(f.key for f in FORMATS), "INTELIGENCIA SISTEMATICA", "Inteligencia Sistemática", "xxALTENyy", "inſis"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    from pyspark.sql import functions as F

    found = [r[0] for r in frame.select(DEFAULT.key(F.col("text"), F.lit("")), "k").orderBy("k").collect()]
    assert found == [None, None, "alten", "altran", "coritel", "exceltic", "ineco", "insis", "insis", None, "alten", "insis"]
    rows = parse(spark, [("coritel.pdf", "x"), ("alten.pdf", ""), ("a.pdf", None), ("a.pdf", "  \n"), ("a.pdf", "nothing"), (None, "alten")])
    assert [r["error_code"] for r in rows] == [S.NOT_IMPLEMENTED, S.NO_TEXT, S.NO_TEXT, S.NO_TEXT, S.UNKNOWN_FORMAT, S.MISSING_PERIOD]
    assert all(r["id"] is None and r["status"] == "ERROR" and r["error_message"] for r in rows)


def test_alten(spark):
    head = "TOTAL DEVENGADO TOTAL DEDUCCIONES "
    rows = parse(spark, [
        ("209903", "LIQUIDO A PERCIBIR 2000,00"), ("209903", head + "1,00 1,00"), ("209903", head + "1 .000 ,50 0,50\nL I Q U I D O A P E R C I B I R: 1 .000,00"),
        ("209903", head + "2000,00 0,00 LIQUIDO A PERCIBIR 0,00 NETO A PERCIBIR 2000,00"), ("209903", head + "1,2,3 7,00 LIQUIDO A PERCIBIR 5,00"), ("209903", head + "5,00 1,2,3 LIQUIDO A PERCIBIR 5,00"),
        ("209913", head + "5,00 0,00 LIQUIDO A PERCIBIR 5,00"), ("209903", head + "5,00 1,00 LIQUIDO A PERCIBIR 5,00"), ("209903", head + "9" * 400 + " 1,00 LIQUIDO A PERCIBIR 5,00"), ("000003", head + "5,00 0,00 LIQUIDO A PERCIBIR 5,00"),
        ("209903", head + "5,00 0,00 liquido a percibir € 5,00"),
    ], "alten")
    assert [r["error_code"] for r in rows] == [S.MISSING_TOTALS, S.MISSING_NET, None, None, None, None, S.INVALID_PERIOD, S.UNBALANCED, S.NON_FINITE, S.INVALID_PERIOD, None]
    assert rows[3]["liquido_percibir"] == 2000.0 and rows[4]["total_devengado"] == 5.0 and rows[4]["total_deducir"] == 0.0 and rows[5]["total_deducir"] == 0.0


def test_altran(spark):
    rows = parse(spark, [
        ("2099_02", "totales 1,00 0,00 Líquido a percibir 1,00"), ("2099_02", "Totales 1,00 0,00 LÍQUIDO A PERCIBIR 1,00"), ("209902", "Totales 10,00 4,00\nLíquido a percibir 0,00"), ("2099_02", "Totales 1,2,3 0,00 Líquido a percibir 1,00"),
        ("2099_02", "Salario Base 1 2 9,00 Totales 5,00 0,00 Líquido a percibir 5,00"), ("2099_02", "Totales 5,00 0,00 Líquido a percibir 1,2,3"),
    ], "altran")
    assert [r["error_code"] for r in rows] == [S.MISSING_TOTALS, None, None, S.RAW_AMOUNT_ERROR, None, None]
    assert rows[2]["liquido_percibir"] == 6.0 and rows[4]["complementos"] == 0.0 and rows[5]["liquido_percibir"] == 5.0


def test_exceltic(spark):
    rows = parse(spark, [
        ("209901", "TOTAL DEVENGADO 5,00 TOTAL DEDU 0,00 TOTAL A PERCIBIR 5,00"), ("209901", "TOTAL DEVENGO . TOTAL DEDU . TOTAL A PERCIBIR 7,50"),
        ("209901", "TOTAL DEVENGO 10,00 TOTAL DEDU 0,00 TOTAL A PERCIBIR 7,50"), ("209901", "total devengo\nx 10,00 total dedu 2,50 LIQUIDO TOTAL A PERCIBIR 0,00 x TOTAL A PERCIBIR 7,50"),
    ], "exceltic")
    assert [r["error_code"] for r in rows] == [S.MISSING_TOTALS, S.UNBALANCED, None, S.UNBALANCED]
    assert rows[2]["total_deducir"] == 2.5


def test_ineco(spark):
    rows = parse(spark, [
        ("i", INECO + "Finiquito"), ("i", INECO + "Paga extra"), ("i", INECO + "PAGAS EXTRAS"), ("i", INECO.replace("1800,00 1800,00 400,00", "nothing")), ("i", INECO.replace("1800,00 400,00", "1,8,0 400,00")),
        ("i", INECO.replace("percibir: 1400,00", "percibir: 1,4,0")), ("i", INECO.replace("percibir: 1400,00", "percibir: 0,00")), ("i", INECO.replace("115,20", "0,00").replace("14,80", "0,00")),
        ("i", INECO + "01/01/2090 02/02/2099  TECNICO SUPERIOR \nNº Afiliación x\nabc 05 123\n"), ("i", INECO.replace("pagas extras :", "pagas\nextras :")), ("i", INECO.lower()),
    ], "ineco")
    assert [r["error_code"] for r in rows] == [S.SETTLEMENT_UNSUPPORTED, None, None, S.MISSING_TOTALS, S.RAW_AMOUNT_ERROR, S.INVALID_TOTAL, None, None, None, None, S.MISSING_TOTALS]
    assert (rows[1]["id"], rows[1]["tipo"], rows[2]["tipo"]) == ("2099-10-INECO-EXTRA", S.EXTRA, S.ORDINARY)
    assert rows[6]["liquido_percibir"] == 1400.0 and rows[7]["descuento_seguridad_social"] == 130.0
    assert (rows[8]["categoria"], rows[8]["grupo_cotizacion"], rows[9]["prorrata_pagas_extra"]) == ("TECNICO SUPERIOR", "05", 300.0)


def test_insis(spark):
    swap = INSIS.replace
    rows = parse(spark, [
        ("i", swap("MARZO", "FOOBAR")), ("i", swap("TOTAL A DEDUCIR", "TOTAL DEDUCIR")), ("i", swap("1.775,50 x\nTOTAL AP", "1.775,50\n12,00 x\nTOTAL AP")), ("i", swap("15,00 266,33", "1,5,0 266,33")),
        ("i", swap("D O ... 1.775,50", "D O ... 0,00")), ("i", swap("DEDUCIR 376,33", "DEDUCIR 0,00")), ("i", swap("PTA 1.399,17", "PTA 0,00")), ("i", swap("en PTA", "en EUR")), ("i", INSIS + "Gratificacion Extraordinaria"),
        ("i", swap("Base sujeta a retención 1.775,50", "")), ("i", INSIS + "FINIQUITO"), ("i", swap("Impuesto", "IMPUESTO")), ("i", swap("D O ... 1.775,50", "D O nothing")), ("i", swap("D O ... 1.775,50", "D O: 1.775,50")),
    ], "insis")
    assert [r["error_code"] for r in rows] == [S.INVALID_PERIOD, S.MISSING_TOTALS, S.INVALID_TOTAL, S.RAW_AMOUNT_ERROR, None, None, None, S.MISSING_TOTAL, None, None, None, None, S.INVALID_TOTAL, S.MISSING_TOTAL]
    assert rows[4]["total_devengado"] == 1775.5 and rows[5]["total_deducir"] == 376.33 and rows[6]["liquido_percibir"] == 1399.17
    assert rows[8]["id"] == "2009-03-INSIS-EXTRA" and rows[9]["base_irpf"] == 1775.5 and rows[11]["irpf_importe"] == 0.0


def test_strict_fails(spark):
    frame = spark.createDataFrame([("a.pdf", "nothing")], "filename string, text string")
    with pytest.raises(Exception, match="exactly one known company"):
        strict(parse_documents(frame)).collect()


def test_registered_format(spark):
    from dataclasses import replace

    added = replace(FORMATS[0], key="acme", company="Acme", cif="X1", suffix="ACME")
    frame = spark.createDataFrame([("209903_acme.pdf", ALTEN)], "filename string, text string")
    assert parse_documents(frame, DEFAULT.register(added)).first()["id"] == "2099-03-ACME"


def test_python_format(spark):
    class Counted:
        """A parser in Python that says how it fared."""

        def parse(self, text, filename):
            if "broken" in text:
                raise RuntimeError("no such line")
            if "later" in text:
                raise NotImplementedError
            if "settled" in text:
                raise ValueError("SETTLEMENT_UNSUPPORTED", "more")
            if "lacking" in text:
                return {"id": "x"}
            gross = 100.0 if "bad" not in text else 99.0
            return {"id": filename, "anio": 2099, "mes": 13 if "month" in text else 1, "periodo": "2099-01", "empresa": "Own", "cif": "Z", "total_devengado": gross, "total_deducir": 40, "liquido_percibir": 60.0}

    from payspark.operators.formats.python import PythonFormat
    from payspark.schema import PAYSLIP

    registry = DEFAULT.register(PythonFormat("ownco", Counted))
    texts = ["ownco fine", "ownco broken", "ownco later", "ownco settled", "ownco lacking", "ownco bad", "ownco month", "ownco altran", "ownco", "", None]
    rows = [(k, f"{k}.pdf", t) for k, t in enumerate(texts)] + [(20, "209903_alten.pdf", "Alten " + ALTEN), (21, None, "nothing")]
    found = {r.k: r for r in parse_documents(spark.createDataFrame(rows, "k int, filename string, text string").repartition(3), registry).collect()}
    codes = {k: r.error_code for k, r in found.items()}
    assert codes == {0: None, 1: "PARSER_ERROR", 2: "NOT_IMPLEMENTED", 3: "SETTLEMENT_UNSUPPORTED", 4: "PARSER_ERROR", 5: "UNBALANCED", 6: "INVALID_PERIOD", 7: "UNKNOWN_OR_AMBIGUOUS_FORMAT", 8: None, 9: "NO_TEXT", 10: "NO_TEXT", 20: None, 21: "UNKNOWN_OR_AMBIGUOUS_FORMAT"}
    assert (found[0].id, found[0].total_deducir, found[0].tipo, found[0].es_procesable, found[0].categoria, found[0].salario_base) == ("0.pdf", 40.0, "NOMINA_ORDINARIA", True, None, 0.0)
    assert found[1].error_message == "RuntimeError: no such line" and "missing fields: ['anio'" in found[4].error_message and found[5].id is None
    assert found[20].id == "2099-03-ALTEN" and found[0].asDict().keys() >= set(PAYSLIP.names)
    plan = parse_documents(spark.createDataFrame(rows, "k int, filename string, text string"), registry)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    only = parse_documents(spark.createDataFrame([("a.pdf", "anything")], "filename string, text string"), registry, only="ownco").first()
    assert (only.format, only.id) == ("ownco", "a.pdf")


def test_fields_that_are_asked_for(spark):
    from payspark.operators.parse import formats_of, statuses_of
    from payspark.plans.synth import fallbacks, rejected

    keys = spark.range(0, 120).select(F.col("id").alias("key"), (F.col("id") * 1000 + 5000).alias("gross"), F.lit("2099-03-01").cast("timestamp").alias("day"))
    texts = fallbacks(keys).select("key", "filename", "text").unionByName(rejected(keys.select((F.col("key") + 1000).alias("key"))).select("key", "filename", "text"))
    texts = texts.cache()
    whole = {r.key: r for r in parse_documents(texts).collect()}
    for fields in (["id"], ["complementos", "tipo"], ["categoria", "periodo"], ["base_ss_comunes", "irpf_importe", "otras_deducciones"], []):
        for r in parse_documents(texts, fields=fields).collect():
            assert [r[f] for f in fields] + [r.format, r.error_code] == [whole[r.key][f] for f in fields] + [whole[r.key].format, whole[r.key].error_code]
    assert {r.key: r.format for r in formats_of(texts).collect()} == {k: r.format for k, r in whole.items()}
    assert all((r.status, r.error_message) == (whole[r.key].status, whole[r.key].error_message) for r in statuses_of(texts).collect())
    with pytest.raises(ValueError, match="surname"):
        parse_documents(texts, fields=["surname"])


def test_filters_reach_the_scan_and_unread_stages_go(spark, tmp_path):
    from payspark.operators.parse import formats_of, statuses_of

    spark.createDataFrame([(7, "a.pdf", "Alten " + ALTEN, 1)], "doc_id long, filename string, text string, more int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    own = plan(parse_documents(docs).where("doc_id = 7 and status = 'OK'").select("doc_id", "id"))
    assert "EqualTo(doc_id,7)" in own.split("PushedFilters")[1] and "more" not in own.split("ReadSchema")[1]
    assert len(plan(statuses_of(docs))) < len(plan(parse_documents(docs)))
    short = plan(formats_of(docs).where("doc_id = 7").select("doc_id", "format"))
    assert "EqualTo(doc_id,7)" in short and "regexp_extract" not in short and len(short) < 5000
    totals = plan(parse_documents(docs, fields=["total_devengado"]))
    assert "9001" not in totals and "9001" in plan(parse_documents(docs, fields=["salario_base"]))
