"""The document store: insert, reject, read, delete, reset."""

import json

import pytest

from payspark import schema as S
from payspark.sources.store import DocumentStore, DuplicateIdError, as_payslips, store_path, to_stored


def payslip(spark, id_="2099-01-X", **more):
    row = {f.name: None for f in S.PAYSLIP} | {n: 0.0 for n in S.PAYSLIP_AMOUNTS} | {"id": id_, "anio": 2099, "mes": 1, "periodo": "2099-01", "empresa": "Ñandú", "cif": "C", "tipo": S.ORDINARY, "es_procesable": True, "observaciones": ""} | more
    return spark.createDataFrame([tuple(row[f.name] for f in S.PAYSLIP)], S.PAYSLIP)


@pytest.fixture(params=["file", "memory"])
def store(request, spark, tmp_path):
    own = DocumentStore(spark, ":memory:" if request.param == "memory" else str(tmp_path / "deep" / "store"))
    own.init()
    own.init()
    return own


def test_insert_and_read(spark, store):
    assert store.table().count() == 0 and store.all().count() == 0
    store.append(payslip(spark, complementos=12.5, irpf_porcentaje=10.0, base_irpf=100.0, total_devengado=2500.0))
    with pytest.raises(DuplicateIdError):
        store.append(payslip(spark))
    store.append(payslip(spark), strict=False)
    row = store.all().first()
    assert store.table().count() == 1 and (row.complementos, row.irpf_porcentaje, row.base_irpf, row.es_procesable, row.empresa) == (12.5, 10.0, 100.0, 1, "Ñandú")
    payload = json.loads(row.payload)
    assert payload["categoria"] is None and "Ñandú" in row.payload and set(payload) == {f.name for f in S.PAYSLIP}
    assert store.by_company("Ñandú").count() == 1 and store.by_company("ñandú").count() == 0
    assert as_payslips(store.all()).schema.names == S.PAYSLIP.names
    store.delete("unknown")
    assert [r.id for r in store.ids().collect()] == ["2099-01-X"]
    store.delete("2099-01-X")
    assert store.table().count() == 0


def test_certificates_settlements_and_reset(spark, store):
    head = ("c1", 2099, 12, "2099-12", "E", "C", S.CERTIFICATE, True, "")
    store.append(spark.createDataFrame([(*head, 35000.0, 0.0, 5200.0)], S.TAX_CERTIFICATE))
    store.append(spark.createDataFrame([("f1", *head[1:6], "FINIQUITO", True, "", 1.0, 2.0, 3.0, 10.0, 4.0, 6.0)], S.SETTLEMENT))
    found = store.certificates().collect()
    assert [(r.id, r.retribuciones_integras, r.retenciones_practicadas, r.salario_base) for r in found] == [("c1", 35000.0, 5200.0, 0.0)]
    assert store.all().where("id = 'f1'").first().indemnizacion == 1.0
    store.reset()
    assert store.table().count() == 0


def test_required_fields(spark, store):
    with pytest.raises(Exception, match="required field"):
        store.append(payslip(spark, empresa=None))


def test_first_of_a_batch_wins(spark, store):
    both = payslip(spark, total_devengado=1.0).unionByName(payslip(spark, total_devengado=2.0))
    new, known = store.split(both, "total_devengado")
    assert [r.total_devengado for r in new.collect()] == [1.0] and [r.total_devengado for r in known.collect()] == [2.0]


def test_missing_table_and_path(spark, tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        DocumentStore(spark, str(tmp_path / "none")).table()
    monkeypatch.setenv("PAYSPARK_STORE", "/x/y")
    assert store_path() == "/x/y"
    monkeypatch.delenv("PAYSPARK_STORE")
    assert store_path().startswith("data/")


def test_unknown_kind_is_refused(spark):
    with pytest.raises(Exception, match="unknown kind"):
        as_payslips(payslip(spark, tipo="OTHER")).collect()
    assert to_stored(payslip(spark)).schema.names == S.STORED.names


def test_exact_payslips(spark):
    whole = payslip(spark)
    assert as_payslips(whole, exact=True).count() == 1
    with pytest.raises(ValueError, match="unknown fields: .'extra'"):
        as_payslips(whole.selectExpr("*", "1 as extra"), exact=True)
    with pytest.raises(ValueError, match="missing fields: .'cif'"):
        as_payslips(whole.drop("cif"))
    read = as_payslips(whole.drop("tipo", "irpf_importe", "categoria")).first()
    assert (read.tipo, read.irpf_importe, read.categoria) == ("NOMINA_ORDINARIA", 0.0, None)
