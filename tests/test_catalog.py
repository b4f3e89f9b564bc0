"""Catalog queries against their SQL, analytics on small tables, rounding and plans."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from payspark.functions.text import cents
from payspark.operators import analytics
from payspark.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else x
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_rounding_is_exact(spark):
    rnd = random.Random(1)
    values = [2.675, 1.005, 0.125, -2.675, 1e14 + 0.005, 1e300, float("inf"), 0.0] + [rnd.randrange(10**9) / 1000 for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", cents(F.col("x")).alias("y")).collect()
    assert all(r.y == round(r.x, 2) for r in rows)


def test_analytics_edges(spark):
    rows = spark.createDataFrame([("b", "2099-02", "E", 200.0, 150.0, 10.0), ("a", "2099-01", "E", 100.0, 80.0, 5.0), ("z", "2099-03", "F", 0.0, 0.0, 0.0), ("n", "2099-04", "F", float("nan"), 1.0, 1.0)], "id string, periodo string, empresa string, total_devengado double, liquido_percibir double, irpf_porcentaje double")
    assert tuple(analytics.kpis(rows).first()) == (200.0, 150.0, 10.0, 100.0, 1, 2)
    assert tuple(analytics.kpis(rows.limit(0)).first())[:4] == (None,) * 4
    assert [r.id for r in analytics.pay_series(rows).collect()] == ["a", "b"]
    assert [tuple(r)[2:] for r in analytics.pay_series_long(rows).collect()] == [("gross", 100.0), ("gross", 200.0), ("net", 80.0), ("net", 150.0)]
    many = spark.createDataFrame([(str(k), "2099-01", "E", float(v), 0.0, 0.0) for k, v in enumerate([10, 11, 12, 13, 90])], rows.schema)
    assert [r.total_devengado for r in analytics.outliers(many).collect()] == [90.0]


def test_whiskers_and_derived_values(spark):
    schema = "id string, periodo string, empresa string, total_devengado double, liquido_percibir double, irpf_porcentaje double"
    pays = [10, 11, 12, 13, 90, -50]
    rows = spark.createDataFrame([(str(k), f"2099-0{k + 1}", "E" if k < 7 else None, float(v), v / 3, 2.0) for k, v in enumerate(pays + [1234567.891] + [5, 5])], schema)
    box = {r.empresa: r for r in analytics.pay_ranges(rows).collect()}
    assert (box["E"].low_whisker, box["E"].high_whisker, box["E"].outliers, box["E"].documents, box["E"].highest) == (10.0, 90.0, 1, 6, 1234567.891)
    assert (box[None].low_whisker, box[None].high_whisker, box[None].outliers) == (5.0, 5.0, 0)
    assert [r.id for r in analytics.outliers(rows).collect()] == ["6"]
    shown = analytics.kpi_texts(rows.where("empresa = 'E'")).first()
    assert (shown.gross, shown.net, shown.growth, shown.tax_rate, shown.companies) == ("1,234,567.89 €", "411,522.63 €", "12,345,578.9 %", "2.0 %", "1")
    assert [r.total_deducciones for r in analytics.with_deductions(rows).where("id = '3'").collect()] == [8.67]


def test_multiset_difference_is_one_pass(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 1)], "k string, v int")
    right = spark.createDataFrame([("a", 1), (None, 2), (None, 2), (None, 2), ("c", 1)], "k string, v int")
    found = analytics.multiset_difference(left, right)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", 1, "removed"), ("b", 1, "removed"), (None, 2, "added"), (None, 2, "added"), ("c", 1, "added")], key=str)


def test_rows_as_dicts(spark):
    from payspark.schema import PAYSLIP
    from payspark.sources.store import to_dict

    row = catalog.new_store(spark, catalog.documents_of(spark, DATA)).all().first()
    said = to_dict(row)
    assert list(said) == [n for n in PAYSLIP.names if n in row] and said["id"] == row.id and "payload" not in said


def test_quartiles_of_skewed_groups(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("AAAAAAAB") if k % 50 else None, float(rnd.choice([1, 2, 2, 3, 50, rnd.randrange(1, 10**4)]))) for k in range(3000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0)]
    table = spark.createDataFrame(rows, "empresa string, total_devengado double").repartition(5)
    expected = table.groupBy("empresa").agg(*(F.percentile("total_devengado", q / 4).alias(n) for q, n in ((1, "q1"), (2, "median"), (3, "q3"))), F.count("*").alias("documents"))
    plain = lambda frame: {r.empresa: (r.q1, r.median, r.q3, r.documents) for r in frame.collect()}
    assert plain(analytics.pay_ranges(table)) == plain(expected) and len(plain(expected)) == 5


def test_scan_reads_needed_columns(spark):
    found = catalog.new_store(spark, catalog.documents_of(spark, DATA)).certificates().select("id", "total_devengado")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,tipo:string,total_devengado:double>" in plan and "EqualTo(tipo,CERTIFICADO_RETENCIONES)" in plan


def test_one_regex_pass_for_all_formats(spark):
    plan = catalog.parse_coritel(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan
