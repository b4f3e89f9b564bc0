"""Work that grows with the rows alone: even tasks, nothing computed over and over."""

import datetime

from pyspark.sql import functions as F

from payspark.operators.dispatch import DEFAULT
from payspark.functions.text import folded, not_blank, period
from payspark.operators.formats import alten, altran, insis
from payspark.operators.formats.python import PythonFormat, read_by_python
from payspark.operators.parse import parse_documents
from payspark.plans.catalog import first_slip
from payspark.plans.synth import euro, payslips
from payspark.schema import PAYSLIP
from payspark.sources import store as stores
from payspark.sources.documents import spread
from payspark.sources.store import DocumentStore, decoded, to_stored


def sizes(rows):
    return [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]


def test_spread_goes_by_rows_not_by_partitions(spark):
    """Many partitions, all rows in one of them, as those of a file with one row group are."""
    cores = spark.sparkContext.defaultParallelism
    lopsided = spark.range(1000).repartition(8 * cores, F.lit(1))
    found = sizes(spread(lopsided, task_rows=50))
    assert sum(found) == 1000 and len(found) >= 20 and max(found) <= 100


def test_numbers_and_names_are_prepared_once(spark):
    with_rounding = F.col("raw")
    assert str(insis.FORMAT.convert(with_rounding)).count("regexp_replace") == 1
    assert "array_compact" not in str(DEFAULT.only(F.col("v"))) and str(insis.flags(F.col("t"))["gate"]).count("regexp_replace") == 1


def test_insis_spaces_gates_and_cents(spark):
    text = "Insis\nPeríodo: DE ENERO DE 2099\nT O T A L DEVENGADO 1 . 0 0 0 , 1 2 5 x\nTOTAL A\nDEDUCIR 0,12 x\nLIQUIDO TOTAL A PERCIBIR PTA 1 000,00 x\nPAGA EXTRAORDINARIA\n"
    rows = [("a.pdf", text), ("b.pdf", text.replace("DEDUCIR", "DEDUC1R")), ("c_insis.pdf", None)]
    found = {r.filename: r for r in parse_documents(spark.createDataFrame(rows, "filename string, text string")).collect()}
    assert (found["a.pdf"].status, found["a.pdf"].total_devengado, found["a.pdf"].liquido_percibir, found["a.pdf"].id) == ("OK", 1000.12, 1000.0, "2099-01-INSIS-EXTRA")
    assert (found["b.pdf"].error_code, found["c_insis.pdf"].error_code) == ("MISSING_TOTALS", "NO_TEXT")


def test_names_are_looked_for_once_and_totals_matched_once(spark):
    assert str(DEFAULT.only(F.col("v"))).count("contains(v, 'altran')") == 1
    assert "gate" not in altran.FORMAT.flags(F.col("t"))
    rows = [("2099_02", t) for t in ("Altran Totales 1,00 0,00", "Altran Líquido a percibir 1,00", "Altran Totales 1,00 0,00 LÍQUIDO A PERCIBIR 1,00", "Altran\nTotales 1,00\nLíquido a percibir 1,00")]
    found = parse_documents(spark.createDataFrame(rows, "filename string, text string").coalesce(1)).collect()
    assert [r.error_code for r in found] == ["MISSING_TOTALS", "MISSING_TOTALS", None, "MISSING_TOTALS"]


def test_cents_months_and_letters_as_before(spark):
    cents = [0, 5, 99, 100, 1234, 99_999, 100_000, 100_001, 1_000_005, 99_999_999, 100_000_000, 123_456_789_012, -5, -123_456]
    plain = F.translate(F.format_number(F.col("v") / 100, 2), ".,", ",.")
    assert all(r[0] == r[1] for r in spark.createDataFrame([(c,) for c in cents], "v long").select(euro(F.col("v")), plain).collect())
    assert "format_string" not in str(period(F.col("y"), F.col("m")))
    months = spark.createDataFrame([(1900, 1), (2099, 9), (9999, 12), (2000, 10)], "y int, m int").select(period(F.col("y"), F.col("m"))).collect()
    assert [r[0] for r in months] == ["1900-01", "2099-09", "9999-12", "2000-10"]
    words = [r[0] for r in spark.createDataFrame([("InſIs",), ("ﬅﬆÍ x",), ("ÍA",), ("",)], "v string").coalesce(1).select(folded(F.col("v"))).collect()]
    assert words == ["insis", "ststí x", "ía", ""]


def test_payloads_are_read_for_what_is_asked(spark):
    row = {f.name: None for f in PAYSLIP} | {"id": "a", "complementos": 12.5, "tipo": "NOMINA_ORDINARIA", "categoria": "B"}
    rows = to_stored(spark.createDataFrame([tuple(row[f.name] for f in PAYSLIP)], PAYSLIP))
    found = decoded(rows, fields=["complementos", "categoria"])
    assert found.select("id", "complementos", "categoria").first() == ("a", 12.5, "B") and "irpf_importe" not in found.columns
    assert decoded(rows, fields=[]).columns == rows.columns
    plan = found.select("complementos")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan and "StructField(vacaciones_no_disfrutadas" not in plan
    try:
        decoded(rows, fields=["surname"])
    except ValueError as error:
        assert "surname" in str(error)
    else:
        raise AssertionError("an unknown field was read")


def test_python_formats_send_asked_columns_as_arrow(spark):
    class Fine:
        def parse(self, text, filename):
            return {"id": filename, "anio": 2099, "mes": 1, "periodo": "2099-01", "empresa": "Own", "cif": "Z", "total_devengado": 5, "es_procesable": None}

    rows = spark.createDataFrame([("own", "t", "a"), (None, "t", "b")], "key string, text string, name string").coalesce(1)
    read = read_by_python({"own": PythonFormat("own", Fine)}, F.col("key"), F.col("text"), F.col("name"), {"id", "total_devengado", "es_procesable"})
    found = rows.select(read.alias("r"))
    assert found.schema["r"].dataType["row"].dataType.names == ["id", "es_procesable", "total_devengado"]
    assert [(r.r.row and tuple(r.r.row), r.r.error_code) for r in found.collect()] == [(("a", None, 5.0), None), ((None, None, None), None)]


def test_first_slip_makes_no_other_text(spark):
    """Else all rows were dealt out and written as texts twice in a batch report."""
    rows = [(k, 10_000 * k + 5, datetime.datetime(2099, 3 - k % 3, 1)) for k in range(1, 40)]
    own = spark.createDataFrame(rows, "key long, gross long, day timestamp").repartition(3)
    slips = payslips(own, "alten")
    least = slips.agg(F.min(F.struct(F.substring("filename", 1, 6), "filename", "text")).alias("m")).select("m.filename", "m.text").first()
    found = first_slip(own)
    assert found.first() == least and found.count() == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "TOTAL DEVENGADO" not in plan[plan.index("Aggregate"):]


def test_a_task_parses_many_rows(spark):
    """Each task writes the code of all stages anew, which takes it some half a second."""
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(400_000 * cores)).rdd.getNumPartitions() == cores


def test_texts_without_split_numbers_stay(spark):
    spaces = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [f"{a}{s}{p}{t}{b}" for a in ("1", "x", "٣") for b in ("2", "y") for p in ".," for s in ("", *spaces) for t in ("", *spaces)]
    texts += ["", "1 .5 , 6", ". ,1", "1 .", ", 2", "1\u200b.2", "𝟏 .𝟐", "Alten TOTAL 1.234,56 7,00\nLIQUIDO"]
    plain = F.col("t")
    for body, by in alten.SPLIT_NUMBERS:
        plain = F.regexp_replace(plain, body, by)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", alten.rejoin_numbers(F.col("t")).alias("joined"), plain.alias("plain")).collect()
    assert all((r.t if r.joined is None else r.joined) == r.plain for r in rows)
    assert [r.joined for r in rows if r.t in ("", "Alten TOTAL 1.234,56 7,00\nLIQUIDO", "1.2", "1\u200b.2")] == [None] * 4


def test_blank_texts_and_names_in_any_letters(spark):
    texts = ["", " ", "\t\n\x1c\x1f\x85\xa0\u3000", " a", "a ", "!", "~", "\x7f", "\x00", "\u200b", "é", "\x1cé", "٣", "😀"]
    own = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] == r[1] for r in own.select(not_blank(F.col("t")), F.rlike("t", F.lit(r"(?dU)[^\s\x1c-\x1f]"))).collect())
    names = [("InſIs", "a.pdf"), ("x", "inſis.pdf"), ("ALTRA", "N.pdf"), (None, "İneco"), ("ΑΣ", "Σ altran"), ("ΑΣ'", "A"), ("alte", None), (None, "ALTEN"), ("inteligencia ", "sistematica")]
    pairs = spark.createDataFrame(names, "t string, n string")
    whole = folded(F.concat(F.coalesce("t", F.lit("")), F.lit(" "), F.coalesce("n", F.lit(""))))
    found = pairs.select(DEFAULT.searched(F.col("t"), F.col("n")), whole, DEFAULT.key(F.col("t"), F.col("n"))).collect()
    assert all(r[0] == r[1] for r in found)
    assert [r[2] for r in found] == ["insis", "insis", None, None, "altran", None, None, "alten", None]


def test_removals_are_dealt_by_file_and_read_without_shuffling_rows(spark, tmp_path, monkeypatch):
    keys = spark.range(70_000).select(F.format_string("%06d", "id").alias("id"), F.lit(2099).alias("anio"), F.lit(1).alias("mes"), *(F.lit(c).alias(c) for c in ("periodo", "empresa", "cif", "tipo")))
    store = DocumentStore(spark, str(tmp_path / "s"), buckets=2)
    store.init()
    store.append(keys)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        store.delete_all(keys.where("id % 7 = 0").select("id"))  # in blocks of 32,768 rows up to the last
        written = list((tmp_path / "s" / "gone").glob("*/*.parquet"))
        assert len(written) > 1  # not a task for each part
        plan = store.table()._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        left = sorted(k for k in range(70_000) if k % 7)
        assert sorted(int(r.id) for r in store.ids().collect()) == left
        monkeypatch.setattr(stores, "MANY_MARKS", -1)
        assert sorted(int(r.id) for r in store.ids().collect()) == left
    finally:
        for k in conf:
            spark.conf.unset(k)
