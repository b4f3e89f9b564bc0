"""Batches, company scripts, streams and sources."""

from payspark.operators.ingest import ingest_batch, ingest_company, ingest_folder, parse_file, report
from payspark.sources import create
from payspark.sources.documents import extract_text, file_name, read_folder, spread, uploads
from payspark.sources.store import DocumentStore
from payspark.streaming.ingest import arriving, ingest_stream

ALTEN = "Alten TOTAL DEVENGADO TOTAL DEDUCCIONES 2500,00 500,00\nLIQUIDO A PERCIBIR 2000,00\n"
ROWS = [("209901_a.pdf", ALTEN), ("209901_b.pdf", ALTEN), ("209902_a.pdf", ALTEN), ("209903_a.pdf", ""), ("209904.pdf", "coritel"), ("209905.pdf", ALTEN.replace("2000,00", "1999,00"))]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "filename string, text string").repartition(3)


def test_batch(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"))
    batch = ingest_batch(frame(spark), store)
    assert tuple(batch.summary.first()) == (6, 2, 3, 0, 1)
    assert [r.filename for r in batch.conflicts.collect()] == ["209901_b.pdf"] and store.table().count() == 2
    again = ingest_batch(frame(spark), store)
    assert tuple(again.summary.first()) == (6, 0, 3, 0, 3) and store.table().count() == 2
    lines = {r.filename: r.line for r in report(batch.outcome).collect()}
    assert lines["209902_a.pdf"].startswith("[OK] ") and lines["209904.pdf"].startswith("[ERROR] ")


def test_company_script(spark):
    store = DocumentStore(spark, ":memory:")
    batch = ingest_company(frame(spark, [*ROWS[:3], ("209906.pdf", "TOTAL DEVENGADO TOTAL DEDUCCIONES 129,00 126,24 LIQUIDO A PERCIBIR 2,78")]), store, "alten")
    assert tuple(batch.summary.first()) == (4, 2, 1, 1, 0)  # the last passes the first check and fails the rounded one
    assert {r.outcome for r in ingest_company(frame(spark), DocumentStore(spark, ":memory:"), "coritel").outcome.collect()} == {"ERROR"}


def test_stream(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "in"))
    store = DocumentStore(spark, str(tmp_path / "s"))
    for _ in range(2):
        ingest_stream(arriving(spark, str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in store.table().collect()) == ["2099-01-ALTEN", "2099-02-ALTEN"]


def test_sources(spark, tmp_path):
    for name, content in (("b.pdf", b"one|two"), ("a.pdf", b"bad"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.pdf").write_bytes(b"x")

    def pages(content):
        if content == b"bad":
            raise ValueError("no pages")
        return [*content.decode().split("|"), None]

    found = extract_text(read_folder(spark, str(tmp_path)), pages).orderBy("path").collect()
    assert [(r.filename, r.text, r.extract_error) for r in found] == [("a.pdf", None, "ValueError: no pages"), ("b.pdf", "one\ntwo\n", None)]
    kept = uploads(spark, [("x.pdf", b"a"), ("y.doc", b"b"), (None, b"c")]).orderBy("idx").collect()
    assert [(r.idx, r.filename) for r in kept] == [(0, "x.pdf"), (2, "document.pdf")]
    assert [r[0] for r in spark.createDataFrame([("/a/b.pdf",), (None,), ("c.pdf",)], "p string").select(file_name("p")).collect()] == ["b.pdf", "document.pdf", "c.pdf"]


def test_one_file_to_its_payslip(spark, tmp_path):
    pages = lambda content: [content.decode()]
    (tmp_path / "209901.pdf").write_text(ALTEN)
    by_path, by_bytes = parse_file(spark, str(tmp_path / "209901.pdf"), extractor=pages).first(), parse_file(spark, ALTEN.encode(), "209902.pdf", pages).first()
    assert (by_path.id, by_bytes.id, by_path.liquido_percibir) == ("2099-01-ALTEN", "2099-02-ALTEN", 2000.0)
    assert parse_file(spark, ALTEN.encode(), extractor=pages).first().error_code == "MISSING_PERIOD"


def test_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = DocumentStore(spark, str(tmp_path / "s"))
    assert ingest_folder(spark, str(tmp_path / "in"), store) is None and not (tmp_path / "s").exists()
    for k in (1, 2):
        (tmp_path / "in" / f"20990{k}_a.pdf").write_text(ALTEN)
    (tmp_path / "in" / "209901_b.pdf").write_text(ALTEN)
    batch = ingest_folder(spark, str(tmp_path / "in"), store, "alten", lambda content: [content.decode()])
    assert tuple(batch.summary.first()) == (3, 2, 1, 0, 0) and store.table().count() == 2


def test_create_and_spread(spark, tmp_path, capsys):
    create.main(["--path", str(tmp_path / "made")])
    assert DocumentStore(spark, str(tmp_path / "made")).table().count() == 0 and "made" in capsys.readouterr().out
    assert spread(spark.range(1).repartition(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
