"""The data source of payslip files: dealing by size, errors as rows, batches into a store."""

from payspark.operators.ingest import ingest_batch
from payspark.sources import files as S
from payspark.sources.store import DocumentStore

ALTEN = "Alten TOTAL DEVENGADO TOTAL DEDUCCIONES 2500,00 500,00\nLIQUIDO A PERCIBIR 2000,00\n"


def test_balanced_by_size():
    files = [("huge", 100 << 20)] + [(f"small{k:04d}", 1000) for k in range(3000)]
    bins = S.balanced(files, 4)
    assert sorted(f for b in bins for f in b) == sorted(files)
    (alone,) = [b for b in bins if ("huge", 100 << 20) in b]
    assert len(alone) == 1 and max(len(b) for b in bins) - min(len(b) for b in bins if b is not alone) <= 1
    assert S.balanced([], 4) == [] and len(S.balanced(files[:2], 9)) == 2


def test_read_files(spark, tmp_path):
    def pages(content):
        if content == b"corrupt":
            raise ValueError("no pages")
        return [*content.decode().split("\f"), None]

    for name, content in (("209901_a.pdf", ALTEN.encode()), ("209902_b.pdf", b"one\ftwo"), ("bad.pdf", b"corrupt"), ("notes.txt", b"x"), ("empty.pdf", b"")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.pdf").write_bytes(b"x")
    (tmp_path / "big.pdf").write_bytes(b"y" * 3_000_000)
    found = S.read_files(spark, str(tmp_path), pages, partitions=3)
    rows = {r.filename: r for r in found.collect()}
    assert set(rows) == {"209901_a.pdf", "209902_b.pdf", "bad.pdf", "empty.pdf", "big.pdf"} and found.rdd.getNumPartitions() == 3
    assert rows["209902_b.pdf"].text == "one\ntwo\n" and rows["209902_b.pdf"].length == 7 and rows["big.pdf"].length == 3_000_000
    assert (rows["bad.pdf"].text, rows["bad.pdf"].extract_error) == (None, "ValueError: no pages")
    store = DocumentStore(spark, str(tmp_path / "store"))
    assert tuple(ingest_batch(found, store).summary.first()) == (5, 1, 4, 0, 0)
    assert S.read_files(spark, str(tmp_path), pages, glob="*.none").count() == 0
    assert S.read_files(spark, f"file://{tmp_path}", pages, glob="big*").first().filename == "big.pdf"
    named = spark.read.format("payslip_files").option("extractor", "builtins:bytes.no").load(str(tmp_path))
    assert named.count() == 5  # the extractor registered last counts
