"""The store's versions: crashes, writers at a time, removals, filters, compaction; batches with a hot id."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from payspark.operators import ingest
from payspark.schema import STORED
from payspark.sources.commits import CommitLog, LostRace, Part, Version
from payspark.sources.store import DocumentStore, DuplicateIdError, first_rows, merged, to_stored


def documents(spark, first, last, **more):
    rows = spark.range(first, last).select(
        F.format_string("%06d", "id").alias("id"), F.lit(2099).alias("anio"), F.lit(1).alias("mes"), F.lit("2099-01").alias("periodo"),
        F.when(F.col("id") % 2 == 0, "E").otherwise("F").alias("empresa"), F.lit("C").alias("cif"), F.lit("NOMINA_ORDINARIA").alias("tipo"), F.col("id").cast("double").alias("total_devengado"),
    )
    return rows.withColumns(more)


@pytest.fixture
def store(spark, tmp_path):
    own = DocumentStore(spark, str(tmp_path / "store"), buckets=4)
    own.init()
    return own


def files(store, kind="data"):
    return sorted(f"{d}/{n}" for d, _, names in os.walk(f"{store.path}/{kind}") for n in names if n.endswith(".parquet"))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_killed_append_is_not_seen(spark, store):
    store.append(documents(spark, 0, 50))
    before = store.version()
    broken = documents(spark, 50, 90, cif=F.when(F.col("id") == "000070", F.raise_error(F.lit("killed"))).otherwise(F.lit("C")))
    with pytest.raises(Exception, match="killed"):
        store.append(broken)
    assert store.version() == before and store.table().count() == 50
    # All files written, but no commit: the next writer and readers don't see them.
    store._write(to_stored(documents(spark, 50, 90)), 4)
    assert store.table().count() == 50
    store.append(documents(spark, 40, 60), strict=False)
    assert store.table().count() == 60 and store.ids().distinct().count() == 60
    store.vacuum(keep=1, older_than=0)
    assert store.table().count() == 60 and len(files(store)) == len(set(files(store))) and len(os.listdir(f"{store.path}/log")) == 1


def test_two_writers_lose_nothing(spark, store, monkeypatch):
    other = DocumentStore(spark, store.path)
    commit = CommitLog.commit
    met = threading.Event()

    def late(log, version):
        if log is store.log and not met.is_set():  # the other writer comes between this one's reading and its commit
            met.set()
            other.append(documents(spark, 20, 60, total_devengado=F.lit(-1.0)), strict=False)
        return commit(log, version)

    monkeypatch.setattr(CommitLog, "commit", late)
    store.append(documents(spark, 0, 40), strict=False)
    rows = {r.id: r.total_devengado for r in store.table().collect()}
    assert len(rows) == store.table().count() == 60
    assert all((v == -1.0) == (int(k) >= 20) for k, v in rows.items())  # who committed first keeps the shared ids
    met.clear()
    monkeypatch.setattr(other, "append", lambda *a, **b: other.delete("000001"))
    store.append(documents(spark, 60, 70))
    assert store.table().count() == 69


def test_threads(spark, store):
    errors = []

    def write(first):
        try:
            DocumentStore(spark, store.path).append(documents(spark, first, first + 30), strict=False)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in (0, 15, 30)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store.table().count() == store.ids().distinct().count() == 60


def test_a_version_is_taken_once(spark, store):
    log = CommitLog(spark, store.path)
    taken = Version(2, 4, (Part("x", 1, 1),))
    assert log.commit(taken) == taken and log.newest() == taken
    with pytest.raises(LostRace):
        log.commit(Version(2, 4))
    assert log.newest() == taken and json.loads(taken.written())["parts"][0]["name"] == "x"
    assert not [n for n in os.listdir(f"{store.path}/log") if n.startswith(".") and not n.endswith(".crc")]


def test_delete_writes_places_only(spark, store):
    store.append(documents(spark, 0, 100))
    before = files(store)
    store.delete("000042")
    store.delete("no such id")
    assert files(store) == before and len(files(store, "gone")) == 1 and store.version().number == 3
    assert store.table().count() == 99 and not store.all().where("id = '000042'").count()
    plan = plan_of(store.all().where("empresa = 'E'").select("id"))
    assert "ReadSchema: struct<id:string,empresa:string,_tmp_metadata_row_index:bigint>" in plan and "EqualTo(empresa,E)" in plan
    store.append(documents(spark, 42, 43))  # the id is free again
    assert store.table().count() == 100
    store.delete_all(documents(spark, 90, 120).select("id"))
    assert store.table().count() == 90 and store.version().removals[-1].rows == 10
    store.delete("000042")
    assert store.table().count() == 89


def test_compaction(spark, store):
    for k in range(4):
        store.append(documents(spark, 10 * k, 10 * k + 10))
    store.delete("000005")
    rows = sorted(store.table().collect())
    old = store.version()
    assert store.compact() and len(store.version().parts) == 1 and not store.version().removals
    assert sorted(store.table().collect()) == rows and sorted(store.table(old).collect()) == rows
    assert not store.compact()
    store.append(documents(spark, 100, 103))
    assert not store.compact(small=5) and len(store.version().parts) == 2
    store.append(documents(spark, 103, 105))
    assert store.compact(small=5) and sorted(p.rows for p in store.version().parts) == [5, 39]
    with pytest.raises(DuplicateIdError):
        store.append(documents(spark, 104, 106))
    store.delete_all(store.ids())
    assert store.compact() and store.version().parts == () and store.table().count() == 0


def test_new_ids_open_no_file(spark, store):
    store.append(documents(spark, 0, 20_000))
    store.append(documents(spark, 20_000, 21_000))
    version = store.version()
    asked = documents(spark, 50_000, 52_000).select("id")
    found, folders = store.files_with(asked, version)
    assert found.count() < 2 * 2000 * 0.05  # false hits
    one = documents(spark, 7, 8).select("id")
    _, folders = store.files_with(one, version)
    assert sum(map(len, folders.values())) <= 2
    both = one.unionByName(documents(spark, 60_000, 60_100).select("id"))
    assert [r.id for r in store.known(both).collect()] == ["000007"]
    assert store.known(documents(spark, 19_990, 20_010).select("id")).count() == 20
    seen = []
    own = store._read
    store._read = lambda kind, schema, names: seen.append((kind, list(names))) or own(kind, schema, names)
    fresh = documents(spark, 70_000, 70_001).select("id")
    assert store.known(fresh).count() == 0 and [n for k, names in seen if k == "data" for n in names] == []


def test_hot_id_in_a_batch(spark, tmp_path):
    text = "Alten TOTAL DEVENGADO TOTAL DEDUCCIONES 2500,00 500,00\nLIQUIDO A PERCIBIR 2000,00\n"
    rows = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "209901").otherwise(F.format_string("2%03d%02d", (F.col("id") % 900).cast("int"), (F.col("id") % 12 + 1).cast("int"))).alias("month"), F.col("id").alias("turn")
    )
    batch = rows.select(F.format_string("%s_%05d.pdf", "month", F.lit(5000) - F.col("turn")).alias("filename"), F.lit(text).alias("text"), "turn").repartition(6)
    store = DocumentStore(spark, str(tmp_path / "s"))
    found = ingest.ingest_batch(batch, store)
    expected = len({r.month for r in rows.collect()})
    assert tuple(found.summary.first()) == (3000, expected, 0, 0, 3000 - expected) and store.table().count() == expected
    assert "Window" not in plan_of(found.outcome)
    kept = found.outcome.where("outcome = 'LOADED' and periodo = '2099-01'").collect()
    assert [r.filename for r in kept] == ["209901_02002.pdf"]  # the least file name of 1,500
    new, known = store.split(documents(spark, 0, 50).unionByName(documents(spark, 25, 75)), "total_devengado")
    assert "Window" not in plan_of(new) + plan_of(known) and (new.count(), known.count()) == (75, 25)
    assert "Window" not in plan_of(first_rows(documents(spark, 0, 9), "id", "total_devengado"))


def test_counts_come_with_the_insert(spark, tmp_path, monkeypatch):
    def never(outcome):
        raise AssertionError("counted apart")

    monkeypatch.setattr(ingest, "summary_of", never)
    batch = spark.createDataFrame([("209901_a.pdf", ""), ("209902_a.pdf", "Alten TOTAL DEVENGADO TOTAL DEDUCCIONES 25,00 5,00 LIQUIDO A PERCIBIR 20,00")], "filename string, text string")
    store = DocumentStore(spark, str(tmp_path / "s"))
    assert tuple(ingest.ingest_batch(batch, store).summary.first()) == (2, 1, 1, 0, 0)
    assert tuple(ingest.ingest_batch(batch, store).summary.first()) == (2, 0, 1, 0, 1)


def test_open_payload(spark, store):
    own = documents(spark, 0, 4, city=F.struct(F.concat(F.lit("c"), "id").alias("name"), F.array(F.lit(1), F.lit(2)).alias("zips")), level=F.lit(7), cif=F.lit("in the column"))
    store.append(own.where("id < '000002'"), extra=("city", "level"))
    store.append(own.where("id >= '000002'"))
    rows = store.all_fields(town="$.city.name: string", zip="$.city.zips[1]: int", wrong="$.city: int").orderBy("id").collect()
    assert [(r.town, r.zip, r.wrong) for r in rows] == [("c000000", 2, None), ("c000001", 2, None), (None, None, None), (None, None, None)]
    assert [json.loads(r.rest.toJson()) for r in rows] == [{"city": {"name": f"c00000{k}", "zips": [1, 2]}, "level": 7} for k in (0, 1)] + [{}, {}]
    changed = store.table().withColumn("cif", F.lit("column")).withColumn("payload", F.lit('{"cif": "payload", "complementos": 3.5, "added": null}'))
    row = merged(changed).first()
    assert (row.cif, row.complementos, json.loads(row.rest.toJson())) == ("column", 3.5, {"added": None})
    assert merged(changed.withColumn("payload", F.lit("no json"))).first().rest.toJson() == "{}"
    with pytest.raises(ValueError, match="cif"):
        merged(changed, cif="$.x: int")
    assert merged(changed).schema.names[: len(STORED.names)] == STORED.names
