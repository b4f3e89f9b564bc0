"""A table of documents, one row for each id, kept as Parquet files with a log of versions.

Each insert writes a part, a folder of its own, and becomes visible by the
version that names it (``commits``); so an insert is there as a whole or not at
all, and several writers may work at a time. Whether ids exist is asked of the
parts' filters (``id_index``) before a data file is opened. Deleting writes the
places of the removed rows, which readers leave out; ``compact`` folds parts
and removals into one part.

    data/batch=PART/bucket=K/*.parquet    rows, by a hash of their id
    ids/batch=PART/*.parquet              filters of each bucket's ids
    gone/act=REMOVAL/*.parquet            part, bucket, file and row number of removed rows
    log/N.json                            what version N consists of
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payspark.schema import CERTIFICATE, DEFAULTS, DOCUMENT, KINDS, PAYLOAD, PAYSLIP, REQUIRED, STORED, STORED_AMOUNTS
from payspark.sources import id_index
from payspark.sources.checkpoints import settled
from payspark.sources.commits import CommitLog, LostRace, Part, Removal, Version

DEFAULT_PATH, PATH_VARIABLE = "data/payslips", "PAYSPARK_STORE"
#: Into how many buckets a new table deals its ids.
BUCKETS = 8
#: Parts from which a stream folds them into one.
MANY_PARTS = 16
#: Bitmaps of removed rows (4 KB each) up to which they are sent to all tasks, and how many rows of a part one stands for at least, by and large.
MANY_MARKS, MARKED_ROWS = 16_384, 8_192
PLACED = T.StructType([*STORED.fields, T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())])
FILTERS = T.StructType([T.StructField(n, k) for n, k in (("bucket", T.IntegerType()), ("block", T.IntegerType()), ("bits", T.BinaryType()), ("batch", T.StringType()))])
#: Where a row is; files of one task have one name in all buckets.
GONE = T.StructType([T.StructField(n, k) for n, k in (("batch", T.StringType()), ("bucket", T.IntegerType()), ("file", T.StringType()), ("row", T.LongType()))])


class DuplicateIdError(ValueError):
    """An inserted id exists, in the store or earlier in the batch."""


def store_path() -> str:
    """Where the environment says, else the default."""
    return os.environ.get(PATH_VARIABLE, DEFAULT_PATH)


def payload_column(documents: DataFrame, extra: Iterable[str] = ()) -> Column:
    """All model fields of a row, and ``extra`` columns, as JSON, nulls included."""
    names = [f.name for f in PAYLOAD if f.name in documents.columns]
    return F.to_json(F.struct(*names, *(n for n in extra if n not in names)), {"ignoreNullFields": "false"})


def to_stored(documents: DataFrame, *more: str, extra: Iterable[str] = ()) -> DataFrame:
    """Documents of any kind as stored rows; amounts that a kind lacks are 0.0.

    ``more`` columns are kept. ``extra`` columns, which no model has, go into
    the payload with their types.
    """
    has = set(documents.columns)
    values = {n: F.col(n) for n in STORED.names if n in has and n not in STORED_AMOUNTS}
    values |= {n: F.coalesce(F.col(n), F.lit(0.0)) if n in has else F.lit(0.0) for n in STORED_AMOUNTS}
    values["payload"] = payload_column(documents, extra)
    values["es_procesable"] = F.coalesce(F.col("es_procesable").cast("int"), F.lit(1)) if "es_procesable" in has else F.lit(1)
    values["observaciones"] = F.coalesce(F.col("observaciones"), F.lit("")) if "observaciones" in has else F.lit("")
    return documents.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in STORED), *more)


def decoded(rows: DataFrame, *more: str, fields: Iterable[str] | None = None) -> DataFrame:
    """Stored rows with their payload's fields; where both have a name the stored column counts. ``more`` columns are kept.

    With ``fields`` only these of the payload's fields are read; a payload is
    parsed for no column that the rows have themselves.
    """
    own = {f.name for f in STORED}
    wanted = T.StructType([f for f in PAYLOAD if f.name not in own and (fields is None or f.name in set(fields))])
    unknown = sorted(set(fields or ()) - set(wanted.names))
    if unknown:
        raise ValueError(f"payloads have no fields {unknown} beside the stored columns")
    read = rows.withColumn("_decoded", F.from_json("payload", wanted)) if wanted.names else rows
    return read.select(*own_order(rows), *(F.col(f"_decoded.{n}").alias(n) for n in wanted.names), *more)


def merged(rows: DataFrame, **fields: str) -> DataFrame:
    """``decoded`` rows with what else their payloads have.

    ``rest`` is a VARIANT object of the payload's fields that are neither
    stored columns nor a model's; where both have a name the stored column
    counts. ``fields`` are further columns, each a path and a type in the
    payload: ``merged(rows, city="$.address.city: string")``; null where a
    payload lacks the path or has another type there.
    """
    known = [f.name for f in STORED] + [f.name for f in PAYLOAD if f.name not in STORED.names]
    clash = sorted({"rest", *fields} & set(known)) or sorted({"rest"} & set(fields))
    if clash:
        raise ValueError(f"these columns exist: {clash}")
    other = F.map_filter(F.from_json("payload", "map<string, variant>"), lambda k, v: ~k.isin(*known))
    payload = F.try_parse_json("payload")
    picked = [F.try_variant_get(payload, path.strip(), kind.strip()).alias(n) for n, (path, _, kind) in ((n, said.rpartition(":")) for n, said in fields.items())]
    given = rows.withColumn("rest", F.coalesce(F.try_parse_json(F.to_json(other)), F.parse_json(F.lit("{}"))))
    return decoded(given.select("*", *picked), "rest", *fields)


def own_order(rows: DataFrame) -> list[str]:
    return [f.name for f in STORED if f.name in rows.columns]


def as_payslips(rows: DataFrame, exact: bool = False) -> DataFrame:
    """Read rows as payslips: the model's fields alone, kinds checked.

    With ``exact`` columns that the model lacks raise, as do required fields
    that the rows lack; else the former are left out and optional fields that
    the rows lack are null or 0.0.
    """
    names, required = {f.name for f in PAYSLIP}, [f.name for f in DOCUMENT.fields[:6]]
    unknown, missing = sorted(set(rows.columns) - names), [n for n in required if n not in rows.columns]
    if missing or (exact and unknown):
        raise ValueError(f"missing fields: {missing}, unknown fields: {unknown if exact else []}")
    rows = rows.withColumns({n: F.lit(v) for n, v in DEFAULTS.items() if n not in rows.columns})
    kind = F.when(F.col("tipo").isin(*KINDS), F.col("tipo")).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.col("tipo"))).cast("string"))
    return rows.select(*((kind if f.name == "tipo" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in PAYSLIP))


def to_dict(row: Row) -> dict[str, object]:
    """A payslip row's model fields by name, in the model's order; other columns are left out."""
    has = row.asDict()
    return {n: has[n] for n in PAYSLIP.names if n in has}


def first_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of each key the first one by ``order``, then by all other columns.

    The least row is an aggregate, so each task sends one row of a key at most
    and no key is too frequent.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    least = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_least"), F.count("*").alias("_times"))
    return least.select(*(F.col(key) if c == key else F.col("_least")[c].alias(c) for c in rows.columns), "_times")


class DocumentStore:
    """Stored documents under ``path``; ``:memory:`` keeps them in this object."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path or store_path(), buckets
        self.log = CommitLog(spark, self.path)
        self._memory: DataFrame | None = None

    @property
    def in_memory(self) -> bool:
        return self.path == ":memory:"

    def _empty(self, schema: T.StructType = STORED) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def version(self) -> Version | None:
        """The newest version; a table in memory has none."""
        if self.in_memory:
            return None
        found = self.log.newest()
        if found is None:
            raise FileNotFoundError(f"no document table at {self.path}; call init()")
        return found

    def init(self) -> None:
        """Create the table if there is none."""
        if self.in_memory:
            self._memory = self._memory if self._memory is not None else self._empty()
        elif self.log.newest() is None:
            try:
                self.log.commit(Version(1, self.buckets))
            except LostRace:
                pass  # another writer has created it

    def reset(self) -> None:
        """Drop all rows."""
        if self.in_memory:
            self._memory = self._empty()
        else:
            self.init()
            self._change(lambda before: ((), ()))

    def _change(self, made: Callable[[Version], tuple[tuple[Part, ...], tuple[Removal, ...]] | None]) -> Version | None:
        """Commit what ``made`` says of the newest version; if another writer was first, ask again. None changes nothing."""
        while True:
            before = self.version()
            found = made(before)
            if found is None:
                return None
            try:
                return self.log.commit(Version(before.number + 1, before.buckets, *found))
            except LostRace:
                for kind, old, new in (("data", before.parts, found[0]), ("gone", before.removals, found[1])):
                    for own in set(new) - set(old):
                        self._drop(kind, own.name)

    def _drop(self, kind: str, name: str) -> None:
        for folder in (f"data/batch={name}", f"ids/batch={name}") if kind == "data" else (f"gone/act={name}",):
            self.log.delete(folder)

    def _read(self, kind: str, schema: T.StructType, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{f}" for f in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else self._empty(schema)

    def _present(self, version: Version, folders: dict[str, list[str]], *columns: str) -> DataFrame:
        """Rows of parts (name to folders) without those removed; rows of untouched parts need no join for that.

        Removed places meet the rows as bitmaps, one bit for each row of a
        file, small enough to be sent to the tasks: so the rows, with their
        payloads, are not shuffled.
        """
        touched = {p for r in version.removals for p in r.parts}
        plain = [f for n, own in folders.items() if n not in touched for f in own]
        hurt = [f for n, own in folders.items() if n in touched for f in own]
        rows = self._read("data", PLACED, plain).select(*columns) if plain or not hurt else None
        if not hurt:
            return rows
        marks = id_index.row_marks(self._read("gone", GONE, [f"act={r.name}" for r in version.removals]), *GONE.names[:3])
        if min(sum(r.rows for r in version.removals), sum(p.rows for p in version.parts if p.name in touched) // MARKED_ROWS) <= MANY_MARKS:
            marks = F.broadcast(marks)
        held = self._read("data", PLACED, hurt).select(*columns, *self._place()).withColumn("_block", id_index.row_block(F.col("_row")))
        keys = [f"_{c}" for c in (*GONE.names[:3], "block")]
        held = held.join(marks.select(*(F.col(c[1:]).alias(c) for c in keys), F.col("bits").alias("_bits")), keys, "left")
        held = held.where(F.col("_bits").isNull() | ~id_index.is_marked(F.col("_bits"), F.col("_row"))).select(*columns)
        return rows.unionByName(held) if rows is not None else held

    @staticmethod
    def _place() -> list[Column]:
        return [F.col("batch").alias("_batch"), F.col("bucket").alias("_bucket"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]

    def table(self, version: Version | None = None) -> DataFrame:
        """The stored rows as they are, in the newest version or the given one."""
        if self.in_memory:
            return self._memory if self._memory is not None else self._empty()
        version = version or self.version()
        return self._present(version, {p.name: [f"batch={p.name}"] for p in version.parts}, *STORED.names)

    def files_with(self, ids: DataFrame, version: Version) -> tuple[DataFrame, dict[str, list[str]]]:
        """(id, batch, bucket) where ``ids`` may be by the filters, and the folders to open for that, by part."""
        index = self._read("ids", FILTERS, [f"batch={p.name}" for p in version.parts])
        found = settled(id_index.candidates(ids, index, {p.name: p.blocks for p in version.parts}, version.buckets))
        folders: dict[str, list[str]] = {}
        for row in found.select("batch", "bucket").distinct().orderBy("batch", "bucket").collect():  # at most as many as there are buckets of parts
            folders.setdefault(row["batch"], []).append(f"batch={row['batch']}/bucket={row['bucket']}")
        return found, folders

    def known(self, ids: DataFrame, version: Version | None = None) -> DataFrame:
        """Those of ``ids`` (id, distinct) that the table has. Only files that may hold one are opened, and only their ids."""
        if self.in_memory:
            return self.table().select("id").join(ids, "id", "left_semi")
        version = version or self.version()
        if not version.parts:
            return self._empty().select("id")
        found, folders = self.files_with(ids, version)
        return self._present(version, folders, "id").join(found.select("id"), "id", "left_semi") if folders else self._empty().select("id")

    def split(self, documents: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
        """Documents whose ids are new, the first of each in ``order``, and the others."""
        by = order or tuple(c for c in documents.columns if c != "id")
        rows = settled(documents.withColumn("_number", F.monotonically_increasing_id()))
        first = settled(rows.groupBy("id").agg(F.min(F.struct(*by, "_number"))["_number"].alias("_first")))
        new = first.join(self.known(first.select("id")), "id", "left_anti").select("_first")
        return tuple(rows.join(new, F.col("_number") == F.col("_first"), how).select(*documents.columns) for how in ("left_semi", "left_anti"))

    def append(self, documents: DataFrame, *order: str, strict: bool = True, extra: Iterable[str] = ()) -> None:
        """Insert documents. A known or repeated id raises if ``strict``, else its later rows are skipped. ``extra`` as in ``to_stored``."""
        by = [c for c in order if c in STORED.names]
        more = [c for c in order if c not in STORED.names]
        rows = settled(first_rows(to_stored(documents, *more, extra=extra), "id", *by, *more))

        def made(before: Version | None) -> DataFrame:
            old = self.known(rows.select("id"), before)
            if strict and (first := rows.where("_times > 1").select("id").head() or old.head()):
                raise DuplicateIdError(f"id exists: {first['id']}")
            return rows.join(old, "id", "left_anti").select(*STORED.names)

        self.insert(made)

    def insert(self, made: Callable[[Version | None], DataFrame]) -> None:
        """Insert the stored rows that ``made`` gives for a version of the table; if another writer commits first, it is asked again."""
        if self.in_memory:
            self._memory = settled(self.table().unionByName(self._checked(made(None))))
            return

        def change(before: Version):
            part = self._write(made(before), before.buckets)
            return ((*before.parts, part), before.removals) if part else None

        self._change(change)

    @staticmethod
    def _checked(rows: DataFrame) -> DataFrame:
        missing = F.lit(False)
        for name in REQUIRED:
            missing = missing | F.col(name).isNull()
        return rows.withColumn("id", F.when(missing, F.raise_error(F.lit("a required field is null")).cast("string")).otherwise(F.col("id")))

    def _write(self, rows: DataFrame, buckets: int) -> Part | None:
        """A new part, not yet in any version; None if there are no rows."""
        name, seen = f"b{uuid.uuid4().hex}", Observation()
        placed = self._checked(rows).withColumn("bucket", id_index.bucket_of(F.col("id"), buckets)).repartition("id").observe(seen, F.count("*").alias("n"))
        placed.write.partitionBy("bucket").parquet(f"{self.path}/data/batch={name}")
        count = seen.get["n"]
        if not count:
            self._drop("data", name)
            return None
        blocks = id_index.blocks_for(count, buckets)
        ids = self._read("data", PLACED, [f"batch={name}"]).select("id")
        id_index.filters(ids, buckets, blocks).repartition("bucket").write.parquet(f"{self.path}/ids/batch={name}")
        return Part(name, count, blocks)

    def all(self) -> DataFrame:
        """All documents, with their payloads' fields."""
        return decoded(self.table())

    def all_fields(self, **fields: str) -> DataFrame:
        """The same with all other fields of the payloads, see ``merged``."""
        return merged(self.table(), **fields)

    def by_company(self, company: str) -> DataFrame:
        """Those of one company, by its exact name."""
        return decoded(self.table().where(F.col("empresa") == company))

    def certificates(self) -> DataFrame:
        return decoded(self.table().where(F.col("tipo") == CERTIFICATE))

    def ids(self) -> DataFrame:
        """All ids; no two rows share one."""
        return self.table().select("id")

    def delete(self, document_id: str) -> None:
        """Remove one document; an unknown id changes nothing."""
        self.delete_all(self.spark.createDataFrame([(document_id,)], "id string"))

    def delete_all(self, ids: DataFrame) -> None:
        """Remove the documents that have one of ``ids`` (id). No data file is written, only the places of what goes."""
        ids = settled(ids.select("id").distinct())
        if self.in_memory:
            self._memory = settled(self.table().join(ids, "id", "left_anti"))
            return

        def change(before: Version):
            found, folders = self.files_with(ids, before) if before.parts else (None, {})
            if not folders:
                return None
            name, seen = f"g{uuid.uuid4().hex}", Observation()
            places = self._present(before, folders, "id", "batch", "bucket", "_metadata").join(found.select("id"), "id", "left_semi")
            gone = places.select("batch", "bucket", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
            gone.repartition("batch", "bucket", "file").observe(seen, F.count("*").alias("n"), F.collect_set("batch").alias("parts")).write.parquet(f"{self.path}/gone/act={name}")
            if not seen.get["n"]:
                self._drop("gone", name)
                return None
            return before.parts, (*before.removals, Removal(name, tuple(sorted(seen.get["parts"])), seen.get["n"]))

        self._change(change)

    def compact(self, small: int | None = None) -> bool:
        """Fold parts into one, without their removed rows: all, or those with removals or at most ``small`` rows.

        False if there was nothing to fold, or if another writer changed these
        parts meanwhile.
        """
        if self.in_memory:
            return False
        start = self.version()
        touched = {p for r in start.removals for p in r.parts}
        old = [p for p in start.parts if small is None or p.rows <= small or p.name in touched]
        if len(old) < 2 and not touched & {p.name for p in old}:
            return False
        names = {p.name for p in old}
        part = self._write(self._present(start, {n: [f"batch={n}"] for n in sorted(names)}, *STORED.names), start.buckets)
        concerned = lambda v: [r for r in v.removals if names & set(r.parts)]
        while True:
            now = self.version()
            if not set(old) <= set(now.parts) or concerned(now) != concerned(start):
                if part:
                    self._drop("data", part.name)
                return False
            parts = tuple(p for p in now.parts if p.name not in names) + ((part,) if part else ())
            left = [Removal(r.name, tuple(p for p in r.parts if p not in names), r.rows) for r in now.removals]
            try:
                self.log.commit(Version(now.number + 1, now.buckets, parts, tuple(r for r in left if r.parts)))
                return True
            except LostRace:
                continue

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> None:
        """Delete all versions but the last ``keep``, and folders that no kept one names; those changed in the last ``older_than`` seconds may be a writer's and stay."""
        for number in self.log.numbers()[:-keep]:
            self.log.delete(f"log/{number:020d}.json")
        kept = [self.log.version(n) for n in self.log.numbers()]
        named = {f"batch={p.name}" for v in kept for p in v.parts} | {f"act={r.name}" for v in kept for r in v.removals}
        for kind in ("data", "ids", "gone"):
            for folder in self.log.folders(kind, older_than):
                if folder not in named:
                    self.log.delete(f"{kind}/{folder}")
