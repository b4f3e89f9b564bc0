"""Named queries over the driver's tables and their DuckDB equivalents.

The tables hold no payslips, so texts are made of orders and parsed back; the
SQL computes the same values from the orders themselves.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payspark.functions.validate import balanced, matches_net
from payspark.operators import analytics
from payspark.operators.dispatch import DEFAULT
from payspark.operators.formats import alten, altran, exceltic, ineco, insis
from payspark.operators.ingest import ingest_batch, ingest_company, outcomes, report, summary_of
from payspark.operators.formats.python import PythonFormat
from payspark.operators.parse import formats_of, parse_documents
from payspark.plans.synth import FALLBACKS, REJECTED, fallbacks, named, payslips, rejected
from payspark.schema import CERTIFICATE, EXTRA, ORDINARY, PAYSLIP_AMOUNTS
from payspark.sources.checkpoints import new_folder
from payspark.sources.documents import spread
from payspark.sources.files import opened, read_files
from payspark.sources.store import DocumentStore, as_payslips, decoded, first_rows, merged, to_stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(own: Query) -> Query:
        key = name or own.__name__
        QUERIES[key] = own
        if sql:
            ORACLE_SQL[key] = sql
        return own

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(value: Column) -> Column:
    """Cents as whole numbers."""
    return F.round(value * 100).cast("long")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, gross in cents, day) of all orders."""
    return own_columns(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")))


def own_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("o_orderkey").alias("key"), money(F.col("o_totalprice")).alias("gross"), F.col("o_orderdate").alias("day"))


# The same for DuckDB: whole cents, and the shares that payslips show.
CENTS = "SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS gross, o_orderdate AS day, o_orderstatus, o_custkey FROM orders"
SLIPS = (
    f"SELECT key, gross, CAST(floor(gross * 17 / 100.0) AS BIGINT) AS less, CAST(floor(gross * 11 / 100.0) AS BIGINT) AS tax, CAST(floor(gross * 60 / 100.0) AS BIGINT) AS base,"
    f" CAST(floor(gross * 20 / 100.0) AS BIGINT) AS plus, strftime(day, '%Y-%m') AS periodo, o_orderstatus, o_custkey FROM ({CENTS})"
)


def parsed(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Parsed payslips of all orders in one format, amounts in cents."""
    slips = payslips(orders(spark, sf_dir), key).select("key", "filename", "text")
    found = parse_documents(slips)
    return found.select("key", "id", "periodo", "empresa", "cif", "tipo", *(money(F.col(c)).alias(c) for c in PAYSLIP_AMOUNTS), "status", "error_code")


def parsed_sql(format_of, **amounts: str) -> str:
    own = format_of.FORMAT
    values = ", ".join(f"CAST({amounts.get(c, '0')} AS BIGINT) AS {c}" for c in PAYSLIP_AMOUNTS)
    return (
        f"SELECT key, periodo || '-{own.key.upper()}' AS id, periodo, '{own.company}' AS empresa, '{own.cif}' AS cif, 'NOMINA_ORDINARIA' AS tipo, {values},"
        f" 'OK' AS status, CAST(NULL AS VARCHAR) AS error_code FROM ({SLIPS})"
    )


TOTALS = {"total_devengado": "gross", "total_deducir": "less", "liquido_percibir": "gross - less", "base_irpf": "gross"}
PARTS = {"salario_base": "base", "plus_convenio": "plus"}
TAXES = {"descuento_seguridad_social": "less - tax", "irpf_porcentaje": "1100", "irpf_importe": "tax"}
REST = {"complementos": "gross - base - plus"}
for _format, _amounts in (
    (alten, TOTALS),
    (altran, TOTALS | PARTS | REST),
    (exceltic, TOTALS | PARTS | REST),
    (ineco, TOTALS | PARTS | TAXES | {"base_ss_comunes": "gross"}),
    (insis, TOTALS | PARTS | TAXES),
):
    query(parsed_sql(_format, **_amounts), f"parse_{_format.FORMAT.key}")(partial(parsed, key=_format.FORMAT.key))


def by_turn(values: list[str], count: int) -> str:
    """SQL: the value of a key's turn."""
    return "CASE key % {} {} END".format(count, " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)))


#: What each of FALLBACKS reads, in cents; what is missing here is 0.
_INECO = {"descuento_seguridad_social": "less - tax", "irpf_importe": "tax", "irpf_porcentaje": "1100"}
FALLEN_BACK: tuple[dict[str, str], ...] = (
    TOTALS,
    {"total_devengado": "gross - less", "liquido_percibir": "gross - less", "base_irpf": "gross - less"},
    TOTALS | {"complementos": "gross"},
    {"total_devengado": "gross - less", "liquido_percibir": "gross - less", "base_irpf": "gross - less", "salario_base": "base", "complementos": "gross - less - base"},
    TOTALS | {"complementos": "gross"},
    TOTALS | _INECO,
    TOTALS | _INECO | {"prorrata_pagas_extra": "plus"},
    TOTALS | {"descuento_seguridad_social": "less", "complementos": "plus"},
    TOTALS | PARTS | REST,
    TOTALS | _INECO,
    TOTALS | {"otras_deducciones": "plus"},
    TOTALS | {"base_irpf": "base", "base_ss_comunes": "plus"},
)
_KINDS = ["-EXTRA" if name.endswith("extra_pay") else "" for name in FALLBACKS]
_SUFFIXES = [f"'-{name.split('_')[0].upper()}{extra}'" for name, extra in zip(FALLBACKS, _KINDS)]


@query(
    f"SELECT key, periodo || {by_turn(_SUFFIXES, len(FALLBACKS))} AS id, {by_turn([repr(EXTRA if k else ORDINARY) for k in _KINDS], len(FALLBACKS))} AS tipo, "
    + ", ".join(f"CAST({by_turn([own.get(c, '0') for own in FALLEN_BACK], len(FALLBACKS))} AS BIGINT) AS {c}" for c in PAYSLIP_AMOUNTS)
    + ", CASE WHEN key % 12 = 7 THEN 'Analista B' END AS categoria, CASE WHEN key % 12 = 7 THEN '05' END AS grupo_cotizacion, CAST(NULL AS VARCHAR) AS error_code"
    + f" FROM ({SLIPS})"
)
def parse_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payslips whose values come from a second label, a sum or another value, of all formats in one scan."""
    found = parse_documents(fallbacks(orders(spark, sf_dir)).select("key", "filename", "text"))
    return found.select("key", "id", "tipo", *(money(F.col(c)).alias(c) for c in PAYSLIP_AMOUNTS), "categoria", "grupo_cotizacion", "error_code")


@query(
    f"SELECT key, CASE WHEN code IS NULL THEN 'OK' ELSE 'ERROR' END AS status, code AS error_code, CASE WHEN code IS NULL THEN 'Procesado desde slip.pdf' END AS observaciones FROM"
    f" (SELECT key, {by_turn([repr(code) if code else 'NULL' for *_, code in REJECTED], len(REJECTED))} AS code FROM ({CENTS}))"
)
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that fail each check, and one that a company's phrase alone names."""
    return parse_documents(rejected(orders(spark, sf_dir).select("key")), fields=["observaciones"]).select("key", "status", "error_code", "observaciones")


@query(f"SELECT key, CAST(NULL AS VARCHAR) AS id, 'NOT_IMPLEMENTED' AS error_code FROM ({CENTS})")
def parse_coritel(spark: SparkSession, sf_dir: str) -> DataFrame:
    slips = payslips(orders(spark, sf_dir), "coritel").select("key", "filename", "text")
    return parse_documents(slips, fields=["id"]).select("key", "id", "error_code")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as stored Altran payslips, one for each order."""
    return to_stored(parse_documents(payslips(orders(spark, sf_dir), "altran").select("key", "filename", "text")).where("status = 'OK'").withColumn("id", F.concat("id", F.lit("-"), F.col("key").cast("string"))))


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the dashboard: the customer's segment is the company."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("empresa"))
    own = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return own.select(
        F.format_string("%012d", "o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("periodo"), "empresa", F.col("o_totalprice").alias("total_devengado"),
        (F.col("o_totalprice") / 2).alias("liquido_percibir"), F.pmod("o_orderkey", F.lit(40)).cast("double").alias("irpf_porcentaje"), F.col("o_orderstatus").alias("tipo"),
    )


ROWS = (
    "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, strftime(o_orderdate, '%Y-%m') AS periodo, c_mktsegment AS empresa, o_totalprice AS total_devengado, o_totalprice / 2 AS liquido_percibir,"
    " CAST(o_orderkey % 40 AS DOUBLE) AS irpf_porcentaje, o_orderstatus AS tipo FROM orders JOIN customer ON o_custkey = c_custkey"
)


@query(
    f"""WITH t AS (SELECT key % 7 AS k, text FROM (SELECT key, '' AS text FROM ({CENTS}))),
    f AS (SELECT k, CASE k WHEN 0 THEN 'alten' WHEN 1 THEN 'altran' WHEN 2 THEN 'coritel' WHEN 3 THEN 'exceltic' WHEN 4 THEN 'ineco' WHEN 5 THEN 'insis' END AS format FROM t),
    d AS (SELECT lower(text) AS v FROM documents),
    h AS (SELECT v, (CASE WHEN contains(v, 'alten') THEN 1 ELSE 0 END) + (CASE WHEN contains(v, 'altran') THEN 1 ELSE 0 END) + (CASE WHEN contains(v, 'coritel') THEN 1 ELSE 0 END)
      + (CASE WHEN contains(v, 'exceltic') THEN 1 ELSE 0 END) + (CASE WHEN contains(v, 'ineco') THEN 1 ELSE 0 END) + (CASE WHEN contains(v, 'insis') OR contains(v, 'inteligencia sistematica') THEN 1 ELSE 0 END) AS n FROM d),
    g AS (SELECT CASE WHEN n <> 1 THEN NULL WHEN contains(v, 'alten') THEN 'alten' WHEN contains(v, 'altran') THEN 'altran' WHEN contains(v, 'coritel') THEN 'coritel' WHEN contains(v, 'exceltic') THEN 'exceltic'
      WHEN contains(v, 'ineco') THEN 'ineco' ELSE 'insis' END AS format FROM h)
    SELECT format, count(*) AS n_documents FROM (SELECT format FROM f UNION ALL SELECT format FROM g) GROUP BY format"""
)
def dispatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of order texts, whose seventh part names two companies, and of all documents."""
    names = F.array(*(F.lit(n) for n in ("Alten", "ALTRAN", "coritel", "Exceltic", "Ineco", "Inteligencia Sistematica", "alten altran")))
    made = orders(spark, sf_dir).select(F.concat(F.lit("Nomina "), F.element_at(names, (F.col("key") % 7 + 1).cast("int"))).alias("text"))
    texts = made.unionByName(table(spark, sf_dir, "documents").select("text"))
    return texts.groupBy(DEFAULT.key(F.col("text"), F.lit("")).alias("format")).agg(F.count("*").alias("n_documents"))


@query(
    """WITH a AS (SELECT round(l_extendedprice * 100) / 100 AS g, round(l_quantity * 100) / 100 AS d, (round(l_extendedprice * 100) - round(l_quantity * 100) + (l_orderkey % 5) - 2) / 100 AS n FROM lineitem)
    SELECT count(*) AS n_rows, CAST(sum(CASE WHEN abs(g - d - n) <= 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS n_balanced,
      CAST(sum(CASE WHEN abs(round((g - d) * 100) / 100 - n) <= 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS n_matching FROM a"""
)
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both balance checks on line items, with gaps of up to two cents."""
    items = table(spark, sf_dir, "lineitem")
    price, less = F.round(F.col("l_extendedprice") * 100), F.round(F.col("l_quantity") * 100)
    rows = items.select((price / 100).alias("g"), (less / 100).alias("d"), ((price - less + F.col("l_orderkey") % 5 - 2) / 100).alias("n"))
    g, d, n = (F.col(c) for c in "gdn")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(balanced(g, d, n)).alias("n_balanced"), F.count_if(matches_net(g, d, n)).alias("n_matching"))


LINE_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    "SELECT id, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, l_orderkey || '-' || l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "
    + ", ".join(LINE_ORDER)
    + ") AS k FROM lineitem) WHERE k = 1"
)
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of line items with one id the first, as the store takes repeated ids of a batch."""
    items = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return first_rows(items, "id", *LINE_ORDER).select("id", "l_partkey", "l_suppkey", "l_extendedprice")


KINDS = {"F": ORDINARY, "O": EXTRA, "P": CERTIFICATE}
DOCUMENTS = (
    "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, c_mktsegment AS empresa, CASE o_orderstatus "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())
    + " END AS tipo, CAST(round(o_totalprice * 100) AS BIGINT) AS total, o_orderkey AS key, strftime(o_orderdate, '%Y-%m') AS periodo FROM orders JOIN customer ON o_custkey = c_custkey"
)


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of three kinds; the customer's segment is the company."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("tipo"))
    rows = rows_of(spark, sf_dir).withColumn("tipo", kind)
    return rows.withColumns({
        "anio": F.substring("periodo", 1, 4).cast("int"), "mes": F.substring("periodo", 6, 2).cast("int"), "cif": F.lit("A1"),
        "complementos": F.col("total_devengado") / 4, "retribuciones_integras": F.when(F.col("tipo") == CERTIFICATE, F.col("total_devengado")),
    })


def new_store(spark: SparkSession, rows: DataFrame | None = None) -> DocumentStore:
    """A store of its own in the shared folder, with the rows inserted."""
    store = DocumentStore(spark, new_folder(spark, "store"))
    store.init()
    if rows is not None:
        store.append(rows, "id", strict=False)
    return store


@query(
    f"""WITH l AS (SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS k FROM lineitem WHERE l_quantity > 45)
    SELECT id, CASE WHEN k IS NULL THEN 'new' ELSE 'conflict' END AS outcome FROM ({DOCUMENTS}) LEFT JOIN l ON id = k"""
)
def conflict_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that meet ids in a store and those that don't."""
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.format_string("%012d", "l_orderkey").alias("id")).distinct()
    own = documents_of(spark, sf_dir)
    store = new_store(spark, own.join(known, "id", "left_semi"))
    new, conflicts = store.split(own, "id")
    outcome = lambda rows, said: rows.select("id", F.lit(said).alias("outcome"))
    return outcome(new, "new").unionByName(outcome(conflicts, "conflict"))


@query(f"SELECT id, empresa, total FROM ({DOCUMENTS}) WHERE empresa = 'BUILDING'")
def filter_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's documents in a store."""
    return new_store(spark, documents_of(spark, sf_dir)).by_company("BUILDING").select("id", "empresa", money(F.col("total_devengado")).alias("total"))


@query(f"SELECT id, tipo, total AS retribuciones FROM ({DOCUMENTS}) WHERE tipo = '{CERTIFICATE}'")
def filter_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificates in a store."""
    return new_store(spark, documents_of(spark, sf_dir)).certificates().select("id", "tipo", money(F.col("retribuciones_integras")).alias("retribuciones"))


@query(f"SELECT id, total FROM ({DOCUMENTS}) WHERE key <> (SELECT min(o_orderkey) FROM orders)")
def delete_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store has after the document with the smallest id and an unknown one were deleted."""
    rows = documents_of(spark, sf_dir)
    store = new_store(spark, rows)
    for gone in (rows.agg(F.min("id")).first()[0], "no such id"):
        store.delete(gone)
    return store.all().select("id", money(F.col("total_devengado")).alias("total"))


@query(f"SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after, count(*) FILTER (WHERE empresa = 'BUILDING') AS n_again FROM ({DOCUMENTS})")
def reset_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's rows, none after a reset, and a company's, whose ids are free again then."""
    rows = documents_of(spark, sf_dir)
    store = new_store(spark, rows)
    before = store.version()
    store.reset()
    empty = store.version()
    store.append(rows.where("empresa = 'BUILDING'"))
    seen = [store.table(v).select(F.lit(n).alias("at")) for v, n in ((before, 0), (empty, 1), (store.version(), 2))]
    count = lambda n: F.count_if(F.col("at") == n)
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).agg(count(0).alias("n_before"), count(1).alias("n_after"), count(2).alias("n_again"))


@query(f"SELECT id, total FROM ({DOCUMENTS})")
def concurrent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers at a time, each with two thirds of all documents: none is lost, none comes twice."""
    rows, store = documents_of(spark, sf_dir), new_store(spark)
    turn = F.pmod(F.col("id").cast("long"), F.lit(3))
    errors: list[Exception] = []

    def write(left_out: int) -> None:
        try:
            DocumentStore(spark, store.path).append(rows.where(turn != left_out), "id", strict=False)
        except Exception as error:  # noqa: BLE001 - raised below, by the thread that waits
            errors.append(error)

    writers = [threading.Thread(target=write, args=(k,)) for k in (0, 1)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    if errors:
        raise errors[0]
    return store.table().select("id", money(F.col("total_devengado")).alias("total"))


@query(f"SELECT id, empresa, total FROM ({DOCUMENTS}) WHERE key % 5 <> 0 AND empresa <> 'MACHINERY'")
def compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of three inserts after a fifth of all documents and then a company went, between them folded into one part."""
    folder, store = new_folder(spark, "documents"), new_store(spark)
    documents_of(spark, sf_dir).write.parquet(folder)  # joined once for all that reads them
    rows, key = spark.read.parquet(folder), F.col("id").cast("long")
    for part in range(3):
        store.append(rows.where(F.pmod(key, F.lit(3)) == part))
    store.delete_all(rows.where(key % 5 == 0).select("id"))
    store.compact()
    store.delete_all(rows.where("empresa = 'MACHINERY'").select("id"))
    return store.all().select("id", "empresa", money(F.col("total_devengado")).alias("total"))


@query(
    f"SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS id FROM lineitem WHERE l_quantity > 48 AND lpad(CAST(l_orderkey AS VARCHAR), 12, '0') IN (SELECT id FROM ({DOCUMENTS}) WHERE empresa = 'BUILDING')"
)
def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the line items' orders a store has, asked of its id filters."""
    store = new_store(spark, documents_of(spark, sf_dir).where("empresa = 'BUILDING'"))
    return store.known(table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.format_string("%012d", "l_orderkey").alias("id")).distinct())


@query(
    f"""SELECT id, 'row' AS cif, CAST(total / 4 AS BIGINT) AS rest_of, key % 7 AS level, 'P' || (key % 3) AS place, CASE WHEN key % 2 = 0 THEN 'k' || (key % 5) END AS tag
    FROM ({DOCUMENTS}) WHERE total % 4 = 0"""
)
def open_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with fields that no model has, read by path and as a whole; where both have a name the column counts."""
    key = F.col("id").cast("long")
    own = documents_of(spark, sf_dir).withColumns({
        "level": key % 7, "where": F.struct(F.concat(F.lit("P"), (key % 3).cast("string")).alias("name")), "tags": F.when(key % 2 == 0, F.array(F.concat(F.lit("k"), (key % 5).cast("string"))))
    })
    store = new_store(spark)
    store.append(own, extra=("level", "where", "tags"))
    changed = store.table().withColumn("cif", F.lit("row"))
    found = merged(changed, level="$.level: long", place="$.where.name: string")
    tag = F.try_variant_get("rest", "$.tags[0]", "string")
    picked = found.select("id", "cif", money(F.col("complementos")).alias("rest_of"), "level", "place", tag.alias("tag"), money(F.col("total_devengado")).alias("total"))
    return picked.where("total % 4 = 0").drop("total")


def text_pages(content: bytes) -> list[str]:
    """Pages of a plain text file."""
    return content.decode().split("\f")


@query(
    f"SELECT CAST(o_custkey AS BIGINT) AS customer, strftime(max(day), '%Y-%m') || '-ALTRAN' AS id, CAST(sum(gross) AS BIGINT) AS gross, CAST(NULL AS VARCHAR) AS extract_error FROM ({CENTS}) WHERE o_custkey % 9 > 0 GROUP BY o_custkey"
    f" UNION ALL SELECT DISTINCT CAST(o_custkey AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), 'UnicodeDecodeError' FROM ({CENTS}) WHERE o_custkey % 9 = 0"
)
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer, written to a folder and read as a data source; a ninth of them are no texts."""
    folder = new_folder(spark, "files")
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sum(money(F.col("o_totalprice"))).alias("gross"), F.max("o_orderdate").alias("day"))
    slips = payslips(own, "altran").select("key", F.date_format("day", "yyyy_MM").alias("month"), "text")

    def write(batches):
        import pyarrow as pa

        store, place = opened(folder)
        store.create_dir(place)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                with store.open_output_stream(f"{place}/{row['month']}_c{row['key']}.pdf") as file:
                    file.write(row["text"].encode() if row["key"] % 9 else b"\xff\xfe")
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    slips.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    files = read_files(spark, folder, text_pages)
    found = parse_documents(files, only="altran", fields=["id", "total_devengado"])
    customer = F.regexp_extract("filename", r"_c(\d+)\.pdf$", 1).cast("long")
    error = F.nullif(F.substring_index("extract_error", ":", 1), F.lit(""))
    return found.select(customer.alias("customer"), "id", F.coalesce(money(F.col("total_devengado")), F.lit(0)).alias("gross"), error.alias("extract_error"))


class PlainParser:
    """Payslips of lines like ``gross: 12.34``."""

    def parse(self, text: str, filename: str) -> dict:
        said = dict(line.split(": ", 1) for line in text.splitlines() if ": " in line)
        if "period" not in said:
            raise ValueError("MISSING_PERIOD")
        year, month = map(int, said["period"].split("-"))
        gross, net = float(said["gross"]), float(said["net"])
        return {
            "id": f"{said['period']}-ACME", "anio": year, "mes": month, "periodo": said["period"], "empresa": "Acme", "cif": "A0",
            "total_devengado": gross, "total_deducir": float(said["less"]), "liquido_percibir": net, "observaciones": filename,
        }


@query(
    f"""SELECT key, CASE WHEN k < 3 THEN 'acme' ELSE 'altran' END AS format, CASE WHEN k = 0 OR k >= 3 THEN periodo || CASE WHEN k = 0 THEN '-ACME' ELSE '-ALTRAN' END END AS id,
    CAST(CASE WHEN k = 0 OR k >= 3 THEN gross ELSE 0 END AS BIGINT) AS total_devengado, CASE k WHEN 1 THEN 'UNBALANCED' WHEN 2 THEN CASE WHEN key % 2 = 0 THEN 'MISSING_PERIOD' ELSE 'PARSER_ERROR' END END AS error_code
    FROM (SELECT *, key % 5 AS k FROM ({SLIPS}))"""
)
def python_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's parser in Python beside the column formats, in one scan; its documents pass, don't balance, or can't be read."""
    own = orders(spark, sf_dir)
    gross, net = F.col("gross"), F.col("gross") - F.floor(F.col("gross") * 17 / 100)
    amount = lambda cents: F.format_string("%d.%02d", F.floor(cents / 100), F.pmod(cents, F.lit(100)))
    k = F.col("key") % 5
    lines = F.concat(
        F.lit("Acme\n"), F.when((k == 2) & (F.col("key") % 2 == 0), "").otherwise(F.concat(F.lit("period: "), F.date_format("day", "yyyy-MM"), F.lit("\n"))),
        F.lit("gross: "), F.when(k == 2, "much").otherwise(amount(gross)), F.lit("\nless: "), amount(gross - net), F.lit("\nnet: "), amount(F.when(k == 1, net - 5).otherwise(net)), F.lit("\n"),
    )
    theirs = payslips(own, "altran").where("key % 5 >= 3").select("key", "filename", "text")
    slips = own.where(k < 3).select("key", F.lit("slip.pdf").alias("filename"), lines.alias("text")).unionByName(theirs)
    found = parse_documents(slips, DEFAULT.register(PythonFormat("acme", PlainParser)), fields=["id", "total_devengado"])
    return found.select("key", "format", "id", F.coalesce(money(F.col("total_devengado")), F.lit(0)).alias("total_devengado"), "error_code")


@query(f"SELECT count(DISTINCT id) AS n_ids, count(*) AS n_documents, count(DISTINCT periodo) AS n_periods FROM ({DOCUMENTS})")
def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inserted twice, the second time without effect, read as they are kept."""
    rows = documents_of(spark, sf_dir)
    store = new_store(spark, rows)
    store.append(rows, "id", strict=False)
    return store.table().agg(F.count_distinct("id").alias("n_ids"), F.count("*").alias("n_documents"), F.count_distinct("periodo").alias("n_periods"))


@query(f"SELECT id, tipo, total, CAST(total / 4 AS BIGINT) AS rest, 1 AS es_procesable FROM ({DOCUMENTS}) WHERE total % 4 = 0")
def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows with their payloads' fields; a column counts where both have a name."""
    rows = to_stored(documents_of(spark, sf_dir).withColumn("tipo", F.lit("NOMINA_ORDINARIA")).withColumn("es_procesable", F.lit(False)))
    kind = documents_of(spark, sf_dir).select("id", F.col("tipo").alias("own"))
    changed = rows.join(kind, "id").withColumns({"tipo": F.col("own"), "es_procesable": F.lit(1)}).drop("own")
    found = decoded(changed).select("id", "tipo", money(F.col("total_devengado")).alias("total"), money(F.col("complementos")).alias("rest"), "es_procesable")
    return found.where("total % 4 = 0")


@query(f"SELECT id, tipo, total, CAST(NULL AS VARCHAR) AS categoria, 0 AS base FROM ({DOCUMENTS})")
def read_as_payslips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a store as payslips again, with what the model has beyond the table."""
    found = as_payslips(new_store(spark, documents_of(spark, sf_dir)).all().drop("categoria"))
    return found.select("id", "tipo", money(F.col("total_devengado")).alias("total"), "categoria", F.coalesce(F.col("salario_base"), F.lit(0.0)).cast("int").alias("base"))


@query(
    f"""WITH t AS (SELECT key, periodo, gross, key % 10 AS k, key % 3 = 0 AS known FROM ({SLIPS})),
    o AS (SELECT *, CASE WHEN k = 0 THEN 'ERROR' WHEN k = 1 THEN 'DESCUADRE' END AS bad FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY periodo, bad ORDER BY key) AS n FROM o)
    SELECT key, CASE WHEN bad IS NOT NULL THEN bad WHEN n = 1 THEN 'LOADED' ELSE 'ERROR' END AS outcome,
      CASE WHEN k = 0 THEN 'MISSING_TOTALS' WHEN k = 1 THEN 'DESCUADRE' WHEN n = 1 THEN NULL ELSE 'DUPLICATE_ID' END AS error_code FROM r"""
)
def company_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's own ingest: the second check finds what differs by two cents and a rounding error; an existing id is an error."""
    slips = payslips(orders(spark, sf_dir), "altran").select("key", "filename", "text")
    edge = "Altran\nTotales 129,00 126,24\nLíquido a percibir 2,78\n"
    broken = slips.withColumn("text", F.when(F.col("key") % 10 == 0, "Altran").when(F.col("key") % 10 == 1, edge).otherwise(F.col("text")))
    return ingest_company(broken, new_store(spark), "altran", "key").outcome.select("key", "outcome", "error_code")


def first_slip(rows: DataFrame) -> DataFrame:
    """(filename, text) of the first month's first file, as names begin with the month; no other row's text is made."""
    least = payslips(rows, "alten").agg(F.min(F.struct("filename", *rows.columns)).alias("m"))
    return payslips(least.select(*(F.col("m")[c].alias(c) for c in rows.columns)), "alten").select("filename", "text")


@query(
    f"""WITH t AS (SELECT key, periodo, key % 10 AS k FROM ({SLIPS})), f AS (SELECT *, row_number() OVER (PARTITION BY periodo ORDER BY key) AS n FROM t WHERE k > 0),
    first AS (SELECT min(periodo) AS p FROM t WHERE k > 0)
    SELECT count(*) AS n_files, CAST(count(*) FILTER (WHERE line LIKE '[OK]%') AS BIGINT) AS n_ok, CAST(count(*) FILTER (WHERE line LIKE '[EXISTS]%') AS BIGINT) AS n_exists,
      CAST(count(*) FILTER (WHERE line LIKE '[ERROR]%') AS BIGINT) AS n_error FROM (
      SELECT CASE WHEN k = 0 THEN '[ERROR]' WHEN n = 1 AND periodo <> (SELECT p FROM first) THEN '[OK]' ELSE '[EXISTS]' END AS line FROM
        (SELECT key, k, periodo, n FROM f UNION ALL SELECT key, k, periodo, 0 FROM t WHERE k = 0))"""
)
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines of a batch into a store that has the first month."""
    slips, store = payslips(orders(spark, sf_dir), "alten").select("key", "filename", "text"), new_store(spark)
    ingest_batch(first_slip(own_columns(table(spark, sf_dir, "orders")).where(F.col("key") % 10 > 0)), store)
    broken = slips.withColumn("text", F.when(F.col("key") % 10 == 0, "").otherwise(F.col("text")))
    lines = report(ingest_batch(broken, store, "key").outcome)
    count = lambda mark: F.count_if(F.startswith("line", F.lit(f"[{mark}]")))
    return lines.agg(F.count("*").alias("n_files"), count("OK").alias("n_ok"), count("EXISTS").alias("n_exists"), count("ERROR").alias("n_error"))


@query(
    "SELECT periodo || '-ALTRAN-' || key AS id, CAST(gross - base - plus AS BIGINT) AS complementos, CAST(gross AS BIGINT) AS total_devengado, 'NOMINA_ORDINARIA' AS tipo, 1 AS es_procesable,"
    f" CAST(NULL AS VARCHAR) AS categoria FROM ({SLIPS})"
)
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed payslips as stored rows, read with their payloads."""
    return decoded(stored(spark, sf_dir), fields=("complementos", "categoria")).select("id", money(F.col("complementos")).alias("complementos"), money(F.col("total_devengado")).alias("total_devengado"), "tipo", "es_procesable", "categoria")


@query(
    f"""WITH r AS ({ROWS}), v AS (SELECT * FROM r WHERE total_devengado > 0)
    SELECT total_devengado AS latest_gross, liquido_percibir AS latest_net, irpf_porcentaje AS latest_irpf FROM v ORDER BY periodo DESC, id DESC LIMIT 1"""
)
def kpi_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.kpis(rows_of(spark, sf_dir)).select("latest_gross", "latest_net", "latest_irpf")


@query(
    f"""WITH r AS ({ROWS}), v AS (SELECT * FROM r WHERE total_devengado > 0)
    SELECT round(((SELECT total_devengado FROM v ORDER BY periodo DESC, id DESC LIMIT 1) / (SELECT total_devengado FROM v ORDER BY periodo, id LIMIT 1) - 1) * 100, 1) AS growth_percent"""
)
def kpi_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.kpis(rows_of(spark, sf_dir)).select("growth_percent")


@query(f"SELECT count(DISTINCT empresa) AS companies FROM ({ROWS}) WHERE total_devengado > 0")
def company_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.kpis(rows_of(spark, sf_dir)).select("companies")


@query("SELECT count(*) AS n_documents FROM orders")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_store(spark, documents_of(spark, sf_dir)).all().agg(F.count("*").alias("n_documents"))


@query(
    f"""WITH v AS (SELECT * FROM ({ROWS}) WHERE total_devengado > 0)
    SELECT periodo, id, 'gross' AS series, total_devengado AS amount FROM v UNION ALL SELECT periodo, id, 'net', liquido_percibir FROM v"""
)
def line_series_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pay_series_long(rows_of(spark, sf_dir))


#: Pays with a long tail, so that some are far from the others.
TAILED = f"SELECT * REPLACE (floor(total_devengado * total_devengado * total_devengado * total_devengado / 1e13) / 100 AS total_devengado) FROM ({ROWS})"
FENCES = (
    "q AS (SELECT empresa, quantile_cont(total_devengado, 0.25) AS q1, quantile_cont(total_devengado, 0.5) AS median, quantile_cont(total_devengado, 0.75) AS q3,"
    " min(total_devengado) AS lowest, max(total_devengado) AS highest, count(*) AS documents FROM v GROUP BY empresa)"
)


def tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay = F.col("total_devengado")
    return rows_of(spark, sf_dir).withColumn("total_devengado", F.floor(pay * pay * pay * pay / F.lit(1e13)) / 100)


@query(
    f"""WITH v AS (SELECT * FROM ({TAILED}) WHERE total_devengado > 0), {FENCES}
    SELECT id, empresa, periodo, total_devengado FROM v JOIN q USING (empresa) WHERE total_devengado < q1 - 1.5 * (q3 - q1) OR total_devengado > q3 + 1.5 * (q3 - q1)"""
)
def pay_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.outliers(tailed(spark, sf_dir))


@query(
    f"""WITH v AS (SELECT * FROM ({TAILED}) WHERE total_devengado > 0), {FENCES}
    SELECT empresa, lowest, q1, median, q3, highest, documents, min(total_devengado) FILTER (WHERE inside) AS low_whisker, max(total_devengado) FILTER (WHERE inside) AS high_whisker,
      count(*) FILTER (WHERE NOT inside) AS outliers FROM (SELECT *, total_devengado BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v JOIN q USING (empresa))
    GROUP BY empresa, lowest, q1, median, q3, highest, documents"""
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pay_ranges(tailed(spark, sf_dir))


@query(
    f"""WITH r AS ({ROWS}), v AS (SELECT * FROM r WHERE total_devengado > 0), l AS (SELECT * FROM v ORDER BY periodo DESC, id DESC LIMIT 1), f AS (SELECT * FROM v ORDER BY periodo, id LIMIT 1)
    SELECT format('{{:,.2f}} €', l.total_devengado) AS gross, format('{{:,.2f}} €', l.liquido_percibir) AS net, format('{{:,.1f}} %', l.irpf_porcentaje) AS tax_rate,
      format('{{:,.1f}} %', round((l.total_devengado / f.total_devengado - 1) * 100, 1)) AS growth, CAST((SELECT count(DISTINCT empresa) FROM v) AS VARCHAR) AS companies FROM l, f"""
)
def kpi_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest values as they are shown."""
    return analytics.kpi_texts(rows_of(spark, sf_dir))


@query(f"SELECT id, CAST(round(total_devengado * 100) AS BIGINT) - CAST(round(liquido_percibir * 100) AS BIGINT) AS deductions FROM (SELECT id, total_devengado, floor(total_devengado * 50) / 100 AS liquido_percibir FROM ({ROWS}))")
def derived_deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross less net pay, which isn't stored."""
    rows = rows_of(spark, sf_dir).withColumn("liquido_percibir", F.floor(F.col("total_devengado") * 50) / 100)
    return analytics.with_deductions(rows).select("id", money(F.col("total_deducciones")).alias("deductions"))


@query(f"SELECT periodo, id, total_devengado, liquido_percibir FROM ({ROWS}) WHERE total_devengado > 0")
def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pay_series(rows_of(spark, sf_dir))


@query(f"SELECT periodo, empresa, id, irpf_porcentaje FROM ({ROWS}) WHERE total_devengado > 0")
def irpf_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.tax_series(rows_of(spark, sf_dir))


@query(
    """WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS periodo, o_orderkey AS key, o_orderkey % 10 AS k FROM orders),
    fine AS (SELECT periodo, row_number() OVER (PARTITION BY periodo ORDER BY key) AS n FROM t WHERE k > 1)
    SELECT (SELECT count(*) FROM t) AS total, (SELECT count(*) FROM fine WHERE n = 1 AND periodo NOT LIKE '%-01') AS loaded, (SELECT count(*) FROM t WHERE k <= 1) AS failed,
      CAST(0 AS BIGINT) AS mismatched, (SELECT count(*) FROM fine WHERE n > 1 OR periodo LIKE '%-01') AS existing"""
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all orders' payslips: the first of each month is loaded, later ones exist, a fifth can't be read. The store has all Januaries."""
    slips = payslips(orders(spark, sf_dir), "alten").select("key", "filename", "text")
    broken = slips.withColumn("text", F.when(F.col("key") % 10 == 0, "").when(F.col("key") % 10 == 1, "alten altran").otherwise(F.col("text")))
    known = orders(spark, sf_dir).where(F.month("day") == 1).select(F.date_format("day", "yyyy-MM'-ALTEN'").alias("id"))
    return summary_of(outcomes(broken, known, "key"))


@query(
    """WITH a AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1)
    SELECT part, side, count(*) AS n_rows FROM (
      SELECT b.part, 'added' AS side, unnest(range(b.n - coalesce(a.n, 0))) AS r FROM b LEFT JOIN a USING (part) WHERE b.n > coalesce(a.n, 0)
      UNION ALL SELECT a.part, 'removed', unnest(range(a.n - coalesce(b.n, 0))) FROM a LEFT JOIN b USING (part) WHERE a.n > coalesce(b.n, 0)) GROUP BY part, side"""
)
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the first and the last lines of orders, as multisets."""
    items = table(spark, sf_dir, "lineitem")
    first, last = (items.where(w).select(F.col("l_partkey").alias("part")) for w in ("l_linenumber <= 3", "l_linenumber >= 3"))
    return analytics.multiset_difference(first, last).groupBy("part", "side").agg(F.count("*").alias("n_rows"))


@query(f"SELECT periodo, count(*) AS n_documents, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(gross - less) AS BIGINT) AS net FROM ({SLIPS}) GROUP BY periodo")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as payslips of five formats, parsed in one scan, checked and summed up by month."""
    slips = named(orders(spark, sf_dir), ("alten", "altran", "exceltic", "ineco", "insis")).select("key", "filename", "text")
    fine = parse_documents(slips, fields=["periodo", "total_devengado", "liquido_percibir"]).where("status = 'OK'")
    return fine.groupBy("periodo").agg(F.count("*").alias("n_documents"), F.sum(money(F.col("total_devengado"))).alias("gross"), F.sum(money(F.col("liquido_percibir"))).alias("net"))
