"""Payslip texts to model fields, one scan for all formats.

Parsing goes in stages: the format, what is read from the text, numbers,
totals, amounts, the error code. A stage is one struct, chosen by a single CASE over the row's
format, so a row is matched against its own format's patterns alone, and later
stages refer to fields instead of repeating expressions. Stages are built from
what is asked: a field that nobody wants is neither computed nor are the
patterns matched that it alone needs.

Formats given as Python classes run over Arrow batches, for their own rows
alone; the other rows send nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payspark.functions.text import not_blank, period
from payspark.functions.validate import first_code, total_checks
from payspark.operators.dispatch import DEFAULT, Registry
from payspark.operators.formats.base import CAPTURES, FLAGS, LABELS, TOTALS, PayslipFormat
from payspark.operators.formats.python import read_by_python
from payspark.schema import EXTRA, MESSAGES, NO_TEXT, ORDINARY, PAYSLIP, PAYSLIP_AMOUNTS, UNKNOWN_FORMAT

#: Columns that parsing adds to the model's.
STATUS = ("status", "error_code", "error_message")
# Fixed value: what the note of a parsed document begins with.
NOTE = "Procesado desde "
#: Amounts that every check of totals looks at.
CHECKED = ("total_devengado", "total_deducir", "liquido_percibir")


def _by_format(registry: Registry, key: Column, value: Callable[[PayslipFormat], Column]) -> Column:
    """The format's own value, null for a row without a format."""
    first, *others = registry.formats.values()
    out = F.when(key == first.key, value(first))
    for f in others:
        out = out.when(key == f.key, value(f))
    return out


def _guarded(value: Column) -> Column:
    """``value`` as a stage that is computed once for each row.

    The condition holds always, but the optimizer can't tell, so it doesn't
    write the stage into each later expression that refers to it. The
    predicate over an array keeps the stage out of whole-stage code, where a
    CASE over all formats would be one method too large to be compiled; a
    projection's code is split. As it is deterministic, filters on the given
    columns pass all stages down to the scan.
    """
    return F.when(F.exists(F.array(F.octet_length(F.coalesce("text", F.lit("")))), lambda n: n >= 0), value)


def _refers(columns: Iterable[Column], *path: str) -> set[str]:
    """Fields of a stage, or of a struct in it, that columns refer to, by how columns are written."""
    stage, *inner = path
    body = re.escape(stage) + "".join(rf"\['?{p}'?\]" for p in (*inner, r"(\w+)"))
    return {name for c in columns for name in re.findall(body, str(c))}


def _blank(names: tuple[str, ...], kind: str, value: object = None) -> dict[str, Column]:
    """What a stage's fields are for formats that lack them, made once for all formats."""
    same = F.lit(value).cast(kind)
    return {n: same.alias(n) for n in names}


def _struct(blank: dict[str, Column], values: dict[str, Column], kind: str) -> Column:
    return F.struct(*(values[n].cast(kind).alias(n) if n in values else own for n, own in blank.items()))


class _Needed:
    """Of one format the expressions that the wanted fields and the checks need."""

    def __init__(self, own: PayslipFormat, amounts: set[str], labels: set[str], flags: set[str], text: Column, clean: Column, name: Column, mark: str):
        field = lambda stage: lambda n: F.col(f"{mark}{stage}")[n]
        self.raw, self.number, self.total = (lambda n: F.col(f"{mark}read")["raw"][n]), field("number"), field("total")
        flag = lambda n: F.col(f"{mark}read")["flag"][n]
        self.errors = own.errors(self.raw, self.number, flag)
        conditions = [c for c, _ in self.errors]
        self.details = {n: c for n, c in own.details(self.number, self.total).items() if n in amounts}
        wanted = _refers(self.details.values(), f"{mark}total")
        self.totals = {n: c for n, c in own.totals(self.raw, self.number).items() if n in wanted}
        readers = [*conditions, *self.details.values(), *self.totals.values()]
        numbers = _refers(readers, f"{mark}number") | {"year", "month"}
        texts = _refers(readers, f"{mark}read", "raw") | numbers | labels
        self.captures = {n: c for n, c in own.captures(clean, name).items() if n in texts}
        self.numbers = {n: own.convert(self.raw(n)) for n in numbers if n in self.captures and n not in ("year", "month")}
        seen = _refers(conditions, f"{mark}read", "flag") | flags
        self.flags = {n: c for n, c in own.flags(text).items() if n in seen}


@lru_cache(maxsize=16)
def _stages(registry: Registry, only: str | None, mark: str, fields: tuple[str, ...], application: str) -> list[tuple[str, Column]]:
    """The stages in order, each a struct that refers to ``text``, ``filename``, ``format`` and the stages before it.

    Building some thousand expressions takes seconds, so an application does
    it once, not for each batch of a stream.
    """
    own = F.col("format")
    field = lambda stage: lambda name: F.col(f"{mark}{stage}")[name]
    inside = lambda part: lambda name: F.col(f"{mark}read")[part][name]
    text, name = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("filename"), F.lit(""))
    raw, flag, number, total, amount = inside("raw"), inside("flag"), field("number"), field("total"), field("amount")
    searched, written = field("said")("searched"), field("key")("written")
    key = F.lit(only) if only else registry.only(searched)
    stages = [
        ("said", F.struct((F.lit("") if only else registry.searched(text, name)).alias("searched"), not_blank(text).alias("written"))),
        ("key", F.struct(F.when(field("said")("written"), key).alias("format"), field("said")("written").alias("written"))),
    ]

    amounts = {c for c in PAYSLIP_AMOUNTS if c in fields or c in CHECKED}
    labels = {n for n, c in (("category", "categoria"), ("group", "grupo_cotizacion")) if c in fields}
    flags = {"is_extra"} if {"id", "tipo"} & set(fields) else set()
    clean = F.coalesce(F.col(f"{mark}clean")["text"], text)
    needed = {f.key: _Needed(f, amounts, labels, flags, text, clean, name, mark) for f in registry.formats.values()}
    names = lambda part, order: tuple(n for n in order if any(n in getattr(x, part) for x in needed.values()))
    each = lambda part, blank, kind: _by_format(registry, own, lambda f: _struct(blank, getattr(needed[f.key], part), kind))

    # Null where a format takes the text as it is, so that no row carries it twice.
    stages.append(("clean", F.struct(_by_format(registry, own, lambda f: f.clean(text) if f.clean else F.lit(None).cast("string")).alias("text"))))
    dates = ("year", "month")
    no_raw = _blank(names("captures", (*CAPTURES, *LABELS)), "string")
    no_flag = _blank(names("flags", FLAGS) or FLAGS[:1], "boolean", False)
    no_number = _blank(tuple(c for c in names("numbers", CAPTURES) if c not in dates), "double")
    when_read = [raw(c).try_cast("int").alias(c) for c in dates]

    def read(f: PayslipFormat) -> Column:
        return F.struct(_struct(no_raw, needed[f.key].captures, "string").alias("raw"), _struct(no_flag, needed[f.key].flags, "boolean").alias("flag"))

    def numbers(f: PayslipFormat) -> Column:
        return F.struct(*when_read, *(needed[f.key].numbers[c].alias(c) if c in needed[f.key].numbers else none for c, none in no_number.items()))

    def adjusted(f: PayslipFormat) -> Column:
        plain = field("value")
        return F.struct(*(f.adjust(plain(c)).alias(c) if f.adjust and c in needed[f.key].numbers else plain(c).alias(c) for c in (*dates, *no_number)))

    stages += [
        ("read", _by_format(registry, own, read)),
        ("value", _by_format(registry, own, numbers)),
        ("number", _by_format(registry, own, adjusted)),
        ("total", each("totals", _blank(names("totals", TOTALS) or TOTALS[:1], "double", 0.0), "double")),
        ("amount", each("details", _blank(tuple(n for n in PAYSLIP_AMOUNTS if n in amounts), "double", 0.0), "double")),
    ]

    checks = total_checks(number("year"), number("month"), *(amount(c) for c in CHECKED))
    known = own.isin(*registry.formats)
    code = F.when(own.isNull(), F.lit(UNKNOWN_FORMAT)).when(known, _by_format(registry, own, lambda f: first_code([*needed[f.key].errors, *checks])))
    stages.append(("judged", F.struct(F.when(~written, NO_TEXT).otherwise(code).alias("code"))))

    error, when, extra = field("judged")("code"), period(number("year"), number("month")), flag("is_extra")
    constant = lambda value: _by_format(registry, own, lambda f: F.lit(value(f)))
    values = {
        "id": lambda: F.concat(when, F.lit("-"), constant(lambda f: f.suffix or f.key.upper()), F.when(extra, "-EXTRA").otherwise("")),
        "anio": lambda: number("year"), "mes": lambda: number("month"), "periodo": lambda: when,
        "empresa": lambda: constant(lambda f: f.company), "cif": lambda: constant(lambda f: f.cif), "tipo": lambda: F.when(extra, EXTRA).otherwise(ORDINARY), "es_procesable": lambda: F.lit(True),
        "observaciones": lambda: F.concat(F.lit(NOTE), name), "categoria": lambda: raw("category"), "grupo_cotizacion": lambda: raw("group"),
    } | {c: (lambda c=c: amount(c)) for c in PAYSLIP_AMOUNTS}
    messages = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    # An absent group or flag that no format has is null.
    held = {"categoria": "category" in no_raw, "grupo_cotizacion": "group" in no_raw}
    wanted = [f for f in PAYSLIP if f.name in fields]
    fine = error.isNull()
    if registry.classes:
        theirs, python = F.col(f"{mark}python"), own.isin(*registry.classes)
        stages.append(("python", read_by_python(registry.classes, F.when(python, own), text, name, {*fields, *CHECKED, "anio", "mes"})))
        their_checks = total_checks(theirs["row"]["anio"], theirs["row"]["mes"], *(theirs["row"][c] for c in CHECKED))
        error = F.when(python, F.coalesce(theirs["error_code"], first_code(their_checks))).otherwise(field("judged")("code"))
        fine = error.isNull()
    mine = lambda f: values[f.name]() if held.get(f.name, True) else F.lit(None)
    value = lambda f: F.when(own.isin(*registry.classes), F.col(f"{mark}python")["row"][f.name]).otherwise(mine(f).cast(f.dataType)) if registry.classes else mine(f)
    model = [F.when(fine, value(f)).cast(f.dataType).alias(f.name) for f in wanted]
    said = F.try_element_at(messages, error)
    if registry.classes:
        said = F.coalesce(F.when(own.isin(*registry.classes), F.col(f"{mark}python")["error_message"]), said)
    state = [F.when(fine, "OK").otherwise("ERROR").alias("status"), error.alias("error_code"), said.alias("error_message")]
    stages.append(("row", F.struct(*model, *state)))
    return [(stage, (value if stage == "python" else _guarded(value)).alias(f"{mark}{stage}")) for stage, value in stages]


def _mark(documents: DataFrame) -> str:
    """What stage columns begin with, so that no given column does."""
    return "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in documents.columns))


def parse_documents(documents: DataFrame, registry: Registry = DEFAULT, only: str | None = None, fields: Iterable[str] | None = None) -> DataFrame:
    """One row for each document (filename, text, and other columns that are kept).

    Adds the payslip's fields, null if it was rejected, ``format``, and
    ``status`` (OK or ERROR) with ``error_code`` and ``error_message``. With
    ``only`` every document is read as that format, without dispatch; with
    ``fields`` only these of the payslip's fields are added and computed.
    """
    wanted = tuple(f.name for f in PAYSLIP if fields is None or f.name in set(fields))
    unknown = sorted(set(fields or ()) - set(wanted))
    if unknown:
        raise ValueError(f"a payslip has no {unknown}")
    given, mark = [F.col(c) for c in documents.columns], _mark(documents)
    (_, said), (_, key), *stages = _stages(registry, only, mark, wanted, documents.sparkSession.sparkContext.applicationId)
    staged = documents.select(*given, said).select(*given, key).select("*", F.col(f"{mark}key")["format"].alias("format"))
    for _, stage in stages:
        staged = staged.select("*", stage)
    # Out of a generator, whose columns no rule traces back through all stages (as that for join keys would).
    return staged.select(*given, "format", F.inline(F.array(f"{mark}row")))


def formats_of(documents: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """Documents with their ``format`` alone: null without text, or where none or several companies are named. No pattern of a format is matched."""
    text, name, mark = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("filename"), F.lit("")), _mark(documents)
    said = documents.withColumn(f"{mark}said", _guarded(F.struct(registry.searched(text, name).alias("searched"), not_blank(text).alias("written"))))
    own = F.col(f"{mark}said")
    return said.withColumn("format", F.when(own["written"], registry.only(own["searched"]))).drop(f"{mark}said")


def statuses_of(documents: DataFrame, registry: Registry = DEFAULT, only: str | None = None) -> DataFrame:
    """Documents with ``format``, ``status``, ``error_code`` and ``error_message``: what the checks need is computed, no other field."""
    return parse_documents(documents, registry, only, fields=())


def strict(parsed: DataFrame) -> DataFrame:
    """The same rows, failing at the first rejected one instead of carrying its code."""
    guarded = F.when(F.col("status") == "OK", F.col("id")).otherwise(F.raise_error(F.concat_ws(": ", "filename", "error_message")).cast("string"))
    return parsed.withColumn("id", guarded)
