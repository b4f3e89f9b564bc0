"""Formats given as Python: any object with ``parse(text, filename)``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, is_dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payspark.schema import CUSTOM_ERROR, DEFAULTS, NOT_IMPLEMENTED, PAYSLIP


class Parser(Protocol):
    def parse(self, text: str, filename: str) -> Any:
        """The payslip's fields, as a dict or a dataclass; raises where it can't be read."""


@dataclass(frozen=True)
class PythonFormat:
    """A company's key and what makes its parser; each Python worker makes one for a batch.

    What the parser leaves out has its default. A ``ValueError`` with a known
    code as its first argument rejects the document with that code, any other
    exception with a general one and its words.
    """

    key: str
    make: Callable[[], Parser]


_CASTS = {T.StringType(): str, T.IntegerType(): int, T.DoubleType(): float, T.BooleanType(): bool}
_KINDS = {f.name: _CASTS[f.dataType] for f in PAYSLIP}
_REQUIRED = _KINDS.keys() - DEFAULTS.keys()


def _fields(said: Any) -> dict[str, Any]:
    """A parser's result as the payslip's fields; raises for fields that it lacks or that no payslip has."""
    values = asdict(said) if is_dataclass(said) else dict(said)
    if not _REQUIRED <= values.keys() <= _KINDS.keys():
        raise TypeError(f"missing fields: {sorted(_REQUIRED - values.keys())}, unknown fields: {sorted(values.keys() - _KINDS.keys())}")
    given = {n: v if v is None or type(v) is _KINDS[n] else _KINDS[n](getattr(v, "value", v)) for n, v in values.items()}
    return DEFAULTS | given


def _outcome(parser: Parser, text: str, filename: str, codes: dict[str, str]) -> tuple[dict[str, Any] | None, str | None, str | None]:
    try:
        return _fields(parser.parse(text, filename)), None, None
    except NotImplementedError:
        return None, NOT_IMPLEMENTED, codes[NOT_IMPLEMENTED]
    except Exception as error:  # noqa: BLE001 - one document must not end the batch
        code = str(error.args[0]) if isinstance(error, ValueError) and error.args else ""
        return (None, code, codes[code]) if code in codes else (None, CUSTOM_ERROR, f"{type(error).__name__}: {error}")


def read_by_python(classes: dict[str, PythonFormat], key: Column, text: Column, filename: Column, fields: Iterable[str] = PAYSLIP.names) -> Column:
    """A struct of ``row``, ``error_code`` and ``error_message`` for rows whose ``key`` is one of ``classes``; all null for others, which send no text.

    All that a parser gives is checked, but only ``fields`` come back. They
    are made column by column, with no object for a row.
    """
    from payspark.schema import MESSAGES

    made = {k: f.make for k, f in classes.items()}
    codes = dict(MESSAGES)
    wanted = T.StructType([f for f in PAYSLIP if f.name in set(fields)])
    none = dict.fromkeys(wanted.names)
    said = T.StructType([T.StructField("row", wanted), T.StructField("error_code", T.StringType()), T.StructField("error_message", T.StringType())])
    kinds = {T.StringType(): "string", T.IntegerType(): "int32", T.DoubleType(): "float64", T.BooleanType(): "bool"}
    columns = [(f.name, kinds[f.dataType]) for f in wanted]

    @F.arrow_udf(said)
    def read(keys: pa.Array, texts: pa.Array, names: pa.Array) -> pa.Array:
        own = keys.to_pylist()
        parsers = {k: made[k]() for k in set(own) - {None}}
        found = [(none, None, None) if k is None else _outcome(parsers[k], t, n, codes) for k, t, n in zip(own, texts.to_pylist(), names.to_pylist())]
        rows = [r or none for r, _, _ in found]
        row = pa.StructArray.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in columns], [c for c, _ in columns])
        error, message = (pa.array([f[k] for f in found], "string") for k in (1, 2))
        return pa.StructArray.from_arrays([row, error, message], ["row", "error_code", "error_message"])

    mine = key.isNotNull()
    return read(key, F.when(mine, text), F.when(mine, filename))
