"""Which format a document has: exactly one company name in its text or file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payspark.functions.text import folded
from payspark.operators.formats import FORMATS
from payspark.operators.formats.base import PayslipFormat
from payspark.operators.formats.python import PythonFormat

# Fixed value: a phrase that stands for a name.
ALIASES = {"inteligencia sistematica": "insis"}


class Registry:
    """Formats by their key, as columns or as Python classes; a copy can be extended with further ones."""

    def __init__(self, formats: tuple[PayslipFormat | PythonFormat, ...] = FORMATS):
        self.formats = {f.key: f for f in formats if isinstance(f, PayslipFormat)}
        self.classes = {f.key: f for f in formats if isinstance(f, PythonFormat)}

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.formats, *self.classes)

    def register(self, added: PayslipFormat | PythonFormat) -> Registry:
        kept = (f for f in (*self.formats.values(), *self.classes.values()) if f.key != added.key)
        return Registry((*kept, added))

    @staticmethod
    def searched(text: Column, filename: Column) -> Column:
        """What keys are looked for in: text and file name, in any case, each folded by itself, so that they are joined once."""
        return F.concat(folded(F.coalesce(text, F.lit(""))), F.lit(" "), folded(F.coalesce(filename, F.lit(""))))

    def only(self, value: Column) -> Column:
        """The only key that occurs, also inside words, in a ``searched`` value, null if there is none or more than one.

        Each key is looked for once: all that occur are written as one text,
        which is a key where there is one alone.
        """
        hits = {}
        for key in self.keys:
            hits[key] = F.contains(value, F.lit(key))
            for phrase, stands_for in ALIASES.items():
                hits[key] = hits[key] | F.contains(value, F.lit(phrase)) if stands_for == key else hits[key]
        names = F.create_map(*(F.lit(key) for key in hits for _ in range(2)))
        return F.try_element_at(names, F.concat_ws("\n", *(F.when(hit, F.lit(key)) for key, hit in hits.items())))

    def key(self, text: Column, filename: Column) -> Column:
        """The only key that occurs in text or file name."""
        return self.only(self.searched(text, filename))


DEFAULT = Registry()
