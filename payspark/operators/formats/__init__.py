"""The payslip formats that come with the package."""

from payspark.operators.formats import alten, altran, coritel, exceltic, ineco, insis

FORMATS = tuple(m.FORMAT for m in (alten, altran, coritel, exceltic, ineco, insis))
