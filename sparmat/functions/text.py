"""String expressions for identifiers written in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A chromosome's number or letter, however the label around it is written.
CHROM_LABEL = r"(?iU)^\s*(?:[a-z][a-z0-9]*[\s_.:\-]+)?(?:chr(?:om(?:osome)?)?)?[\s_.:\-]*0*([0-9]+|[a-z])\s*$"
BARCODE_RUN = r"(?<![ACGT])([ACGT]{16})(?![ACGT])"


def chrom_label(c: Column) -> Column:
    """Number or letter of a chromosome name in upper case ('7', 'X'); null when there is none (chrUn, '*', '')."""
    label = F.upper(F.regexp_extract(c, CHROM_LABEL, 1))
    return F.when(label != "", label)


def barcode_code(c: Column) -> Column:
    """The field's run of exactly 16 letters A, C, G, T (any case) as a number of 32 bits; null when there is none."""
    run = F.regexp_extract(F.upper(c), BARCODE_RUN, 1)
    return F.when(run != "", F.conv(F.translate(run, "ACGT", "0123"), 4, 10).cast("bigint"))


def barcode_text(code: Column) -> Column:
    """Inverse of ``barcode_code``."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), 16, "0"), "0123", "ACGT")
