"""Identifier renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted renderings of a company key.
CIK_PATTERN = r"(?i)^\s*(?:CIK[-_]?)?0*(\d{1,10})\s*$"


def cik10(c: Column | str) -> Column:
    """The ten-digit key of any accepted rendering; null where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(c.cast("string"), CIK_PATTERN, 1)
    return F.when((digits != "") & (digits != "0"), F.lpad(digits, 10, "0"))


def cik_for_facts(c: Column | str) -> Column:
    return F.concat(F.lit("CIK"), cik10(c))


def cik_for_archives(c: Column | str) -> Column:
    return cik10(c).cast("bigint").cast("string")


def accession_digits(c: Column | str) -> Column:
    """An accession number without its dashes and outer blanks, as in archive paths."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(c), "-", "")
