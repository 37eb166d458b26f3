"""Instants from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3339 date and time with an offset or Z.
RFC3339 = (
    r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
)


def instant(text: Column) -> Column:
    """The instant of an RFC 3339 text; null for null, for other forms and for days that don't exist.

    Spark's own cast also takes dates without a time or an offset, so the form is checked first. Digits after the
    sixth of a fraction are cut off.
    """
    whole = F.regexp_replace(F.upper(text), r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(whole))
