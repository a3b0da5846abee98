"""Telling a text format by its first line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AmbiguousInputFormatErr, UnrecognizedInputFormatErr
from ..model import U32_MAX


def _is_u32(text: str) -> bool:
    digits = text.removeprefix("+")
    return digits.isascii() and digits.isdigit() and int(digits) <= U32_MAX


def sniff(line: str) -> str:
    """The format of an input whose first line this is."""
    line = line.split("\n", 1)[0]
    if line.startswith("@HD") and len(line) > 2:
        return "sam"
    if "\t" not in line:
        return "themisto"
    first, second = line.split("\t")[:2]
    if first in ("query_name", "query_index"):
        return "bifrost" if first == "query_name" else "tsv"
    if _is_u32(first) and _is_u32(second):
        raise AmbiguousInputFormatErr(f"either of two formats: {line[:80]!r}")
    if _is_u32(second):
        return "fulgor"
    if _is_u32(first):
        return "metagraph"
    raise UnrecognizedInputFormatErr(f"no known format: {line[:80]!r}")


def sniff_column(line: Column) -> Column:
    """The same for a column of first lines; ``ambiguous`` and ``unknown`` instead of errors."""
    parts = F.split(line, "\t", -1)

    def number(c: Column) -> Column:
        return c.rlike(r"^\+?0*[0-9]{1,10}$") & (F.regexp_replace(c, r"^\+", "").try_cast("decimal(20,0)") <= U32_MAX)

    one, two = F.coalesce(number(parts[0]), F.lit(False)), F.coalesce(number(F.get(parts, F.lit(1))), F.lit(False))
    return (
        F.when(line.startswith("@HD"), "sam")
        .when(~line.contains("\t"), "themisto")
        .when(parts[0] == "query_name", "bifrost")
        .when(parts[0] == "query_index", "tsv")
        .when(one & two, "ambiguous")
        .when(two, "fulgor")
        .when(one, "metagraph")
        .otherwise("unknown")
    )
