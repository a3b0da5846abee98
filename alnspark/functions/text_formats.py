"""Text formats on DataFrames and Columns: one parser and one renderer each.

They run in batch and in streams and never leave the JVM.  A parser splits each line once, in a
projection of its own; the columns of the record then read the fields of that one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import U32_MAX

FORMATS = ["tsv", "bifrost", "fulgor", "metagraph", "themisto", "sam"]
#: Formats whose first line names the targets, and the fields before those names.
HEADERS = {"bifrost": ["query_name"], "tsv": ["query_index", "query_name"]}
#: What parts the fields of a line, if not a tab, and how many fields a line has at least, if not one.
SEPARATORS = {"themisto": " "}
LEAST_FIELDS = {"fulgor": 2, "metagraph": 3, "tsv": 2, "sam": 3}


def fail(name: str, what: Column | str) -> Column:
    """An expression that stops the query with a named error."""
    return F.raise_error(F.concat(F.lit(f"{name}: "), what if isinstance(what, Column) else F.lit(what)))


def _up_to(most: int) -> str:
    """A pattern of the decimal numbers up to ``most``, zeros before them allowed."""
    digits = str(most)
    below = [f"{digits[:i]}[0-{int(d) - 1}][0-9]{{{len(digits) - i - 1}}}" for i, d in enumerate(digits) if d != "0"]
    return f"0*(?:[0-9]{{1,{len(digits) - 1}}}|{'|'.join(below)}|{digits})"


U32_PATTERN = rf"^\+?{_up_to(U32_MAX)}$"


def u32(text: Column) -> Column:
    """Strict parse of an unsigned 32-bit number: digits with at most a plus before them.  The pattern
    tells all, so that each text is matched and cast once."""
    return F.when(text.rlike(U32_PATTERN), text.try_cast("long")).otherwise(
        fail("CorruptedInputErr", F.concat(F.lit("not a 32-bit number: "), F.coalesce(text, F.lit("nothing")))).cast("long")
    )


def _rest(fields: Column, skip: int) -> Column:
    """What follows the first ``skip`` fields."""
    return F.slice(fields, skip + 1, F.greatest(F.size(fields) - skip, F.lit(0)))


def _positive(cells: Column) -> Column:
    """Places of the cells that hold more than zero."""
    marked = F.transform(cells, lambda c, i: F.when(u32(c) > 0, i.cast("long")))
    return F.filter(marked, lambda x: x.isNotNull())


def _themisto(f: Column) -> dict[str, Column]:
    return {"query_id": u32(f[0]), "ones": F.transform(_rest(f, 1), u32)}


def _fulgor(f: Column) -> dict[str, Column]:
    # the count in the second field is not used
    return {"query_name": f[0], "ones": F.transform(_rest(f, 2), u32)}


def _no_header(first: Column, fmt: str, value: Column, kind: str) -> Column:
    return F.when(first == HEADERS[fmt][0], fail("HeaderNotConsumedError", fmt).cast(kind)).otherwise(value)


def _bifrost(f: Column) -> dict[str, Column]:
    return {"query_name": _no_header(f[0], "bifrost", f[0], "string"), "ones": _positive(_rest(f, 1))}


def _metagraph(f: Column) -> dict[str, Column]:
    names = F.filter(F.split(f[2], ":", -1), lambda x: x != "")
    return {"query_id": u32(f[0]), "query_name": f[1], "ones_names": names}


def _tsv(f: Column) -> dict[str, Column]:
    return {"query_id": _no_header(f[0], "tsv", u32(f[0]), "bigint"), "query_name": f[1], "ones": _positive(_rest(f, 2))}


def _sam(f: Column) -> dict[str, Column]:
    """One record a line; reads that the flag calls unmapped say nothing about targets."""
    mapped = u32(f[1]).bitwiseAND(F.lit(4)) == 0
    target = F.when(f[2] == "*", fail("CorruptedInputErr", "a mapped read without a reference").cast("string")).otherwise(f[2])
    return {"query_name": f[0], "ones_names": F.when(mapped, F.array(target))}


_RECORDS = {"themisto": _themisto, "fulgor": _fulgor, "bifrost": _bifrost, "metagraph": _metagraph, "tsv": _tsv, "sam": _sam}
_KINDS = {"query_id": "bigint", "query_name": "string", "ones": "array<bigint>", "ones_names": "array<string>"}


def parse(rows: DataFrame, fmt: str, value: Column | str = "value", keep: list[str] | None = None) -> DataFrame:
    """Records of lines: query_id, query_name, ones and ones_names, and the columns to ``keep``.

    Fields a format does not have are null.  A malformed line stops the query when a column that
    reads the malformed part is used.
    """
    kept = [F.col(c) for c in keep or []]
    line = F.col(value) if isinstance(value, str) else value
    least = LEAST_FIELDS.get(fmt, 1)
    split = rows.select(F.split(line, SEPARATORS.get(fmt, "\t"), -1).alias("__fields"), *kept)
    fields = F.col("__fields")
    found = _RECORDS[fmt](fields)
    columns = []
    for name, kind in _KINDS.items():
        column = found.get(name, F.lit(None)).cast(kind)
        if name in found and least > 1:
            column = F.when(F.size(fields) >= least, column).otherwise(fail("CorruptedInputErr", f"fewer than {least} fields").cast(kind))
        columns.append(column.alias(name))
    return split.select(*columns, *kept)


def _must(column: Column, field: str, kind: str) -> Column:
    return F.coalesce(column.cast(kind), fail("FieldMissing", field).cast(kind))


def _cells(ones: Column, n_targets: Column | int) -> Column:
    """Zeros and ones of all targets: stretches of zeros between the ones, so that the cost is that
    of the text written."""
    n = (n_targets if isinstance(n_targets, Column) else F.lit(n_targets)).cast("bigint")
    inside = F.array_sort(F.array_distinct(F.filter(ones, lambda x: (x >= 0) & (x < n))))
    before = F.concat(F.array(F.lit(-1).cast("bigint")), inside)

    def stretch(one: Column, last: Column) -> Column:
        zeros = F.repeat(F.lit("0\t"), (F.coalesce(one, n) - last - 1).cast("int"))
        return F.when(one.isNull(), zeros).otherwise(F.concat(zeros, F.lit("1\t")))

    text = F.array_join(F.zip_with(inside, before, stretch), "")
    return F.when(n > 0, F.substr(text, F.lit(1), (2 * n - 1).cast("int"))).otherwise(
        fail("NeedTargetSequences", "a wide format needs targets").cast("string"))


def render(fmt: str, n_targets: Column | int = 0) -> Column:
    """The line of a record, from columns query_id, query_name, ones and ones_names."""
    query_id = _must(F.col("query_id"), "query_id", "string")
    name = _must(F.col("query_name"), "query_name", "string")
    ones = F.coalesce(F.col("ones"), fail("FieldMissing", "ones").cast("array<bigint>"))
    listed = F.transform(ones, lambda x: x.cast("string"))
    if fmt == "themisto":
        return F.array_join(F.concat(F.array(query_id), listed), " ")
    if fmt == "fulgor":
        return F.array_join(F.concat(F.array(name, F.size(ones).cast("string")), listed), "\t")
    if fmt == "bifrost":
        return F.concat_ws("\t", name, _cells(ones, n_targets))
    if fmt == "tsv":
        return F.concat_ws("\t", query_id, name, _cells(ones, n_targets))
    if fmt == "metagraph":
        names = F.coalesce(F.col("ones_names"), fail("FieldMissing", "ones_names").cast("array<string>"))
        return F.concat_ws("\t", query_id, name, F.array_join(names, ":"))
    if fmt == "sam":
        raise NotImplementedError("SAM records can be read, not written")
    raise ValueError(f"unknown format {fmt!r}")


#: Columns that a format shows; others need not be filled.
SHOWN = {
    "themisto": ["query_id", "ones"],
    "fulgor": ["query_name", "ones"],
    "bifrost": ["query_name", "ones"],
    "tsv": ["query_id", "query_name", "ones"],
    "metagraph": ["query_id", "query_name", "ones_names"],
}


def header_lines(fmt: str, targets: list[str]) -> list[str]:
    """Header lines of a format: none for most."""
    if fmt in HEADERS:
        return ["\t".join(HEADERS[fmt] + targets)]
    if fmt == "sam":
        return ["@HD\tVN:1.6", *(f"@SQ\tSN:{t}\tLN:1" for t in targets)]
    return []
