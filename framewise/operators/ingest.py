"""Rows that fail to parse: delimited lines to typed records, or apart with the reason."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.plans.scale import free_name


@dataclass(frozen=True)
class Field:
    """A field's name, Spark type, and checks: (reason, text of the field -> true where it is fine)."""

    name: str
    kind: str = "string"
    checks: tuple[tuple[str, Callable[[Column], Column]], ...] = ()


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def is_clean(text: Column) -> Column:
    """No control character other than tab, no replacement character."""
    return ~text.rlike(r"[\p{Cc}&&[^\t]]|\x{FFFD}")


def plain_number(text: Column) -> Column:
    """Empty, or digits with at most one point that has digits on both sides."""
    return text.rlike(r"\A([0-9]+(\.[0-9]+)?)?\z")


def at_most(limit: float) -> Callable[[Column], Column]:
    return lambda text: F.coalesce(text.try_cast("double") <= F.lit(limit), F.lit(True))


def _texts(line: Column, sep: str, quote: str) -> tuple[Column, Column]:
    """(array of the fields' texts, whether the rules on quotes hold).

    The line, with a separator put before and after it, is cut at the quote marks: pieces at odd places are
    inside quotes, those at even places outside. An empty even piece is a doubled mark; any other has to
    hold a separator, with only spaces between it and the marks. Separators inside quotes are written
    as an escape before the line is cut at separators, and read back afterwards. The lambdas use their own element
    alone: anything else of the line would be computed again for every piece.
    """
    pieces = F.split(F.concat(F.lit(sep), line, F.lit(sep)), f"\\Q{quote}\\E", -1)

    def outside_ok(x: Column, i: Column) -> Column:
        opens = x.rlike(f"\\Q{sep}\\E *\\z")
        closes = (i == 0) | x.rlike(f"\\A *\\Q{sep}\\E")
        return (i % 2 == 1) | (x == "") | (opens & closes)

    well = (F.size(pieces) % 2 == 1) & F.forall(F.transform(pieces, outside_ok), lambda x: x)
    escaped = F.transform(pieces, lambda x: F.replace(x, F.lit("\\"), F.lit("\\b")))
    inner = F.transform(escaped, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(sep), F.lit("\\t"))).otherwise(F.when(x == "", F.lit(quote)).otherwise(x)))
    fields = F.split(F.array_join(inner, ""), f"\\Q{sep}\\E", -1)
    read = F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 2, F.lit(0))), lambda x: F.replace(F.replace(x, F.lit("\\t"), F.lit(sep)), F.lit("\\b"), F.lit("\\")))
    return F.when(line.contains(quote), read).otherwise(F.split(line, f"\\Q{sep}\\E", -1)), ~line.contains(quote) | well


def parse_lines(df: DataFrame, line: str, fields: Sequence[Field], sep: str = "\t", quote: str = '"') -> DataFrame:
    """Every row of ``df`` with its fields as typed columns and ``errors``, the array of reasons it fails.

    All fields are taken as nullable text first (outer spaces off, empty = null); each rule is then an
    expression over the text, and its reason goes into ``errors``: ``quoting`` alone if the rules on
    quotes are broken, else ``columns`` alone if the count is wrong (a null line has no field), else
    the reasons of the fields' checks in order, each once. Unchecked fields of another type become null
    where their text can't be cast. Rows with empty ``errors`` are the good ones. It is one narrow
    projection without Python or shuffle. New columns whose names are taken get ``_2``.
    """
    source = F.col(f"`{line}`")
    texts, well = _texts(source, sep, quote)
    work = df.withColumn("__fw_t", texts).withColumn("__fw_q", well)
    trimmed = work.withColumn("__fw_t", F.transform("__fw_t", lambda x: F.trim(x)))
    right = F.coalesce(F.size("__fw_t"), F.lit(0)) == len(fields)
    text = [F.coalesce(F.try_element_at("__fw_t", F.lit(i + 1)), F.lit("")) for i in range(len(fields))]
    checks = F.array_distinct(F.filter(F.array(*[F.when(~ok(text[i]), F.lit(reason)) for i, f in enumerate(fields) for reason, ok in f.checks], F.lit(None).cast("string")), lambda x: x.isNotNull()))
    errors = F.when(source.isNull() | (F.col("__fw_q") & ~right), F.array(F.lit("columns"))).when(~F.col("__fw_q"), F.array(F.lit("quoting"))).otherwise(checks)
    out, taken = [], list(df.columns)
    for i, f in enumerate(fields):
        taken.append(name := free_name(f.name, taken))
        value = F.when(right & F.coalesce("__fw_q", F.lit(False)) & (text[i] != ""), text[i])
        out.append((value if f.kind == "string" else value.try_cast(f.kind)).alias(name))
    return trimmed.select(*[F.col(f"`{c}`") for c in df.columns], *out, errors.alias(free_name("errors", taken)))


def split_valid(parsed: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one and the first ``reason``)."""
    good = parsed.where(F.size(errors) == 0).drop(errors)
    bad = parsed.where(F.size(errors) > 0)
    return good, bad.withColumn(free_name("reason", bad.columns), F.element_at(errors, 1))
