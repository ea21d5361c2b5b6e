"""Column helpers shared by the operators."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.config import CHANNELS
from spendlens.schemas import MONEY, MONEY_TOTAL

WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# Text that counts as missing in a delimited file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: str) -> Column:
    """A SQL expression as an exact amount."""
    return F.expr(f"CAST({value} AS {MONEY.simpleString()})")


def money_sum(value: str) -> Column:
    """Exact sum; the result keeps one decimal width however often sums are summed."""
    return F.expr(f"CAST(sum({value}) AS {MONEY_TOTAL.simpleString()})")


def whole_sum(value: str) -> Column:
    return F.expr(f"CAST(sum({value}) AS BIGINT)")


def ratio(numerator: str, denominator: str, default: float | None = 0.0) -> Column:
    """numerator / denominator where the denominator is positive, else ``default`` (None gives NULL)."""
    otherwise = "NULL" if default is None else f"{default}D"
    return F.expr(
        f"CASE WHEN {denominator} > 0 THEN CAST({numerator} AS DOUBLE) / CAST({denominator} AS DOUBLE) "
        f"ELSE CAST({otherwise} AS DOUBLE) END"
    )


def canonical_channel(channel: Column | str) -> Column:
    """One of the five channel names whatever the case and surrounding blanks, or NULL."""
    name = F.lower(F.btrim(as_column(channel), F.lit(WHITESPACE)))
    return F.when(name.isin(*CHANNELS), name)


def missing_to_null(text: Column | str) -> Column:
    """Text that stands for a missing value becomes NULL."""
    value = as_column(text)
    return F.when(~value.isin(*MISSING_TOKENS), value)


WHOLE_TYPES = ("tinyint", "smallint", "int", "bigint")
EXACT = "decimal(38,18)"


def parse(text: Column | str, data_type: str, strict: bool = True) -> Column:
    """Typed value of a text column: a malformed value raises when strict, else becomes NULL.

    A whole number may be written as 12.0, as columns with gaps often are; one with a fraction is malformed.
    """
    value = as_column(text)
    if data_type not in WHOLE_TYPES:
        return value.cast(data_type) if strict else value.try_cast(data_type)
    number = value.cast(EXACT) if strict else value.try_cast(EXACT)
    whole = number.cast(data_type) if strict else number.try_cast(data_type)
    refused = F.raise_error(F.concat(F.lit("not a whole number: "), value)) if strict else F.lit(None).cast(data_type)
    return F.when(number == F.floor(number), whole).when(number.isNotNull(), refused)


def struct_rows(rows: list[dict[str, object]]) -> Column:
    """A few configuration rows as a literal array of structs, to be exploded next to data rows."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])
