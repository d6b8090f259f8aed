"""Contracts of records: one description gives the checks, the typed schema and the quarantine.

A contract lists a record's fields with what must hold for each.  ``divide`` checks and writes records in
one pass: those that keep the contract, in the types it names, and broken ones as they came with every
reason; both are read back under their schemas, so a reader needs no checks of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.functions import dates, numbers
from paperloom.operators.validate import ACCOUNT, ID


@dataclass(frozen=True)
class Field:
    """A text field: its type once it is checked (``text``, ``money``, ``date`` or ``month``), and what must hold."""

    name: str
    kind: str = "text"
    required: bool = True
    pattern: str | None = None
    most: int | None = None  # characters
    low: str | None = None  # least money
    high: str | None = None  # most money


#: What records must look like.
PAYSLIP = (
    Field("name", most=100),
    Field("id_number", pattern=ID),
    Field("gross_income", "money"),
    Field("net_income", "money"),
    Field("total_deduction", "money"),
    Field("month_year", "month", pattern=r"^\d{2}/\d{4}$"),
)
BANK = (
    Field("account_holder_name", most=100),
    Field("account_number", pattern=ACCOUNT),
    Field("statement_date", "date", pattern=r"^\d{2}/\d{2}/\d{4}$"),
    Field("opening_balance", "money"),
    Field("closing_balance", "money"),
)

TYPES = {"text": "string", "money": numbers.MONEY, "date": "date", "month": "date"}


def typed(f: Field) -> Column:
    """The field's value in its type; null where it can't have it.  A month is its first day."""
    c = F.col(f.name)
    if f.kind == "money":
        return c.try_cast(numbers.MONEY)
    if f.kind == "date":
        return dates.as_date(c)
    if f.kind == "month":
        return dates.as_date(F.concat(F.lit("01/"), c))
    return c


def reasons(fields: tuple[Field, ...]) -> Column:
    """array<string>: why a record breaks its contract, in the order of its fields; a field's first reason counts."""
    out = []
    for f in fields:
        c, value = F.col(f.name), typed(f)
        said = F.length(c) > 0
        why = F.when(~F.coalesce(said, F.lit(False)), F.lit(f"{f.name}: missing") if f.required else F.lit(None))
        if f.most is not None:
            why = why.when(F.length(c) > f.most, F.lit(f"{f.name}: over {f.most} characters"))
        if f.pattern is not None:
            why = why.when(~c.rlike(f.pattern), F.lit(f"{f.name}: not of its shape"))
        why = why.when(value.isNull(), F.lit(f"{f.name}: no {f.kind}"))
        if f.low is not None:
            why = why.when(value < F.lit(f.low).cast(numbers.MONEY), F.lit(f"{f.name}: below {f.low}"))
        if f.high is not None:
            why = why.when(value > F.lit(f.high).cast(numbers.MONEY), F.lit(f"{f.name}: above {f.high}"))
        out.append(why)
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _names(rows: DataFrame, fields: tuple[Field, ...]) -> list[str]:
    return [c for c in rows.columns if c not in {f.name for f in fields} | {"reasons"}]


def good_schema(rows: DataFrame, fields: tuple[Field, ...]) -> StructType:
    """The schema of records that keep the contract: other columns of ``rows`` as they are, fields in their types."""
    return rows.select(*_names(rows, fields), *[F.lit(None).cast(TYPES[f.kind]).alias(f.name) for f in fields]).schema


def divide(rows: DataFrame, fields: tuple[Field, ...], path: str) -> tuple[DataFrame, DataFrame]:
    """(records that keep the contract, broken ones with reasons), written below ``path`` in one pass and read back.

    Fields that ``rows`` lacks are missing; an empty text is missing; a field that isn't required may be null.
    """
    spark = rows.sparkSession
    lacking = {f.name: F.lit(None).cast("string") for f in fields if f.name not in rows.columns}
    others = _names(rows, fields)
    text = rows.withColumns({**lacking, **{f.name: F.col(f.name).cast("string") for f in fields if f.name not in lacking}})
    checked = text.withColumn("reasons", reasons(fields))
    good = F.size("reasons") == 0
    out = checked.select(
        *others, *[F.when(good, typed(f)).alias(f.name) for f in fields], "reasons", good.alias("keeps"),
        F.when(~good, F.struct(*[f.name for f in fields])).alias("as_it_came"),
    )
    out.write.partitionBy("keeps").parquet(path)
    back = spark.read.schema(StructType([*out.schema])).parquet(path)
    kept = back.where("keeps").select(*good_schema(rows, fields).names)
    broken = back.where("not keeps").select(*others, *[F.col(f"as_it_came.{f.name}").alias(f.name) for f in fields], "reasons")
    return kept, broken
