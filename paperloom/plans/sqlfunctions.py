"""The library's column functions as SQL functions, for use in ``spark.sql``.

``register`` defines temporary SQL functions whose bodies are the functions' own expressions, written as
SQL.  Spark puts a body in the place of its call before it optimises, so a query in SQL gets the plan of
the same query over columns: nothing is a UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import classify, dates, numbers, text

#: name: (arguments by type, the function over their columns)
FUNCTIONS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "clean_text": ({"said": "string"}, text.clean_text),
    "fix_number_spacing": ({"said": "string"}, text.fix_number_spacing),
    "fix_decimal_points": ({"said": "string"}, text.fix_decimal_points),
    "remove_extra_spaces": ({"said": "string"}, text.remove_extra_spaces),
    "fix_lookalikes": ({"said": "string"}, text.fix_lookalikes),
    "file_extension": ({"path": "string"}, text.file_extension),
    "clean_currency": ({"said": "string"}, numbers.clean_currency),
    "parse_number": ({"said": "string"}, numbers.parse_number),
    "normalize_number": ({"said": "string", "bank": "string"}, numbers.normalize_number),
    "payslip_currency": ({"said": "string"}, numbers.payslip_currency),
    "valid_date": ({"said": "string"}, dates.valid_date),
    "valid_or_clamped_date": ({"said": "string"}, dates.valid_or_clamped_date),
    "as_date": ({"said": "string"}, dates.as_date),
    "twelve_digits": ({"said": "string"}, dates.twelve_digits),
    "first_transaction_date": ({"said": "string", "day": "string"}, dates.first_transaction_date),
    "last_transaction_date": ({"said": "string", "day": "string"}, dates.last_transaction_date),
    "document_type": ({"said": "string"}, classify.document_type),
    "issuing_bank": ({"said": "string"}, classify.issuing_bank),
    "told_language": ({"said": "string"}, classify.language),
}
_OPERATOR = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`\-])(<=>|>=|<=|!=|[><=+*/%!&|^~-])(?=\()")


def body(arguments: dict[str, str], make: Callable[..., Column], spark: SparkSession) -> tuple[str, str]:
    """(SQL of the function's expression, its type)."""
    value = make(*[F.col(a) for a in arguments])
    df = spark.createDataFrame([], ", ".join(f"{a} {t}" for a, t in arguments.items())).select(value.alias("v"))
    typed = df.schema["v"].dataType.simpleString()
    whole = df._jdf.queryExecution().analyzed().expressions().head().child().sql()
    if "lambdafunction(" not in whole:
        return whole, typed
    # resolved lambdas have no SQL of their own; as they were written they have, with operators as function names
    return _OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`", value._jc.node().sql()), typed


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Defines all functions in the session, their names after ``prefix``; returns the names."""
    for name, (arguments, make) in FUNCTIONS.items():
        sql, typed = body(arguments, make, spark)
        given = ", ".join(f"{a} {t}" for a, t in arguments.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {typed} RETURN {sql}")
    return [prefix + n for n in FUNCTIONS]


def layout_views(tokens: DataFrame, prefix: str = "") -> None:
    """Temporary views over positioned tokens: ``runs`` (numbers joined), ``lines`` (with line and place) and ``page_texts``."""
    from paperloom.operators import tokens as layout

    layout.merge_runs(tokens).createOrReplaceTempView(f"{prefix}runs")
    layout.reading_order(layout.cluster_lines(tokens)).createOrReplaceTempView(f"{prefix}lines")
    layout.page_text(tokens).createOrReplaceTempView(f"{prefix}page_texts")
