"""Payslip records, from one-line text or from page text with its line breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import numbers, rules
from paperloom.functions.dates import format_month_year
from paperloom.functions.text import captured, contains_any, contains_word, let
from paperloom.operators.bank import completeness

FIELDS = ("name", "id_number", "gross_income", "net_income", "total_deduction", "month_year")


def _matches(text: Column, pattern: str, reach: int) -> Column:
    """All matches of a pattern in order: array of (value, context), context being the match with ``reach`` characters around.

    Matches are taken one after another by splitting the text before them, so a match's context
    also sees what other matches took.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    pairs = F.arrays_zip(whole.alias("whole"), value.alias("value"))
    begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<value:string,context:string>>").alias("found"))

    def step(acc: Column, m: Column) -> Column:
        w, v = m["whole"], m["value"]
        at = F.call_function("locate", w, text, acc["next"])
        low = F.greatest(at - reach, F.lit(1))
        context = F.substring(text, low, at + F.length(w) + reach - low)
        return F.struct((at + F.length(w)).cast("int").alias("next"), F.concat(acc["found"], F.array(F.struct(v.alias("value"), context.alias("context")))).alias("found"))

    return F.aggregate(pairs, begin, step, lambda acc: acc["found"])


def text_field(text: Column, name: str) -> Column:
    """After a field's words, else by its further patterns; matches near unwanted words don't count.

    A name's letters may spell an unwanted word, so near names those count as whole words only.
    """
    r = rules.PAYSLIP[name]

    def near(context: Column) -> Column:
        return (contains_word if name == "name" else contains_any)(F.lower(context), r["not_near"])

    tried = []
    for w in r["words"]:
        first = F.try_element_at(_matches(text, rf"(?i){w}[:\s]*({r['pattern']})", 50), F.lit(1))
        tried.append(let(first, lambda m: F.when(m.isNotNull() & ~near(m["context"]), F.trim(m["value"]))))
    for p in r["more"]:
        good = F.filter(_matches(text, "(?i)" + p, 50), lambda m: ~near(m["context"]))
        tried.append(F.trim(F.try_element_at(good, F.lit(1))["value"]))
    out = F.coalesce(*tried)
    return format_month_year(out, text) if name == "month_year" else out


def money_field(text: Column, name: str, used: Column) -> Column:
    """The first match, pattern by pattern, whose value no earlier field took and that no unwanted word is near."""
    r = rules.PAYSLIP[name]
    tried = []
    for p in r["more"]:
        good = F.filter(
            F.transform(_matches(text, "(?im)" + p, 100), lambda m: F.struct(F.trim(m["value"]).alias("value"), m["context"].alias("context"))),
            lambda m: ~F.array_contains(used, m["value"]) & ~contains_any(F.lower(m["context"]), r["not_near"]),
        )
        tried.append(F.try_element_at(good, F.lit(1))["value"])
    return F.coalesce(*tried)


def deduction_items(text: Column) -> Column:
    """The sum of deduction items if at least two are found."""
    found = F.array().cast("array<string>")
    for p in rules.PAYSLIP["total_deduction"]["items"]:
        found = F.concat(found, F.regexp_extract_all(text, F.lit("(?im)" + p), F.lit(1)))
    values = F.filter(F.transform(found, numbers.payslip_number), lambda v: v > 0)
    total = F.aggregate(values, F.lit(0).cast("decimal(28,2)"), lambda a, v: (a + v).cast("decimal(28,2)"))
    return F.when(F.size(values) >= 2, numbers.money_text(total))


def _net(net: Column, gross: Column, deduction: Column) -> Column:
    m = lambda c: c.try_cast(numbers.MONEY)
    return F.when(F.coalesce(net, F.lit("0.00")) == "0.00", numbers.money_text(m(gross) - m(deduction))).otherwise(net)


def payslip_record(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the payslip fields from one-line text; gross, then deduction, then net take their values."""
    t, none = F.col(text), F.array().cast("array<string>")
    df = df.withColumns({"name": text_field(t, "name"), "id_number": text_field(t, "id_number"), "__gross": money_field(t, "gross_income", none)})
    df = df.withColumn("__deduction", money_field(t, "total_deduction", F.array_compact(F.array("__gross"))))
    df = df.withColumn("__net", money_field(t, "net_income", F.array_compact(F.array("__gross", "__deduction"))))
    return _finish(df, t, F.coalesce(F.col("__deduction"), deduction_items(t)))


def page_record(df: DataFrame, page: str = "page_text", text: str = "text") -> DataFrame:
    """``df`` with the payslip fields from labels in page text, with one-line text as the second choice."""
    p, t, none = F.col(page), F.col(text), F.array().cast("array<string>")
    names = [captured(p, x) for x in rules.PAGE_NAMES]
    good = [F.when((F.length(F.trim(n)) > 3) & ~contains_word(F.upper(n), rules.NAME_NEVER), F.trim(n)) for n in names]
    label = lambda x: numbers.label_value(captured(p, x))
    df = df.withColumns(
        {
            "name": F.trim(F.substring_index(F.coalesce(*good, text_field(t, "name")), "\n", 1)),
            "id_number": F.coalesce(*[captured(p, x) for x in rules.PAGE_ID], text_field(t, "id_number")),
            "__gross": F.coalesce(label(rules.PAGE_GROSS), money_field(t, "gross_income", none)),
        }
    )
    df = df.withColumn("__deduction", F.coalesce(label(rules.PAGE_DEDUCTION), money_field(t, "total_deduction", F.array_compact(F.array("__gross")))))
    df = df.withColumn("__net", F.coalesce(label(rules.PAGE_NET), money_field(t, "net_income", F.array_compact(F.array("__gross", "__deduction")))))
    known = F.nullif(F.col("__deduction"), F.lit("0.00"))
    return _finish(df, t, F.coalesce(known, deduction_items(t), F.col("__deduction")))


def _finish(df: DataFrame, text: Column, deduction: Column) -> DataFrame:
    df = df.withColumns(
        {
            "gross_income": numbers.payslip_currency(F.col("__gross")),
            "total_deduction": numbers.payslip_currency(deduction),
            "net_income": numbers.payslip_currency(F.col("__net")),
            "month_year": text_field(text, "month_year"),
        }
    )
    return df.withColumn("net_income", _net(F.col("net_income"), F.col("gross_income"), F.col("total_deduction"))).drop("__gross", "__deduction", "__net")


def payslip_completeness() -> Column:
    return completeness([F.col(c) for c in FIELDS], truthy=True)
