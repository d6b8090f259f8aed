"""Field rules as rows: a table of patterns that pages meet by a join, one plan for any number of banks.

A rule row says, for a bank and a field, what to look for and what to make of it:

* ``option`` and ``try``: options are tried in order; within one, the first pattern that matches counts.
* ``start``, ``must``, ``length``, ``until``: where to look.  From the first match of ``start`` (without
  one from the beginning; ``must`` says that nothing is found then), ``length`` characters, up to ``until``.
* ``pattern``, ``groups``: a pattern and its groups that count, joined by spaces in the order given.
* ``pick``: the first match, the last one, or the first that is a valid date.
* ``treat``: how the text becomes a value (``_treated``), or a value made from other fields.
* ``decides``: whether a match ends the search even if no value comes of it.

Rows are grouped into one list of options per bank and field, which is joined with the pages by bank and
folded over with the page's text, so the pattern is a column: nothing is generated per bank, texts aren't
shuffled, and a bank is added by adding rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import dates, numbers, rules
from paperloom.functions.text import let, upper_words

SCHEMA = "bank string, field string, option int, try int, pattern string, groups array<int>, pick string, treat string, decides boolean, start string, must boolean, length int, until string"
#: Most banks whose rules are broadcast, of some kilobytes each.
BROADCAST_BANKS = 2_000
OTHER = "generic"


class _Field:
    """Collects the rows of one field of one bank."""

    def __init__(self, bank: str, field: str):
        self.bank, self.field, self.rows, self._option = bank, field, [], 0

    def option(self, *patterns: str, groups: tuple[int, ...] = (1,), pick: str = "first", treat: str = "text", decides: bool = False, start: str | None = None, must: bool = False, length: int | None = None, until: str | None = None) -> _Field:
        for i, p in enumerate(patterns):
            self.rows.append((self.bank, self.field, self._option, i, p, list(groups), pick, treat, decides, start, must, length, until))
        self._option += 1
        return self


def _after(words: tuple[str, ...], pattern: str, gap: str = r"[:\s]*") -> list[str]:
    return [rf"(?i){w}{gap}({pattern})" for w in words]


def _amounts(words: tuple[str, ...]) -> list[str]:
    return [rf"(?i){w}[:\s]*(?:RM)?[:\s]*{rules.AMOUNT}" for w in words]


def _fields_of(bank: str, r: rules.BankRules) -> Iterator[_Field]:
    amount = "amount_dots" if bank == "bsn" else "amount"
    islamic, section = bank == "public_islamic", f"(?i){r.section}" if r.section else None
    exact = [r.account_exact] if r.account_exact else []
    yield _Field(bank, "account_number").option(*exact, *_after(r.account_words, r.account, r"[:\s\.]*"), f"({r.account})", treat="trim")
    yield _Field(bank, "account_holder_name").option(*["(?i)" + p for p in (*r.holder, *rules.HOLDERS)], treat="upper")
    date = _Field(bank, "statement_date")
    if islamic:
        date.option(rf"(?i)(\d{{4}})\s+({rules.MONTHS})\s+(\d{{1,2}})", groups=(3, 2, 1)).option(rf"(?i)(\d{{1,2}}\s+(?:{rules.MONTHS})\s+\d{{4}})")
    for p in _after(r.date_words, r.date):
        date.option(p, treat="date")
    yield date.option(f"({r.date})", pick="valid", treat="date", length=500)
    yield _Field(bank, "opening_balance").option(*_amounts(r.opening), treat=amount, decides=True)
    debit, credit = _Field(bank, "total_debit"), _Field(bank, "total_credit")
    if islamic:
        debit.option(r"(\d{1,3}(?:,\d{3})+\.\d{2})", pick="last", treat=amount, decides=True, start=rules.SUMMARY, must=True, length=1000, until=r"(?i)(?:Jumlah Debit|Total Debits)")
        credit.option(r"(?i)([0-9,\.]+)\s+[^\d]*?(?:Jumlah Kredit|Total Credits)", treat=amount, decides=True, start=rules.SUMMARY, must=True, length=1000)
    yield debit.option(*_amounts(r.debit), treat=amount, decides=True, start=section)
    yield credit.option(*_amounts(r.credit), treat=amount, decides=True, start=section)
    closing = _Field(bank, "closing_balance")
    if bank == "bsn":
        yield closing.option(rules.AVAILABLE, treat="money_dots", decides=True)
        yield _Field(bank, "available_balance").option(rules.AVAILABLE, treat="money_dots", decides=True)
    else:
        if bank == "bank_islam":
            closing.option("", treat="derived")
        if islamic:
            for p in rules.ISLAMIC_CLOSING:
                closing.option(p, treat=amount)
            closing.option(r"(?i)([0-9,\.]+)\s+[^\d]*?(?:Baki Penutup|Closing Balance)", treat=amount, start=rules.SUMMARY, must=True, length=1000)
        yield closing.option(*_amounts(r.closing), treat=amount, decides=True).option(r"\d{1,2}/\d{1,2}/\d{2,4}.*?([0-9,\.]+)", pick="last", treat=amount)
    for side, (field, words) in enumerate((("statement_period_from", r.period_from), ("statement_period_to", r.period_to)), 1):
        yield _Field(bank, field).option(*_after(words, r.period)).option(rules.DATE_RANGE, groups=(side,)).option("", treat="first_transaction" if side == 1 else "last_transaction")


def rule_rows(banks: dict[str, rules.BankRules] = rules.BANKS) -> list[tuple]:
    """The rows (``SCHEMA``) of the banks' rules."""
    return [row for bank, r in banks.items() for field in _fields_of(bank, r) for row in field.rows]


def rule_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rule_rows() if rows is None else rows, SCHEMA)


def by_bank(table: DataFrame, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    """(bank, one column per list of fields: for each of them its options, or null) of a rule table."""
    tries = F.transform(F.array_sort(F.collect_list(F.struct("try", "pattern", "groups"))), lambda t: F.struct(t["pattern"].alias("pattern"), t["groups"].alias("groups")))
    option = table.groupBy("bank", "field", "option", "pick", "treat", "decides", "start", "must", "length", "until").agg(tries.alias("tries"))
    ordered = F.array_sort(F.collect_list(F.struct("option", "treat", "pick", "decides", "start", "must", "length", "until", "tries")))
    of = option.groupBy("bank", "field").agg(ordered.alias("options"))
    return of.groupBy("bank").agg(*[F.array(*[F.max(F.when(F.col("field") == f, F.col("options"))) for f in fields]).alias(name) for name, fields in lists.items()])


def with_rules(df: DataFrame, bank: str, table: DataFrame | None, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    """``df`` with the rules of its rows' banks, a column per list of fields; banks without rules have those of ``OTHER``.

    Without a table, rules are those of ``rules.BANKS``.
    """
    names = list(rules.BANKS) if table is None else [r.bank for r in table.select("bank").distinct().collect()]  # one row per bank
    table = rule_table(df.sparkSession) if table is None else table
    rows = by_bank(table, lists).withColumnRenamed("bank", "__rules_of")
    if len(names) <= BROADCAST_BANKS:
        rows = F.broadcast(rows)
    of = F.when(F.col(bank).isin(names), F.col(bank)).otherwise(OTHER)
    return df.withColumn("__of", of).join(rows, F.col("__of") == F.col("__rules_of"), "left").drop("__of", "__rules_of")


def _extract(text: Column, pattern: Column, group: Column) -> Column:
    """The first match's group, or null where there is none or it is empty."""
    return let(F.call_function("regexp_extract", text, pattern, group), lambda v: F.when(v != "", v))


def _joined(text: Column, t: Column) -> Column:
    """A try's groups, joined."""
    one = _extract(text, t["pattern"], t["groups"][0])
    all_ = F.array_join(F.transform(t["groups"], lambda g: _extract(text, t["pattern"], g)), " ")
    return F.when(F.size(t["groups"]) == 1, one).otherwise(F.when(one.isNotNull(), all_))


def _region(text: Column, o: Column) -> Column:
    """Where an option looks."""
    size = F.coalesce(o["length"], F.length(text))
    at = F.call_function("regexp_instr", text, o["start"])
    found = let(at, lambda i: F.when(i > 0, F.substring(text, i, size)).when(o["must"], F.lit(None)).otherwise(text))
    base = F.when(o["start"].isNotNull(), found).otherwise(F.when(o["length"].isNull(), text).otherwise(F.substring(text, F.lit(1), size)))
    cut = let(base, lambda b: let(F.call_function("regexp_instr", b, o["until"]), lambda i: F.when(i > 0, F.substring(b, F.lit(1), i - 1))))
    return F.when(o["until"].isNull(), base).otherwise(cut)


def _found(region: Column, o: Column) -> Column:
    none = F.lit(None).cast("string")
    every = lambda t: F.call_function("regexp_extract_all", region, t["pattern"], t["groups"][0])
    valid = lambda t: F.try_element_at(F.filter(F.transform(every(t), dates.valid_or_clamped_date), lambda d: d.isNotNull()), F.lit(1))
    one = lambda t: F.when(o["pick"] == "first", _joined(region, t)).when(o["pick"] == "last", F.try_element_at(every(t), F.lit(-1))).otherwise(valid(t))
    return F.aggregate(o["tries"], none, lambda a, t: F.coalesce(a, one(t)))


def _treated(v: Column, treat: Column, made: dict[str, Column]) -> Column:
    out = F.when(treat == "text", v).when(treat == "trim", F.trim(v)).when(treat == "upper", upper_words(v)).when(treat == "date", dates.valid_or_clamped_date(v))
    out = out.when(treat.isin("amount", "amount_dots"), numbers.amount(v, F.when(treat == "amount_dots", "bsn").otherwise("")))
    out = out.when(treat == "money_dots", numbers.money_text(numbers.normalize_number(v, "bsn")))
    for name, value in made.items():
        out = out.when(treat == name, value)
    return out


def value(text: Column, options: Column, made: dict[str, Column] | None = None) -> Column:
    """A field's value by its options; ``made`` are the values that options may name instead of a pattern."""
    state = F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("value"))

    def step(acc: Column, o: Column) -> Column:
        looked = F.when(o["tries"][0]["pattern"] == "", F.lit("")).otherwise(let(_region(text, o), lambda r: _found(r, o)))
        fresh = let(looked, lambda v: let(F.when(v.isNotNull(), _treated(v, o["treat"], made or {})), lambda x: F.struct((x.isNotNull() | (v.isNotNull() & o["decides"])).alias("done"), x.alias("value"))))
        return F.when(acc["done"], acc).otherwise(fresh)

    return F.aggregate(options, state, step, lambda acc: acc["value"])


def values(text: Column, fields: Column, made: dict[str, Column] | None = None) -> Column:
    """The values of a list of fields, in its order."""
    return F.transform(fields, lambda options: value(text, options, made))
