"""Bank fields by rows of a rule table."""

import pytest

from paperloom.functions import rules
from paperloom.operators import bank, ruletable

ROWS = "bank string, text string, text_length int"


def test_a_bank_is_added_by_rows(spark):
    new = [
        ("kiwi", "account_number", 0, 0, r"Konto ([A-Z]{2}\d{4})", [1], "first", "text", False, None, False, None, None),
        ("kiwi", "account_holder_name", 0, 0, r"(?i)Inhaber ([a-z]+) ([a-z]+),", [2, 1], "first", "upper", False, None, False, None, None),
        ("kiwi", "statement_date", 0, 0, r"(\d{2}/\d{2}/\d{4})", [1], "valid", "date", False, None, False, None, None),
        ("kiwi", "opening_balance", 0, 0, r"Start ([0-9,.]+)", [1], "first", "amount", True, None, False, None, None),
        ("kiwi", "opening_balance", 1, 0, r"Beginn ([0-9,.]+)", [1], "first", "amount", False, None, False, None, None),
        ("kiwi", "total_debit", 0, 0, r"([0-9,]+\.\d{2})", [1], "last", "amount", False, "Summe", True, 40, "Ende"),
        ("kiwi", "total_credit", 0, 0, r"Haben ([0-9,.]+)", [1], "first", "amount", False, None, False, 20, None),
        ("kiwi", "closing_balance", 0, 0, "", [1], "first", "derived", False, None, False, None, None),
    ]
    table = ruletable.rule_table(spark, ruletable.rule_rows() + new)
    text = "Konto AB1234 Inhaber anna brown, am 99/99/1999 am 31/02/1999 dann 05/03/2024 Start 0.00 Beginn 7.00 Haben 5.00 9.99 Summe 1.00 und 2,000.50 Ende 3.00"
    rows = [("kiwi", text, 1), ("kiwi", "Haben 5.00 Start 10.00 Summe 4.00 Ende", 2), ("other", "Account No 123456789012 Opening Balance 5.00", 3), (None, "Account No 123456789012", 4), ("kiwi", "", 5)]
    got = {r.text_length: r for r in bank.bank_record(spark.createDataFrame(rows, ROWS), bank="bank", table=table).collect()}
    a = got[1]
    assert (a.account_number, a.account_holder_name, a.statement_date) == ("AB1234", "BROWN ANNA", "31/12/2000")
    # a zero that decides is missing, so the balance isn't looked for further and can't be derived
    assert (a.opening_balance, a.total_debit, a.total_credit, a.closing_balance) == ("0.00", "2000.50", None, "0.00")
    b = got[2]
    assert (b.opening_balance, b.total_debit, b.total_credit, b.closing_balance, b.account_number) == ("10.00", "4.00", "5.00", "11.00", None)
    assert got[3].account_number == got[4].account_number == "123456789012" and got[3].opening_balance == "5.00"
    assert (got[5].opening_balance, got[5].closing_balance, got[5].statement_date) == ("0.00", "0.00", None)


def test_a_table_without_a_bank_leaves_its_fields_empty(spark):
    table = ruletable.rule_table(spark, [r for r in ruletable.rule_rows() if r[0] == "cimb"])
    (r,) = bank.bank_record(spark.createDataFrame([("bsn", "No.Akaun 1234567890123456", 1)], ROWS), bank="bank", table=table).collect()
    assert r.account_number is None and r.opening_balance == "0.00"


def test_one_small_plan_for_all_banks(spark):
    df = bank.bank_record(spark.createDataFrame([("bsn", "x", 1)], ROWS), bank="bank")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 2 and "Union" not in plan  # pages are read once, rules once
    several = bank.bank_record(spark.createDataFrame([("bsn", "x", 1)], ROWS), bank="bank", table=ruletable.rule_table(spark, ruletable.rule_rows({f"b{i}": r for i in range(20) for r in rules.BANKS.values()})))
    assert len(several._jdf.queryExecution().optimizedPlan().toString()) < 1.5 * len(df._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("name", list(rules.BANKS))
def test_rows_are_in_the_order_of_their_options(name):
    rows = [r for r in ruletable.rule_rows() if r[0] == name]
    for field in {r[1] for r in rows}:
        own = [(r[2], r[3]) for r in rows if r[1] == field]
        assert own == sorted(own) and len(set(own)) == len(own)
