"""Contracts with quarantine, and layered settings as rows against the driver's merge."""

import datetime
import json
import random
from decimal import Decimal

from paperloom.operators import contracts
from paperloom.plans import scratch
from paperloom.sources import settingrows, settings

BANK = "upload_id int, account_holder_name string, account_number string, statement_date string, opening_balance string, reasons string"


def test_records_are_divided_in_one_pass(spark):
    rows = [
        (1, "A", "51-1103355-2", "29/02/2024", "550.00", "mine"), (2, "A", "51-1103355-2", "30/02/2024", "550.00", "mine"),
        (3, None, "x", "1/2/2024", "5,5", "mine"), (4, "A" * 101, "51-1103355-2", "01/02/2024", "-3", "mine"), (4, "A" * 101, "51-1103355-2", "01/02/2024", "-3", "mine"),
    ]
    fields = (*contracts.BANK[:-1], contracts.Field("closing_balance", "money", required=False), contracts.Field("extra", required=False))
    fields = tuple(contracts.Field(f.name, "money", low="0.00", high="600.00") if f.name == "opening_balance" else f for f in fields)
    df = spark.createDataFrame(rows, BANK)
    good, broken = contracts.divide(df, fields, scratch.fresh(spark, "contract"))
    assert [tuple(r) for r in good.collect()] == [(1, "A", "51-1103355-2", datetime.date(2024, 2, 29), Decimal("550.00"), None, None)]
    assert good.schema == contracts.good_schema(df, fields)
    why = {r.upload_id: list(r.reasons) for r in broken.collect()}
    assert why == {
        2: ["statement_date: no date"], 4: ["account_holder_name: over 100 characters", "opening_balance: below 0.00"],
        3: ["account_holder_name: missing", "account_number: not of its shape", "statement_date: not of its shape", "opening_balance: no money"],
    }
    assert {r.statement_date for r in broken.collect()} == {"30/02/2024", "1/2/2024", "01/02/2024"} and broken.count() == 4


def test_a_contract_on_no_rows(spark):
    good, broken = contracts.divide(spark.createDataFrame([], BANK), contracts.BANK, scratch.fresh(spark, "contract"))
    assert good.count() == broken.count() == 0


def leaves(value, path=()):
    if isinstance(value, dict) and value:
        return {k: v for key, x in value.items() for k, v in leaves(x, (*path, key)).items()}
    return {path: value}


def some(rnd, depth=0):
    if depth < 3 and rnd.random() < 0.6:
        return {rnd.choice("abc"): some(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return rnd.choice([1, 2.5, "t", None, True, [1, {"z": 2}], []])


def test_layers_resolve_as_the_merge_does(spark):
    rnd = random.Random(5)
    given = []
    for template in (None, "t1", "t2", "t3", "t4", ""):
        for layer in ((0, 1) if template is None else (2, 3, 4)):
            given.append((template, layer, json.dumps({k: some(rnd) for k in "abcd" if rnd.random() < 0.8})))
    given += [("t1", 5, "[1, 2]"), ("t2", 5, "no json"), ("t3", 5, None), ("t4", 5, "{}")]
    rows = settingrows.resolved(spark.createDataFrame(given, settingrows.LAYERS).repartition(3)).collect()
    got = {}
    for r in rows:
        assert got.setdefault(r.template, {}).setdefault(tuple(r.path), json.loads(r.value)) == json.loads(r.value)
    assert sum(map(len, got.values())) == len(rows)
    for template in (None, "t1", "t2", "t3", "t4"):
        layers = [json.loads(d) for t, _, d in sorted((x for x in given if x[0] in (None, template)), key=lambda x: x[1]) if d and d.startswith("{")]
        want = {p: v for p, v in leaves(settings.layered(layers)).items() if p}
        assert got[template] == want, template


def test_no_layers(spark):
    assert settingrows.resolved(spark.createDataFrame([], settingrows.LAYERS)).count() == 0
