"""The library's queries against DuckDB on the smallest tables, and functions on small inputs."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SAMPLE = ("e1_latest_label", "d1_spine", "e5_monthly_flow", "e11_monthly_income_vs_expense", "e16_f9_recurring_subscriptions", "e20_categorization_mix", "f5_d4_recurrence", "b3_b7_normalize_counterparty", "b16_b17_classify_iban", "b26_cadence")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    from kontor.plans.registry import QUERIES, SQL

    got = QUERIES[name](spark, SF).toArrow()
    want = con.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.schema.names)
    want = con.sql(SQL[name]).fetchall()
    names = [d[0] for d in con.sql(SQL[name]).description]
    rows = sorted(repr([r[names.index(c)] for c in cols]) for r in want)
    assert rows == sorted(repr(list(r)) for r in zip(*[got[c].to_pylist() for c in cols]))


def test_entry_imports_without_session():
    import subprocess
    import sys

    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True, env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"})


def one(spark, df_rows, schema, c):
    return [r[0] for r in spark.createDataFrame(df_rows, schema).select(c).collect()]


def test_german_cells(spark):
    from kontor.functions import amounts, dates

    cells = ["1.234,56", "-12,34", "12,34 €", "1 234,56", "+5", "x", ""]
    got = one(spark, [(c,) for c in cells], "c string", amounts.to_cents(amounts.parse_german_amount(F.col("c"))))
    assert got == [123456, -1234, 1234, 123456, 500, None, None]
    days = ["08.05.2026", "8.5.26", "2026-05-08", "08/05/2026", "01.01.70", "31.02.2020", ""]
    got = one(spark, [(c,) for c in days], "c string", dates.parse_german_date(F.col("c")).cast("string"))
    assert got == ["2026-05-08"] * 4 + ["1970-01-01", None, None]


def test_week_key_and_iban(spark):
    from kontor.functions import dates, iban

    assert one(spark, [("2023-01-01",), ("2024-01-01",)], "d string", dates.week_key(F.col("d").cast("date"))) == ["2023-W00", "2024-W01"]
    got = one(spark, [("de89 3704 0044 0532 0130 00",), ("DE00370400440532013000",), ("",)], "i string", iban.is_valid(iban.clean(F.col("i"))))
    assert got == [True, False, False]


def test_greedy_days():
    from kontor.operators.matching import decide_days

    made = lambda rows: decide_days(pd.DataFrame(rows, columns=["day", "ids", "n_records"]).assign(a=5), 5)
    out = made([(10, [1], 0), (11, [2], 1), (13, [], 1), (16, [], 0)])
    assert [(r.id, r.day, r.days) for r in out.itertuples()] == [(1, 11, 1), (2, 13, 2)]
    tie = made([(9, [], 1), (10, [1, 2], 0), (11, [], 1)])
    assert sorted(zip(tie.day, tie.outcome, strict=True)) == [(9, "ambiguous"), (11, "ambiguous")]
    many = made([(9, [7, 8, 9], 1), (12, [], 3)])
    assert [(r.day, r.outcome) for r in many.itertuples()] == [(9, "matched"), (12, "ambiguous")]


def test_bank_file_round_trip(spark, tmp_path):
    from kontor.sources import files

    (tmp_path / "a.csv").write_bytes("Konto;1\n\nBuchungsdatum;Betrag (€);Verwendungszweck;Zahlungsempfänger*in\n01.02.2024;-1.234,50;Miete  Mai;Müller\n;;;\n02.02.2024;bad;x;y\n".encode("cp1252"))
    good, bad = files.bank_rows(files.read_files(spark, str(tmp_path)))
    assert [(str(r.date), r.cents, r.memo, r.payee) for r in good.collect()] == [("2024-02-01", -123450, "Miete Mai", "Müller")]
    assert [r.reason for r in bad.collect()] == ["bad or missing amount"]
    assert files.whole_files_only(good, bad).count() == 0
