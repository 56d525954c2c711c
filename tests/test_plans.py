"""Plan shape: filters reach the Parquet scan, no Cartesian product, no Python UDF."""

import datetime as dt

import pytest

from conftest import SF_SMALL
from ledgerframe.params import DateRange
from ledgerframe.plans.payables import report_ap_invoices
from ledgerframe.plans.registry import QUERIES, load_all
from ledgerframe.sources.demo import erp_tables
from ledgerframe.sources.loaders import read_erp_lake, write_erp_lake


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    t = erp_tables(spark, SF_SMALL)
    write_erp_lake(t, root, names=["apca_t", "apcb_t", "pmaal_t"])
    return read_erp_lake(spark, root)


def test_ap_date_range_pushed_to_parquet(spark, lake):
    df = report_ap_invoices(lake, DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31)), supplier="7")
    plan = _plan(df)
    assert "GreaterThanOrEqual(apcadocdt,1995-03-01T00:00)" in plan
    assert "LessThan(apcadocdt,1995-04-01T00:00)" in plan
    assert "EqualTo(apca004,7)" in plan
    assert "EqualTo(apcastus,Y)" in plan


def test_prefix_filter_pushed(spark):
    load_all()
    plan = _plan(QUERIES["filter_prefix_any"](spark, SF_SMALL))
    assert "StringStartsWith(p_type,SMALL)" in plan


def test_named_parameters_fold_to_pushed_range(spark):
    load_all()
    plan = _plan(QUERIES["param_month"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate,1995-03-01T00:00)" in plan and "LessThan(o_orderdate,1995-04-01T00:00)" in plan




def test_all_plans_clean(spark):
    load_all()
    for key, build in QUERIES.items():
        plan = build(spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                    "FlatMapGroupsInPandas", "MapInPandas"):
            assert bad not in plan, f"{key}: {bad}"


def test_column_pruning_on_scan(spark):
    load_all()
    plan = _plan(QUERIES["fmt_date_mon"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_blank_text_normalised_on_write(spark, tmp_path):
    from ledgerframe.sources.loaders import Tables
    from ledgerframe.sources.schemas import ERP_SCHEMAS

    rows = [(666, "C1", "en_US", ""), (666, "C2", "en_US", "x")]
    t = Tables(["pmaal_t"], lambda n: spark.createDataFrame(rows, ERP_SCHEMAS[n]))
    write_erp_lake(t, str(tmp_path))
    back = read_erp_lake(spark, str(tmp_path))["pmaal_t"]
    assert sorted((r.pmaal001, r.pmaal004) for r in back.collect()) == [("C1", None), ("C2", "x")]
    plan = _plan(back.filter("pmaal004 = 'x'"))
    assert "EqualTo(pmaal004,x)" in plan


def test_partitioned_lake_prunes_month_folders_and_agrees(spark, tmp_path):
    from ledgerframe.params import MonthParam
    from ledgerframe.plans.costing import report_cost_ledger
    from ledgerframe.plans.gl import report_gl_expense_vouchers

    t = erp_tables(spark, SF_SMALL)
    names = ["apca_t", "apcb_t", "pmaal_t", "glap_t", "glaq_t", "ooefl_t", "glacl_t", "xcea_t", "xcbl_t", "oocql_t"]
    flat, parted = str(tmp_path / "flat"), str(tmp_path / "parted")
    write_erp_lake(t, flat, names=names)
    write_erp_lake(t, parted, names=names, files=4, partitioned=True)
    a, b = read_erp_lake(spark, flat), read_erp_lake(spark, parted)
    assert "doc_month" in b["apca_t"].columns

    march = DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31))
    df = report_ap_invoices(b, march)
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(doc_month" in plan and "(doc_month#" in plan
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, report_ap_invoices(a, march).collect()))

    period = MonthParam(1995, 3)
    gl_a = report_gl_expense_vouchers(a, period).collect()
    assert gl_a == report_gl_expense_vouchers(b, period).collect()  # same rows in the same (total) order
    ledger = report_cost_ledger(b, period)
    assert "PartitionFilters: [isnotnull(xcbl002" in _plan(ledger)
    assert sorted(map(tuple, ledger.collect())) == sorted(map(tuple, report_cost_ledger(a, period).collect()))
