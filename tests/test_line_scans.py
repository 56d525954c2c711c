"""Line tables: read once a report, only the months asked for, hot documents split, same rows."""

import datetime as dt
import re
from decimal import Decimal

import pytest

from conftest import SF_SMALL
from ledgerframe.operators import joins
from ledgerframe.operators.steps import steps_folder
from ledgerframe.params import DateRange, MonthParam
from ledgerframe.plans import costing
from ledgerframe.plans.costing import report_issue_cost_by_account, report_issue_cost_by_dept
from ledgerframe.plans.gl import report_gl_expense_vouchers
from ledgerframe.plans.inventory import report_misc_issue_lines
from ledgerframe.plans.payables import report_ap_invoices
from ledgerframe.plans.sales import report_order_fulfilment, report_tax_invoice, report_tax_invoice_by_price
from ledgerframe.sources.demo import erp_tables
from ledgerframe.sources.loaders import Tables, read_erp_lake, with_header_month, write_erp_lake
from ledgerframe.sources.schemas import ERP_SCHEMAS
from test_skew import SKEW_CONF, _key, _with_conf

MARCH, PERIOD = DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31)), MonthParam(1995, 3)

# report, tables that it reads as lines (or large lookups) once
REPORTS = {
    "gl": (lambda t: report_gl_expense_vouchers(t, PERIOD), ["glaq_t"]),
    "issues": (lambda t: report_misc_issue_lines(t, PERIOD), ["inbb_t"]),
    "dept": (lambda t: report_issue_cost_by_dept(t, PERIOD), ["xceb_t", "xcea_t", "inbb_t", "inba_t"]),
    "account": (lambda t: report_issue_cost_by_account(t, PERIOD), ["xcec_t", "xcea_t", "inbb_t", "inba_t"]),
    "fulfilment": (lambda t: report_order_fulfilment(t, MARCH), ["xmdh_t", "isag_t"]),
    "tax": (lambda t: report_tax_invoice(t, MARCH), ["isag_t"]),
    "tax by price": (lambda t: report_tax_invoice_by_price(t, MARCH), ["isag_t"]),
    "payables": (lambda t: report_ap_invoices(t, MARCH), ["apcb_t"]),
}


@pytest.fixture(scope="module")
def lakes(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lakes"))
    t = erp_tables(spark, SF_SMALL)
    write_erp_lake(t, f"{root}/flat")
    write_erp_lake(read_erp_lake(spark, f"{root}/flat"), f"{root}/months", partitioned=True, files=2)
    return read_erp_lake(spark, f"{root}/flat"), read_erp_lake(spark, f"{root}/months")


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that a report writes on its way."""
    seen, write = [], joins.written_once

    def noted(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(joins, "written_once", noted)
    monkeypatch.setattr(costing, "written_once", noted)
    return seen


@pytest.mark.parametrize("name", REPORTS)
def test_lines_are_scanned_once_and_by_month(lakes, plans, name):
    report, once = REPORTS[name]
    flat, months = lakes
    df = report(months)
    every = plans + [df._jdf.queryExecution().executedPlan().toString()]
    scans = [line for plan in every for line in plan.splitlines() if "FileScan" in line]
    for table in once:
        own = [s for s in scans if re.search(rf"/{table}[\],]", s)]
        # payables use their rows once and stay lazy: their second scan reads the month's keys only
        assert len(own) == (2 if name == "payables" else 1), (name, table, len(own))
        assert name != "payables" or sum("struct<apcbent:int,apcbdocno:string>" in s for s in own) == 1
        if table in ("glaq_t", "inbb_t", "isag_t", "xmdh_t", "apcb_t") and table == once[0]:
            assert all(re.search(r"PartitionFilters: \[[^]]*doc_month#\d+ >= 199503", s) for s in own), own
    assert sorted(map(str, df.collect())) == sorted(map(str, report(flat).collect()))


def test_line_months(spark):
    head = spark.createDataFrame(
        [("A", dt.datetime(1995, 3, 5)), ("A", dt.datetime(1995, 3, 9)), ("B", dt.datetime(1995, 3, 31)),
         ("B", dt.datetime(1995, 4, 1)), ("C", None), (None, dt.datetime(1995, 3, 1))],
        "apcadocno string, apcadocdt timestamp_ntz")
    lines = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), ("C", 4), ("D", 5), (None, 6)], "apcbdocno string, n int")
    got = with_header_month(lines, "apcb_t", {"apca_t": head})
    assert {(r.n, r.doc_month) for r in got.collect()} == {(1, 199503), (2, 199503), (3, 0), (4, -1), (5, -1), (6, -1)}


def test_a_document_of_two_months_keeps_its_lines(spark, tmp_path):
    """A repeated number with headers in March and April: both headers keep all lines under pruning."""
    rows = {
        "apca_t": [(666, "A", dt.datetime(1995, m, 5), "17", "S", None, None, "Y") for m in (3, 4)]
        + [(666, "E", dt.datetime(1995, 3, 6), "17", "S", None, None, "Y")],
        "apcb_t": [(666, "A", None, str(i), None, None, 1, None, None, None, None, None) for i in range(3)],
    }
    t = Tables(list(ERP_SCHEMAS), lambda n: spark.createDataFrame(rows.get(n, []), ERP_SCHEMAS[n]))
    write_erp_lake(t, str(tmp_path), names=["apca_t", "apcb_t", "pmaal_t"], partitioned=True)
    got = report_ap_invoices(read_erp_lake(spark, str(tmp_path)), MARCH).collect()
    assert sorted((r.apcadocno, r.apcb004 or "") for r in got) == [("A", "0"), ("A", "1"), ("A", "2"), ("E", "")]


def test_hot_document_is_split_where_lines_are_read_once(spark):
    head = spark.createDataFrame([("HOT", 1), ("B", 2), ("C", 3), (None, 4)], "doc string, h int")
    lines = spark.createDataFrame([("HOT", i) for i in range(20000)] + [("B", 1), ("X", 0)], "ldoc string, n int").repartition(8)

    def run():
        inner = joins.matched_lines(head, lines, ["doc"], ["ldoc"])
        inner.collect()
        got = joins.lines_of_headers(head, lines, ["doc"], ["ldoc"]).collect()
        return inner._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, got), key=_key)

    plan, got = _with_conf(spark, SKEW_CONF, run)
    want = sorted(map(tuple, head.join(lines, head.doc == lines.ldoc, "left").collect()), key=_key)
    assert "skew=true" in plan and got == want


def test_steps_need_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        steps_folder(Session())


def test_fulfilment_sort_computes_its_joins_once(lakes):
    """A range sort would run everything below it a second time to sample it."""
    plan = report_order_fulfilment(lakes[1], MARCH)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_tax_invoice_deals_out_lines_with_their_units_once(spark):
    """One shuffle by ranges serves groups and order (F1, F2): none by the wide grouping columns."""
    for report in (report_tax_invoice, report_tax_invoice_by_price):
        plan = report(erp_tables(spark, SF_SMALL), MARCH)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange rangepartitioning\(isaf011", plan)) == 1
        assert not re.search(r"Exchange hashpartitioning\(isaf011#\d+, formatted_date", plan)
        assert plan.index("explode(units") < plan.index("Exchange rangepartitioning(isaf011")  # printed from the last step down


def test_units_of_a_notice_in_several_lists(erp, monkeypatch):
    """More units than a list holds give the same sums as one row for each notice line."""
    from ledgerframe.plans import sales

    monkeypatch.setattr(sales, "UNITS_PER_ROW", 2)
    day = dt.datetime(1995, 3, 5)
    head = [(666, "IS1", "C1", "IV1", day, "TAX", "Buyer", "USD", None, "Y"), (666, "IS2", "C1", "IV2", day, "TAX", "Buyer", "USD", None, "Y")]
    amounts = [Decimal(x) for x in ("1.00", "10.00", "1.00", "11.00")]
    line = (666, "IS1", "SH1", Decimal("3.00"), "I1", "w", "RT1", "F", "goods", "SO1", *amounts)
    packed = ["BAG 25KG", "BAG 50KG", "BAG 75KG", "BAG 100KG", "BAG 100KG", None, "LOOSE"]
    t = erp(isaf_t=head, isag_t=[line], xmdl_t=[(666, "SH1", "SN1", "SO1")] * 2, xmda_t=[("SO1", "PO1")],
            xmdh_t=[(666, "SN1", "SO1", "I1", p, None, None, None, None) for p in packed])
    got = [(r.isaf011, r.unit, r.isag103, r.isag004, r.xmdl001, r.xmda033) for r in report_tax_invoice(t, MARCH).collect()]
    none = [("IV1", Decimal(u), Decimal(a), Decimal(q), "SN1", "PO1")
            for u, a, q in (("0", "40.00", "12.00"), ("0.025", "20.00", "6.00"), ("0.050", "20.00", "6.00"), ("0.075", "20.00", "6.00"), ("0.100", "40.00", "12.00"))]
    assert sorted(got[:5], key=lambda x: x[1]) == none
    assert got[5:] == [("IV2", Decimal(0), None, None, None, None)]


def test_join_chain_joins_lines_last(spark):
    """The rows that a line makes with its order's notice lines are not shuffled or sorted again (F4)."""
    from ledgerframe.plans.keys_ops import join_chain

    plan = join_chain(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    first_join = next(x for x in plan.splitlines() if "Join LeftOuter" in x)
    assert "isag002" in first_join and "xmdldocno" in first_join
