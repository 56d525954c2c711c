"""Steps of the sales reports: one join's shuffles on disk at a time, and no step kept that isn't read."""

import datetime as dt
import os
import time
from decimal import Decimal

import pytest

from conftest import SF_SMALL
from ledgerframe.operators.steps import SHUFFLE_CLEANUP, forget_step, steps_folder, written_once
from ledgerframe.params import DateRange
from ledgerframe.plans.sales import report_order_fulfilment, report_tax_invoice, report_tax_invoice_by_price
from ledgerframe.sources.demo import erp_tables

MARCH = DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31))
KEPT = {report_order_fulfilment: {"notice-rows"}, report_tax_invoice: {"invoice-heads", "invoice-lines"},
        report_tax_invoice_by_price: {"invoice-heads", "invoice-lines"}}


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def _steps(spark):
    folder = steps_folder(spark).removeprefix("file:")
    return set(os.listdir(folder))


def test_a_step_leaves_no_shuffle_files(spark):
    before, conf = _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    rows = spark.range(10000).selectExpr("id % 700 AS k").groupBy("k").count()
    got = written_once(rows, "counts")
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before and spark.conf.get(SHUFFLE_CLEANUP) == conf
    assert got.count() == 700


def test_only_the_named_step_is_forgotten(spark):
    a, b = (written_once(spark.range(5), name) for name in ("first", "first2"))
    both, steps = a.unionByName(b), _steps(spark)
    forget_step(both, "first")
    gone = steps - _steps(spark)
    assert len(gone) == 1 and gone.pop().startswith("first-") and b.count() == 5


@pytest.mark.parametrize("report", KEPT, ids=lambda r: r.__name__)
def test_joins_are_steps_and_only_the_last_is_kept(spark, report):
    """At the end there is one shuffle of the lines, and nothing but its input on disk (F1, F2, F3)."""
    before = _steps(spark)
    plan = report(erp_tables(spark, SF_SMALL), MARCH)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert {x.rsplit("-", 1)[0] for x in _steps(spark) - before} == KEPT[report]


def test_fulfilment_of_repeated_notices_and_labels(erp):
    """A repeated number has all lines under each header; labels fan out; NULL orders and notices without lines stay."""
    day = lambda d: dt.datetime(1995, 3, d)
    head = [(666, n, day(d), "1", None, "C1", None, None, "C1", day(9), "Y") for n, d in (("SN1", 2), ("SN1", 3), ("SN2", 4), (None, 5))]
    lines = [(666, "SN1", o, "I1", "BAG 25KG", Decimal("4.00"), None, None, None) for o in ("SO1", None, "SO1")]
    t = erp(xmdg_t=head, xmdh_t=lines, xmda_t=[("SO1", "PO1"), ("SO1", "PO2")],
            pmaal_t=[(666, "C1", "en_US", x) for x in ("a", "b")], imaal_t=[(666, "I1", "en_US", x, None) for x in ("i", "j")],
            xmdk_t=[(666, "SH2", day(5), "SN1", "SO1"), (666, "SH1", day(6), "SN1", "SO1")],
            isag_t=[(666, "IS1", s, None, None, None, None, None, None, "SO1", None, None, None, None) for s in ("SH1", "SH2", "SH1")],
            isaf_t=[(666, "IS1", None, "IV1", None, None, None, None, None, "Y")])
    got = [(r.xmdgdocno, r.xmdgdocdt[:2], r.xmdh001, r.pmaal004, r.imaal003, r.xmda033, r.xmdkdocno, r.isag002_list, r.isaf011_list, r.unit)
           for r in report_order_fulfilment(t, MARCH).collect()]
    found, none = ("PO2", "SH1", "SH1, SH2", "IV1"), (None,) * 4
    want = [("SN1", d, o, name, item, *more, Decimal("0.025")) for d in ("02", "03")
            for o, more in (("SO1", found), ("SO1", found), (None, none)) for name in "ab" for item in "ij"]
    want += [(n, d, None, name, None, *none, Decimal(0)) for n, d in (("SN2", "04"), (None, "05")) for name in "ab"]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]  # the order
