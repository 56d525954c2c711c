"""Trap tests on hand-made ERP rows."""

import datetime as dt
from decimal import Decimal as D

from ledgerframe.params import DateRange, MonthParam
from ledgerframe.plans.costing import report_cost_ledger, report_issue_cost_by_dept
from ledgerframe.plans.gl import report_gl_expense_vouchers
from ledgerframe.plans.inventory import report_misc_issue_lines
from ledgerframe.plans.payables import report_ap_invoices
from ledgerframe.plans.sales import report_order_fulfilment, report_tax_invoice, report_tax_invoice_by_price

T = dt.datetime
MARCH = MonthParam(1995, 3)


def _ap_tables(erp):
    head = [
        (666, "AP-1", T(1995, 1, 31, 10), "01", "C1", None, "1-URGENT", "Y"),
        (666, "AP-2", T(1995, 2, 1, 23), "17", "C1", None, "2-HIGH", "Y"),   # end day, 23:00: kept
        (666, "AP-3", T(1995, 2, 1, 9), "99", "C2", None, "5-LOW", "N"),     # not confirmed
        (100, "AP-4", T(1995, 2, 1, 9), "99", "C2", None, "5-LOW", "Y"),     # other tenant
        (666, "AP-5", T(1995, 2, 2, 0), "29", "C2", None, "5-LOW", "Y"),     # after the range
    ]
    line = lambda doc, qty, sign: (666, doc, "F", "ITEM", "R", D(qty), sign, "S1", D("10.00"), D("10.00"),
                                   D("0.50"), D("10.00"))
    lines = [line("AP-1", "5.00", -1), line("AP-1", "5.00", -1), line("AP-2", "2.00", 1), line("AP-2", "3.00", 1)]
    names = [(666, "C1", "en_US", "Cust One"), (666, "C1", "zh_TW", "Cust One zh")]
    return erp(apca_t=head, apcb_t=lines, pmaal_t=names)


def test_ap_invoices_range_sign_labels_and_day_first_sort(erp):
    t = _ap_tables(erp)
    rows = report_ap_invoices(t, DateRange(dt.date(1995, 1, 31), dt.date(1995, 2, 1))).collect()
    assert [(r.apcadocno, r.apcadocdt) for r in rows] == [
        ("AP-2", "01/02/1995"), ("AP-2", "01/02/1995"), ("AP-1", "31/01/1995")]  # O3: text order, day first
    ap1 = [r for r in rows if r.apcadocno == "AP-1"]
    assert len(ap1) == 1 and ap1[0].apcb007 == D("-10.00") and ap1[0].apcb101 == D("-20.00")  # A2 sign
    assert ap1[0].branch_no == "01:AP  Estimations"  # T14: two spaces kept
    assert {r.branch_no for r in rows} == {"01:AP  Estimations", "17:Invoice Payable"}
    assert {r.apcb007 for r in rows if r.apcadocno == "AP-2"} == {D("2.00"), D("3.00")}  # A6 hidden key
    assert {r.pmaal004 for r in rows} == {"Cust One"}


def test_ap_invoices_supplier_filter(erp):
    t = _ap_tables(erp)
    r = DateRange(dt.date(1995, 1, 1), dt.date(1995, 12, 31))
    assert {x.apcadocno for x in report_ap_invoices(t, r, supplier="C2").collect()} == {"AP-5"}
    assert {x.apcadocno for x in report_ap_invoices(t, r).collect()} == {"AP-1", "AP-2", "AP-5"}
    nameless = [x for x in report_ap_invoices(t, r).collect() if x.apcadocno == "AP-5"]
    assert nameless[0].pmaal004 is None and nameless[0].apcb007 is None and nameless[0].branch_no == \
        "29:Other expect offset form"


def test_misc_issue_closed_month_and_status(erp):
    head = [
        (666, "TS-IN010-1", "1", T(1995, 3, 31, 0), "3", "4", None, "F"),
        (666, "TS-IN010-2", "1", T(1995, 3, 31, 23), "3", "4", "1-URGENT", "F"),  # T5: dropped
        (666, "TS-IN010-3", "1", T(1995, 3, 15), "3", "4", "1-URGENT", None),     # NULL status: dropped
        (666, "TS-IN010-4", "1", T(1995, 3, 10), "3", "4", "1-URGENT", "X"),      # void
        (666, "TS-IN010-5", "2", T(1995, 3, 10), "3", "4", "1-URGENT", "F"),      # other kind
    ]
    t = erp(inba_t=head)
    rows = report_misc_issue_lines(t, MARCH).collect()
    assert [(r.inbadocno, r.inba008, r.inbb020) for r in rows] == [("TS-IN010-1", " ", " ")]


def test_gl_vouchers_evening_null_doc_excluded_doc_and_trim(erp):
    t = erp(
        glap_t=[("GL-1", T(1995, 3, 31, 23), "S"), ("GL-2", T(1995, 3, 5), "S"), ("GL-3", T(1995, 3, 5), "S"),
                ("GL-4", T(1995, 3, 6), "N")],
        glaq_t=[("GL-1", "AF", "6200 ", D("100.00"), D("0.00"), "1"), ("GL-2", "AF", "6100", D("50.00"), D("0.00"), "1"),
                ("GL-2", "AF", "6100", D("50.00"), D("0.00"), "1"),  # T13: equal lines merge
                ("GL-3", "AF", "7100", D("10.00"), D("0.00"), "1"), ("GL-2", "AF", "1100", D("1.00"), D("0.00"), "1"),
                ("GL-4", "AF", "6100", D("1.00"), D("0.00"), "1"), ("GL-2", "AF", "6100", D("9.00"), D("0.00"), "2")],
        ooefl_t=[(666, "1", "en_US", "DEPT", "Dept/en"), (666, "1", "zh_TW", "DEPT", "Dept/zh"),
                 (666, "2", "zh_TW", "D2", "D2/zh")],
        glacl_t=[("6200", "zh_TW", None), ("6200", "en_US", "Rent"), ("6100", "zh_TW", "Sal zh"),
                 ("6100", "en_US", "Sal")],
        apca_t=[(666, "AP-9", T(1995, 3, 1), "01", "C", "GL-2", "x", "Y"),
                (666, "AP-8", T(1995, 3, 1), "01", "C", "GL-2", "x", "Y")],
        xcea_t=[("XC090-3", 1995, 3, "GL-3"), ("XC-2", 1995, 3, "GL-2")],
    )
    rows = report_gl_expense_vouchers(t, MARCH).collect()
    got = [(r.glaq002, r.glacl004, r.glaqdocno, r.glapdocdt, r.ooefl004, r.docno, r.glaq003) for r in rows]
    assert got == [
        ("6100", "Sal", "GL-2", "05/03/1995", "Dept/en", "AP-8", D("50.00")),
        ("6200 ", "Rent", "GL-1", "31/03/1995", "Dept/en", None, D("100.00")),
    ]


def test_cost_ledger_label_tie_break(erp):
    t = erp(
        xcbl_t=[("C1", "L1", "TF", 1995, 3, "AP-1", "1-URGENT", "A", "1", D("5.00")),
                ("C1", "L1", "TF", 1995, 4, "AP-2", "1-URGENT", "A", "1", D("5.00"))],
        ooefl_t=[(666, "1", "zh_TW", "ZH", "x"), (666, "1", "en_US", "EN", "y")],
        oocql_t=[(666, "300", "A", "en_US", "A/300"), (666, "216", "A", "en_US", "A/216"),
                 (666, "216", "A", "zh_TW", "A/216/zh")],
    )
    rows = report_cost_ledger(t, MARCH).collect()
    assert [(r.xcbl004, r.ooefl003, r.oocql004) for r in rows] == [("AP-1", "EN", "A/216")]


def test_issue_cost_max_over_fanout(erp):
    t = erp(
        xcea_t=[("XC-1", 1995, 3, None), ("XC-1", 1995, 3, None), ("XC-2", 1995, 4, None)],
        xceb_t=[("XC-1", "TS-IN010-1", 1, "P1", "6100", "1", "A", D("1.00"), D("9.00")),
                ("XC-1", "TS-IN500-1", 2, "P1", "6100", "1", "A", D("1.00"), D("9.00")),   # prefix not listed
                ("XC-2", "TS-IN010-2", 1, "P1", "6100", "1", "A", D("1.00"), D("9.00"))],  # other month
        imaal_t=[(666, "P1", "en_US", "b-en", "t1"), (666, "P1", "zh_TW", "a-zh", "t2")],
        inbb_t=[(666, "TS-IN010-1", "P1", "PCS", D("1.00"), "A", None), (666, "TS-IN010-1", "P1", "PCS", D("1.00"), "A", "O")],
        ooff_t=[("aint301", "TS-IN010-1", 1, "note A"), ("other", "TS-IN010-1", 1, "zzz")],
        ooefl_t=[(666, "1", "en_US", "D", "D/en"), (666, "1", "zh_TW", "D", "D/zh")],
    )
    rows = report_issue_cost_by_dept(t, MARCH).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.xceb001, r.imaal003, r.imaal004, r.inbb020, r.ooff013, r.ooefl004, r.inba008) == \
        ("TS-IN010-1", "b-en", "t2", "O", "note A", "D/zh", None)


def test_order_fulfilment_short_item_and_base_date_sort(erp):
    head = [
        (666, "SN-2", T(1995, 2, 1), "1", "1", "C1", "1-URGENT", "A", "C1", T(1995, 2, 3), "Y"),
        (666, "SN-1", T(1995, 1, 31), "1", "1", "C1", "1-URGENT", "A", "C1", T(1995, 2, 3), "Q"),
    ]
    lines = [(666, "SN-1", "SO-1", "123", "BAG 25KG 2", D("4.00"), D("4.00"), "R", "F"),
             (666, "SN-2", "SO-2", "00001234", None, D("3.00"), D("3.00"), "R", "F")]
    t = erp(xmdg_t=head, xmdh_t=lines)
    rows = report_order_fulfilment(t, DateRange(dt.date(1995, 2, 1), dt.date(1995, 2, 28))).collect()
    assert [r.xmdgdocno for r in rows] == ["SN-1", "SN-2"]  # O4: raw date order, 31 Jan first
    assert [r.xmdh006_last6 for r in rows] == [None, "001234"]
    assert [(r.unit, r.calc_qty) for r in rows] == [(D("0.025"), D("0.10000")), (D("0.000"), D("0.00000"))]
    assert [r.status_desc for r in rows] == ["Q", "Confirmed"]  # P3 pass-through


def _tax_tables(erp):
    head = [(666, "IS-1", "C1", "IV00000001", T(1995, 3, 1), "TAX1", "Buyer", "USD", D("35.5000"), "Y"),
            (666, "IS-2", "C1", "F00000002", T(1995, 3, 2), "TAX1", "Buyer", "THB", D("1.0000"), "Y")]
    line = lambda doc: (666, doc, "SH-1", D("5.00"), "P1", "waste R", "RT-1", "F", "goods R", "SO-1",
                        D("0.10"), D("100.00"), D("7.00"), D("107.00"))
    xrce = [("F00000002", None, "RC-1"), ("F00000002", "A", "RC-2")]
    return erp(isaf_t=head, isag_t=[line("IS-1")] * 3 + [line("IS-2")], xrce_t=xrce)


def test_tax_invoice_sum_of_key_and_lists(erp):
    t = _tax_tables(erp)
    r = DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31))
    r7 = {x.isaf011: x for x in report_tax_invoice(t, r).collect()}
    r8 = {x.isaf011: x for x in report_tax_invoice_by_price(t, r).collect()}
    assert r7["IV00000001"].isag004 == D("15.00") and r8["IV00000001"].isag004 == D("5.00")  # A7
    assert r7["IV00000001"].isag103 == D("300.00") == r8["IV00000001"].isag103
    assert r7["F00000002"].xmdl001 == ",RC-1A,RC-2"  # A8 + T9: NULL code leaves a leading comma
    assert r7["F00000002"].isag017 == "waste R" and r7["F00000002"].pmao010 == "WASTE"
    assert r7["IV00000001"].branch_no == "HEAD OFFICE" and r7["IV00000001"].unit == D("0.000")
    assert r7["IV00000001"].formatted_date == "01 Mar 1995"
    assert "isaf100" in report_tax_invoice(t, r).columns and "isaf100" not in report_tax_invoice_by_price(t, r).columns


def test_strict_entity_restricts_what_the_source_leaves_open(erp):
    # T1: by default a second tenant's rows are used where the source has no tenant filter.
    t = erp(
        xcbl_t=[("C1", "L1", "TF", 1995, 3, "AP-1", "1-URGENT", "A", "1", D("5.00"))],
        ooefl_t=[(100, "1", "en_US", "AAA other tenant", "x"), (666, "1", "en_US", "EN", "y")],
        oocql_t=[(666, "216", "A", "en_US", "A/216")],
    )
    assert report_cost_ledger(t, MARCH).first().ooefl003 == "AAA other tenant"
    assert report_cost_ledger(t, MARCH, strict_entity=True).first().ooefl003 == "EN"

    tax = _tax_tables(erp)
    head = [(100, "IS-9", "C1", "IV00000009", T(1995, 3, 3), "TAX1", "Buyer", "USD", D("35.5000"), "Y")]
    line = (666, "IS-9", "SH-9", D("1.00"), "P1", "w", "RT-9", "F", "g", "SO-9", D("0.10"), D("1.00"),
            D("0.07"), D("1.07"))
    t2 = erp(isaf_t=[tuple(r) for r in tax["isaf_t"].collect()] + head,
             isag_t=[tuple(r) for r in tax["isag_t"].collect()] + [line],
             xrce_t=[tuple(r) for r in tax["xrce_t"].collect()])
    r = DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31))
    assert "IV00000009" in {x.isaf011 for x in report_tax_invoice(t2, r).collect()}
    assert "IV00000009" not in {x.isaf011 for x in report_tax_invoice(t2, r, strict_entity=True).collect()}


def test_order_by_several_columns_puts_nulls_last(erp):
    def head(doc, staff, dept, day):
        return (666, doc, "1", T(1995, 3, day), staff, dept, None, "F")

    t = erp(inba_t=[head("A", "b", None, 1), head("B", "a", "D2", 2), head("C", None, "D1", 3), head("D", "z", "D1", 4)])
    assert [r.inbadocno for r in report_misc_issue_lines(t, MARCH).collect()] == ["D", "C", "B", "A"]  # O1


def test_order_by_account_then_date_text(erp):
    t = erp(
        glap_t=[("GL-1", T(1995, 3, 31), "S"), ("GL-2", T(1995, 3, 5), "S"), ("GL-3", T(1995, 3, 1), "S")],
        glaq_t=[(doc, "AF", acct, D("1.00"), D("0.00"), "1") for doc, acct in (("GL-1", "6100"), ("GL-2", "6100"), ("GL-3", "6200"))],
        ooefl_t=[(666, "1", "en_US", "DEPT", "Dept/en")],
    )
    assert [r.glaqdocno for r in report_gl_expense_vouchers(t, MARCH).collect()] == ["GL-2", "GL-1", "GL-3"]  # O2


def test_order_by_invoice_puts_nulls_last(erp):
    head = [(666, f"IS-{i}", "C1", number, T(1995, 3, i), "TAX1", "Buyer", "USD", D("1.0000"), "Y")
            for i, number in ((1, "IV2"), (2, None), (3, "IV1"))]
    days = DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31))
    assert [r.isaf011 for r in report_tax_invoice(erp(isaf_t=head), days).collect()] == ["IV1", "IV2", None]  # O5
