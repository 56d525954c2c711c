"""Operator keys: each operator on the driver's tables or on the ERP tables
Spark derives from them, with DuckDB text computing the same rows.

Every key reads whole tables; parameters (a month, a day range, a supplier) are the
operator's own feature.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import (
    by_prefix,
    concat_null_safe,
    date_text,
    date_text_mon,
    decode,
    decode_passthrough,
    last_chars,
    normalised_key,
    nvl,
    per_thousand,
)
from ..functions.predicates import (
    closed_month,
    day_range,
    equals_optional,
    for_entity,
    in_month,
    not_contains_or_null,
    not_in,
    starts_with_any,
)
from ..operators.joins import drop_null_keys, left_join_lines
from ..operators.lookups import first_per_key, list_per_key, max_per_key
from ..params import DateRange
from ..sinks import relabel, rows_as_arrays, rows_as_objects
from ..sources.demo import erp_tables
from ..sources.loaders import read_driver_tables
from .checks import FANOUT_LOOKUPS, fanout_filter, fanout_report, missing_labels
from .costing import report_cost_ledger
from .gl import GL_EXPORT_LABELS, account_titles, report_gl_expense_vouchers
from .inventory import MISC_COLUMNS, report_misc_issue_lines
from .keys_reports import _UNIT_SQL, REPORT_DATES, REPORT_MONTH, _cost_ledger, _misc_issues, _payables, _vouchers
from .oracle import with_fixtures, with_steps
from .payables import AP_KIND_OTHER, AP_KINDS, report_ap_invoices
from .registry import register
from .sales import NOTICE_STATUS, branch_text, settlement_lists, shipment_lookups

# Fixed operator parameters.
MONTH = REPORT_MONTH
DAYS = DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31))


def _drv(spark: SparkSession, sf_dir: str):
    return read_driver_tables(spark, sf_dir)


def _erp(spark: SparkSession, sf_dir: str):
    return erp_tables(spark, sf_dir)


def _ts(day: dt.date) -> str:
    return f"TIMESTAMP '{day.isoformat()}'"


_M = {"month": MONTH.month, "year": MONTH.year}

# ======================================================================= sources and sinks


@register("scan_project", """
SELECT o_orderkey AS order_no, o_custkey AS customer_no, o_orderdate AS order_date,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderpriority AS priority
FROM orders""")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _drv(spark, sf_dir)["orders"]
    return o.select(F.col("o_orderkey").alias("order_no"), F.col("o_custkey").alias("customer_no"),
                    F.col("o_orderdate").alias("order_date"),
                    F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
                    F.col("o_orderpriority").alias("priority"))


@register("param_month", f"""
SELECT o_orderkey, o_orderdate FROM orders
WHERE month(o_orderdate) = {MONTH.month} AND year(o_orderdate) = {MONTH.year}""")
def param_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parameters bound into SQL (``:year``, ``:month``), folded to a pushed range."""
    o = _drv(spark, sf_dir)["orders"]
    return spark.sql(
        "SELECT o_orderkey, o_orderdate FROM {orders} "
        "WHERE o_orderdate >= make_timestamp_ntz(:year, :month, 1, 0, 0, 0) "
        "AND o_orderdate < make_timestamp_ntz(:year, :month, 1, 0, 0, 0) + INTERVAL 1 MONTH",
        args={"year": MONTH.year, "month": MONTH.month}, orders=o)


@register("month_bounds", """
SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER), 1) AS month_first,
       last_day(o_orderdate) AS month_last
FROM orders""")
def month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _drv(spark, sf_dir)["orders"]
    d = F.col("o_orderdate")
    return o.select("o_orderkey", F.make_date(F.year(d), F.month(d), F.lit(1)).alias("month_first"),
                    F.last_day(d).alias("month_last"))


def _trim_num(c: str) -> str:
    return f"json(regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '0+$', ''), '[.]$', ''))"


@register("rows_as_array", with_fixtures(f"""
SELECT CAST(json_array(xcblcomp, xcblld, xcbl002, xcbl003, xcbl004, xcbl001, xcbl005, xcbl010, oocql004,
                       xcbl012, ooefl003, {_trim_num('xcbl100')}) AS VARCHAR) AS row
FROM ({_cost_ledger(REPORT_MONTH)[1]})""", _cost_ledger(REPORT_MONTH)[0]))
def rows_as_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_as_arrays(report_cost_ledger(_erp(spark, sf_dir), MONTH))


def _dated_array_sql() -> str:
    shown = {"inba002": "strftime(inba002, '%Y-%m-%dT%H:%M:%S.%gZ')", "inbb012": _trim_num("inbb012")}
    steps, body = _misc_issues(REPORT_MONTH)
    return with_fixtures(f"SELECT CAST(json_array({', '.join(shown.get(c, c) for c in MISC_COLUMNS)}) AS VARCHAR) AS row FROM ({body})", steps)


@register("rows_as_array_dated", _dated_array_sql())
def rows_as_array_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional rows of a report that shows a raw date and time."""
    return rows_as_arrays(report_misc_issue_lines(_erp(spark, sf_dir), MONTH, ordered=False))


@register("rows_as_object", with_fixtures(f"""
SELECT CAST(json_object('APCADOCNO', apcadocno, 'APCADOCDT', apcadocdt, 'BRANCH_NO', branch_no,
                        'APCA004', apca004, 'PMAAL004', pmaal004, 'APCB002', apcb002, 'APCB004', apcb004,
                        'APCB005', apcb005, 'APCB007', {_trim_num('apcb007')}, 'APCB101', {_trim_num('apcb101')},
                        'APCB103', {_trim_num('apcb103')}, 'APCB104', {_trim_num('apcb104')},
                        'APCB105', {_trim_num('apcb105')}, 'APCA053', apca053, 'APCB028', apcb028) AS VARCHAR) AS row
FROM ({_payables(REPORT_DATES)[1]})""", _payables(REPORT_DATES)[0]))
def rows_as_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_as_objects(report_ap_invoices(_erp(spark, sf_dir), REPORT_DATES, ordered=False))


def _labelled_gl_sql() -> str:
    cols = ["glaq002", "glacl004", "glaqdocno", "glapdocdt", "glaq018", "ooefl004", "docno", "glaq001",
            "glaq003", "glaq004"]
    sel = ", ".join(f'{c} AS "{label}"' for c, label in zip(cols, GL_EXPORT_LABELS))
    steps, body = _vouchers(REPORT_MONTH)
    return with_fixtures(f"SELECT {sel} FROM ({body})", steps)


@register("export_labelled", _labelled_gl_sql())
def export_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voucher report under its ten spreadsheet headers (the writer adds year/month folders)."""
    return relabel(report_gl_expense_vouchers(_erp(spark, sf_dir), MONTH, ordered=False), GL_EXPORT_LABELS)


# ======================================================================= projections and predicates


@register("case_decode", with_fixtures("""
SELECT apcadocno, CASE apca001 WHEN '01' THEN '01:AP  Estimations' WHEN '17' THEN '17:Invoice Payable'
       WHEN '19' THEN '19:Other Payment Order' WHEN '29' THEN '29:Other expect offset form'
       ELSE 'NOT Match' END AS branch_no
FROM apca_t"""))
def case_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["apca_t"].select("apcadocno", decode("apca001", AP_KINDS, AP_KIND_OTHER).alias("branch_no"))


@register("case_passthrough", with_fixtures("""
SELECT inbadocno, CASE WHEN inbastus = 'X' THEN 'Voided' WHEN inbastus = 'Y' THEN 'Confirmed'
       WHEN inbastus = 'H' THEN 'Holding' ELSE inbastus END AS status_desc
FROM inba_t"""))
def case_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["inba_t"].select(
        "inbadocno", decode_passthrough("inbastus", NOTICE_STATUS).alias("status_desc"))


@register("case_null_token", with_steps(
    # a table of branch texts instead of a CASE: NULL is looked up as the text that stands for it
    branch="""SELECT * FROM (VALUES ('NULL', 'HEAD OFFICE'), ('R0001', 'BRANCH NO.00001'), ('R0002', 'BRANCH NO.00002'),
              ('R0003', 'BRANCH NO.00003'), ('R0006', 'BRANCH NO.00006'), ('R0007', 'BRANCH NO.00007')) AS v(code, text)""",
    partner="SELECT pmaa001, ifnull(pmaa006, 'NULL') AS code FROM pmaa_t",
    result="SELECT pmaa001, ifnull(text, 'NOT Match') AS branch_no FROM partner LEFT JOIN branch USING (code)"))
def case_null_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["pmaa_t"].select("pmaa001", branch_text("pmaa006").alias("branch_no"))


@register("case_prefix_source", with_fixtures("""
SELECT isafdocno,
       CASE WHEN isaf011 LIKE 'F%' THEN isaf022 WHEN isaf011 LIKE 'CN%' THEN isaf021 ELSE isaf002 END AS source_text,
       CASE WHEN isaf011 LIKE 'F%' THEN 'WASTE' ELSE isaf100 END AS kind
FROM isaf_t"""))
def case_prefix_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["isaf_t"].select(
        "isafdocno",
        by_prefix("isaf011", [("F", "isaf022"), ("CN", "isaf021")], "isaf002").alias("source_text"),
        by_prefix("isaf011", [("F", F.lit("WASTE"))], "isaf100").alias("kind"))


@register("unit_quantity", with_fixtures(f"""
SELECT xmdhdocno, xmdh001, xmdh015, {_UNIT_SQL.format(c='xmdh015')} AS unit,
       CAST({_UNIT_SQL.format(c='xmdh015')} * COALESCE(xmdh016, 0) AS DECIMAL(38,5)) AS calc_qty
FROM xmdh_t"""))
def unit_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = per_thousand("xmdh015")
    return _erp(spark, sf_dir)["xmdh_t"].select(
        "xmdhdocno", "xmdh001", "xmdh015", unit.alias("unit"),
        (unit * F.coalesce(F.col("xmdh016"), F.lit(0))).cast("decimal(38,5)").alias("calc_qty"))


@register("filter_eq", with_fixtures("SELECT isafdocno, isaf011 FROM isaf_t WHERE isafstus = 'Y'"))
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["isaf_t"].filter(F.col("isafstus") == "Y").select("isafdocno", "isaf011")


@register("filter_prefix_any", """
SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'SMALL%' OR p_type LIKE 'STANDARD%' OR p_type LIKE 'PROMO%'""")
def filter_prefix_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _drv(spark, sf_dir)["part"]
    return p.filter(starts_with_any("p_type", ["SMALL", "STANDARD", "PROMO"])).select("p_partkey", "p_type")


_DOCNO_SQL = """
SELECT a.glaqdocno, a.glaq002, COALESCE(e.apcadocno, f.xceadocno) AS docno
FROM glaq_t a
LEFT JOIN (SELECT apca038, apcadocno FROM (
             SELECT apca038, apcadocno, ROW_NUMBER() OVER (PARTITION BY apca038 ORDER BY apcadocno NULLS LAST) AS rn
             FROM apca_t) WHERE rn = 1) e ON a.glaqdocno = e.apca038
LEFT JOIN (SELECT xcea101, xceadocno FROM (
             SELECT xcea101, xceadocno, ROW_NUMBER() OVER (PARTITION BY xcea101 ORDER BY xceadocno NULLS LAST) AS rn
             FROM xcea_t) WHERE rn = 1) f ON a.glaqdocno = f.xcea101
"""


def _source_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    pay = first_per_key(drop_null_keys(t["apca_t"], ["apca038"]), ["apca038"], ["apcadocno"], ["apca038", "apcadocno"])
    cost = first_per_key(drop_null_keys(t["xcea_t"], ["xcea101"]), ["xcea101"], ["xceadocno"], ["xcea101", "xceadocno"])
    return (t["glaq_t"].join(pay, F.col("glaqdocno") == F.col("apca038"), "left")
            .join(cost, F.col("glaqdocno") == F.col("xcea101"), "left")
            .select("glaqdocno", "glaq002", F.coalesce("apcadocno", "xceadocno").alias("docno")))


@register("coalesce_docs", with_fixtures(_DOCNO_SQL))
def coalesce_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_docs(spark, sf_dir)


@register("filter_not_contains_or_null", with_fixtures(
    f"SELECT * FROM ({_DOCNO_SQL}) WHERE docno NOT LIKE '%XC090%' OR docno IS NULL"))
def filter_not_contains_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_docs(spark, sf_dir).filter(not_contains_or_null("docno", "XC090"))


@register("filter_not_in", with_fixtures("SELECT inbadocno, inbastus FROM inba_t WHERE inbastus NOT IN ('X')"))
def filter_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["inba_t"].filter(not_in("inbastus", ["X"])).select("inbadocno", "inbastus")


@register("filter_between", with_fixtures(
    f"SELECT inbadocno, inba002 FROM inba_t WHERE inba002 BETWEEN {_ts(MONTH.first_day)} AND {_ts(MONTH.last_day)}"))
def filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["inba_t"].filter(closed_month("inba002", MONTH)).select("inbadocno", "inba002")


@register("filter_day_range", f"""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= {_ts(DAYS.start)} AND o_orderdate < {_ts(DAYS.end)} + INTERVAL 1 DAY""")
def filter_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _drv(spark, sf_dir)["orders"]
    return o.filter(day_range("o_orderdate", DAYS)).select("o_orderkey", "o_orderdate")


@register("filter_month", with_fixtures(f"""
SELECT glapdocno, glapdocdt, CAST(month(glapdocdt) AS INTEGER) AS period_month,
       CAST(year(glapdocdt) AS INTEGER) AS period_year
FROM glap_t WHERE strftime(glapdocdt, '%m') = '{MONTH.month:02d}' AND strftime(glapdocdt, '%Y') = '{MONTH.year}'"""))
def filter_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _erp(spark, sf_dir)["glap_t"].filter(in_month("glapdocdt", MONTH))
    return g.select("glapdocno", "glapdocdt", F.month("glapdocdt").alias("period_month"),
                    F.year("glapdocdt").alias("period_year"))


@register("filter_optional_none", with_fixtures(
    "SELECT apcadocno, apca004 FROM apca_t WHERE (CAST(NULL AS VARCHAR) IS NULL OR apca004 = CAST(NULL AS VARCHAR))"))
def filter_optional_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equals_optional(_erp(spark, sf_dir)["apca_t"], "apca004", None).select("apcadocno", "apca004")


@register("filter_entity", with_fixtures("SELECT apcadocno, apcaent FROM apca_t WHERE apcaent = 666"))
def filter_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_entity(_erp(spark, sf_dir)["apca_t"], "apcaent", 666).select("apcadocno", "apcaent")


# ======================================================================= joins


@register("join_left", with_fixtures("""
SELECT a.glaqdocno, a.glaq002, e.apcadocno FROM glaq_t a LEFT JOIN apca_t e ON a.glaqdocno = e.apca038"""))
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    return (t["glaq_t"].join(t["apca_t"], F.col("glaqdocno") == F.col("apca038"), "left")
            .select("glaqdocno", "glaq002", "apcadocno"))


@register("join_left_composite", with_fixtures("""
SELECT b.isagdocno, b.isag002, b.isag019, e.xmdl001
FROM isag_t b LEFT JOIN xmdl_t e ON b.isag002 = e.xmdldocno AND b.isag019 = e.xmdl003"""))
def join_left_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    cond = (F.col("isag002") == F.col("xmdldocno")) & (F.col("isag019") == F.col("xmdl003"))
    return t["isag_t"].join(t["xmdl_t"], cond, "left").select("isagdocno", "isag002", "isag019", "xmdl001")


@register("join_left_on_filter", with_steps(
    note="SELECT ooff003 AS xceb001, ooff004 AS xceb002, ooff013 FROM ooff_t WHERE ooff002 = 'aint301'",
    dept="SELECT ooefl001 AS xceb108, ooefl004 FROM ooefl_t WHERE (ooeflent, ooefl002) = (666, 'en_US')",
    noted="SELECT xcebdocno, xceb001, xceb002, xceb108, ooff013 FROM xceb_t LEFT JOIN note USING (xceb001, xceb002)",
    result="SELECT xcebdocno, xceb001, xceb002, ooff013, ooefl004 FROM noted LEFT JOIN dept USING (xceb108)"))
def join_left_on_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    notes = t["ooff_t"].filter(F.col("ooff002") == "aint301")
    depts = t["ooefl_t"].filter((F.col("ooeflent") == 666) & (F.col("ooefl002") == "en_US"))
    return (t["xceb_t"]
            .join(notes, (F.col("xceb001") == F.col("ooff003")) & (F.col("xceb002") == F.col("ooff004")), "left")
            .join(depts, F.col("xceb108") == F.col("ooefl001"), "left")
            .select("xcebdocno", "xceb001", "xceb002", "ooff013", "ooefl004"))


@register("join_preagg", with_steps(
    # the largest label of an order is its first in descending order
    label="SELECT DISTINCT ON (xmdadocno) xmdadocno AS xmdh001, xmda033 FROM xmda_t ORDER BY xmdadocno, xmda033 DESC NULLS LAST",
    result="SELECT xmdhdocno, xmdh001, xmda033 FROM xmdh_t LEFT JOIN label USING (xmdh001)"))
def join_preagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    orders = max_per_key(t["xmda_t"], ["xmdadocno"], ["xmda033"])
    return (t["xmdh_t"].join(orders, F.col("xmdh001") == F.col("xmdadocno"), "left")
            .select("xmdhdocno", "xmdh001", "xmda033"))


@register("join_dedup", with_steps(
    # the row of rank one in the order of document numbers bears the least of them
    payable="SELECT apca038 AS glaqdocno, MIN(apcadocno) AS apcadocno FROM apca_t GROUP BY ALL",
    result="SELECT glaqdocno, glaq002, apcadocno FROM glaq_t LEFT JOIN payable USING (glaqdocno)"))
def join_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    pay = first_per_key(drop_null_keys(t["apca_t"], ["apca038"]), ["apca038"], ["apcadocno"], ["apca038", "apcadocno"])
    return (t["glaq_t"].join(pay, F.col("glaqdocno") == F.col("apca038"), "left")
            .select("glaqdocno", "glaq002", "apcadocno"))


@register("join_normalised_key", with_steps(
    ranked="""SELECT glacl002, glacl004, (glacl004 IS NULL, glacl003 IS DISTINCT FROM 'en_US', glacl003 IS NULL, glacl003) AS place
              FROM glacl_t""",
    title="""SELECT trim(glacl002) AS account, glacl004 FROM (
             SELECT DISTINCT ON (glacl002) glacl002, glacl004 FROM ranked ORDER BY glacl002, place, glacl004)""",
    voucher="SELECT glaqdocno, glaq002, trim(glaq002) AS account FROM glaq_t",
    result="SELECT glaqdocno, glaq002, glacl004 FROM voucher LEFT JOIN title USING (account)"))
def join_normalised_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    return (t["glaq_t"].join(account_titles(t["glacl_t"]), normalised_key("glaq002") == F.col("acct_key"), "left")
            .select("glaqdocno", "glaq002", "glacl004"))


@register("join_null_rejecting", with_fixtures("""
SELECT a.glaqdocno, a.glaq002, b.glapdocdt
FROM glaq_t a LEFT JOIN glap_t b ON a.glaqdocno = b.glapdocno WHERE b.glapstus = 'S'"""))
def join_null_rejecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    posted = t["glap_t"].filter(F.col("glapstus") == "S")
    return (t["glaq_t"].join(posted, F.col("glaqdocno") == F.col("glapdocno"), "inner")
            .select("glaqdocno", "glaq002", "glapdocdt"))


@register("join_inner_preagg", with_fixtures("""
SELECT x.xmdk005 AS docno, x.xmdk006 AS item, string_agg(DISTINCT i.isag002, ', ' ORDER BY i.isag002) AS isag002_list
FROM xmdk_t x JOIN isag_t i ON x.xmdkdocno = i.isag002 AND x.xmdk006 = i.isag019
WHERE x.xmdkent = 666 GROUP BY x.xmdk005, x.xmdk006"""))
def join_inner_preagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    ships = t["xmdk_t"].filter(F.col("xmdkent") == 666)
    billed = ships.join(t["isag_t"], (F.col("xmdkdocno") == F.col("isag002")) & (F.col("xmdk006") == F.col("isag019")))
    return list_per_key(billed, ["xmdk005", "xmdk006"], "isag002", "isag002_list") \
        .withColumnRenamed("xmdk005", "docno").withColumnRenamed("xmdk006", "item")


@register("correlated_listagg", with_steps(
    billed="""SELECT DISTINCT xmdk005 AS notice, xmdk006 AS order_no, isag002, isagdocno
              FROM xmdk_t, isag_t WHERE (isag002, isag019) = (xmdkdocno, xmdk006) AND xmdkent = 666""",
    invoice="SELECT DISTINCT isafdocno AS isagdocno, isaf011 FROM isaf_t WHERE isafent = 666",
    # the list of each (notice, order) for itself, sorted before it is joined to text
    listed="""SELECT notice, order_no, array_to_string(list_sort(list(DISTINCT isaf011)), ', ') AS isaf011_list
              FROM billed JOIN invoice USING (isagdocno) WHERE isaf011 IS NOT NULL GROUP BY ALL""",
    line="SELECT xmdhdocno AS notice, xmdh001 AS order_no FROM xmdh_t WHERE xmdhent = 666",
    row_="SELECT xmdgdocno AS notice, order_no FROM (SELECT xmdgdocno, xmdgdocno AS notice FROM xmdg_t WHERE xmdgent = 666) LEFT JOIN line USING (notice)",
    result="SELECT notice AS xmdgdocno, order_no AS xmdh001, isaf011_list FROM row_ LEFT JOIN listed USING (notice, order_no)"))
def correlated_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlated scalar subquery as a grouped aggregate plus a left join on both keys."""
    t = _erp(spark, sf_dir)
    _, lists = shipment_lookups(t)
    lines = t["xmdh_t"].filter(F.col("xmdhent") == 666).select("xmdhdocno", "xmdh001")
    head = t["xmdg_t"].filter(F.col("xmdgent") == 666).select("xmdgdocno")
    return (left_join_lines(head, lines, ["xmdgdocno"], ["xmdhdocno"])
            .join(lists, (F.col("xmdgdocno") == F.col("xmdk005")) & (F.col("xmdh001") == F.col("xmdk006")), "left")
            .select("xmdgdocno", "xmdh001", "isaf011_list"))


@register("join_roles", with_steps(
    billed="""SELECT DISTINCT xmdk005 AS notice, xmdk006 AS order_no, isag002, isagdocno
              FROM xmdk_t, isag_t WHERE (isag002, isag019) = (xmdkdocno, xmdk006) AND xmdkent = 666""",
    invoice="SELECT DISTINCT isafdocno AS isagdocno, isaf011 FROM isaf_t WHERE isafent = 666",
    listed="""SELECT notice, order_no, list_sort(list(DISTINCT isag002)) AS shipments,
              list_sort(list(DISTINCT isaf011) FILTER (isaf011 IS NOT NULL)) AS invoices
              FROM billed LEFT JOIN invoice USING (isagdocno) GROUP BY ALL""",
    earliest="SELECT xmdk005 AS notice, xmdk006 AS order_no, MIN(xmdkdocno) AS xmdkdocno FROM xmdk_t WHERE xmdkent = 666 GROUP BY ALL",
    result="""SELECT e.notice AS xmdk005, e.order_no AS xmdk006, xmdkdocno, array_to_string(shipments, ', ') AS isag002_list,
              array_to_string(invoices, ', ') AS isaf011_list
              FROM earliest e LEFT JOIN listed l ON e.notice = l.notice AND e.order_no = l.order_no"""))
def join_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipment table in two roles: first shipment per order line, and billed shipments."""
    first, lists = shipment_lookups(_erp(spark, sf_dir))
    return first.join(lists, ["xmdk005", "xmdk006"], "left").select(
        "xmdk005", "xmdk006", "xmdkdocno", "isag002_list", "isaf011_list")


@register("join_chain", with_steps(
    # from the far end: orders into notices, notices into shipments, shipments into invoice lines
    label="SELECT xmdadocno AS order_no, MAX(xmda033) AS xmda033 FROM xmda_t GROUP BY ALL",
    notice="SELECT xmdhdocno AS notice, xmdh001 AS order_no FROM xmdh_t WHERE xmdhent = 666",
    labelled="SELECT notice, order_no, order_no AS xmdh001, xmda033 FROM notice LEFT JOIN label USING (order_no)",
    shipment="SELECT xmdldocno AS isag002, xmdl003 AS isag019, xmdl001, xmdl001 AS notice, xmdl003 AS order_no FROM xmdl_t WHERE xmdlent = 666",
    shipped="SELECT isag002, isag019, xmdl001, xmdh001, xmda033 FROM shipment LEFT JOIN labelled USING (notice, order_no)",
    billed="SELECT isagdocno, isag002, isag019 FROM isag_t WHERE isagent = 666",
    result="SELECT isagdocno, isag002, xmdl001, xmdh001, xmda033 FROM billed LEFT JOIN shipped USING (isag002, isag019)"))
def join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive left joins, each keyed on a column the previous join may leave NULL.

    Joined from the far end: a line meets every notice line of its order, so the rows are many more
    than the lines; joined last, they are neither shuffled nor sorted again. NULL keys match nothing.
    """
    t = _erp(spark, sf_dir)
    ship = t["xmdl_t"].filter(F.col("xmdlent") == 666).select("xmdldocno", "xmdl001", "xmdl003")
    ship = drop_null_keys(ship, ["xmdldocno", "xmdl003"])
    notice = t["xmdh_t"].filter(F.col("xmdhent") == 666).select("xmdhdocno", "xmdh001")
    notice = drop_null_keys(notice, ["xmdhdocno", "xmdh001"])
    orders = max_per_key(t["xmda_t"], ["xmdadocno"], ["xmda033"])
    labelled = notice.join(orders, F.col("xmdh001") == F.col("xmdadocno"), "left").drop("xmdadocno")
    shipped = ship.join(labelled, (F.col("xmdl001") == F.col("xmdhdocno")) & (F.col("xmdl003") == F.col("xmdh001")), "left")
    return (t["isag_t"].filter(F.col("isagent") == 666)
            .join(shipped, (F.col("isag002") == F.col("xmdldocno")) & (F.col("isag019") == F.col("xmdl003")), "left")
            .select("isagdocno", "isag002", "xmdl001", "xmdh001", "xmda033"))


# ======================================================================= aggregations


@register("agg_sum", """
SELECT l_returnflag, l_linestatus,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price,
       CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_tax
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _drv(spark, sf_dir)["lineitem"]
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        *[F.sum(F.col(c).cast("decimal(18,2)")).cast("decimal(38,2)").alias(a)
          for c, a in (("l_quantity", "sum_qty"), ("l_extendedprice", "sum_price"), ("l_tax", "sum_tax"))])


@register("agg_sum_signed", with_fixtures("""
SELECT apcb005, CAST(SUM(apcb007 * apcb022) AS DECIMAL(38,2)) AS signed_qty,
       CAST(SUM(apcb101 * apcb022) AS DECIMAL(38,2)) AS signed_amount
FROM apcb_t GROUP BY apcb005"""))
def agg_sum_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _erp(spark, sf_dir)["apcb_t"]
    return b.groupBy("apcb005").agg(
        F.sum(F.col("apcb007") * F.col("apcb022")).cast("decimal(38,2)").alias("signed_qty"),
        F.sum(F.col("apcb101") * F.col("apcb022")).cast("decimal(38,2)").alias("signed_amount"))


@register("agg_max", with_fixtures("SELECT xmdg005, MAX(xmdg008) AS xmdg008 FROM xmdg_t GROUP BY xmdg005"))
def agg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_per_key(_erp(spark, sf_dir)["xmdg_t"], ["xmdg005"], ["xmdg008"])


@register("agg_max_label", with_fixtures("""
SELECT a.xcebdocno, a.xceb002, a.xceb004, MAX(b.imaal003) AS imaal003, MAX(b.imaal004) AS imaal004
FROM xceb_t a LEFT JOIN imaal_t b ON a.xceb004 = b.imaal001
GROUP BY a.xcebdocno, a.xceb002, a.xceb004"""))
def agg_max_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAX of a label over a fanned-out join, computed as the lookup's per-key MAX joined once."""
    t = _erp(spark, sf_dir)
    groups = t["xceb_t"].select("xcebdocno", "xceb002", "xceb004").distinct()
    items = max_per_key(t["imaal_t"], ["imaal001"], ["imaal003", "imaal004"])
    return (groups.join(items, F.col("xceb004") == F.col("imaal001"), "left")
            .select("xcebdocno", "xceb002", "xceb004", "imaal003", "imaal004"))


@register("group_by_expr", """
SELECT CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE 'NOT Match' END AS flag_text,
       strftime(l_shipdate, '%m/%Y') AS ship_month, count(*) AS line_count,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount
FROM lineitem GROUP BY 1, 2""")
def group_by_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _drv(spark, sf_dir)["lineitem"].select(
        decode("l_returnflag", {"R": "Returned", "A": "Accepted"}, "NOT Match").alias("flag_text"),
        F.date_format("l_shipdate", "MM/yyyy").alias("ship_month"), "l_extendedprice")
    return li.groupBy("flag_text", "ship_month").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("amount"))


@register("agg_hidden_key", with_fixtures("""
SELECT apcbdocno, CAST(SUM(apcb007 * apcb022) AS DECIMAL(38,2)) AS apcb007
FROM apcb_t GROUP BY apcbdocno, apcb007"""))
def agg_hidden_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity is a grouping key but only its signed sum is shown."""
    b = _erp(spark, sf_dir)["apcb_t"]
    return (b.groupBy("apcbdocno", F.col("apcb007").alias("qty_key"))
            .agg(F.sum(F.col("apcb007") * F.col("apcb022")).cast("decimal(38,2)").alias("apcb007"))
            .select("apcbdocno", "apcb007"))


@register("agg_sum_of_key", with_fixtures("""
SELECT isagdocno, isag004 AS qty, CAST(SUM(isag004) AS DECIMAL(38,2)) AS isag004
FROM isag_t GROUP BY isagdocno, isag004"""))
def agg_sum_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _erp(spark, sf_dir)["isag_t"].select("isagdocno", F.col("isag004").alias("qty"), "isag004")
    return g.groupBy("isagdocno", "qty").agg(F.sum("isag004").cast("decimal(38,2)").alias("isag004"))


@register("listagg_plain", with_fixtures("""
SELECT xrce054, string_agg(concat(xrce003, ',', xrcedocno), '' ORDER BY xrcedocno, concat(xrce003, ',', xrcedocno))
       AS list_docno
FROM xrce_t GROUP BY xrce054"""))
def listagg_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settlement_lists(_erp(spark, sf_dir)["xrce_t"])


@register("listagg_distinct", """
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities
FROM orders GROUP BY o_custkey""")
def listagg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_per_key(_drv(spark, sf_dir)["orders"], ["o_custkey"], "o_orderpriority", "priorities")


@register("distinct_rows", with_fixtures("SELECT DISTINCT glaq002, glaq018, glaq001 FROM glaq_t"))
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["glaq_t"].select("glaq002", "glaq018", "glaq001").distinct()


@register("agg_after_fanout", with_steps(
    # how many rows each shipment key stands for, then amounts times that number
    notice="SELECT xmdhdocno AS notice, xmdh001 AS order_no, count(*) AS n FROM xmdh_t WHERE xmdhent = 666 GROUP BY ALL",
    shipment="SELECT xmdldocno AS isag002, xmdl003 AS isag019, xmdl001 AS notice, xmdl003 AS order_no FROM xmdl_t WHERE xmdlent = 666",
    weight="SELECT isag002, isag019, SUM(ifnull(n, 1)) AS w FROM shipment LEFT JOIN notice USING (notice, order_no) GROUP BY ALL",
    result="""SELECT isagdocno, CAST(SUM(isag103 * ifnull(w, 1)) AS DECIMAL(38,2)) AS isag103, CAST(SUM(ifnull(w, 1)) AS BIGINT) AS joined_rows
              FROM isag_t LEFT JOIN weight USING (isag002, isag019) GROUP BY ALL"""))
def agg_after_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM after a lookup that matches several rows: each amount counts once per match.

    The lookup chain is first reduced to a match count per join key, so the multiplied rows are
    never materialised: ``SUM(x) over the fan-out = SUM(x * matches)``.
    """
    t = _erp(spark, sf_dir)
    ship = t["xmdl_t"].filter(F.col("xmdlent") == 666).select("xmdldocno", "xmdl001", "xmdl003")
    notice = (t["xmdh_t"].filter(F.col("xmdhent") == 666).groupBy("xmdhdocno", "xmdh001")
              .agg(F.count(F.lit(1)).alias("n_notice")))
    weights = (ship.join(notice, (F.col("xmdl001") == F.col("xmdhdocno")) & (F.col("xmdl003") == F.col("xmdh001")),
                         "left")
               .groupBy("xmdldocno", "xmdl003")
               .agg(F.sum(F.coalesce(F.col("n_notice"), F.lit(1))).alias("w")))
    lines = t["isag_t"].join(weights, (F.col("isag002") == F.col("xmdldocno")) & (F.col("isag019") == F.col("xmdl003")),
                             "left").withColumn("w", F.coalesce(F.col("w"), F.lit(1)))
    return lines.groupBy("isagdocno").agg(
        F.sum(F.col("isag103") * F.col("w")).cast("decimal(38,2)").alias("isag103"),
        F.sum("w").cast("bigint").alias("joined_rows"))


# ======================================================================= windows


@register("first_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT o_custkey, o_orderkey, o_orderdate,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey NULLS LAST) AS rn
  FROM orders) WHERE rn = 1""")
def first_per_key_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _drv(spark, sf_dir)["orders"]
    return first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_custkey", "o_orderkey", "o_orderdate"])


@register("first_non_null", with_fixtures("""
SELECT inbbdocno, inbb020, inbb001 FROM (
  SELECT inbbdocno, inbb020, inbb001, ROW_NUMBER() OVER (PARTITION BY inbbdocno ORDER BY
           CASE WHEN inbb020 IS NOT NULL THEN 0 ELSE 1 END, inbb020 NULLS LAST, inbb001 NULLS LAST,
           inbb012 NULLS LAST, inbb016 NULLS LAST) AS rn
  FROM inbb_t) WHERE rn = 1"""))
def first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _erp(spark, sf_dir)["inbb_t"]
    has = F.when(F.col("inbb020").isNotNull(), 0).otherwise(1)
    return first_per_key(b, ["inbbdocno"], [has, "inbb020", "inbb001", "inbb012", "inbb016"],
                         ["inbbdocno", "inbb020", "inbb001"])


@register("first_arbitrary", with_fixtures("""
SELECT xmdk005, xmdk006, xmdkdocno, xmdk001 FROM (
  SELECT x.*, ROW_NUMBER() OVER (PARTITION BY x.xmdk005, x.xmdk006
            ORDER BY x.xmdkdocno NULLS LAST, x.xmdk001 NULLS LAST, x.xmdkent NULLS LAST) AS rn
  FROM xmdk_t x WHERE x.xmdkent = 666) WHERE rn = 1"""))
def first_arbitrary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROW_NUMBER ordered by its own partition key picks any row; a total order makes it stable."""
    first, _ = shipment_lookups(_erp(spark, sf_dir))
    return first


# ======================================================================= sorting


@register("sort_multi", with_fixtures("SELECT inbadocno, inba004, inba003 FROM inba_t ORDER BY inba004, inba003"))
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_erp(spark, sf_dir)["inba_t"].select("inbadocno", "inba004", "inba003")
            .orderBy(F.col("inba004").asc_nulls_last(), F.col("inba003").asc_nulls_last()))


@register("sort_date_text", with_fixtures(
    "SELECT glapdocno, strftime(glapdocdt, '%d/%m/%Y') AS glapdocdt FROM glap_t ORDER BY 2"))
def sort_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_erp(spark, sf_dir)["glap_t"].select("glapdocno", date_text("glapdocdt").alias("glapdocdt"))
            .orderBy(F.col("glapdocdt").asc_nulls_last()))


@register("sort_alias_capture", with_fixtures(
    "SELECT apcadocno, strftime(apcadocdt, '%d/%m/%Y') AS apcadocdt FROM apca_t ORDER BY 2, 1"))
def sort_alias_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unqualified sort name means the output alias: day-first text order across months."""
    return (_erp(spark, sf_dir)["apca_t"].select("apcadocno", date_text("apcadocdt").alias("apcadocdt"))
            .orderBy(F.col("apcadocdt").asc_nulls_last(), F.col("apcadocno").asc_nulls_last()))


@register("sort_base_date", with_fixtures(
    "SELECT xmdgdocno, strftime(xmdgdocdt, '%d/%m/%Y') AS xmdgdocdt FROM xmdg_t ORDER BY xmdg_t.xmdgdocdt"))
def sort_base_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A qualified sort on the raw date: true date order, text shown."""
    g = _erp(spark, sf_dir)["xmdg_t"]
    return (g.select("xmdgdocno", F.col("xmdgdocdt").alias("__d"), date_text("xmdgdocdt").alias("xmdgdocdt"))
            .orderBy(F.col("__d").asc_nulls_last()).drop("__d"))


# ======================================================================= scalar functions


@register("fmt_date_slash", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS order_day FROM orders")
def fmt_date_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drv(spark, sf_dir)["orders"].select("o_orderkey", date_text("o_orderdate").alias("order_day"))


@register("fmt_date_mon", "SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS order_day FROM orders")
def fmt_date_mon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drv(spark, sf_dir)["orders"].select("o_orderkey", date_text_mon("o_orderdate").alias("order_day"))


@register("null_default", with_fixtures("""
SELECT inbbdocno, inbb001, COALESCE(inbb020, ' ') AS inbb020 FROM inbb_t"""))
def null_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["inbb_t"].select("inbbdocno", "inbb001", nvl("inbb020", " ").alias("inbb020"))


@register("last_six", with_fixtures("""
SELECT xmdhdocno, xmdh006, CASE WHEN length(xmdh006) >= 6 THEN right(xmdh006, 6) END AS xmdh006_last6 FROM xmdh_t"""))
def last_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["xmdh_t"].select("xmdhdocno", "xmdh006", last_chars("xmdh006", 6).alias("xmdh006_last6"))


@register("concat_null_safe", with_fixtures("""
SELECT xrcedocno, NULLIF(concat(xrce003, ',', xrcedocno), '') AS settle_text FROM xrce_t"""))
def concat_null_safe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _erp(spark, sf_dir)["xrce_t"].select(
        "xrcedocno", concat_null_safe("xrce003", F.lit(","), "xrcedocno").alias("settle_text"))


# ======================================================================= checks


def _fanout_sql() -> str:
    parts = []
    for name, table, keys, where, tenant in FANOUT_LOOKUPS:
        condition = fanout_filter(where, tenant)
        cond = f" WHERE {condition}" if condition else ""
        parts.append(f"SELECT '{name}' AS lookup, concat_ws('|', {', '.join(keys)}) AS key, count(*) AS matches "
                     f"FROM {table}{cond} GROUP BY {', '.join(keys)} HAVING count(*) > 1")
    return with_fixtures("\nUNION ALL\n".join(parts))


@register("fanout_check", _fanout_sql())
def fanout_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout_report(_erp(spark, sf_dir))


@register("missing_label_check", with_fixtures("""
SELECT DISTINCT a.apca004 AS key FROM apca_t a
WHERE a.apca004 IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM pmaal_t c WHERE c.pmaal001 = a.apca004 AND c.pmaalent = 666 AND c.pmaal002 = 'en_US')"""))
def missing_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _erp(spark, sf_dir)
    names = t["pmaal_t"].filter((F.col("pmaalent") == 666) & (F.col("pmaal002") == "en_US"))
    return missing_labels(t["apca_t"], "apca004", names, "pmaal001")
