"""R1 ``report_gl_expense_vouchers``: posted expense voucher lines (accounts 6*/7*) of a month."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import date_text, normalised_key
from ..functions.predicates import DEFAULT_ENTITY, lines_in, not_contains_or_null, on_month, starts_with_any, tenant_rows
from ..operators.joins import drop_null_keys, only_keys
from ..operators.lookups import first_per_key
from ..params import MonthParam

# Expense account prefixes, the excluded cost-document marker, the posted status.
EXPENSE_PREFIXES = ("6", "7")
EXCLUDED_DOC_MARK = "XC090"
POSTED = "S"

GL_COLUMNS = ["glaq002", "glacl004", "glaqdocno", "glapdocdt", "glaq018", "ooefl004", "docno",
              "glaq001", "glaq003", "glaq004"]

# Human headers of the spreadsheet export, one per column above.
GL_EXPORT_LABELS = ["Account No.", "A/C Title", "Voucher No.", "Voucher Date", "Dept. Code", "Dept.",
                    "Source Doc No", "Summary", "Debit Amt", "Credit Amt"]


def account_titles(glacl: DataFrame, lang: str = "en_US") -> DataFrame:
    """One title per raw account code: a non-NULL title first, then ``lang``, then the rest
    ascending (a total order, T2). The join uses the trimmed text of the code (J7)."""
    has_title = F.when(F.col("glacl004").isNotNull(), 0).otherwise(1)
    not_lang = F.when(F.col("glacl003") == lang, 0).otherwise(1)
    first = first_per_key(drop_null_keys(glacl, ["glacl002"]), ["glacl002"],
                          [has_title, not_lang, "glacl003", "glacl004"], ["glacl002", "glacl004"])
    return first.select(normalised_key("glacl002").alias("acct_key"), "glacl004")


def report_gl_expense_vouchers(t: Mapping[str, DataFrame], period: MonthParam, lang: str = "en_US",
                               ordered: bool = True, entity: int = DEFAULT_ENTITY,
                               strict_entity: bool = False) -> DataFrame:
    """Distinct posted voucher lines on 6*/7* accounts dated in ``period`` (any time of day).

    Source document: the lowest payable document pointing at the voucher, else the lowest
    cost document; lines whose source document carries the excluded marker drop, lines with
    no source document stay. The department label must exist in ``lang`` (inner join, J8).
    ``strict_entity`` restricts department labels and payables to ``entity`` (the source does not).
    """
    vouchers = on_month(t["glap_t"], "glapdocdt", period).filter(F.col("glapstus") == POSTED)
    lines = lines_in(t["glaq_t"], period.first_day, period.last_day).filter(starts_with_any("glaq002", EXPENSE_PREFIXES))
    month_docs = vouchers.select("glapdocno")

    apca = tenant_rows(t["apca_t"], "apcaent", entity, strict_entity)
    payables = only_keys(drop_null_keys(apca, ["apca038"]), ["apca038"], month_docs, ["glapdocno"])
    first_payable = first_per_key(payables, ["apca038"], ["apcadocno"], ["apca038", "apcadocno"])
    costs = only_keys(drop_null_keys(t["xcea_t"], ["xcea101"]), ["xcea101"], month_docs, ["glapdocno"])
    first_cost = first_per_key(costs, ["xcea101"], ["xceadocno"], ["xcea101", "xceadocno"])
    depts = tenant_rows(t["ooefl_t"], "ooeflent", entity, strict_entity) \
        .filter(F.col("ooefl002") == lang).select("ooefl001", "ooefl004")

    joined = (
        lines.join(vouchers, lines["glaqdocno"] == vouchers["glapdocno"], "inner")
        .join(depts, F.col("glaq018") == F.col("ooefl001"), "inner")
        .join(account_titles(t["glacl_t"], lang), normalised_key("glaq002") == F.col("acct_key"), "left")
        .join(first_payable, F.col("glaqdocno") == F.col("apca038"), "left")
        .join(first_cost, F.col("glaqdocno") == F.col("xcea101"), "left")
        .withColumn("docno", F.coalesce("apcadocno", "xceadocno"))
        .filter(not_contains_or_null("docno", EXCLUDED_DOC_MARK))
        .withColumn("glapdocdt", date_text("glapdocdt"))
    )
    out = joined.select(*GL_COLUMNS).distinct()
    if not ordered:
        return out
    # ORDER BY account, date text; the remaining columns break ties so the order is total.
    ties = ["glaqdocno", "glaq001", "glaq003", "glaq004", "glaq018", "docno"]
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in ["glaq002", "glapdocdt", *ties]])
