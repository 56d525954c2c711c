"""R9 ``report_ap_invoices``: confirmed payable documents with signed line sums."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import date_text, decode
from ..functions.predicates import DEFAULT_ENTITY, equals_optional, lines_in, on_days
from ..operators.joins import left_join_lines
from ..operators.lookups import labels
from ..params import DateRange

# Payable document kinds, shown verbatim (two spaces in the first, T14).
AP_KINDS = {
    "01": "01:AP  Estimations",
    "17": "17:Invoice Payable",
    "19": "19:Other Payment Order",
    "29": "29:Other expect offset form",
}
AP_KIND_OTHER = "NOT Match"

AP_COLUMNS = [
    "apcadocno", "apcadocdt", "branch_no", "apca004", "pmaal004", "apcb002", "apcb004", "apcb005",
    "apcb007", "apcb101", "apcb103", "apcb104", "apcb105", "apca053", "apcb028",
]


def report_ap_invoices(
    t: Mapping[str, DataFrame],
    dates: DateRange,
    supplier: str | None = None,
    entity: int = DEFAULT_ENTITY,
    ordered: bool = True,
) -> DataFrame:
    """Confirmed (``Y``) payable headers of one tenant dated within ``dates`` (whole days),
    optionally for one supplier (``apca004``), left-joined to their lines and the supplier's
    English name, grouped per line shape with every amount multiplied by the line sign.

    The raw document date and the raw line quantity are grouping keys although only the date
    text and the signed quantity sum are shown (A6), so two lines that differ only in quantity
    stay two rows. The sort is on the date *text* (day first), then document number (O3).
    """
    head = on_days(t["apca_t"], "apcadocdt", dates).filter((F.col("apcaent") == entity) & (F.col("apcastus") == "Y"))
    head = equals_optional(head, "apca004", supplier).select("apcadocno", "apcadocdt", "apca001", "apca004", "apca053")
    lines = lines_in(t["apcb_t"], dates.start, dates.end).filter(F.col("apcbent") == entity).drop("apcbent")
    names = labels(t["pmaal_t"], "pmaal001", "pmaal004", lang_col="pmaal002", ent_col="pmaalent", entity=entity)

    joined = (
        # its rows are used once: a second scan of the key column costs less than writing them
        left_join_lines(head, lines, ["apcadocno"], ["apcbdocno"])
        .join(names, F.col("apca004") == F.col("pmaal001"), "left")
        .withColumn("branch_no", decode("apca001", AP_KINDS, AP_KIND_OTHER))
    )
    sign = F.col("apcb022")
    grouped = joined.groupBy(
        "apcadocno", F.col("apcadocdt").alias("apcadocdt_raw"), "branch_no", "apca004", "pmaal004",
        "apcb002", "apcb004", "apcb005", F.col("apcb007").alias("apcb007_raw"), "apca053", "apcb028",
    ).agg(
        *[F.sum(F.col(c) * sign).cast("decimal(38,2)").alias(c)
          for c in ("apcb007", "apcb101", "apcb103", "apcb104", "apcb105")]
    )
    out = grouped.withColumn("apcadocdt", date_text("apcadocdt_raw")).select(*AP_COLUMNS)
    if not ordered:
        return out
    # ORDER BY date text (day first), document; line columns break ties so the order is total.
    ties = ["apcb004", "apcb002", "apcb005", "apcb007", "apcb028", "pmaal004"]
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in ["apcadocdt", "apcadocno", *ties]])
