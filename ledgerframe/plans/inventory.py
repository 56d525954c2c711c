"""R2 ``report_misc_issue_lines``: miscellaneous issue lines of a month with their labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import nvl
from ..functions.predicates import DEFAULT_ENTITY, lines_in, not_in, on_month
from ..operators.joins import lines_of_headers
from ..operators.lookups import labels
from ..params import MonthParam

# Issue kind kept, status excluded, reason category, blank default.
ISSUE_KIND = "1"
VOID_STATUS = "X"
REASON_CATEGORY = "216"
BLANK = " "

MISC_COLUMNS = ["ooefl003", "inba004", "inba008", "inbb020", "inbb016", "oocql004", "inba002", "inba003",
                "inbadocno", "inbastus", "ooag011", "ooag003", "inbb001", "imaal003", "imaal004", "inbb010",
                "inbb012"]


def report_misc_issue_lines(t: Mapping[str, DataFrame], period: MonthParam, entity: int = DEFAULT_ENTITY,
                            lang: str = "en_US", ordered: bool = True) -> DataFrame:
    """Distinct issue lines of kind ``1`` whose header date lies between the first and the last
    day of the month *at midnight* (later times on the last day drop, T5), status not ``X``
    (a NULL status drops too), with staff, department, item and reason labels."""
    head = on_month(t["inba_t"], "inba002", period, closed=True).filter(
        (F.col("inbaent") == entity) & not_in("inbastus", [VOID_STATUS]) & (F.col("inba001") == ISSUE_KIND)
    ).select("inbaent", "inbadocno", "inba002", "inba003", "inba004", "inba008", "inbastus")
    staff = labels(t["ooag_t"], "ooag001", ["ooag011", "ooag003"], ent_col="ooagent", entity=entity)
    depts = labels(t["ooefl_t"], "ooefl001", "ooefl003", lang_col="ooefl002", ent_col="ooeflent", entity=entity)
    lines = lines_in(t["inbb_t"], period.first_day, period.last_day)
    items = labels(t["imaal_t"], "imaal001", ["imaalent", "imaal003", "imaal004"], lang_col="imaal002", lang=lang)
    reasons = labels(t["oocql_t"], "oocql002", ["oocqlent", "oocql004"], lang_col="oocql003", lang=lang,
                     where=F.col("oocql001") == REASON_CATEGORY)

    joined = (
        lines_of_headers(head, lines, ["inbaent", "inbadocno"], ["inbbent", "inbbdocno"], "issues")
        .join(staff, F.col("ooag001") == F.col("inba003"), "left")
        .join(depts, F.col("ooefl001") == F.col("inba004"), "left")
        .join(items, (F.col("imaal001") == F.col("inbb001")) & (F.col("imaalent") == F.col("inbbent")), "left")
        .join(reasons, (F.col("oocqlent") == F.col("inbbent")) & (F.col("oocql002") == F.col("inbb016")), "left")
        .withColumn("inba008", nvl("inba008", BLANK))
        .withColumn("inbb020", nvl("inbb020", BLANK))
    )
    out = joined.select(*MISC_COLUMNS).distinct()
    if not ordered:
        return out
    # ORDER BY department, staff; document and line columns break ties so the order is total.
    ties = ["inbadocno", "inbb001", "inbb016", "inbb020", "inbb012", "inba002"]
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in ["inba004", "inba003", *ties]])
