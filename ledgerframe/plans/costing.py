"""Cost reports: R3 ``report_cost_ledger``, R4 ``report_issue_cost_by_dept``, R5
``report_issue_cost_by_account``.

R4 and R5 group issue-cost lines by their own columns and take ``MAX`` of every looked-up
label. Each lookup is keyed on a grouping column, so ``MAX`` over the fanned-out join equals
the per-key ``MAX`` of the lookup: the distinct groups are formed once, written, and left-joined to
lookups that were reduced to one row per key (and, for the large ones, to the keys of the
month) before any join. No row is multiplied, whatever the lookups' duplication.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import DEFAULT_ENTITY, starts_with_any, tenant_rows
from ..operators.joins import drop_null_keys, only_keys
from ..operators.lookups import first_per_key, max_per_key
from ..operators.steps import written_once
from ..params import MonthParam

# Issue document prefixes per report, the note program tag.
DEPT_ISSUE_PREFIXES = ("TS-IN010", "TS-IN999", "TS-IN020")
ACCOUNT_ISSUE_PREFIXES = ("TS-IN010", "TS-IN020")
NOTE_PROGRAM = "aint301"

LEDGER_COLUMNS = ["xcblcomp", "xcblld", "xcbl002", "xcbl003", "xcbl004", "xcbl001", "xcbl005", "xcbl010",
                  "oocql004", "xcbl012", "ooefl003", "xcbl100"]


def _one_label(df: DataFrame, key: str, lang_col: str, ent_col: str, label: str, extra: Sequence[str],
               lang: str) -> DataFrame:
    """First label row per code: ``lang`` first, then language, tenant, other columns, label
    ascending with NULLs last (T2 total order for an arbitrary ROW_NUMBER winner)."""
    not_lang = F.when(F.col(lang_col) == lang, 0).otherwise(1)
    order = [not_lang, lang_col, ent_col, *extra, label]
    return first_per_key(drop_null_keys(df, [key]), [key], order, [key, label])


def report_cost_ledger(t: Mapping[str, DataFrame], period: MonthParam, lang: str = "en_US",
                       entity: int = DEFAULT_ENTITY, strict_entity: bool = False) -> DataFrame:
    """Cost ledger rows of one period with one department name and one reason label each
    (``strict_entity``: labels of ``entity`` only)."""
    rows = t["xcbl_t"].filter((F.col("xcbl002") == period.year) & (F.col("xcbl003") == period.month))
    ooefl = tenant_rows(t["ooefl_t"], "ooeflent", entity, strict_entity)
    oocql = tenant_rows(t["oocql_t"], "oocqlent", entity, strict_entity)
    depts = _one_label(ooefl, "ooefl001", "ooefl002", "ooeflent", "ooefl003", ["ooefl004"], lang)
    reasons = _one_label(oocql, "oocql002", "oocql003", "oocqlent", "oocql004", ["oocql001"], lang)
    return (
        rows.join(depts, F.col("ooefl001") == F.col("xcbl012"), "left")
        .join(reasons, F.col("oocql002") == F.col("xcbl010"), "left")
        .select(*LEDGER_COLUMNS)
    )


def _issue_cost(t: Mapping[str, DataFrame], period: MonthParam, table: str, prefixes: Sequence[str],
                by_account: bool, lang: str, entity: int = DEFAULT_ENTITY, strict: bool = False) -> DataFrame:
    p = table[:4]

    def own(name: str, ent_col: str) -> DataFrame:
        return tenant_rows(t[name], ent_col, entity, strict)

    col = {k: f"{p}{k}" for k in ("docno", "001", "002", "004", "101", "108", "110", "201", "202")}
    docs = t["xcea_t"].filter((F.col("xcea005") == period.month) & (F.col("xcea004") == period.year))
    lines = t[table].filter(starts_with_any(col["001"], prefixes))
    lines = only_keys(lines, [col["docno"]], docs, ["xceadocno"])

    keys = [col["001"], col["002"], col["004"]]
    keys += [col["101"], col["110"]] if by_account else [col["110"], col["108"]]
    keys += [col["201"], col["202"]]
    # written once: the lookups below take their keys from it, and the lines are read once
    groups = written_once(lines.select(*keys).distinct(), "issue-groups")
    issue_docs = groups.select(col["001"])

    items = max_per_key(own("imaal_t", "imaalent"), ["imaal001"], ["imaal003", "imaal004"])
    reasons = max_per_key(own("oocql_t", "oocqlent").filter(F.col("oocql003") == lang), ["oocql002"], ["oocql004"]) \
        .withColumnRenamed("oocql004", f"{p}110_name")
    heads = max_per_key(only_keys(own("inba_t", "inbaent"), ["inbadocno"], issue_docs, [col["001"]]),
                        ["inbadocno"], ["inba008"])
    issue_lines = max_per_key(only_keys(own("inbb_t", "inbbent"), ["inbbdocno"], issue_docs, [col["001"]]),
                              ["inbbdocno"], ["inbb020"])
    notes = max_per_key(
        only_keys(t["ooff_t"].filter(F.col("ooff002") == NOTE_PROGRAM), ["ooff003"], issue_docs, [col["001"]]),
        ["ooff003", "ooff004"], ["ooff013"])

    out = (
        groups.join(items, F.col(col["004"]) == F.col("imaal001"), "left")
        .join(reasons, F.col(col["110"]) == F.col("oocql002"), "left")
        .join(heads, F.col(col["001"]) == F.col("inbadocno"), "left")
        .join(issue_lines, F.col(col["001"]) == F.col("inbbdocno"), "left")
        .join(notes, (F.col(col["001"]) == F.col("ooff003")) & (F.col(col["002"]) == F.col("ooff004")), "left")
    )
    if by_account:
        titles = max_per_key(t["glacl_t"].filter(F.col("glacl003") == lang), ["glacl002"], ["glacl004"]) \
            .withColumnRenamed("glacl004", f"{p}101_name")
        out = out.join(titles, F.col(col["101"]) == F.col("glacl002"), "left")
        names = [col["001"], col["002"], col["004"], "imaal003", "imaal004", col["101"], f"{p}101_name",
                 col["110"], f"{p}110_name", col["201"], col["202"], "inba008", "inbb020", "ooff013"]
    else:
        depts = max_per_key(own("ooefl_t", "ooeflent"), ["ooefl001"], ["ooefl004"])
        out = out.join(depts, F.col(col["108"]) == F.col("ooefl001"), "left")
        names = [col["001"], col["002"], col["004"], "imaal003", "imaal004", col["110"], f"{p}110_name",
                 col["108"], "ooefl004", col["201"], col["202"], "inba008", "inbb020", "ooff013"]
    return out.select(*names)


def report_issue_cost_by_dept(t: Mapping[str, DataFrame], period: MonthParam, lang: str = "en_US",
                              entity: int = DEFAULT_ENTITY, strict_entity: bool = False) -> DataFrame:
    """Issue cost per document line (``xceb_t``) of a cost period, three issue prefixes, with
    item, reason and department labels and the issue header/line/note texts
    (``strict_entity``: lookups of ``entity`` only)."""
    return _issue_cost(t, period, "xceb_t", DEPT_ISSUE_PREFIXES, False, lang, entity, strict_entity)


def report_issue_cost_by_account(t: Mapping[str, DataFrame], period: MonthParam, lang: str = "en_US",
                                 entity: int = DEFAULT_ENTITY, strict_entity: bool = False) -> DataFrame:
    """As R4 on ``xcec_t``, two issue prefixes, the account title instead of the department."""
    return _issue_cost(t, period, "xcec_t", ACCOUNT_ISSUE_PREFIXES, True, lang, entity, strict_entity)
