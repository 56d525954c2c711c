"""Sales reports: R6 ``report_order_fulfilment``, R7 ``report_tax_invoice``, R8
``report_tax_invoice_by_price``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import (
    by_prefix,
    concat_null_safe,
    date_text,
    date_text_mon,
    decode,
    decode_passthrough,
    is_null_or_token,
    last_chars,
    per_thousand,
)
from ..functions.predicates import DEFAULT_ENTITY, lines_in, on_days, tenant_rows
from ..operators.joins import drop_null_keys, joined_once, lines_of_headers, only_keys
from ..operators.lookups import distinct_list, first_per_key, labels, max_per_key
from ..operators.ranges import default_ranges, long_list_per_key, sort_by_known_cuts
from ..operators.steps import forget_step, written_once
from ..params import DateRange

# Shipment-notice status texts (other codes pass through).
NOTICE_STATUS = {"X": "Voided", "Y": "Confirmed", "H": "Holding"}
# Customer branch texts; NULL and the text 'NULL' mean head office.
HEAD_OFFICE = "HEAD OFFICE"
BRANCHES = {
    "R0001": "BRANCH NO.00001",
    "R0002": "BRANCH NO.00002",
    "R0003": "BRANCH NO.00003",
    "R0006": "BRANCH NO.00006",
    "R0007": "BRANCH NO.00007",
}
BRANCH_OTHER = "NOT Match"
CONFIRMED = "Y"
WASTE = "WASTE"
LIST_SEP = ", "
#: A list of units in the shipment chain has at most so many.
UNITS_PER_ROW = 100

FULFILMENT_COLUMNS = [
    "xmdgdocno", "xmdgdocdt", "xmdg028", "xmdg005", "pmaal004", "xmdh001", "calc_qty", "unit", "xmdh023",
    "xmdg017", "xmdh006_last6", "xmdkdocno", "xmdk001", "status_desc", "xmdg002", "oofa011", "ooefl003",
    "xmdh006", "imaal003", "pmao009", "pmao010", "xmdh016", "xmdh017", "xmda033", "oofb011", "isag002_list",
    "isaf011_list", "xmdg008", "ooibl004", "xmdg009", "oocql004",
]


NOTICE_COLUMNS = ["xmdgdocno", "xmdgdocdt", "xmdg002", "xmdg003", "xmdg005", "xmdg008", "xmdg009", "xmdg017",
                  "xmdg028", "xmdgstus"]
#: The tax-invoice reports' order up to their sums; all of these are grouping columns.
INVOICE_RANGES = ["isaf011", "formatted_date", "isag017", "pmao010", "isaf022", "branch_no", "isaf021", "isaf002", "isag101"]
INVOICE_COLUMNS = ["isafdocno", "isaf002", "isaf011", "isaf014", "isaf021", "isaf022", "isaf100", "isaf101"]


def shipment_lookups(t: Mapping[str, DataFrame], entity: int = DEFAULT_ENTITY,
                     strict_entity: bool = False, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per (notice, order) key: the first shipment, and the sorted distinct invoice-line
    shipment numbers and invoice numbers. One aggregate builds both lists; ``collect_set``
    deduplicates in the partial (map-side) step, so only distinct values are shuffled.
    ``keys`` (``xmdgdocno``, ``xmdh001``) restricts the shipments to those a report can reach
    before anything is joined or aggregated."""
    ships = drop_null_keys(t["xmdk_t"].filter(F.col("xmdkent") == entity), ["xmdk005", "xmdk006"])
    if keys is not None:
        ships = only_keys(ships, ["xmdk005", "xmdk006"], keys, ["xmdgdocno", "xmdh001"])
    first = first_per_key(ships, ["xmdk005", "xmdk006"], ["xmdkdocno", "xmdk001", "xmdkent"],
                          ["xmdk005", "xmdk006", "xmdkdocno", "xmdk001"])
    inv_lines = tenant_rows(t["isag_t"], "isagent", entity, strict_entity).select("isagdocno", "isag002", "isag019")
    invoices = t["isaf_t"].filter(F.col("isafent") == entity).select("isafdocno", "isaf011")
    billed = (
        ships.select("xmdk005", "xmdk006", "xmdkdocno")
        .join(inv_lines, (F.col("xmdkdocno") == F.col("isag002")) & (F.col("xmdk006") == F.col("isag019")), "inner")
        .join(invoices, F.col("isagdocno") == F.col("isafdocno"), "left")
        .select("xmdk005", "xmdk006", "isag002", "isaf011")
    )
    lists = billed.groupBy("xmdk005", "xmdk006").agg(
        distinct_list("isag002", LIST_SEP).alias("isag002_list"),
        distinct_list("isaf011", LIST_SEP).alias("isaf011_list"),
    )
    return first, lists


def noted_orders(t: Mapping[str, DataFrame], pairs: DataFrame, head: DataFrame, entity: int, lang: str,
                 strict_entity: bool) -> DataFrame:
    """All that depends on notice and order, by ``__notice`` and ``__order`` (NULL for a notice without lines).

    ``pairs`` (``notice``, ``xmdh001``) may repeat. The notice's labels, which fan out where they repeat, and
    the first shipment, invoice lists and order are looked up once for each pair, not for each line.
    """
    pairs = written_once(pairs.distinct().withColumnsRenamed({"notice": "__notice", "xmdh001": "__order"}), "notice-orders")
    pairs = pairs.join(head, F.col("__notice") == F.col("notice")).drop("notice")
    # (notice, order) pairs of the rows: the shipment and order lookups are cut down to them
    # before they are joined or aggregated, whatever the length of the range.
    reach = pairs.select("xmdgdocno", F.col("__order").alias("xmdh001")).dropna()
    orders = max_per_key(only_keys(t["xmda_t"], ["xmdadocno"], reach, ["xmdh001"]), ["xmdadocno"], ["xmda033"])
    first, lists = shipment_lookups(t, entity, strict_entity, reach)
    lists = lists.withColumnsRenamed({"xmdk005": "__listed", "xmdk006": "__listed_order"})
    shipped = joined_once(pairs, [
        (first, (F.col("xmdgdocno") == F.col("xmdk005")) & (F.col("__order") == F.col("xmdk006"))),
        (lists, (F.col("xmdgdocno") == F.col("__listed")) & (F.col("__order") == F.col("__listed_order"))),
        (orders, F.col("__order") == F.col("xmdadocno")),
    ], "notice-shipments", drop=["xmdk005", "xmdk006", "__listed", "__listed_order", "xmdadocno"])
    contacts = labels(t["oofa_t"], "oofa003", "oofa011", ent_col="oofaent", entity=entity)
    depts = labels(t["ooefl_t"], "ooefl001", "ooefl003", lang_col="ooefl002", ent_col="ooeflent", entity=entity)
    segments = max_per_key(t["oofb_t"].filter(F.col("oofbent") == entity), ["oofb019"], ["oofb011"])
    names = labels(t["pmaal_t"], "pmaal001", "pmaal004", lang_col="pmaal002", lang=lang, ent_col="pmaalent",
                   entity=entity)
    terms = max_per_key(t["ooibl_t"].filter((F.col("ooiblent") == entity) & (F.col("ooibl003") == lang)),
                        ["ooibl002"], ["ooibl004"])
    codes = max_per_key(t["oocql_t"].filter((F.col("oocqlent") == entity) & (F.col("oocql003") == lang)),
                        ["oocql002"], ["oocql004"])
    labelled = joined_once(shipped, [
        (contacts, F.col("xmdg002") == F.col("oofa003")), (depts, F.col("xmdg003") == F.col("ooefl001")),
        (segments, F.col("xmdg017") == F.col("oofb019")), (names, F.col("xmdg005") == F.col("pmaal001")),
        (terms, F.col("xmdg008") == F.col("ooibl002")), (codes, F.col("xmdg009") == F.col("oocql002")),
    ], "notices", drop=["xmdg003", "oofa003", "ooefl001", "oofb019", "pmaal001", "ooibl002", "oocql002"])
    forget_step(shipped, "notice-shipments")
    forget_step(pairs, "notice-orders")
    return labelled


def report_order_fulfilment(t: Mapping[str, DataFrame], dates: DateRange, entity: int = DEFAULT_ENTITY,
                            lang: str = "en_US", ordered: bool = True, strict_entity: bool = False) -> DataFrame:
    """One row per shipment-notice line (or per line-less notice) of notices whose date
    ``xmdg028`` falls in ``dates``: order, item, unit from the packing text, first shipment,
    invoice lists, customer and code labels. Label lookups that are not collapsed fan out
    as in the source report (T3). Sorted by the raw document date (O4)."""
    head = on_days(t["xmdg_t"], "xmdg028", dates).filter(F.col("xmdgent") == entity).select(*NOTICE_COLUMNS)
    # A number for each notice, fixed once written: its lines bear that until all else is looked up.
    head = written_once(head.withColumn("notice", F.monotonically_increasing_id()), "notice-heads")
    lines = lines_in(t["xmdh_t"], dates.start, dates.end).filter(F.col("xmdhent") == entity).drop("xmdhent")
    rows = lines_of_headers(head.select("notice", "xmdgdocno", "xmdg005"), lines, ["xmdgdocno"], ["xmdhdocno"], "notice-lines")
    orders_of = noted_orders(t, rows.select("notice", "xmdh001"), head, entity, lang, strict_entity)
    items = labels(t["imaal_t"], "imaal001", "imaal003", lang_col="imaal002", lang=lang, ent_col="imaalent",
                   entity=entity)
    parts = labels(t["pmao_t"], "pmao002", ["pmao001", "pmao004", "pmao009", "pmao010"], ent_col="pmaoent",
                   entity=entity)
    own = rows.select("notice", "xmdg005", "xmdh001", "xmdh006", per_thousand("xmdh015").alias("unit"), "xmdh016",
                      "xmdh017", "xmdh023", "xmdh034")
    part = ((F.col("xmdh006") == F.col("pmao002")) & (F.col("xmdg005") == F.col("pmao001"))
            & (F.col("xmdh034") == F.col("pmao004")))
    known = joined_once(own, [(parts, part), (items, F.col("xmdh006") == F.col("imaal001"))], "notice-items",
                        drop=["xmdg005", "xmdh034", "pmao001", "pmao002", "pmao004", "imaal001"])
    forget_step(rows, "notice-lines")
    forget_step(head, "notice-heads")
    same = (F.col("notice") == F.col("__notice")) & F.col("xmdh001").eqNullSafe(F.col("__order"))
    j = joined_once(known, [(orders_of, same)], "notice-rows", drop=["notice", "__notice", "__order"])
    forget_step(known, "notice-items")
    forget_step(orders_of, "notices")
    if ordered:
        # ORDER BY the raw notice date (O4); document number, order and item break ties. The cuts come from
        # the written rows, so nothing is computed a second time to sample it; texts are made after the shuffle.
        j = sort_by_known_cuts(j, ["xmdgdocdt", "xmdgdocno", "xmdh001", "xmdh006"], j)
    return j.select(
        "xmdgdocno", date_text("xmdgdocdt").alias("xmdgdocdt"),
        date_text("xmdg028").alias("xmdg028"), "xmdg005", "pmaal004", "xmdh001",
        (F.col("unit") * F.coalesce(F.col("xmdh016"), F.lit(0))).cast("decimal(38,5)").alias("calc_qty"),
        "unit", "xmdh023", "xmdg017", last_chars("xmdh006", 6).alias("xmdh006_last6"), "xmdkdocno",
        date_text("xmdk001").alias("xmdk001"), decode_passthrough("xmdgstus", NOTICE_STATUS).alias("status_desc"),
        "xmdg002", "oofa011", "ooefl003", "xmdh006", "imaal003", "pmao009", "pmao010", "xmdh016", "xmdh017",
        "xmda033", "oofb011", "isag002_list", "isaf011_list", "xmdg008", "ooibl004", "xmdg009", "oocql004",
    )


def branch_text(c: str) -> F.Column:
    return F.when(is_null_or_token(c), F.lit(HEAD_OFFICE)).otherwise(decode(c, BRANCHES, BRANCH_OTHER))


def settlement_lists(xrce: DataFrame) -> DataFrame:
    """Per invoice number: ``LISTAGG(xrce003 || ',' || xrcedocno) WITHIN GROUP (ORDER BY
    xrcedocno)`` with no separator; NULL parts are skipped (``,RC-..`` for a NULL code).
    Made in two levels, so no task holds all rows of a hot invoice number."""
    text = concat_null_safe("xrce003", F.lit(","), "xrcedocno")
    return long_list_per_key(xrce, ["xrce054"], text, ["xrcedocno"], "list_docno")


def no_unit() -> Column:
    return F.lit(0).cast("decimal(18,3)")


def one_row() -> Column:
    """The units of a line without notice lines."""
    return F.array(F.struct(no_unit().alias("unit"), F.lit(1).cast("long").alias("w")))


def shipment_chain(t: Mapping[str, DataFrame], entity: int, keys: DataFrame | None = None) -> DataFrame:
    """The invoice-line lookup chain shipment -> notice lines -> order, collapsed per shipment key.

    The source report joins every notice line of the shipped order (J12), so an invoice line
    fans out once per notice line and its amounts are summed that many times (A11). Only
    ``xmdl001``, the unit from the packing text and ``xmda033`` of the chain reach the report's
    grouping, so a shipment has one row per ``xmdl001`` with ``units``, a list of (unit, ``w``):
    ``w`` is the number of joined rows that the unit stands for; ``SUM(x)`` over the fan-out equals
    ``SUM(x * w)``. A list has ``UNITS_PER_ROW`` units at most; more units make more rows. So an
    invoice line is dealt out with its units, not once for each. A shipment without notice lines
    keeps one row (``w`` = 1, unit 0).
    ``keys`` (``isag002``, ``isag019``) restricts the chain to the shipments the report reaches.
    """
    shipments = labels(t["xmdl_t"], "xmdldocno", ["xmdl001", "xmdl003"], ent_col="xmdlent", entity=entity)
    if keys is not None:
        shipments = only_keys(shipments, ["xmdldocno", "xmdl003"], keys, ["isag002", "isag019"])
    # Notice lines counted per (notice, order, unit) map-side first: a notice with very many
    # lines shrinks to a few rows before it is joined, so it cannot pile up in one task.
    key = ["xmdhdocno", "xmdh001"]
    notices = (
        only_keys(labels(t["xmdh_t"], "xmdhdocno", ["xmdh001", "xmdh015"], ent_col="xmdhent", entity=entity),
                  key, shipments, ["xmdl001", "xmdl003"])
        .groupBy(*key, F.coalesce(per_thousand("xmdh015"), no_unit()).alias("unit"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("unit"))
    units = (
        notices.withColumn("__part", F.floor((nth - 1) / UNITS_PER_ROW))
        .groupBy(*key, "__part").agg(F.collect_list(F.struct("unit", "w")).alias("units"))
    )
    orders = max_per_key(only_keys(t["xmda_t"], ["xmdadocno"], shipments, ["xmdl003"]), ["xmdadocno"], ["xmda033"])
    return (
        shipments.groupBy("xmdldocno", "xmdl003", "xmdl001").agg(F.count(F.lit(1)).alias("n"))
        .join(units, (F.col("xmdl001") == F.col("xmdhdocno")) & (F.col("xmdl003") == F.col("xmdh001")), "left")
        .join(orders, F.col("xmdh001") == F.col("xmdadocno"), "left")
        .withColumn("units", F.coalesce("units", one_row()))
        .select("xmdldocno", "xmdl003", "xmdl001", "xmda033",
                F.transform("units", lambda u: F.struct(u["unit"], (u["w"] * F.col("n")).alias("w"))).alias("units"))
    )


def _tax_invoice(t: Mapping[str, DataFrame], dates: DateRange, entity: int, with_currency: bool,
                 strict_entity: bool = False, ordered: bool = True) -> DataFrame:
    head = tenant_rows(t["isaf_t"], "isafent", entity, strict_entity)
    head = on_days(head, "isaf014", dates).filter(F.col("isafstus") == CONFIRMED).select(*INVOICE_COLUMNS)
    partners = labels(t["pmaa_t"], "pmaa001", "pmaa006", ent_col="pmaaent", entity=entity)
    xrce = drop_null_keys(t["xrce_t"], ["xrce054"])
    settle = settlement_lists(only_keys(xrce, ["xrce054"], head, ["isaf011"]))
    currency = ["isaf101", "isaf100"] if with_currency else []
    # What depends on the invoice alone is looked up before its lines come in, and written once.
    head = (
        head.join(partners, F.col("isaf002") == F.col("pmaa001"), "left")
        .join(settle, F.col("xrce054") == F.col("isaf011"), "left")
        .select("isafdocno", "isaf011", date_text_mon("isaf014").alias("formatted_date"), "isaf022",
                branch_text("pmaa006").alias("branch_no"), "isaf021", "isaf002", *currency,
                by_prefix("isaf011", [("F", "list_docno")], F.lit(None)).alias("list_docno"))
    )
    head = written_once(head, "invoice-heads")
    lines = lines_in(t["isag_t"], dates.start, dates.end).filter(F.col("isagent") == entity).drop("isagent")
    rows = lines_of_headers(head, lines, ["isafdocno"], ["isagdocno"], "invoices")
    parts = labels(t["pmao_t"], "pmao002", ["pmao001", "pmao004", "pmao010"], ent_col="pmaoent", entity=entity)
    # Each lookup is a step, so the disk holds the shuffles of one join at a time, and of the lines one copy.
    chain = written_once(shipment_chain(t, entity, rows.select("isag002", "isag019").dropna()), "invoice-units")

    head_cols = ["isaf011", "formatted_date", "isaf022", "branch_no", "isaf021", "isaf002", "isag101", *currency]
    amounts = ["isag103", "isag104", "isag105", "isag004"]
    own = rows.select(*head_cols, *amounts, "isag002", "isag019", "isag009", "isag016",
                      by_prefix("isaf011", [("F", "isag010")], "isag017").alias("isag017"),
                      by_prefix("isaf011", [("F", "list_docno"), ("CN", "isag014")], F.lit(None)).alias("own_docno"))
    part = ((F.col("pmao002") == F.col("isag009")) & (F.col("pmao001") == F.col("isaf002"))
            & (F.col("pmao004") == F.col("isag016")))
    known = joined_once(own, [(parts, part)], "invoice-parts",
                        drop=["pmao001", "pmao002", "pmao004", "isag009", "isag016"])
    forget_step(rows, "invoices")
    shipment = (F.col("isag002") == F.col("xmdldocno")) & (F.col("isag019") == F.col("xmdl003"))
    shipped = joined_once(known, [(chain, shipment)], "invoice-lines", drop=["isag002", "isag019", "xmdldocno", "xmdl003"])
    forget_step(known, "invoice-parts")
    forget_step(chain, "invoice-units")
    ready = shipped.select(
        *head_cols, *amounts, "isag017", by_prefix("isaf011", [("F", F.lit(WASTE))], "pmao010").alias("pmao010"),
        "xmda033", F.coalesce("units", one_row()).alias("units"),
        by_prefix("isaf011", [("F", "own_docno"), ("CN", "own_docno")], "xmdl001").alias("xmdl001"))
    if ordered:
        # One shuffle for the groups and the order: ranges by what comes first in the order (all of it
        # grouping columns), so a hot invoice number spans several. The units are listed until then;
        # a fixed number of ranges, as small ranges put together would grow again by their units.
        ready = ready.repartitionByRange(default_ranges(ready), *[F.col(c).asc_nulls_last() for c in INVOICE_RANGES])
    keyed = (
        ready.withColumn("u", F.explode("units"))
        .select(*[c for c in ready.columns if c != "units"], F.col("isag004").alias("isag004_key"), "u.unit", "u.w")
    )
    group = [*INVOICE_RANGES, *currency, "isag004_key", "xmdl001", "unit", "xmda033"]
    sums = [F.sum(F.col(c) * F.col("w")).cast("decimal(38,2)").alias(c) for c in ("isag103", "isag104", "isag105")]
    if with_currency:
        sums.append(F.sum(F.col("isag004") * F.col("w")).cast("decimal(38,2)").alias("isag004"))
    agg = keyed.groupBy(*group).agg(*sums)
    head_cols = ["formatted_date", "isaf011", "isag017", "pmao010", "isaf022", "branch_no", "isaf021", "isaf002",
                 "isag101", "isag103", "isag104", "isag105"]
    if with_currency:
        cols = head_cols + ["isaf101", "isaf100", "isag004", "xmdl001", "unit", "xmda033"]
    else:
        agg = agg.withColumnRenamed("isag004_key", "isag004")
        cols = head_cols + ["isag004", "xmdl001", "unit", "xmda033"]
    return agg.select(*cols)


def _invoice_order(df: DataFrame) -> DataFrame:
    """ORDER BY invoice number; all other columns break ties, so the order is total."""
    ties = [c for c in df.columns if c != "isaf011"]
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in ["isaf011", *ties]])


def report_tax_invoice(t: Mapping[str, DataFrame], dates: DateRange, entity: int = DEFAULT_ENTITY,
                       ordered: bool = True, strict_entity: bool = False) -> DataFrame:
    """Confirmed tax invoices dated in ``dates``, grouped per line shape: net, tax and gross
    sums, exchange rate and currency, and ``SUM`` of the quantity although the quantity is
    also a grouping key (value times matching rows, A7). Lookup fan-out multiplies sums as in
    the source report (A11, T3). The header has no tenant filter in the source (T1);
    ``strict_entity`` adds it."""
    out = _tax_invoice(t, dates, entity, True, strict_entity, ordered)
    return _invoice_order(out) if ordered else out


def report_tax_invoice_by_price(t: Mapping[str, DataFrame], dates: DateRange, entity: int = DEFAULT_ENTITY,
                                ordered: bool = True, strict_entity: bool = False) -> DataFrame:
    """As R7 with the plain quantity and without the currency columns."""
    out = _tax_invoice(t, dates, entity, False, strict_entity, ordered)
    return _invoice_order(out) if ordered else out
