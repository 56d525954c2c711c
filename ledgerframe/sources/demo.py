"""ERP-shaped test tables derived from the generated TPC-H-style tables.

These are test inputs, not engine code: they give the reports realistic joins (headers and
lines by document number), a second tenant (100), a second language, NULL and ``'NULL'``
codes, trailing blanks in account codes, short item codes, missing labels, duplicate lines and
two shipments for some orders. Every table is a lazy DataFrame over the driver's Parquet files,
so its size grows with the scale factor. The same definitions, written as SQL, feed the DuckDB
oracle in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .loaders import Tables, read_driver_tables
from .schemas import ERP_SCHEMAS

# Fixed values planted in the test tables.
LANGUAGES = ("en_US", "zh_TW")
MAIN_ENTITY = 666
OTHER_ENTITY = 100
ACCOUNT_LABELS = [
    ("6100", "en_US", "Salaries"),
    ("6100", "zh_TW", "Salaries zh"),
    ("6200", "zh_TW", None),
    ("6200", "en_US", "Rent"),
    ("7100", "en_US", None),
]
CATEGORY_CODES = ("A", "N", "R")
CATEGORIES = ("216", "300")


def _entity(key: Column) -> Column:
    return F.when(key % 50 == 0, F.lit(OTHER_ENTITY)).otherwise(F.lit(MAIN_ENTITY)).cast("int")


def _pad8(key: Column) -> Column:
    return F.lpad(key.cast("string"), 8, "0")


def _doc(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), _pad8(key))


def _item(partkey: Column) -> Column:
    return F.when(partkey % 10 == 0, partkey.cast("string")).otherwise(_pad8(partkey))


def _issue_doc(key: Column) -> Column:
    prefix = (
        F.when(key % 4 == 0, "TS-IN010-").when(key % 4 == 1, "TS-IN020-").when(key % 4 == 2, "TS-IN999-")
        .otherwise("TS-IN500-")
    )
    return F.concat(prefix, _pad8(key))


def _cost_doc(key: Column) -> Column:
    return F.concat(F.when(key % 10 == 0, "XC090-").otherwise("XC-"), _pad8(key))


def _account(linenumber: Column) -> Column:
    n = linenumber % 4
    return F.when(n == 0, "6100").when(n == 1, "6200 ").when(n == 2, "7100").otherwise("1100")


def _abc(key: Column) -> Column:
    return F.when(key % 3 == 0, "A").when(key % 3 == 1, "N").otherwise("R")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def _languages(df: DataFrame, name: str) -> DataFrame:
    """One copy of each row per language (a generator, not a join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in LANGUAGES])))


def _build(spark: SparkSession, base: Tables, name: str) -> DataFrame:  # noqa: C901 - one branch per table
    o = base["orders"]
    li = base["lineitem"]
    ok, lk = F.col("o_orderkey"), F.col("l_orderkey")
    ocust = F.col("o_custkey").cast("string")
    if name == "apca_t":
        pri = F.col("o_orderpriority")
        return o.select(
            _entity(ok).alias("apcaent"), _doc("AP-", ok).alias("apcadocno"), F.col("o_orderdate").alias("apcadocdt"),
            F.when(pri == "1-URGENT", "01").when(pri == "2-HIGH", "17").when(pri == "3-MEDIUM", "19")
            .when(pri == "5-LOW", "29").otherwise("99").alias("apca001"),
            ocust.alias("apca004"), F.when(ok % 3 == 0, _doc("GL-", ok)).alias("apca038"),
            pri.alias("apca053"), F.when(F.col("o_orderstatus") == "P", "N").otherwise("Y").alias("apcastus"))
    if name == "apcb_t":
        return li.select(
            _entity(lk).alias("apcbent"), _doc("AP-", lk).alias("apcbdocno"), F.col("l_linestatus").alias("apcb002"),
            _item(F.col("l_partkey")).alias("apcb004"), F.col("l_returnflag").alias("apcb005"),
            _money("l_quantity").alias("apcb007"),
            F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("int").alias("apcb022"),
            F.col("l_suppkey").cast("string").alias("apcb028"), _money("l_extendedprice").alias("apcb101"),
            _money("l_extendedprice").alias("apcb103"), _money("l_tax").alias("apcb104"),
            _money("l_extendedprice").alias("apcb105"))
    if name == "glacl_t":
        return spark.createDataFrame(ACCOUNT_LABELS, ERP_SCHEMAS["glacl_t"])
    if name == "glap_t":
        return o.select(
            _doc("GL-", ok).alias("glapdocno"), F.col("o_orderdate").alias("glapdocdt"),
            F.when(F.col("o_orderstatus") == "P", "N").otherwise("S").alias("glapstus"))
    if name == "glaq_t":
        return li.select(
            _doc("GL-", lk).alias("glaqdocno"), F.concat("l_returnflag", "l_linestatus").alias("glaq001"),
            _account(F.col("l_linenumber")).alias("glaq002"), _money("l_extendedprice").alias("glaq003"),
            F.lit(0).cast("decimal(18,2)").alias("glaq004"), (F.col("l_suppkey") % 25).cast("string").alias("glaq018"))
    if name == "imaal_t":
        p = _languages(base["part"], "lang")
        return p.select(
            F.lit(MAIN_ENTITY).alias("imaalent"), _item(F.col("p_partkey")).alias("imaal001"),
            F.col("lang").alias("imaal002"), F.concat("p_name", F.lit("/"), "lang").alias("imaal003"),
            F.col("p_type").alias("imaal004"))
    if name == "inba_t":
        st = F.col("o_orderstatus")
        return o.select(
            _entity(ok).alias("inbaent"), _issue_doc(ok).alias("inbadocno"),
            F.when(ok % 3 == 0, "2").otherwise("1").alias("inba001"), F.col("o_orderdate").alias("inba002"),
            (F.col("o_custkey") % 100 + 1).cast("string").alias("inba003"),
            (F.col("o_custkey") % 25).cast("string").alias("inba004"),
            F.when(ok % 5 != 0, F.col("o_orderpriority")).alias("inba008"),
            F.when(st == "P", "X").otherwise(st).alias("inbastus"))
    if name == "inbb_t":
        return li.select(
            _entity(lk).alias("inbbent"), _issue_doc(lk).alias("inbbdocno"), _item(F.col("l_partkey")).alias("inbb001"),
            F.lit("PCS").alias("inbb010"), _money("l_quantity").alias("inbb012"), F.col("l_returnflag").alias("inbb016"),
            F.when(F.col("l_linenumber") != 1, F.col("l_linestatus")).alias("inbb020"))
    if name == "isaf_t":
        invoice = F.when(ok % 10 == 0, "F").when(ok % 10 == 1, "CN").otherwise("IV")
        return o.select(
            _entity(ok).alias("isafent"), _doc("IS-", ok).alias("isafdocno"), ocust.alias("isaf002"),
            F.concat(invoice, _pad8(ok)).alias("isaf011"), F.col("o_orderdate").alias("isaf014"),
            F.concat(F.lit("TAX"), ocust).alias("isaf021"), F.concat(F.lit("Buyer "), ocust).alias("isaf022"),
            F.when(ok % 2 == 0, "USD").otherwise("THB").alias("isaf100"),
            F.when(ok % 2 == 0, F.lit(35.5)).otherwise(F.lit(1)).cast("decimal(10,4)").alias("isaf101"),
            F.when(F.col("o_orderstatus") == "P", "N").otherwise("Y").alias("isafstus"))
    if name == "isag_t":
        rf = F.col("l_returnflag")
        return li.select(
            _entity(lk).alias("isagent"), _doc("IS-", lk).alias("isagdocno"), _doc("SH-", lk).alias("isag002"),
            _money("l_quantity").alias("isag004"), _item(F.col("l_partkey")).alias("isag009"),
            F.concat(F.lit("waste "), rf).alias("isag010"), _doc("RT-", lk).alias("isag014"),
            F.col("l_linestatus").alias("isag016"), F.concat(F.lit("goods "), rf).alias("isag017"),
            _doc("SO-", lk).alias("isag019"), _money("l_discount").alias("isag101"),
            _money("l_extendedprice").alias("isag103"), _money("l_tax").alias("isag104"),
            _money("l_extendedprice").alias("isag105"))
    if name == "ooag_t":
        return base["supplier"].select(
            F.lit(MAIN_ENTITY).alias("ooagent"), F.col("s_suppkey").cast("string").alias("ooag001"),
            F.col("s_nationkey").cast("string").alias("ooag003"), F.col("s_name").alias("ooag011"))
    if name == "oocql_t":
        rows = [(MAIN_ENTITY, cat, code, lang, f"{code}/{cat}/{lang}")
                for code in CATEGORY_CODES for cat in CATEGORIES for lang in LANGUAGES]
        return spark.createDataFrame(rows, ERP_SCHEMAS["oocql_t"])
    if name == "ooefl_t":
        n = _languages(base["nation"], "lang")
        return n.select(
            F.lit(MAIN_ENTITY).alias("ooeflent"), F.col("n_nationkey").cast("string").alias("ooefl001"),
            F.col("lang").alias("ooefl002"), F.col("n_name").alias("ooefl003"),
            F.concat("n_name", F.lit("/"), "lang").alias("ooefl004"))
    if name == "oofa_t":
        return base["supplier"].select(
            F.lit(MAIN_ENTITY).alias("oofaent"), F.col("s_suppkey").cast("string").alias("oofa003"),
            F.col("s_name").alias("oofa011"))
    if name == "oofb_t":
        return base["customer"].select(
            F.lit(MAIN_ENTITY).alias("oofbent"), F.col("c_custkey").cast("string").alias("oofb019"),
            F.col("c_mktsegment").alias("oofb011"))
    if name == "ooff_t":
        return li.select(
            F.lit("aint301").alias("ooff002"), _issue_doc(lk).alias("ooff003"), F.col("l_linenumber").alias("ooff004"),
            F.concat(F.lit("note "), "l_returnflag").alias("ooff013"))
    if name == "ooibl_t":
        pri = _languages(o.select(F.col("o_orderpriority").alias("p")).distinct(), "lang")
        return pri.select(
            F.lit(MAIN_ENTITY).alias("ooiblent"), F.col("p").alias("ooibl002"), F.col("lang").alias("ooibl003"),
            F.concat("p", F.lit("/"), "lang").alias("ooibl004"))
    if name == "pmaa_t":
        nk = F.col("c_nationkey") % 8
        branch = (F.when(nk == 1, "NULL").when(nk == 2, "R0001").when(nk == 3, "R0002").when(nk == 4, "R0003")
                  .when(nk == 5, "R0006").when(nk == 6, "R0007").when(nk != 0, "R0099"))
        return base["customer"].select(
            F.lit(MAIN_ENTITY).alias("pmaaent"), F.col("c_custkey").cast("string").alias("pmaa001"),
            branch.alias("pmaa006"))
    if name == "pmaal_t":
        c = _languages(base["customer"].filter(F.col("c_custkey") % 7 != 0), "lang")
        return c.select(
            F.lit(MAIN_ENTITY).alias("pmaalent"), F.col("c_custkey").cast("string").alias("pmaal001"),
            F.col("lang").alias("pmaal002"), F.concat("c_name", F.lit("/"), "lang").alias("pmaal004"))
    if name == "pmao_t":
        pk = F.col("l_partkey")
        # made distinct as the numbers that the texts are made of, which are shuffled in less room
        pairs = li.filter(pk % 3 != 0).join(o, lk == ok).select("o_custkey", "l_partkey", "l_linestatus").distinct()
        return pairs.select(
            F.lit(MAIN_ENTITY).alias("pmaoent"), ocust.alias("pmao001"), _item(pk).alias("pmao002"),
            F.col("l_linestatus").alias("pmao004"), F.concat(F.lit("CP-"), pk.cast("string")).alias("pmao009"),
            F.concat(F.lit("cust part "), pk.cast("string")).alias("pmao010"))
    if name == "xcbl_t":
        return o.select(
            F.lit("C1").alias("xcblcomp"), F.lit("L1").alias("xcblld"),
            F.concat(F.lit("T"), "o_orderstatus").alias("xcbl001"),
            F.year("o_orderdate").cast("int").alias("xcbl002"), F.month("o_orderdate").cast("int").alias("xcbl003"),
            _doc("AP-", ok).alias("xcbl004"), F.col("o_orderpriority").alias("xcbl005"), _abc(ok).alias("xcbl010"),
            (F.col("o_custkey") % 25).cast("string").alias("xcbl012"), _money("o_totalprice").alias("xcbl100"))
    if name == "xcea_t":
        return o.select(
            _cost_doc(ok).alias("xceadocno"), F.year("o_orderdate").cast("int").alias("xcea004"),
            F.month("o_orderdate").cast("int").alias("xcea005"),
            F.when(ok % 7 != 3, _doc("GL-", ok)).alias("xcea101"))
    if name in ("xceb_t", "xcec_t"):
        p = name[:4]
        return li.select(
            _cost_doc(lk).alias(f"{p}docno"), _issue_doc(lk).alias(f"{p}001"), F.col("l_linenumber").alias(f"{p}002"),
            _item(F.col("l_partkey")).alias(f"{p}004"), F.trim(_account(F.col("l_linenumber"))).alias(f"{p}101"),
            (F.col("l_suppkey") % 25).cast("string").alias(f"{p}108"), F.col("l_returnflag").alias(f"{p}110"),
            _money("l_quantity").alias(f"{p}201"), _money("l_extendedprice").alias(f"{p}202"))
    if name == "xmda_t":
        return o.select(_doc("SO-", ok).alias("xmdadocno"), F.concat(F.lit("PO-"), ocust).alias("xmda033"))
    if name == "xmdg_t":
        st = F.col("o_orderstatus")
        return o.select(
            _entity(ok).alias("xmdgent"), _doc("SN-", ok).alias("xmdgdocno"), F.col("o_orderdate").alias("xmdgdocdt"),
            (F.col("o_custkey") % 100 + 1).cast("string").alias("xmdg002"),
            (F.col("o_custkey") % 25).cast("string").alias("xmdg003"), ocust.alias("xmdg005"),
            F.col("o_orderpriority").alias("xmdg008"), _abc(ok).alias("xmdg009"), ocust.alias("xmdg017"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(2))).alias("xmdg028"),
            F.when(st == "P", "X").when(st == "F", "Y").otherwise("H").alias("xmdgstus"))
    if name == "xmdh_t":
        n = F.col("l_linenumber") % 3
        bag = F.concat(F.lit("BAG "), F.col("l_quantity").cast("int").cast("string"), F.lit("KG 2"))
        return li.select(
            _entity(lk).alias("xmdhent"), _doc("SN-", lk).alias("xmdhdocno"), _doc("SO-", lk).alias("xmdh001"),
            _item(F.col("l_partkey")).alias("xmdh006"), F.when(n == 1, bag).when(n == 2, "LOOSE").alias("xmdh015"),
            _money("l_quantity").alias("xmdh016"), _money("l_quantity").alias("xmdh017"),
            F.col("l_returnflag").alias("xmdh023"), F.col("l_linestatus").alias("xmdh034"))
    if name == "xmdk_t":
        # Every order has one shipment; every fourth order a second one (one scan, no union).
        first = F.struct(_doc("SH-", ok).alias("doc"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(3))).alias("at"))
        second = F.struct(_doc("SX-", ok).alias("doc"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(4))).alias("at"))
        ships = o.select(ok, F.explode(F.when(ok % 4 == 0, F.array(first, second)).otherwise(F.array(first))).alias("s"))
        return ships.select(
            F.lit(MAIN_ENTITY).alias("xmdkent"), F.col("s.doc").alias("xmdkdocno"), F.col("s.at").alias("xmdk001"),
            _doc("SN-", ok).alias("xmdk005"), _doc("SO-", ok).alias("xmdk006"))
    if name == "xmdl_t":
        return o.select(
            _entity(ok).alias("xmdlent"), _doc("SH-", ok).alias("xmdldocno"), _doc("SN-", ok).alias("xmdl001"),
            _doc("SO-", ok).alias("xmdl003"))
    if name == "xrce_t":
        return li.filter(lk % 10 == 0).select(
            _doc("F", lk).alias("xrce054"), F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("xrce003"),
            F.concat(_doc("RC-", lk), F.lit("-"), F.col("l_linenumber").cast("string")).alias("xrcedocno"))
    raise KeyError(name)


def erp_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All 30 ERP tables, derived lazily from the driver's tables under ``sf_dir``."""
    base = read_driver_tables(spark, sf_dir)
    return Tables(list(ERP_SCHEMAS), lambda name: _build(spark, base, name))
