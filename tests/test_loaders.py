import datetime as dt
import glob
from decimal import Decimal as D

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerframe.sources.loaders import as_declared, connection_shares, month_cuts, range_predicates, read_erp_jdbc
from ledgerframe.sources import loaders
from ledgerframe.sources.loaders import Tables, write_erp_lake
from ledgerframe.sources.schemas import ERP_SCHEMAS


def test_database_types_become_declared_types(spark):
    rows = [(D("666.0000000000"), "GL-1", "S", dt.datetime(1995, 3, 31, 23, 30), "x"), (None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "EXTRA decimal(38,10), GLAPDOCNO string, GLAPSTUS string, GLAPDOCDT timestamp, Z string")
    got = as_declared(raw, "glap_t")
    assert got.schema == spark.createDataFrame([], ERP_SCHEMAS["glap_t"]).schema
    assert [tuple(r) for r in got.collect()] == [("GL-1", dt.datetime(1995, 3, 31, 23, 30), "S"), (None, None, None)]

    tenant = spark.createDataFrame([(D("666"), "S1", "a", "b")], "OOAGENT decimal(38,10), OOAG001 string, OOAG003 string, OOAG011 string")
    assert as_declared(tenant, "ooag_t").filter("ooagent = 666").count() == 1
    with pytest.raises(ValueError, match="ooag011"):
        as_declared(tenant.drop("OOAG011"), "ooag_t")


def test_large_tables_need_partitioning(spark):
    tables = read_erp_jdbc(spark, "jdbc:none:", {})
    for name in ("apcb_t", "glap_t"):
        with pytest.raises(ValueError, match="partitioning"):
            tables[name]


def _matches(df, predicates):
    """How many of the conditions each row meets."""
    met = sum((F.expr(f"coalesce(cast(({p}) AS int), 0)") for p in predicates), F.lit(0))
    return {r.met for r in df.select(met.alias("met")).collect()}


@pytest.mark.parametrize(("kind", "values", "cuts"), [
    ("string", ["", "A", "AP-1", "AP-10", "AP-2", "O'Neil", "b", None], ["AP-1", "AP-2", "O'Neil"]),
    ("timestamp_ntz", [None, *(dt.datetime(1995, m, d, 23, 59, 59) for m in (1, 2, 3, 12) for d in (1, 28))],
     month_cuts(dt.date(1995, 2, 7), dt.date(1995, 3, 1))),
    ("int", [None, -5, 0, 9, 10, 11, 99], [0, 10]),
    ("int", [None, 1, 2], [2]),
    ("int", [None, 1, 2], []),
])
def test_predicates_leave_no_gap_and_no_overlap(spark, kind, values, cuts):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    assert _matches(df, range_predicates("c", cuts)) == {1}


def test_cuts_must_ascend():
    for cuts in (["b", "a"], ["a", "a"]):
        with pytest.raises(ValueError, match="ascend"):
            range_predicates("c", cuts)
    with pytest.raises(TypeError):
        range_predicates("c", [1.5])
    assert month_cuts(dt.date(1995, 11, 30), dt.date(1996, 1, 1)) == [
        dt.date(1995, 11, 1), dt.date(1995, 12, 1), dt.date(1996, 1, 1), dt.date(1996, 2, 1)]


def test_connections_share_one_bound():
    wanted = {"apcb_t": 90, "apca_t": 30, "pmaal_t": 1}
    for budget in (3, 4, 10, 50, 500):
        shares = connection_shares(wanted, budget)
        assert sum(shares.values()) <= budget and all(1 <= shares[n] <= wanted[n] for n in wanted)
    assert connection_shares(wanted, 13) == {"apcb_t": 9, "apca_t": 3, "pmaal_t": 1}
    assert connection_shares(wanted, 500) == wanted
    with pytest.raises(ValueError, match="budget"):
        connection_shares(wanted, 2)


def test_a_job_reads_its_ranges_within_the_bound(spark):
    calls = {}

    class Reader:
        def jdbc(self, url, name, predicates=None, properties=None, **rest):
            calls[name] = predicates, rest
            return spark.createDataFrame([], ERP_SCHEMAS[name]).repartition(len(predicates or [0]))

    class Session:
        read = Reader()

    days = range_predicates("apcadocdt", month_cuts(dt.date(1995, 1, 1), dt.date(1995, 12, 31)))
    keys = range_predicates("apcbdocno", ["AP-2", "AP-4", "AP-6"])
    names = ["apca_t", "apcb_t", "pmaal_t"]
    t = read_erp_jdbc(Session(), "jdbc:none:", {}, predicates={"apca_t": days, "apcb_t": keys}, budget=6, names=names)
    sizes = {n: t[n].rdd.getNumPartitions() for n in names}
    assert calls["apca_t"][0] == days and calls["apcb_t"][0] == keys and calls["pmaal_t"][0] is None
    assert sizes["apca_t"] + sizes["apcb_t"] + 1 <= 6 and sizes["apca_t"] > sizes["apcb_t"] > 0
    with pytest.raises(ValueError, match="either"):
        read_erp_jdbc(Session(), "jdbc:none:", {}, {"apca_t": ("x", 1, 2)}, predicates={"apca_t": days})
    with pytest.raises(KeyError):
        t["glap_t"]


def _groups_to_read(folder):
    """(row groups, those among them whose statistics admit an account that begins with 6 or 7)."""
    every = wanted = 0
    for path in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(path).metadata
        at = meta.schema.names.index("glaq002")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            every += 1
            wanted += stats.max >= "6" and stats.min < "8"
    return every, wanted


@pytest.mark.parametrize("partitioned", [False, True])
def test_voucher_lines_are_clustered_by_account_too(spark, tmp_path, monkeypatch, partitioned):
    accounts = F.format_string("%d%03d", F.expr("id % 9 + 1"), F.expr("id * 7919 % 1000"))
    names = StructType.fromDDL(ERP_SCHEMAS["glaq_t"]).fields
    made = {"glaqdocno": F.format_string("GL-%05d", F.expr("id div 40")), "glaq002": accounts, "glaq001": F.sha2(F.col("id").cast("string"), 256)}
    lines = spark.range(40_000).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in names])
    heads = spark.range(1000).select(*[
        {"glapdocno": F.format_string("GL-%05d", "id"), "glapdocdt": F.expr("date_add(date'1995-01-01', cast(id div 500 * 31 as int))")}
        .get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ERP_SCHEMAS["glap_t"]).fields])
    t = Tables(["glap_t", "glaq_t"], {"glap_t": heads, "glaq_t": lines}.__getitem__)
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(64 << 10))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.page.size.row.check.min", "100")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size.row.check.min", "100")
    try:
        write_erp_lake(t, f"{tmp_path}/new", files=2, partitioned=partitioned)
        monkeypatch.setattr(loaders, "FILTER_KEYS", {})
        write_erp_lake(t, f"{tmp_path}/old", files=2, partitioned=partitioned)
    finally:
        for key in ("parquet.block.size", "parquet.page.size.row.check.min", "parquet.block.size.row.check.min"):
            spark.sparkContext._jsc.hadoopConfiguration().unset(key)
    new, old = _groups_to_read(f"{tmp_path}/new/glaq_t"), _groups_to_read(f"{tmp_path}/old/glaq_t")
    assert new[0] >= 10 and old[1] == old[0] and new[1] <= new[0] * 0.5
    assert spark.read.parquet(f"{tmp_path}/new/glaq_t").count() == 40_000
