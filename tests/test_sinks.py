import csv
import glob
import json
import os
from decimal import Decimal as D

from ledgerframe.sinks import relabel, rows_as_arrays, rows_as_objects, with_row_count, write_labelled_csv


def test_rows_as_arrays_and_objects(spark):
    df = spark.createDataFrame([("AP-1", 3, None, D("12.50")), ("AP-2", None, "x", D("100.00"))],
                               "doc string, n int, s string, amt decimal(18,2)")
    arrays = [json.loads(r.row) for r in rows_as_arrays(df).collect()]
    assert arrays == [["AP-1", 3, None, 12.5], ["AP-2", None, "x", 100]]
    objs = [r.row for r in rows_as_objects(df).collect()]
    assert objs[0] == '{"DOC":"AP-1","N":3,"S":null,"AMT":12.5}'  # NULL fields kept, upper-case keys
    assert json.loads(objs[1]) == {"DOC": "AP-2", "N": None, "S": "x", "AMT": 100}


def test_labelled_csv_by_period(spark, tmp_path):
    df = spark.createDataFrame([("6100", "Sal")], "a string, b string")
    out = str(tmp_path / "export")
    write_labelled_csv(df, ["Account No.", "A/C Title"], out, year=1995, month=3)
    files = glob.glob(os.path.join(out, "year=1995", "month=3", "*.csv"))
    assert files
    with open(files[0]) as fh:
        rows = list(csv.reader(fh))
    assert rows == [["Account No.", "A/C Title"], ["6100", "Sal"]]
    assert relabel(df, ["x", "y"]).columns == ["x", "y"]


def test_row_count_observation(spark):
    df, obs = with_row_count(spark.range(7))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 7


def test_dates_in_rows_are_iso_text(spark):
    df = spark.sql("SELECT timestamp_ntz'1995-03-01 05:06:07.5' AS d, CAST(NULL AS timestamp_ntz) AS e")
    assert rows_as_arrays(df).first().row == '["1995-03-01T05:06:07.500Z",null]'
    assert rows_as_objects(df).first().row == '{"D":"1995-03-01T05:06:07.500Z","E":null}'
