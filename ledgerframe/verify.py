"""Cross-engine check: run a key in Spark and its oracle text in DuckDB, compare unordered rows.

Mirrors the driver's gate: column names compared sorted, row counts, and the multiset of rows
with values normalised to text (decimals keep their scale, so a type drift shows up).
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_VIEWS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v: object) -> object:
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return f"D:{v}"
    if isinstance(v, dt.datetime):
        return f"T:{v.isoformat()}"
    if isinstance(v, dt.date):
        return f"d:{v.isoformat()}"
    if isinstance(v, float):
        return f"F:{v!r}"
    if isinstance(v, bool):
        return f"B:{v}"
    if isinstance(v, int):
        return f"I:{v}"
    return f"S:{v}"


@dataclass
class Comparison:
    key: str
    ok: bool
    spark_rows: int
    oracle_rows: int
    spark_cols: list[str]
    oracle_cols: list[str]
    only_spark: list[tuple] = field(default_factory=list)
    only_oracle: list[tuple] = field(default_factory=list)

    def summary(self) -> str:
        head = f"{self.key}: {'OK' if self.ok else 'MISMATCH'} spark={self.spark_rows} oracle={self.oracle_rows}"
        if self.spark_cols != self.oracle_cols:
            head += f"\n  cols spark={self.spark_cols}\n  cols oracle={self.oracle_cols}"
        for r in self.only_spark[:3]:
            head += f"\n  only spark : {r}"
        for r in self.only_oracle[:3]:
            head += f"\n  only oracle: {r}"
        return head


def compare(key: str, df: DataFrame, sql: str, con) -> Comparison:
    s_cols = sorted(df.columns)
    s_rows = Counter(tuple(_norm(r[c]) for c in s_cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    o_cols = sorted(names)
    idx = [names.index(c) for c in o_cols]
    o_rows = Counter(tuple(_norm(row[i]) for i in idx) for row in cur.fetchall())
    only_s = list((s_rows - o_rows).elements())
    only_o = list((o_rows - s_rows).elements())
    ok = s_cols == o_cols and not only_s and not only_o
    return Comparison(key, ok, sum(s_rows.values()), sum(o_rows.values()), s_cols, o_cols, only_s, only_o)
