"""Data checks that accompany the reports (the reports reproduce fan-out on purpose, T3).

* ``fanout_keys``: lookup keys that match more than one row, i.e. keys that multiply report
  rows or sums. A partial count per key happens before the shuffle, so a hot key costs one
  row per map task.
* ``missing_labels``: driving keys with no label row, by a left-anti join (no collect).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import DEFAULT_ENTITY


def fanout_keys(df: DataFrame, keys: Sequence[str], lookup: str) -> DataFrame:
    """``(lookup, key, matches)`` for every key with more than one row."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches")).filter(F.col("matches") > 1)
    return counted.select(F.lit(lookup).alias("lookup"), F.concat_ws("|", *keys).alias("key"), "matches")


# Lookups the reports join without collapsing them: name, table, key expressions, ON filter, tenant
# column (None where the source report has no tenant filter).
FANOUT_LOOKUPS: list[tuple[str, str, list[str], str | None, str | None]] = [
    ("xmdh_t by notice and order", "xmdh_t", ["xmdhdocno", "xmdh001"], None, "xmdhent"),
    ("imaal_t by item, any language", "imaal_t", ["imaal001"], None, None),
    ("imaal_t by item, en_US", "imaal_t", ["imaal001"], "imaal002 = 'en_US'", "imaalent"),
    ("oocql_t by code, en_US", "oocql_t", ["oocql002"], "oocql003 = 'en_US'", None),
    ("inbb_t by issue document", "inbb_t", ["inbbdocno"], None, None),
    ("pmao_t by part, customer, type", "pmao_t", ["pmao002", "pmao001", "pmao004"], None, "pmaoent"),
    ("oofa_t by contact", "oofa_t", ["oofa003"], None, "oofaent"),
    ("ooefl_t by department, en_US", "ooefl_t", ["ooefl001"], "ooefl002 = 'en_US'", "ooeflent"),
    ("pmaal_t by partner, en_US", "pmaal_t", ["pmaal001"], "pmaal002 = 'en_US'", "pmaalent"),
    ("pmaa_t by partner", "pmaa_t", ["pmaa001"], None, "pmaaent"),
    ("xmdl_t by shipment and order", "xmdl_t", ["xmdldocno", "xmdl003"], None, "xmdlent"),
    ("ooag_t by staff", "ooag_t", ["ooag001"], None, "ooagent"),
    ("glacl_t by trimmed account, en_US", "glacl_t", ["trim(glacl002)"], "glacl003 = 'en_US'", None),
]


def fanout_filter(where: str | None, tenant: str | None, entity: int = DEFAULT_ENTITY) -> str | None:
    """The SQL condition of one lookup."""
    conditions = [c for c in (where, tenant and f"{tenant} = {int(entity)}") if c]
    return " AND ".join(conditions) or None


def fanout_report(t: Mapping[str, DataFrame], entity: int = DEFAULT_ENTITY) -> DataFrame:
    """Fan-out keys of every uncollapsed lookup, in one DataFrame."""
    out: DataFrame | None = None
    for name, table, keys, where, tenant in FANOUT_LOOKUPS:
        condition = fanout_filter(where, tenant, entity)
        df = t[table] if condition is None else t[table].filter(F.expr(condition))
        named = df.select(*[F.expr(k).alias(f"k{i}") for i, k in enumerate(keys)])
        part = fanout_keys(named, named.columns, name)
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def list_sizes(t: Mapping[str, DataFrame], most: int = 100) -> DataFrame:
    """``(xrce054, n_rows)`` of the ``most`` longest settlement lists, which end as one value each."""
    counted = t["xrce_t"].filter(F.col("xrce054").isNotNull()).groupBy("xrce054").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.orderBy(F.col("n_rows").desc(), "xrce054").limit(most)


def missing_labels(driving: DataFrame, key: str, labels: DataFrame, label_key: str) -> DataFrame:
    """Distinct non-NULL driving keys without any label row."""
    keys = driving.select(F.col(key).alias("key")).filter(F.col("key").isNotNull()).distinct()
    return keys.join(labels.select(F.col(label_key).alias("key")), "key", "left_anti")
