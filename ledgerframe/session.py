"""Spark session settings shared by reports, tests and the benchmark.

Everything here is a public Spark configuration key. The same settings are right for a
cluster; only the loopback binding is applied for ``local[...]`` masters.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every report relies on:
# * AQE re-plans at stage boundaries: coalesces small shuffle partitions, turns a shuffle
#   join into a broadcast when the measured side is under the threshold, and splits skewed
#   partitions (the NULL-key chains of the tax-invoice reports, hot customers, hot documents).
# * UTC session zone: report timestamps are zone-free (timestamp_ntz), but text formatting of
#   session timestamps must not depend on the machine.
# * ANSI mode stays on (Spark 4 default): bad casts raise instead of silently producing NULL.
BASE_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}

LOCAL_CONF: dict[str, str] = {
    # Both are needed on a loopback-only machine; binding alone loses large task results.
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.driver.memory": "16g",
}


def build_session(
    master: str | None = None,
    app_name: str = "ledgerframe",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the report settings.

    ``shuffle_partitions`` should be about 2-3x the total executor cores of the cluster; AQE
    then coalesces what is not needed. Leave it ``None`` to keep the cluster's value.
    """
    builder = SparkSession.builder.appName(app_name)
    conf = dict(BASE_CONF)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            conf.update(LOCAL_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
