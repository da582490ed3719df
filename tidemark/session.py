"""Session factory for tests, the bench and examples, and the folder that a session's executors share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tidemark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A UTC session with AQE on; keyword arguments override single settings."""
    n = os.cpu_count() if cores == "*" else int(cores)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"),
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then uses a folder beside its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse')}/tidemark-checkpoints"
    return base.rstrip("/")
