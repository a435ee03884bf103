"""Where sessions of the registered queries live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from keelstone.sources.files import Files


def session_root(spark: SparkSession) -> str:
    """A fresh empty folder below ``spark.checkpoint.dir``, which driver and executors share; it goes with the application.

    Where that is unset, a local master gets a temporary folder, and any other
    one a folder in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        base = tempfile.mkdtemp(prefix="keelstone-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/keelstone/session-{uuid.uuid4().hex}"
    files = Files(spark)
    files.make(root)
    files.drop_at_exit(root)
    return root
