"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared scratch folder the cluster names in `spark.checkpoint.dir`.

    Only a local master, whose tasks all run in this process, may do without the setting; it
    then gets a folder of its own, once per session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="veilscan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
