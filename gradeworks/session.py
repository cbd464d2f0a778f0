"""Where written tables and checkpoints go: the shared folder the session names."""

import uuid

from pyspark.sql import SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; its warehouse folder then serves.
    """
    folder = spark.conf.get(FOLDER_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {FOLDER_SETTING} to a folder all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.replace("file:/", "file:///", 1)
    return folder.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, so that no run overwrites another's."""
    return f"{shared_folder(spark)}/gradeworks/{name}-{uuid.uuid4().hex}"
