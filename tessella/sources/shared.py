"""The folder that all executors and the driver share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


#: Folders made by this process, by application: the setting itself cannot be changed while a session runs.
_made: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or, where that is unset, a folder in the warehouse that goes when the session's JVM ends."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        application = spark.sparkContext.applicationId
        path = _made.get(application)
        if path is None:
            path = _made[application] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared-{uuid.uuid4().hex}"
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            files.mkdirs(folder)
            files.deleteOnExit(folder)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name below it that nothing has yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
