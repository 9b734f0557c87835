"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.errors import QuerytideError

_LOCAL_FOLDERS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def build_session(app_name: str = "querytide", **conf: str) -> SparkSession:
    """A session with the settings the operators expect. The cluster's own settings win where they exist."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise QuerytideError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="querytide-")
    return _LOCAL_FOLDERS[context.applicationId]


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` to the shared folder, with the writer's options, and read it back.

    The read side knows the table's true size, so Catalyst broadcasts it in later joins only if it is small, and
    a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_paths(spark: SparkSession) -> list[str]:
    """The tables this application has stored and not dropped."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_stored(spark: SparkSession, paths: Iterable[str] | None = None) -> int:
    """Delete the tables this application has stored so far, or those given, and return how many there were.

    Results that still read them must have been written or collected before."""
    held = stored_paths(spark)
    gone = held if paths is None else [path for path in held if path in set(paths)]
    _WRITTEN[spark.sparkContext.applicationId] = [path for path in held if path not in set(gone)]
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in gone:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(gone)


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
