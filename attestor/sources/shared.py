"""The folder that all executors see, and tables kept there for a session by what they were made from."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only on a local master may the session name none, elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestor-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table that several later steps read, written to the shared folder and read again: it is computed once, and a lost
    executor costs no more than one step."""
    path = f"{shared_dir(df.sparkSession)}/attestor/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of the files below paths: it changes when one of the tables is written anew."""
    jvm, conf, seen = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def made_once(spark: SparkSession, name: str, sources: list[str], make: Callable[[str], None]) -> str:
    """The path of what make(path) writes, written once in an application for one state of the source files."""
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, *sources))
    if key not in _made:
        path = f"{shared_dir(spark)}/attestor/{'-'.join(key)}"
        make(path)
        _made[key] = path
    return _made[key]
