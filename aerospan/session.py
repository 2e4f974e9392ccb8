"""Session settings, and cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What a session needs for the engine's semantics and for large inputs; set before it starts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "aerospan", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that ``spark.checkpoint.dir`` names; in local tests in one made for them."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="aerospan-"))
    return df.checkpoint(eager=True)


_MADE: list[tuple[SparkSession, str]] = []


def _delete() -> None:
    """Folders made below the shared one go when the driver's Python ends."""
    for spark, path in _MADE:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before the interpreter does
            return


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; below one made for the test where none is set and Spark is local."""
    import atexit
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="aerospan-")
        spark.sparkContext.setCheckpointDir(found)
    if not _MADE:
        atexit.register(_delete)
    _MADE.append((spark, f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"))
    return _MADE[-1][1]


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and the plan starts anew.

    For loops: what a checkpoint keeps of the plan before it (constraints) doubles with every round.
    """
    path, schema = shared_folder(df.sparkSession, "step"), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
