"""Session helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_built: dict[tuple, object] = {}
#: Tables written by ``materialize``, by their object's id.
_written: dict[int, tuple] = {}


def built_once(spark: SparkSession, name: str, build):
    """The large column expression of that name: building one takes thousands of calls into the JVM."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="webgauge-"), "webgauge.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("webgauge", os.path.relpath(full, here)))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, as in tests, a local folder is made and set for it, but only on a local master: on a cluster the
    executors couldn't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="webgauge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, p = _hadoop(spark, path)
    files.deleteOnExit(p)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    files, p = _hadoop(spark, path)
    files.delete(p, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a reread of finished files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` gave and that nothing reads any more."""
    ref, path = _written.pop(id(df), (None, None))
    if ref is not None and ref() is df:
        remove_path(df.sparkSession, path)


@contextlib.contextmanager
def session_settings(spark: SparkSession, **settings: str):
    """Settings of the session (dots written as double underscores) for a while."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
