"""Session helpers: shipping the package to Python workers, and safe scratch space."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: dict[str, str] = {}


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, from the shared folder.

    Unless the cluster sets them itself, Arrow batches are limited to 4 MB, since texts
    are large and a batch is held several times over in the JVM and in Python.
    """
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, "4m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    target = f"{scratch_dir(spark)}/ship-{app}/{root.name}.zip"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(target)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(target)
    _shipped[app] = target


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset and the master is local is a folder of this machine used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext.getCheckpointDir()
    if named:
        if not have:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if have:
        return have
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir("file://" + folder)
    return "file://" + folder


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and cut its lineage there."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hinted(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """A broadcast hint if a materialised df measures at most max_bytes; else df, for a shuffle join."""
    one = F.lit(16)
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            one = one + 8 * F.greatest(F.size(name), F.lit(1))
        elif kind in ("string", "binary"):
            one = one + F.coalesce(F.octet_length(name), F.lit(0))
        else:
            one = one + 8 * (1 + kind.count(":"))
    size = df.agg(F.sum(one.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames uses."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = base
    while name.lower() in taken:
        name = f"{base}_{uuid.uuid4().hex[:6]}"
    return name
