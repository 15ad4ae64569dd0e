"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "fleetweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query here expects (UTC, AQE on)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    return b.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`.

    Where the cluster names none (tests, a laptop) a local folder is made once for the session.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    own = getattr(shared_folder, "_own", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="fleetweave-")
        shared_folder._own = own
    return own


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what `staged` wrote, once nothing reads it any more."""
    path = getattr(df, "_staged_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def shipped(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per context: their Python workers import it."""
    sc = spark.sparkContext
    if getattr(sc, "_fleetweave_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="fleetweave-code-")  # on the driver, which serves it to the executors
    target = os.path.join(folder, "fleetweave_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("fleetweave", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._fleetweave_shipped = True
    return spark


def default_tokenizer_dir() -> str:
    """Where the vocabulary files lie; the environment variable FLEETWEAVE_TOKENIZERS moves it."""
    return os.environ.get("FLEETWEAVE_TOKENIZERS", "/opt/tokenizers")
