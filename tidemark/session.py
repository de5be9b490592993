"""Session settings, and the package's way to executors that do not have it on their path."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides (dots as in Spark's names)."""
    b = SparkSession.builder.appName(app)
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
    path.write_bytes(held.getvalue())
    sc.addPyFile(str(path))
    sc._tidemark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset one of our own, on a local master only."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share ({master})")
    at = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def tabled(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the folder that the cluster shares and read it back.

    Stages that several features read are computed once, plans stay short, sizes are known to the optimizer, and a lost
    executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
