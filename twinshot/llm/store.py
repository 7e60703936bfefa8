"""Tables written once under the cluster's shared folder and read back; joins that no hot key can hold up."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Bytes of one Arrow batch between Spark and Python. Texts differ in length by orders of magnitude, so a
#: bound in rows alone would let one batch grow to any size.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="twinshot-llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder and read it back: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_lookup(rows: DataFrame, table: DataFrame, on: list[str], by: Column, how: str = "inner", parts: int = 32) -> DataFrame:
    """Join ``rows`` to a table with at most one row per key, whatever share of the rows one key has.

    Rows of a key are dealt into ``parts`` parts by ``by``. A key's row goes only to the parts that there
    are, so a key with few rows costs few copies, and no task gets more than a part of a hot key.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copies = dealt.select(*on, "_part").distinct().join(table, on)
    return dealt.join(copies, [*on, "_part"], how).drop("_part")


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors, as ``spark-submit --py-files`` would.

    Operators run their Python in tasks, which need the package; on a cluster where it is
    installed this call is superfluous but harmless. It acts once per application.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="twinshot-package-")) / "twinshot_package.zip"
        with zipfile.ZipFile(target, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
