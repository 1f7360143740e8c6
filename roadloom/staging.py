"""Tables that cut lineage, written to the folder that all executors share.

Iterative and multi-pass operators write what they need again as Parquet under ``spark.checkpoint.dir``. A lost executor
then costs only its running tasks: the table is in shared storage, not in executor memory or on executor disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows in an Arrow batch, so that batches of very long texts stay small.
BATCH_ROWS = 512

_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset (tests on one machine), a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='roadloom-')}"
        atexit.register(_remove, _own[app])
    return _own[app]


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df``, written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def within_bound(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a staged table has few enough rows to be broadcast; beyond that, joins shuffle."""
    return df.limit(rows + 1).count() <= rows


def grown(df: DataFrame) -> DataFrame:
    """``df``, which Python or an explode has made many times larger than its source, for a join that shuffles it.

    The planner takes such rows for about as many as the source has, and would send them all to the driver to broadcast them.
    """
    return df.hint("merge")


def bounded(df: DataFrame) -> DataFrame:
    """A staged table for a join: broadcast if it has few enough rows, else shuffled.

    The planner goes by bytes of its files, and a broadcast takes many times as many in the driver.
    """
    return F.broadcast(df) if within_bound(df) else grown(df)


def python_ready(spark: SparkSession) -> None:
    """Before a Python stage: ships this package to the workers, and keeps Arrow batches short, as a row may hold a very long text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="roadloom-code-")) / "roadloom_code.zip"
        atexit.register(_remove, str(target.parent))
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
