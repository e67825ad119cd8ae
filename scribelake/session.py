"""Session helpers: where scratch tables go, and the settings the jobs like."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for.  The skew, rebalance and local-shuffle
# decisions are left to adaptive execution; the byte limit keeps an Arrow batch of
# long documents or audio from outgrowing a Python worker.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def dealt(stored: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a stored table out to four tasks a core where its files make fewer."""
    wanted = 4 * stored.sparkSession.sparkContext.defaultParallelism
    return stored.repartition(wanted, *keys) if stored.rdd.getNumPartitions() < wanted else stored


# temporary folders of local sessions that name no shared one, by application
_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="scribelake-")
    return _LOCAL_ROOTS[context.applicationId]


def _scratch_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/scribelake-{spark.sparkContext.applicationId}"


# paths given out while a step runs whose intermediates go when it is done, by application
_STEPS: dict[str, list[list[str]]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's scratch folder; nothing is ever overwritten."""
    path = f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _STEPS.get(spark.sparkContext.applicationId, []):
        paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    found.getFileSystem(conf).delete(found, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application stored.  Frames that were read from it are void then."""
    _delete(spark, _scratch_folder(spark))


@contextmanager
def step(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end what was stored inside, except paths taken out of the list given.

    For jobs of several steps, each of which leaves one table that was materialised: what
    was stored on the way to it is not read again.
    """
    running = _STEPS.setdefault(spark.sparkContext.applicationId, [])
    paths: list[str] = []
    running.append(paths)
    try:
        yield paths
    finally:
        # by identity, as lists of equal paths are equal
        running[:] = [p for p in running if p is not paths]
        for path in paths:
            _delete(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet to shared storage and reading it back.

    Unlike an executor-local cache the table survives the loss of any executor.  It stays
    until :func:`clear_scratch`, or the end of the :func:`step` that it is made in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def step_result(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """:func:`materialise` at the end of a step: the result is kept, what led to it is not."""
    kept = materialise(df, name)
    own = paths.pop()
    # an outer step, if there is one, still has the path
    assert own.rsplit("/", 1)[-1].startswith(f"{name}-")
    return kept
