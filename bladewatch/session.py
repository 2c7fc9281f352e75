"""Session settings and the shared scratch folder."""

from __future__ import annotations

import getpass
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
MODELS_KEY = "spark.bladewatch.models.dir"
UNIT_ROWS_KEY = "spark.bladewatch.maxUnitRows"
DEFAULT_UNIT_ROWS = 2_000_000

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A single-node session for tests and bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bladewatch")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Session setting the wide projections need.

    HotSpot does not compile methods above 8000 bytes, so a generated method beyond that size is slower than
    the operator-wise code Spark falls back to under this limit.
    """
    ship(spark)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='bladewatch-package-')}/bladewatch", "zip", package.parent, package.name)
        context.addPyFile(archive)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh temporary one only when it is unset."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        _local_scratch[app] = tempfile.mkdtemp(prefix="bladewatch-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def models_root(spark: SparkSession) -> str:
    """The folder where fitted models stay for later sessions: as set, or below the shared folder.

    In local mode without either, a folder of this machine's user; elsewhere that is an error.
    """
    configured = spark.conf.get(MODELS_KEY, None)
    if configured:
        return configured.rstrip("/")
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if shared:
        return f"{shared.rstrip('/')}/models"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {MODELS_KEY} or {CHECKPOINT_KEY} to a folder every executor can reach")
    return f"{tempfile.gettempdir()}/bladewatch-models-{getpass.getuser()}"


def unit_row_limit(spark: SparkSession) -> int:
    """Rows of one engine that a single task may sort; larger engines are split by cycle blocks."""
    return int(spark.conf.get(UNIT_ROWS_KEY, str(DEFAULT_UNIT_ROWS)))
