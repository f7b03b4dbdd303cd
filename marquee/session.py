"""Session set-up shared by tests, benchmark and queries."""

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "marquee") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return utc(spark)


#: Rows in memory are this many times as large as their compressed columns, about.
UNPACKED = 20.0


def utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC; wall-clock logic converts explicitly.

    Spark takes the size of files for that of their rows when it decides what to broadcast, so it is told how
    much larger they get; else rows of hundreds of megabytes go through the driver.
    """
    tidy(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < UNPACKED:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
    return spark


#: Lets Spark delete the shuffle files of a query when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tidy(spark: SparkSession) -> SparkSession:
    """Shuffle files last no longer than the step that wrote them; Spark else keeps them until the driver's garbage is collected.

    A step whose rows are asked for again derives them again.
    """
    if spark.conf.get(TIDY, "false") != "true":
        spark.conf.set(TIDY, "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="marquee-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The result has no lineage, so a lost executor costs at most one step, and it
    has true sizes and column pruning. The tables of an application lie under its
    id and can be dropped with it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shipped(spark: SparkSession) -> SparkSession:
    """Hand this package to the session's Python workers, which may not have it on their path."""
    context = tidy(spark).sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="marquee-package-")) / "marquee.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))  # Spark's own file service takes it to the executors
    return spark


_SHIPPED: set[str] = set()
