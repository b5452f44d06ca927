"""Sessions, shared scratch tables, and shipping of this package to Python workers."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "corpusmill", **conf: str) -> SparkSession:
    """A session with the settings that the operators count on."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    builder = SparkSession.builder.appName(app)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that no executor needs a copy of its own."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


#: Tables of long texts, and the size up to which such a table of few files is dealt to all cores.
TEXTS, SMALL = ("documents", "pages"), 256 << 20


#: Bytes of a larger table that go to one task where it is dealt.
DEALT = 8 << 20


def spread(df: DataFrame, most: int = SMALL, deal: bool = False) -> DataFrame:
    """A small table of fewer files than cores, dealt to all cores by row: one row group is one task whatever its
    texts cost. Larger tables are left as their scan splits them, so nothing of size is shuffled; unless `deal`, for
    work that costs far more than a shuffle of its texts: then those of large files are dealt in parts of DEALT."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size, files = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), len(df.inputFiles())
    if size <= most:
        return df.repartition(2 * cores) if files < cores else df
    return df.repartition(max(2 * cores, -(-size // DEALT))) if deal and size > 2 * DEALT * files else df


def few(df: DataFrame, of: DataFrame | None = None, most: int = SMALL) -> DataFrame:
    """What is made of a small table (of `of`, or df itself), in four parts a core at most: however many splits it came
    in, and where partitions aren't coalesced. On a local file system Hadoop launches chmod for each file it writes,
    several times, each a fork of the executor. What larger tables give is left as it is."""
    size = int((df if of is None else of)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def table(spark: SparkSession, sf_dir: str, name: str, deal: bool = False) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, deal=deal) if name in TEXTS else df


def settle(spark: SparkSession) -> None:
    """Gives back what finished jobs left. Plans are held until Python lets go of its frames; the driver's heap shrinks,
    and executors drop the broadcasts and shuffles of a query, only when the driver's JVM collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Tables that are written between two calls of settle.
SETTLE = 8

#: How tables of rows of some megabytes are written: sizes are looked at after every row, and a row group is closed at 16
#: MB. By default a writer holds 100 rows before it looks, and whoever reads a row group holds all of its rows at once.
LARGE = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}

_watching: list[list[Scratch]] = []


@contextmanager
def released() -> Iterator[None]:
    """Scratch tables that are begun inside are deleted at the end: for results that have been written by then."""
    made: list[Scratch] = []
    _watching.append(made)
    try:
        yield
    finally:
        _watching.remove(made)
        for scratch in made:
            scratch.clear()


class Scratch:
    """Written tables that cut lineage, in the folder that all executors share (spark.checkpoint.dir; one of our own
    where it is unset and the session runs on this machine only)."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)  # whoever writes scratch tables may start Python workers over them
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not root:
            root = "/tmp/checkpoints/corpusmill"
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.at, self.made = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        for made in _watching:
            made.append(self)

    def keep(self, df: DataFrame, name: str = "t", large: bool = False) -> DataFrame:
        """The written table. large: rows are of some megabytes; see LARGE."""
        path = f"{self.at}/{self.made:03d}-{name}"
        self.made += 1
        if self.made % SETTLE == 0:
            settle(self.spark)
        df.write.option("compression", "zstd").options(**(LARGE if large else {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)

    def clear(self) -> None:
        self._delete(self.at)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
