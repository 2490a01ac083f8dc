"""Helpers that all operators of this subpackage use: the shared folder,
lineage cuts, column checks and bounded sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of most operators, as Java regular expression classes.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session where it is set. Where it is not: a
    temporary folder on a local master (tests), else a folder in the warehouse,
    which is shared on any cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if sc.master.startswith("local[") or sc.master == "local":
            path = tempfile.mkdtemp(prefix="hearthlake-")
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor
    never has its lineage computed again. Spark's cleaner deletes the files when
    no plan refers to them any more, where the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def words(text: Column) -> Column:
    """Number of words (runs of other than space and \\t..\\r); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def named(columns: list[str], prefix: str = "") -> list[Column]:
    """Columns by their names as they are, whatever characters they hold; within the struct ``prefix`` if given."""
    return [F.col(f"{prefix}." * bool(prefix) + "`" + c.replace("`", "``") + "`").alias(c) for c in columns]


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or one made of it that is not among ``columns`` (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a side may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row apart from its values, about.
ROW_BYTES = 16


def _bytes(kind: T.DataType, value: Column) -> Column | int:
    """Bytes of a value, about; a number where they are the same for all rows."""
    if isinstance(kind, T.StructType):
        fields = [_bytes(f.dataType, value[f.name]) for f in kind]
        return sum((x for x in fields if not isinstance(x, int)), ROW_BYTES + sum(x for x in fields if isinstance(x, int)))
    if isinstance(kind, T.ArrayType):
        each = _bytes(kind.elementType, F.lit(None).cast(kind.elementType))
        return F.coalesce(F.size(value), F.lit(0)).cast("long") * (each if isinstance(each, int) else 64)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    return 8


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, which is cheap to read (cut), to be broadcast if it has at most ``most``
    bytes; a larger one is joined by shuffle, with the same rows."""
    sizes = [_bytes(f.dataType, F.col(f.name)) for f in df.schema]
    fixed = ROW_BYTES + sum(x for x in sizes if isinstance(x, int))
    total = F.count("*") * fixed
    for x in sizes:
        total = total if isinstance(x, int) else total + F.coalesce(F.sum(x), F.lit(0))
    return F.broadcast(df) if df.agg(total).first()[0] <= most else df


#: Rows that go to a Python worker at a time where texts go with them.
TEXT_ROWS = 1000


class small_batches:  # noqa: N801
    """Within the ``with`` block at most ``rows`` rows go to Python workers at a time, so a worker and the JVM beside it hold a few MB of text each."""

    def __init__(self, spark: SparkSession, rows: int = TEXT_ROWS):
        self.conf, self.name, self.rows = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", rows

    def __enter__(self) -> None:
        self.before = self.conf.get(self.name, None)
        self.conf.set(self.name, str(min(self.rows, int(self.before or self.rows))))

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.conf.unset(self.name)
        else:
            self.conf.set(self.name, self.before)


class Scratch:
    """Parquet tables in the shared folder that an operator needs while it runs.

    Columnar and compressed, so a wide intermediate takes a fraction of what a
    checkpoint of it would. They are deleted at the end of the ``with`` block,
    whether the operator succeeds or not; what is returned must be cut before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.folder = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
