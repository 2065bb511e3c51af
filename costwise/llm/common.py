"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwise.session import scratch_path, ship_package

#: The white space of every contract here: blank and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
WHITE_REGEX = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of whole texts that a worker unpacks at once.
TEXT_ROWS = 256
#: Bytes of texts that a worker unpacks at once where rows are cut by size (a longer text goes alone).
TEXT_BYTES = 4 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files that every executor can reach and that outlive
    the executor that wrote them. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> None:
    """Ship the package to the workers. No setting of the session is changed: what a
    worker unpacks at once is bounded where batches are read (``slices``, ``text_slices``)."""
    ship_package(spark)


def ascii_lower(col):
    """A-Z to a-z and nothing else (``lower`` also folds other letters)."""
    return F.translate(col, UPPER, LOWER)


def id_text(col):
    """An id as text; a null id is the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def md5_bits(col, first: int = 1):
    """60 bits of the MD5 of ``col`` as a non-negative long (SQL can say the same)."""
    return F.conv(F.substring(F.md5(col.cast("binary")), first, 15), 16, 10).cast("long")


def slices(batches, rows: int = TEXT_ROWS):
    """Arrow batches cut into pieces of at most ``rows`` rows (no copy).

    Spark fills a batch up to ``spark.sql.execution.arrow.maxBytesPerBatch``
    (64 MB) or its row limit; what a worker unpacks at once is bounded here.
    """
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        pa.default_memory_pool().release_unused()


def text_slices(batches, column: int, most: int = TEXT_BYTES):
    """Arrow batches cut into pieces of at most about ``most`` bytes in a text or binary column (no copy)."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(size, dtype=np.int64) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)
        pa.default_memory_pool().release_unused()


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def finite_vector(col):
    """True where a vector is not null and all its components are finite numbers."""
    return F.coalesce(F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))


def scaled_floor(col, scale: float):
    """Each component times ``scale`` as a double, rounded down to a long (held at the ends of the range)."""
    return F.transform(col, lambda v: F.floor(v.cast("double") * scale).cast("long"))
