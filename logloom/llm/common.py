"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the whitespace kind: runs of anything but space and 0x09-0x0D.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the alphanumeric kind, on text of either case: letters, digits and all beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which the driver and all executors share.

    Only a local session without one gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back; more compact than checkpointed()."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a column name that counts them from 0 in the given order (nulls first), without bringing all into one task.

    They are sorted over range partitions and written to the shared folder together with their partition and their place in
    it; the partitions' sizes, a row for each, then give where each begins. Rows equal in the whole order take any turn.
    """
    part, place = free_names(rows.columns, "part", "place")
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), place: here}))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("rows"))
    begins = sizes.select(part, (F.sum("rows").over(Window.orderBy(part)) - F.col("rows")).alias("begins_"))
    return dealt.join(F.broadcast(begins), part).withColumn(name, F.col("begins_") + F.col(place)).drop(part, place, "begins_")


def free_names(taken, *wanted: str) -> list[str]:
    """Column names like those wanted that are not among the taken ones, whatever their case."""
    out, taken = [], {c.lower() for c in taken}
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def space_word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def alnum_words(text: Column) -> Column:
    """The lower-cased alphanumeric words of a text, as an array without empty entries."""
    return F.filter(F.split(lower_ascii(text), ALNUM_GAP), lambda w: w != "")
