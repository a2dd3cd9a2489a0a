"""What the corpus operators share: the shared folder, written tables, ASCII case."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def tokenizer_file(folder: str | None, name: str) -> str:
    """A vocabulary file in a folder, or where the package of public tokenizers keeps it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session has none (as in tests) one is made on this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows of a file of a table whose size is known to be small.
FILE_ROWS = 20_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors.

    ``rows``: how many rows it has at most, if that is known. A small table is then written by
    few tasks, as a file each for many partitions would cost more than the rows.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart, in order of doc_id, nulls last.

    That is ``doc_id`` itself if it is distinct and never null. Otherwise rows are numbered
    in this order, those of one doc_id as they were read, and written with their numbers.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    key = "_".join(["row_key", *(c for c in docs.columns if c.lower().startswith("row_key"))])
    read = docs.withColumn(key, F.monotonically_increasing_id())
    ordered = read.orderBy(F.asc_nulls_last("doc_id"), F.col(f"`{key}`"))
    return written(ordered.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Spark's ``lower`` does that in ASCII texts only."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
