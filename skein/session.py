"""Session helpers: shared checkpoint folder, size-checked broadcasts and joins that survive hot keys."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast. A larger side goes through a shuffle join.
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_skein_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # Only the driver reads this file; Spark's file server hands it to the executors.
    path = os.path.join(tempfile.mkdtemp(prefix="skein"), "skein.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(here):
            for n in names:
                if n.endswith((".py", ".json")):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join("skein", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._skein_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own; on a cluster this is an error, as executors don't share a machine's folders."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-checkpoint"))
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, settle: bool = False) -> DataFrame:
    """Marks df for broadcast when it has at most ``rows`` rows (counted, not guessed); else returns it unmarked for a shuffle join.

    ``settle`` checkpoints a df that is costly to compute first, so that counting and joining don't each compute it.
    """
    df = cut(df) if settle else df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(left: DataFrame, right: DataFrame, on: list[str], weight: str, hot: int = 100_000) -> DataFrame:
    """Inner join of left with a table of one row per key whose column ``weight`` says how many rows of left hold the key.

    Keys of more than ``hot`` rows can't be many (rows / hot): they are joined by broadcast if they are few indeed,
    so no task gets all rows of a hot key; the other keys are joined by shuffle.
    Every row of left whose key is in right comes out exactly once.
    """
    right = cut(right)
    heavy = small(right.where(F.col(weight) > hot))
    light = right.where(F.col(weight) <= hot)
    rest = left.join(small(heavy.select(*on)), on, "left_anti")
    return left.join(heavy, on, "inner").unionByName(rest.join(light, on, "inner"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
