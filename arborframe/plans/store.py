"""Cutting lineage: checkpoints in the folder that the session names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table is sent to all tasks.
FEW = 10_000


def stored(df: DataFrame) -> DataFrame:
    """df, checkpointed; the folder is a temporary one only where one machine is all there is."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="arborframe-"))
    return df.checkpoint()


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most FEW rows, so that what it is joined with need not be shuffled."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
