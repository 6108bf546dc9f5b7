"""Where a plan that grows by rounds is cut: written to the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and read from a checkpoint from then on.

    The folder is the one that spark.checkpoint.dir names. Where nobody has set it, a local master gets one of its own; on a
    cluster that is an error, since executors would each write to their own disk.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(where or f"file://{tempfile.gettempdir()}/docblocks-checkpoints")
    return frame.checkpoint()
