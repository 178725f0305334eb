"""Folders for queries that write files and read them back."""
from __future__ import annotations

import uuid

from quartier.session import ensure_checkpoint_dir


def folder(spark, name: str) -> str:
    """A fresh folder beside the checkpoints, reachable from all executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files/{name}-{uuid.uuid4().hex}"
