"""Default parameters, one frozen record instead of process-wide configuration."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    # Defaults that results depend on.
    embedding_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    embedding_batch_size: int = 32
    chunk_size: int = 512
    chunk_overlap: int = 64
    default_top_k: int = 5
    score_threshold: float = 0.0
    generation_model: str = "llama3.2:3b"
    temperature: float = 0.2
    max_tokens: int = 512


# Request bounds.
SEARCH_TOP_K_MAX = 100
GROUNDED_TOP_K_MAX = 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a session in one process without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = os.path.join(tempfile.gettempdir(), f"groundwell-{context.applicationId}")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")
