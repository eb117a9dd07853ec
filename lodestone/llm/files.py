"""Files that tasks write to and read from the shared folder, by its address."""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def open_folder(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder address such as file:///..., hdfs://... or /..."""
    return fs.FileSystem.from_uri(address)


def attempt_name(prefix: str, number: int, suffix: str) -> str:
    """A name of its own for each attempt of a task, so a lost or repeated attempt never
    touches a file that a committed manifest names."""
    task = TaskContext.get()
    where = f"{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}" if task else f"{number:05d}"
    return f"{prefix}-{where}{suffix}"
