"""Replies kept as they arrive.

One small file per prompt, named by the SHA-256 of its text, in a folder on
shared storage. A reply is written under another name first and then renamed, so
that a file is whole or absent. Tasks read the journal before they call: a task
that is tried again, or a second run, asks only what was never answered. Failed
calls leave no file and are asked again.

The look-up is one request to the storage per call, which takes seconds. Files go
two levels deep, 65,536 folders at most.
"""

from __future__ import annotations

import hashlib
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Journal:
    def __init__(self, uri: str):
        self.fs, self.base = pafs.FileSystem.from_uri(uri)
        self.made: set[str] = set()

    def _path(self, prompt: str) -> str:
        name = hashlib.sha256(prompt.encode()).hexdigest()
        return f"{self.base}/{name[:2]}/{name[2:4]}/{name}.txt"

    def get(self, prompt: str) -> str | None:
        """The reply to a prompt, if there was one."""
        path = self._path(prompt)
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read().decode()

    def put(self, prompt: str, reply: str) -> None:
        path = self._path(prompt)
        folder = path.rsplit("/", 1)[0]
        if folder not in self.made:
            self.fs.create_dir(folder, recursive=True)
            self.made.add(folder)
        part = f"{path}.{uuid.uuid4().hex[:12]}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(reply.encode())
        self.fs.move(part, path)


def replies(spark: SparkSession, path: str) -> DataFrame:
    """``prompt_sha256``, ``reply`` of everything that a journal holds."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return found.select(F.regexp_extract("_metadata.file_name", "^([0-9a-f]+)", 1).alias("prompt_sha256"), F.col("value").alias("reply"))
