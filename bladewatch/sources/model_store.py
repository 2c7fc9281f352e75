"""Fitted models kept under a key of what they were fitted on, for this and later sessions.

An entry is written below a folder of its own attempt and published last, by a line that names the attempt. So readers
never meet a half-written model, and of several sessions that fit the same model at once all may publish: the smallest
name counts, for all of them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

from bladewatch.session import models_root


def file_state(spark: SparkSession, paths: Iterable[str]) -> list:
    """Number, bytes and two order-free digests of the files below ``paths``: names, lengths and times of change.

    Only the listing is read, by Spark's readers; the digests are sums, so any number of files makes one row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")
    digest = lambda salt: F.sum(F.xxhash64(F.lit(salt), "name", "length", "modificationTime").cast("decimal(38,0)"))
    return [str(v) for v in files.agg(F.count(F.lit(1)), F.sum("length"), digest(1), digest(2)).first()]


def fingerprint(spark: SparkSession, paths: Iterable[str], **settings) -> str:
    """Key of a model: the state of every input file, and all settings (columns, parameters, seeds) it is fitted with."""
    content = [file_state(spark, [p]) for p in sorted(paths)]
    return hashlib.sha256(json.dumps([content, settings], sort_keys=True, default=str).encode()).hexdigest()


class ModelStore:
    """Model entries below one shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or models_root(spark)).rstrip("/")

    def find(self, key: str) -> str | None:
        """Path of the published entry, None if there is none."""
        try:
            attempt = self.spark.read.text(f"{self.root}/{key}/published").agg(F.min("value")).first()[0]
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None
        return attempt and f"{self.root}/{key}/{attempt}"

    def fetch(self, key: str, write: Callable[[str], None]) -> str:
        """Path of the entry; ``write`` fits the model and writes it below the path it gets, if there is none yet."""
        found = self.find(key)
        if found is None:
            attempt = uuid.uuid4().hex
            write(f"{self.root}/{key}/{attempt}")
            line = self.spark.createDataFrame([(attempt,)], "value string").coalesce(1)
            line.write.mode("append").text(f"{self.root}/{key}/published")
            found = self.find(key)
        return found
