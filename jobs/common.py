"""What both jobs share: their configuration and their log lines."""

from __future__ import annotations

import json
import logging
import re
import uuid

from pyspark.sql import SparkSession


def configuration(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The JSON object at path (local or remote, read through Spark) over the defaults; unknown keys are an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def note(job: str, **facts: object) -> None:
    logging.getLogger(job).info(json.dumps(facts, default=str))


def fresh_folder(spark: SparkSession, job: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{job}-{uuid.uuid4().hex}"
