"""Session settings that the library relies on."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace
from functools import partial
from inspect import signature
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Fixed semantics; none of these depends on the size of the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for scripts and tests; on a cluster pass no master and let spark-submit decide."""
    builder = SparkSession.builder.appName("emberlog")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@dataclass(frozen=True)
class Config:
    """What an installation may set: in a JSON file, and above it by environment variables EMBERLOG_<NAME>."""

    store: str = "store"
    profiles: str = "profiles"
    max_bytes: int = 500 << 20
    poll_seconds: int = 60
    check_seconds: int = 300
    expected_ms: int = 1000
    grace_ms: int = 5000
    queue_ms: int = 30000
    gap_minutes: int = 10

    @classmethod
    def load(cls, path: str | None = None, environ: Mapping[str, str] = os.environ) -> Config:
        """Relative folders are meant from the file's folder. Unknown names in the file are an error."""
        given = json.loads(Path(path).read_text()) if path else {}
        for f in fields(cls):
            if (value := environ.get(f"EMBERLOG_{f.name.upper()}")) is not None:
                given[f.name] = int(value) if isinstance(f.default, int) else value
        made = cls(**given)
        base = Path(path).parent if path else Path()
        return replace(made, **{n: str(base / getattr(made, n)) for n in ("store", "profiles") if "://" not in getattr(made, n)})

    def of(self, f: Callable, **given) -> Callable:
        """f with this installation's numbers for those of its parameters that are called as they are; `given` goes before them."""
        known = signature(f).parameters
        return partial(f, **{x.name: getattr(self, x.name) for x in fields(self) if isinstance(x.default, int) and x.name in known} | given)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: what several later steps need is computed once and outlives executors."""
    path = f"{shared(df.sparkSession)}/emberlog/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. The path goes to Spark's reader only, whatever its scheme is."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
