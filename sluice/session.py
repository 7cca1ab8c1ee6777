"""Session helpers: a configured builder, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch where the session has no setting of its own: whole texts are large rows, and a batch
#: lies in the JVM and in its Python worker at once.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give executors this package's source, once an application, since Python tasks import it there; sets ``ARROW_BATCH``."""
    for name, value in ARROW_BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="sluice-"), "sluice.zip")
    with zipfile.ZipFile(at, "w") as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(Path(d, n), Path(top.name, Path(d, n).relative_to(top)))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
