"""Where the state of a stream is kept."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STORE = "spark.sql.streaming.stateStore.rocksdb"
# A batch writes what changed instead of whole files, in bounded memory, and a join keeps one store
# in each partition, not four: what a batch costs for each store is then paid less often.
# A stream that goes on from an earlier start keeps the join's format and the parts it was started with.
SETTINGS = {
    PROVIDER: ROCKSDB,
    f"{_STORE}.changelogCheckpointing.enabled": "true",
    f"{_STORE}.boundedMemoryUsage": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


PARTITIONS = "spark.sql.shuffle.partitions"
# Parts of a new stream's state: some for each core, so that more cores can share them later, and not
# fewer than these; never more than the session asks for. Every batch opens and closes a store in each.
PARTS_PER_CORE, LEAST_PARTS = 4, 32


def _settings(spark: SparkSession) -> dict[str, str]:
    parts = max(LEAST_PARTS, PARTS_PER_CORE * spark.sparkContext.defaultParallelism)
    return SETTINGS | {PARTITIONS: str(min(parts, int(spark.conf.get(PARTITIONS))))}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own settings return after.

    A stream takes a copy of the settings when it starts, so later queries are not touched.
    """
    settings = _settings(spark)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
