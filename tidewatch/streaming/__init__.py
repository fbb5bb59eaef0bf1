"""Structured Streaming forms of the stateful operators.

All use event time.  Rows wait in state until the watermark has passed them and are then
handled in time order, so the result equals the batch operator's for any arrival order
within the watermark's delay.  The session needs the RocksDB state store provider:
``spark.sql.streaming.stateStore.providerClass``.
"""

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
