"""The stateless steps on streams, and deduplication with bounded state or for good."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.clean import CleanOptions, clean
from lexweave.operators.dedup import exact_hash
from lexweave.operators.quality import QualityOptions, route


def cleaned(stream: DataFrame, options: CleanOptions = CleanOptions(), text_col: str = "text") -> DataFrame:
    """Cleaning and filtering keep no state, so they run on a stream as on a table."""
    return clean(stream, options, text_col)


def filtered(stream: DataFrame, options: QualityOptions = QualityOptions(), text_col: str = "text") -> DataFrame:
    return route(stream, options, text_col)[0]


def deduplicated(stream: DataFrame, time_col: str, delay: str, text_col: str = "text") -> DataFrame:
    """The first arrival of each normalised text; a text is forgotten once the watermark has passed it by `delay`."""
    marked = stream.withWatermark(time_col, delay).withColumn("_h", exact_hash(F.col(text_col)))
    return marked.dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def _first_rows(key_col: str, order_col: str):
    """For mapInArrow: of each key of a partition, the row of the least order (nulls last). Rows wait in a file of the task; keys and orders alone are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow, writer = [], None
        with tempfile.TemporaryFile() as held:
            for batch in batches:
                if writer is None:
                    writer = pa.ipc.new_stream(held, batch.schema)
                writer.write_batch(batch)
                # taken, not selected: a part of a batch would hold the memory of its texts
                narrow.append(batch.select([key_col, order_col]).take(pa.array(np.arange(batch.num_rows))))
            if writer is None:
                return
            writer.close()
            held.seek(0)
            rows = pa.Table.from_batches(narrow)
            at = pc.sort_indices(rows, sort_keys=[(key_col, "ascending"), (order_col, "ascending")], null_placement="at_end").to_numpy()
            codes = rows[key_col].combine_chunks().dictionary_encode().indices.to_numpy()[at]
            keep = np.zeros(len(at), dtype=bool)
            keep[at[np.flatnonzero(np.diff(codes, prepend=-1))]] = True
            done = 0
            for batch in pa.ipc.open_stream(held):
                yield batch.filter(pa.array(keep[done : done + batch.num_rows]))
                done += batch.num_rows

    return run


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams that are started from here on keep their state in RocksDB below their checkpoint, not in memory, where the hashes of deduplicated_for_good() would grow."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def deduplicated_for_good(stream: DataFrame, text_col: str = "text", order_col: str = "pos") -> DataFrame:
    """The first arrival of each normalised text, of a batch the row of the least order; no text is ever forgotten, and nothing is after a restart from the stream's checkpoint.

    A batch looks up and writes the hashes that it holds, not those of all batches before it. Null texts count as empty. Where batches arrive in the rows' order, the rows are those of dedup.exact_dedup.
    The first rows of a batch are found in each partition before the shuffle and after it, so copies are few when they meet; Spark's own deduplication then looks them up.
    """
    keyed = stream.withColumn("_h", exact_hash(F.coalesce(F.col(text_col), F.lit(""))))
    first = _first_rows("_h", order_col)
    once = keyed.mapInArrow(first, keyed.schema).repartition("_h").mapInArrow(first, keyed.schema)
    return once.dropDuplicates(["_h"]).drop("_h")


def windowed_counts(stream: DataFrame, time_col: str, key_col: str, size: str, delay: str) -> DataFrame:
    """Rows of each key in each window of time; late rows within the delay count."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, size).alias("w"), key_col).agg(F.count("*").alias("n")).select("w.start", "w.end", key_col, "n")
