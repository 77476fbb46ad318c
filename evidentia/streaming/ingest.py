"""Articles as they arrive: the batch parser over a stream of files.

The checkpoint remembers which files were read, as the batch pipeline's resume
does by comparing tables.  A star remembers which batches of a stream it has, so
that a batch that comes again after a stop adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import add_to_star
from ..sources.jats import parse_articles

_FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_articles(spark: SparkSession, source: str, target: str, checkpoint: str, *, glob: str = "PMC*.xml", files_per_batch: int = 1000) -> StreamingQuery:
    """Parse all files that are new since the last call and append them to a table of processed documents."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(source)
    parsed = parse_articles(files.select(F.col("content").alias("xml")))
    return parsed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_into_star(entries: DataFrame, folder: str, checkpoint: str, name: str = "entries") -> StreamingQuery:
    """Load entries as they arrive (``pmcid``, ``pmid``, ``title`` and the fields of an entry) into the star in a folder, each batch exactly once.

    The number of a batch is part of the version that has its rows.  A run that
    is stopped before the version is made leaves rows that no version names; one
    that is stopped after it, but before the checkpoint, finds the batch there.
    The name of a stream stays with its checkpoint: another checkpoint begins to
    count anew and needs another name.
    """
    def add(batch: DataFrame, number: int) -> None:
        papers = batch.select("pmcid", "pmid", "title").distinct()
        add_to_star(batch.drop("pmid", "title"), papers, folder, batch=(name, number))

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
