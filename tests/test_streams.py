"""The streams of tables: one file or a folder of parts gives the same."""

import os

import pytest

from quarry.queries import QUERIES
from quarry.sources.adapter import table_stream

from .conftest import SF


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The tables with every larger one as a folder of parts."""
    folder = str(tmp_path_factory.mktemp("parts"))
    for name in os.listdir(SF):
        rows = spark.read.parquet(f"{SF}/{name}")
        if name in ("documents.parquet", "events.parquet"):
            rows.repartition(3).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")
    return folder


def test_a_stream_reads_a_file_and_a_folder(spark, parts, tmp_path):
    for i, folder in enumerate((SF, parts)):
        for name in ("documents", "events"):
            out, stream = f"{tmp_path}/{i}-{name}", table_stream(spark, folder, name)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
            assert spark.read.parquet(out).exceptAll(spark.read.parquet(f"{SF}/{name}.parquet")).count() == 0
            assert spark.read.parquet(out).count() == spark.read.parquet(f"{SF}/{name}.parquet").count()


@pytest.mark.parametrize("name", ["stream_percolate", "watch_stream", "stream_documents", "stream_index", "stream_rate_limit"])
def test_streaming_queries_read_folders_of_parts(spark, parts, name):
    a, b = (sorted(map(repr, QUERIES[name](spark, folder).collect())) for folder in (SF, parts))
    assert a == b and a
