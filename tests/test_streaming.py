"""The streaming summary equals the batch summary after all files are processed."""

import os
import tempfile

from carelens.operators import summary
from carelens.sources.fixtures import Source
from carelens.streaming import los_stream, start_summary
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="carelens-stream-")
    src = Source(spark, SF_SMALL)
    d = src.discharges
    incoming = os.path.join(base, "incoming")
    d.filter("discharge_id % 2 = 0").write.parquet(os.path.join(incoming, "part1"))
    d.filter("discharge_id % 2 = 1").write.parquet(os.path.join(incoming, "part2"))
    stream = los_stream(spark, os.path.join(incoming, "*"), d.schema, max_files_per_trigger=1)
    out = os.path.join(base, "out")
    q = start_summary(stream, os.path.join(base, "ck"), output_path=out)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(map(tuple, summary.los_by(d, ["lob"]).collect()))
    assert got == want
