import struct

import numpy as np
import pytest

from quayside.sources.ranged import ReplayReader, paced_replay, read_signal_ranges, sample_ranges
from quayside.sources.signals import read_signals

VALUES = [0, 1 << 30, -(1 << 31), (1 << 31) - 1, *range(19)]


def _write(folder, name, values, tail=b""):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(struct.pack(f"<{len(values)}i", *values) + tail)


@pytest.mark.parametrize("range_bytes", [1, 3, 4, 6, 7, 13, 92, 1000])
@pytest.mark.parametrize("samples", [None, 0, 1, 10, 23, 99])
def test_ranges_hold_every_sample_once(range_bytes, samples):
    ranges = sample_ranges("f", "f", 4 * 23 + 3, samples, range_bytes)
    covered = [i for r in ranges for i in range(r.first, r.last)]
    assert covered == list(range(23 if samples is None else min(23, samples)))
    # a range reads no more than its bytes and the rest of its last sample
    assert all(4 * (r.last - r.first) <= range_bytes + 3 for r in ranges)


@pytest.mark.parametrize("range_bytes", [6, 7, 64])
def test_ranges_that_cut_samples_equal_whole_files(spark, tmp_path, range_bytes):
    _write(tmp_path / "in", "BR_CC_ND_N_H1.raw", VALUES, b"xx")
    _write(tmp_path / "in", "N_H1.v2.raw", [8, 16, 32])
    _write(tmp_path / "in", "empty.raw", [])
    _write(tmp_path / "in", "_hidden.raw", [1])
    got = read_signal_ranges(spark, str(tmp_path / "in"), 10, range_bytes)
    assert sorted(got.collect()) == sorted(r for r in read_signals(spark, str(tmp_path / "in"), 10).collect() if r.file_id != "_hidden")
    whole = read_signal_ranges(spark, str(tmp_path / "in"), None, range_bytes)
    assert whole.filter("file_id = 'BR_CC_ND_N_H1'").count() == len(VALUES)
    assert whole.rdd.getNumPartitions() == sum(len(sample_ranges("", "", s, None, range_bytes)) for s in (4 * len(VALUES) + 2, 12))


def test_a_long_recording_in_many_ranges(spark, tmp_path):
    values = np.arange(500_000, dtype="<i4") * 1000
    (tmp_path / "long.raw").write_bytes(values.tobytes())
    rows = read_signal_ranges(spark, f"file://{tmp_path}/long.raw", None, 300_001)
    assert rows.rdd.getNumPartitions() == 7
    found = rows.selectExpr("count(*) n", "count(DISTINCT pos) p", "max(second) s", "sum(value * 2147483648D - pos * 1000) d").first()
    assert tuple(found) == (500_000, 500_000, 62, 0.0)


def test_no_recordings(spark, tmp_path):
    assert read_signal_ranges(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        read_signal_ranges(spark, str(tmp_path / "none")).count()


def test_replay_offsets(tmp_path):
    (tmp_path / "a.log").write_text("1\n2\n\n3")
    (tmp_path / "b.log").write_text("ä\n5\n")
    (tmp_path / "c.log").write_text("")
    reader, start, batches = ReplayReader(str(tmp_path), 4), {"file": "", "byte": 0}, []
    while True:
        rows, end = reader.read(start)
        rows = [value for _, value in rows]
        assert [v for _, v in reader.readBetweenOffsets(start, end)] == rows
        if not rows:
            break
        batches.append(rows)
        start = end
    assert batches == [["1", "2", "", "3"], ["ä", "5"]] and end == start
    (tmp_path / "d.log").write_text("6\n")
    assert [v for _, v in reader.read(start)[0]] == ["6"]


def test_a_replay_goes_on_where_it_stopped(spark, tmp_path):
    source, out, kept = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "kept")
    source.mkdir()
    (source / "1.log").write_text("".join(f"m{i}\n" for i in range(7)))

    def run(batches):
        seen = []

        def write(df, number):
            seen.append(df.count())
            df.write.mode("overwrite").parquet(f"{out}/{number}")

        stream = paced_replay(spark, str(source), 3).writeStream.foreachBatch(write).option("checkpointLocation", kept).start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        assert [n for n in seen if n] == batches

    run([3, 3, 1])
    (source / "2.log").write_text("x\ny\n")
    run([2])
    rows = [r.value for r in spark.read.option("recursiveFileLookup", True).parquet(out).collect()]
    assert sorted(rows) == sorted([*(f"m{i}" for i in range(7)), "x", "y"])
