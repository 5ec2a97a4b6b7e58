"""The CSV data source: headers, ranges, bytes read, streams."""

import gzip
import json
import os
import random
import time

import pytest

from tankline.sources import uploaded
from tankline.sources.uploaded import File, Range

COLS = ["a", "b"]


def write(path, header, rows, end="\n", last=True):
    text = end.join([",".join(header), *(",".join(r) for r in rows)]) + (end if last else "")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def rows_of(path, block):
    (f,) = uploaded.listed([path])
    out = []
    for part in uploaded.ranges([f], block):
        for batch in uploaded.read_range(part, COLS):
            out += batch.to_pylist()
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("last", [True, False])
def test_ranges_cover_every_line_once(tmp_path, monkeypatch, end, last):
    monkeypatch.setattr(uploaded, "HEAD", 7)
    monkeypatch.setattr(uploaded, "CHUNK", 11)
    rnd = random.Random(1)
    rows = [(str(k), "x" * rnd.randrange(9), '"q, ""' + str(k) + '"""') for k in range(60)]
    path = write(tmp_path / "f.csv", ["b", "junk", "a"], rows, end, last)
    size = os.path.getsize(path)
    for block in (1, 2, 5, 17, 64, size - 1, size, size + 9):
        got = rows_of(path, block)
        assert [(r["b"], r["a"]) for r in got] == [(str(k), f'q, "{k}"') for k in range(60)], block
        seq = [r["_seq"] for r in got]
        assert seq == sorted(set(seq)) and all(r["_corrupt_record"] is None for r in got)


def test_rows_of_another_width_are_rejects(tmp_path):
    path = write(tmp_path / "f.csv", COLS, [("1", "2"), ("1",), ("1", "2", "3"), ("", '""'), ("4", "5")])
    got = rows_of(path, 1 << 20)
    assert sorted((r["a"] or "", r["b"] or "", r["_corrupt_record"] or "") for r in got) == [("", "", ""), ("", "", "1"), ("", "", "1,2,3"), ("1", "2", ""), ("4", "5", "")]
    assert [(r["a"], r["b"]) for r in got if r["_corrupt_record"] is None][1] == (None, "")


def test_empty_lines_marks_and_bytes_that_are_no_text(tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes(b"\xef\xbb\xbfa,b\n\n1,2\n\n\n\xff,3\n")
    assert [(r["a"], r["b"]) for r in rows_of(str(path), 1 << 20)] == [("1", "2"), ("\ufffd", "3")]
    path.write_bytes(b"a,b")
    assert rows_of(str(path), 1 << 20) == []


def test_a_line_longer_than_a_chunk(tmp_path, monkeypatch):
    monkeypatch.setattr(uploaded, "CHUNK", 1000)
    path = write(tmp_path / "f.csv", COLS, [("1", "x" * 5000), ("2", "y")])
    for block in (300, 10_000):
        assert [(r["a"], len(r["b"])) for r in rows_of(path, block)] == [("1", 5000), ("2", 1)]


def test_input_is_read_once(tmp_path, monkeypatch):
    """Bytes read are those of the file, and the header and the rest of a line for each range."""
    path = write(tmp_path / "f.csv", COLS, [(str(k), "x" * 50) for k in range(40_000)])
    read = []
    store = uploaded.store_of

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            read.append(len(data := self.f.read(n)))
            return data

        def seek(self, at):
            self.f.seek(at)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    class System:
        def open_input_file(self, inner):
            return Counted(store(path)[0].open_input_file(inner))

    monkeypatch.setattr(uploaded, "store_of", lambda p: (System(), p, ""))
    size = os.path.getsize(path)
    parts = uploaded.ranges([File(path, size, 0)], size // 4 + 1)
    assert sum(b.num_rows for p in parts for b in uploaded.read_range(p, COLS)) == 40_000
    assert sum(read) <= size + 3 * uploaded.HEAD * len(parts)


def test_listing(tmp_path):
    for name in ("x/1.csv", "x/y/2.csv", "x/_tmp/3.csv", "x/.4.csv", "z/5.csv"):
        write(tmp_path / name, COLS, [("1", "2")])
    (tmp_path / "x/empty.csv").write_text("")
    names = lambda *p: sorted(f.path[len(str(tmp_path)) + 1 :] for f in uploaded.listed([str(tmp_path / q) for q in p]))
    assert names("x") == ["x/1.csv", "x/y/2.csv"]
    assert names("*/*.csv") == ["x/1.csv", "z/5.csv"]
    assert names("x/1.csv", "x") == ["x/1.csv", "x/y/2.csv"]
    assert names("_no*") == []
    with pytest.raises(FileNotFoundError):
        names("nothing")
    assert uploaded.readable("s3a://b/x") and uploaded.readable("/a:b/c") and not uploaded.readable("viewfs://x/y")


def test_compressed_files_and_mixed_headers(spark, tmp_path):
    write(tmp_path / "in/1.csv", ["b", "a"], [("2", "1")])
    (tmp_path / "in/2.csv.gz").write_bytes(gzip.compress(b"a,x,b\n3,,4\n"))
    got = uploaded.read_uploaded(spark, [str(tmp_path / "in")], COLS, block=3).select(*COLS).collect()
    assert sorted(map(tuple, got)) == [("1", "2"), ("3", "4")]


def test_a_stream_takes_every_file_once(spark, tmp_path):
    src, out, state, log = (str(tmp_path / x) for x in ("in", "out", "state", "log"))

    def run():
        rows = uploaded.stream_uploaded(spark, src, COLS, log).select(*COLS)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("a string, b string").parquet(out).collect())

    write(tmp_path / "in/1.csv", ["a", "b"], [("1", "2")])
    write(tmp_path / "in/2.csv", ["b", "c", "a"], [("4", "x", "3")])
    assert run() == [("1", "2"), ("3", "4")]
    # a file that comes later with an older time of change is taken, the others not again
    old = write(tmp_path / "in/0.csv", ["b", "a"], [("6", "5")])
    os.utime(old, (time.time() - 9e6, time.time() - 9e6))
    assert run() == [("1", "2"), ("3", "4"), ("5", "6")]
    assert run() == [("1", "2"), ("3", "4"), ("5", "6")]
    assert len(os.listdir(log)) == 2 and len(json.load(open(f"{log}/000000000000.json"))) == 2


def test_ranges_are_numbered_in_the_order_of_files():
    parts = uploaded.ranges([File("/a", 5, 1), File("/b.gz", 9, 2)], 3)
    assert parts == [Range(File("/a", 5, 1), 0, 0, 3), Range(File("/a", 5, 1), 0, 3, 5), Range(File("/b.gz", 9, 2), 1, 0, 9)]
