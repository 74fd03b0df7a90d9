"""Lines of files, with their numbers, through both readers."""

from __future__ import annotations

import io
import random

import pytest

from timberline.sources import logsource
from timberline.sources.lines import numbered_lines, read_lines


def plain_lines(data):
    """Lines as the rules say: one \\r before a line end goes; no line behind the last end."""
    parts = data.split(b"\n")
    last = parts.pop()
    lines = [p[:-1] if p.endswith(b"\r") else p for p in parts]
    return [x.decode("utf-8", "replace") for x in lines + ([last] if last else [])]


FILES = {
    "a.log": b"one\ntwo\r\nthree\r\r\n\n\r\nlast\r", "b.log": b"\n\n", "c.log": b"no end", "d.log": b"\r", "e log%.txt": "é ü\n日本\n".encode(), "f.log": b"", "g.log": b"x\ry\nz\n",
    "sub/h.log": b"".join(b"line %d%s\n" % (k, b" more" * (k % 40)) for k in range(300)),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    for name, data in FILES.items():
        (root / name).write_bytes(data)
    return root


def by_file(df):
    out = {}
    for r in df.collect():
        out.setdefault(logsource.unquote(r["file_id"]).rsplit("/", 1)[-1], {})[r["line_no"]] = r["raw"]
    return {name: [lines[k] for k in range(len(lines))] for name, lines in out.items()}


@pytest.mark.parametrize("size", [None, 3000])
def test_both_readers_number_the_same_lines(spark, folder, size):
    want = {name.rsplit("/", 1)[-1]: plain_lines(data) for name, data in FILES.items() if data}
    assert by_file(numbered_lines(spark, str(folder), block_bytes=size)) == want
    # Spark's splits of at least the size asked for
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size or 1 << 27))
    try:
        assert by_file(read_lines(spark, str(folder))) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_readers_agree_on_names(spark, folder):
    names = lambda df: {r[0] for r in df.select("file_id").distinct().collect()}
    assert names(read_lines(spark, str(folder))) == names(numbered_lines(spark, str(folder)))
    assert names(read_lines(spark, str(folder), "*.txt")) == names(numbered_lines(spark, str(folder), "*.txt")) and len(names(numbered_lines(spark, str(folder), "*.txt"))) == 1
    assert numbered_lines(spark, str(folder / "f.log")).count() == 0


def test_every_cut_into_blocks(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r\n", b"\n\n"]) for _ in range(rng.randrange(30)))
        monkeypatch.setattr(logsource, "CHUNK", rng.randrange(1, 6))
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(4))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in logsource.lines_between(io.BytesIO(data), a, b)]
        assert [t.decode() for _, t in got] == plain_lines(data)
        assert all(data[at : at + len(t)] == t for at, t in got)
