"""Byte-exact lines in pieces of any size."""

import io
import random

from brinelake.sources.bytelines import lines_of, read_byte_lines


def test_every_cut():
    rng = random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"\n\nab\xff\x00\r") for _ in range(rng.randint(0, 60)))
        want, at = [], 0
        for row in data.split(b"\n"):
            want.append((at, row))
            at += len(row) + 1
        if data.endswith(b"\n") or not data:
            want.pop()
        for piece in (1, 3, 7, 100):
            for buffer in (1, 4, 64):
                got = [r for k in range(0, len(data), piece)
                       for rows in lines_of(io.BytesIO(data), k, min(len(data), k + piece), buffer) for r in rows]
                assert got == want, (data, piece, buffer)


def test_source(spark, tmp_path):
    data = {"a.nmea": b"\xff\xfe\x01\n\n$PNORS,1\r\nlast", "b.nmea": b"x" * 5000 + b"\n" + b"\x80" * 3, "c.txt": b"no\n", "d.nmea": b""}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    df = read_byte_lines(spark, f"{tmp_path}/*.nmea", piece=4)
    got = sorted((r.file_path.rsplit("/", 1)[1], r.offset, bytes(r.line)) for r in df.collect())
    assert got == [("a.nmea", 0, b"\xff\xfe\x01"), ("a.nmea", 4, b""), ("a.nmea", 5, b"$PNORS,1\r"), ("a.nmea", 15, b"last"),
                   ("b.nmea", 0, b"x" * 5000), ("b.nmea", 5001, b"\x80" * 3)]
    assert df.rdd.getNumPartitions() > 1000 and read_byte_lines(spark, str(tmp_path / "c.txt")).count() == 1
