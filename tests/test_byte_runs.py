"""Many small pieces share tasks, and a piece reads little beyond its end."""

import io
import random

from brinelake.sources import bytelines as B


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_small_pieces_read_little():
    source = Counted((b"x" * 60 + b"\n") * 100_000)
    found = [r for rows in B.lines_of(source, 500_000, 505_000) for r in rows]
    assert 80 <= len(found) <= 83 and source.taken < 20_000
    long = Counted(b"a\n" + b"y" * 3_000_000 + b"\nb\n")
    assert [len(r) for rows in B.lines_of(long, 1, 100) for _, r in rows] == [3_000_000]


def test_runs_of_pieces(tmp_path):
    rng = random.Random(4)
    data = b"".join(bytes(rng.choice(b"ab\xff\x00\r") for _ in range(rng.randint(0, 9))) + b"\n" for _ in range(4000)) + b"end"
    for name in ("a.nmea", "b.nmea"):
        (tmp_path / name).write_bytes(data)
    reader = B.ByteLinesReader({"path": str(tmp_path), "piece": "7"})
    parts = reader.partitions()
    assert len(parts) < 2100 < 2 * len(data) // 7
    got = [(p, start, offset, line) for part in parts for batch in reader.read(part) for line, p, start, offset
           in zip(*(c.to_pylist() for c in batch.columns))]
    want, at = [], 0
    for line in data.split(b"\n"):
        want.append((at - at % 7, at, line))
        at += len(line) + 1
    for name in ("a.nmea", "b.nmea"):
        assert [g[1:] for g in got if g[0].endswith(name)] == want
