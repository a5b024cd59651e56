"""Captured datagrams and connections as a stream into a store."""

from logloom.sources.captures import lines, read_captures
from logloom.streaming.ingest import ingest
from logloom.streaming.store import LogStore


def datagram(data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + data


def test_captures_into_a_store(spark, tmp_path):
    folder, store = tmp_path / "in", LogStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    udp, tcp = folder / "10.0.0.1_514.udp", folder / "fd00::1_1514.tcp"

    def go():
        ingest(read_captures(spark, str(folder), 60), store, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.message, r.source_ip) for r in store.logs().collect())

    head = b"<34>1 2026-01-01T00:00:00Z h su - - - "
    udp.write_bytes(datagram(head + b"one\ntwo") + datagram(head + b"bad \xff\xfe byte") + datagram(b"") + datagram(head + b"x" * 90) + datagram(head + b"cut off")[:-3])
    tcp.write_bytes(head + b"first\r\n\n" + head + b"long" * 20 + b"\n" + head + b"\xff\n" + head + b"second\n" + head + b"thi")
    a, b = "10.0.0.1:514", "[fd00::1]:1514"
    want = [("one\ntwo", a), ("bad �� byte", a), ("x" * 22, a), ("first", b), ("second", b)]
    assert go() == sorted(want)
    with udp.open("ab") as f:
        f.write(b"off" + datagram(head + b"next"))
    with tcp.open("ab") as f:
        f.write(b"rd\n" + head + b"last")
    want += [("cut off", a), ("next", a), ("third", b)]
    assert go() == sorted(want), "files that grew; nothing comes twice after a restart"
    assert go() == sorted(want)
    (folder / "fd00::1_1514.tcp.eof").touch()
    assert go() == sorted([*want, ("last", b)])


def test_lines_around_the_limit(tmp_path):
    path = tmp_path / "c.tcp"
    path.write_bytes(b"".join(b"y" * n + end for n in range(12) for end in (b"\n", b"\r\n")))
    assert list(lines(str(path), 0, path.stat().st_size, 8)) == ["y" * n for n in range(9) for _ in range(2)]
