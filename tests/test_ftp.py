"""FTP sessions, attribution and files."""

import pytest

from flowguard.operators import ftp
from flowguard.schemas import PACKET, as_packets

SCHEMA = (
    "flow string, seq long, request_command string, request_arg string, text_lines string, fin int, "
    "src_ip string, dst_ip string"
)


def line(text):
    return f"head\n x{text}###\n"


@pytest.fixture
def make(spark):
    def rows(*items):
        full = [(f, s, cmd, arg, text, fin, f"{f}-src{s}", "dst") for f, s, cmd, arg, text, fin in items]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return rows


def test_sessions_follow_commands_and_fin(make):
    df = make(
        ("a", 0, None, None, line("early"), 0),
        ("a", 1, "STOR", "one", None, 0),
        ("b", 0, None, None, None, 1),  # FIN without a command
        ("a", 2, "USER", "me", None, 0),
        ("a", 3, None, None, line("x"), 0),
        ("a", 4, "RETR", "two", None, 0),  # ends the file before
        ("a", 5, None, None, line("y"), 1),
        ("a", 6, None, None, line("late"), 0),
        ("a", 7, "RETR", "three", None, 1),  # opened and closed by one packet
        ("b", 1, "STOR", "bb", None, 0),
    )
    got = {(r.flow, r.seq): (r.sess, r.file_name) for r in ftp.sessions(df).collect()}
    assert [got["a", i] for i in range(8)] == [
        (0, None), (0, "one"), (0, "one"), (0, "one"), (0, "two"), (0, "two"), (1, None), (1, "three"),
    ]
    assert (got["b", 0], got["b", 1]) == ((0, None), (1, "bb"))
    source = {(r.flow, r.seq): r.src_ip for r in ftp.sessions(df).collect()}
    assert source["a", 3] == "a-src1" and source["a", 5] == "a-src4" and source["a", 6] is None


def test_files_in_order_and_whole(make):
    df = make(
        ("a", 1, "STOR", "f", None, 0), ("a", 3, None, None, line("2"), 0), ("a", 2, None, None, line("1"), 0),
        ("a", 4, None, None, None, 1), ("b", 1, "STOR", "g", None, 0), ("b", 2, None, None, line("open"), 0),
    )
    got = {r.flow: r for r in ftp.files(ftp.sessions(df)).collect()}
    # of " x1###\n" the first character and the last three (two marks and the line end) go
    assert (got["a"].content, got["a"].size, got["a"].closed) == ("x1#\nx2#\n", 8, True)
    assert got["b"].closed is False


def test_a_file_too_large_for_a_row_is_reported(make):
    df = make(
        ("a", 1, "STOR", "f", None, 0), ("a", 2, None, None, line("1"), 0), ("a", 3, None, None, line("2"), 1),
        ("b", 1, "STOR", "g", None, 0), ("b", 2, None, None, line("1"), 1),
    )
    got = {r.flow: (r.content, r.size) for r in ftp.files(ftp.sessions(df), max_bytes=5).collect()}
    assert got == {"a": (None, 8), "b": ("x1#\n", 4)}


def test_each_command_has_a_file_of_its_own(make):
    df = make(
        ("a", 1, "STOR", "one", None, 0), ("a", 2, None, None, line("1"), 0), ("a", 3, "STOR", "two", None, 0),
        ("a", 4, None, None, line("2"), 1), ("a", 5, "STOR", "one", None, 0), ("a", 6, None, None, line("3"), 0),
    )
    got = sorted((r.file_no, r.file_name, r.content, r.closed) for r in ftp.files(ftp.sessions(df)).collect())
    assert got == [(1, "one", "x1#\n", True), (3, "two", "x2#\n", True), (5, "one", "x3#\n", False)]


def test_commands_and_data_on_different_ports(spark):
    def packet(n, src, sport, dport, layers, highest, fin=0, **more):
        return {"pkt_no": n, "layers": layers, "highest_layer": highest, "ip": {"src": src, "dst": "sd"[src == "s"]},
                "src_port": sport, "dst_port": dport, "tcp": {"fin": fin}, **more}

    rows = [
        packet(0, "s", 999, 21, ["eth", "ip", "tcp", "ftp"], "FTP", ftp={"request_command": "STOR", "request_arg": "a"}),
        packet(1, "s", 1000, 20, ["eth", "ip", "tcp", "ftp-data"], "DATA-TEXT-LINES", text_lines=line("q")),
        packet(2, "d", 20, 1000, ["eth", "ip", "tcp"], "TCP", fin=1),
        packet(3, "d", 21, 999, ["eth", "ip", "tcp"], "TCP", fin=1),
    ]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in PACKET) for r in rows], PACKET)
    got = ftp.files(ftp.sessions(ftp.from_packets(as_packets(df)))).collect()
    assert [(r.file_name, r.content, r.closed) for r in got] == [("a", "xq#\n", True)]


def test_from_packets_gives_one_flow_for_both_directions(spark):
    def packet(n, src, sport, layers, highest, **more):
        return {"pkt_no": n, "layers": layers, "highest_layer": highest, "ip": {"src": src, "dst": "sd"[src == "s"]},
                "src_port": sport, "dst_port": 30 - sport, "tcp": {"fin": 0}, **more}

    rows = [
        packet(0, "s", 9, ["eth", "ip", "tcp", "ftp"], "FTP", ftp={"request_command": "STOR", "request_arg": "f"}),
        packet(1, "d", 21, ["eth", "ip", "tcp", "ftp-data"], "DATA-TEXT-LINES", text_lines="t"),
        packet(2, "d", 21, ["eth", "ip", "tcp", "ftp-data"], "OTHER", text_lines="no"),
        packet(3, "d", 21, ["eth", "ip", "udp"], "DNS"),
    ]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in PACKET) for r in rows], PACKET)
    got = ftp.from_packets(as_packets(df)).orderBy("seq").collect()
    assert len({r.flow for r in got}) == 1
    assert [(r.seq, r.request_arg, r.text_lines) for r in got] == [(0, "f", None), (1, None, "t"), (2, None, None)]
