"""Column functions against plain Python."""

import re
import urllib.parse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from flowguard.functions import encode, network as net, text as tx

S = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
TEXTS = st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=40)


def py_codes(s):
    marks = {8217: [134, 132], 8221: [129], 8220: [130], 8216: [131], 8211: [133]}
    out = []
    for c in s:
        out += marks.get(ord(c), [ord(c)] if ord(c) <= 128 else [])
    return out


@S
@given(TEXTS)
def test_char_codes(column, values):
    values = values + ["’”“‘–", "\x80\x81", "😀a", "", "a\nb"]
    assert column(values, tx.char_codes(F.col("s"))) == [py_codes(v) for v in values]


@S
@given(TEXTS)
def test_extract_tag(column, values):
    values = values + ["<a\n>", "<a>\n<b>", "<a\r>z", "<a b>", "<a> x <b> y", ">x<", "a< >b"]

    def want(s):
        m = re.search("<.*>", s)
        return m.group(0) if m else ""

    assert column(values, tx.extract_tag(F.col("s"))) == [want(v) for v in values]


@S
@given(st.lists(st.text(alphabet="%0123456789abcdefABCDEFg+ 你x", max_size=12), min_size=1, max_size=60))
def test_url_unquote(column, values):
    values = values + ["%zz", "100%", "a+b", "%FF", "%E4%BD", "x%2", "你%41", "%E4你", ""]
    assert column(values, tx.url_unquote(F.col("s"))) == [urllib.parse.unquote(v) for v in values]


def test_strip_and_form_values(column):
    form = "Form\n \x1b[0m\x1b[1mKey: a:b\n  Value: x:y z \t\nValue:　k　\n none"
    assert column([form, "nothing"], tx.form_values(F.col("s"))) == [["y z", "k"], []]


def test_frames_keep_the_whole_text(column):
    long = "<" * 10_000 + "ab"
    got = column(["", "abc", long], tx.frames(tx.code_text(F.col("s"))))
    assert got == [[""], ["abc"], ["<" * 10_000, "ab"]]
    vector = column(["A’"], tx.frame_vector(tx.code_text(F.col("s"))))[0]
    assert len(vector) == 10_000 and vector[:4] == [65 / 128, 134 / 128, 132 / 128, 0.0]


def test_hex_text(column):
    values = ["68c3a9", "", "6", "zz", "ff", "68\n", "AB" * 40_000]
    got = column(values, tx.hex_text(F.col("s")))
    assert got == ["hé", "", None, None, None, None, None]
    assert column(["61" * 40_000], tx.hex_text(F.col("s"))) == ["a" * 40_000]


def test_tokens(column):
    assert column(["A b1 éÈ_x, ünd 你好 c"], tx.tokens(F.col("s"))) == [["b1", "éè_x", "ünd", "你好"]]


def py_trim(text, name):
    lines = text.splitlines(keepends=True)
    out = []
    for i, line in enumerate(lines[1:]):
        line = (line[1:] if i == 0 else line).strip("\t")[:-3]
        out.append((line[:-3] if name.lower().endswith(".txt") else line) + "\n")
    return "".join(out)


@pytest.mark.parametrize("name", ["a.TXT", "a.bin"])
@S
@given(st.lists(st.text(alphabet="ab\t\n ", max_size=40), min_size=1, max_size=30))
def test_ftp_trim(column, name, values):
    values = values + ["", "head", "head\n", "head\n\txyz\\r\\n\n\t\tabcdefgh\\r\\n", "h\n\t"]
    got = column(values, tx.trim_ftp_text(F.col("s"), F.lit(name)))
    assert got == [py_trim(v, name) for v in values]


def test_ftp_trim_splits_at_any_line_end(column):
    assert column(["h\r\nxabcdef\rghijkl"], tx.trim_ftp_text(F.col("s"), F.lit("f"))) == ["abcd\nghi\n"]


def test_ipv4(column):
    values = ["10.0.0.1", "255.255.255.255", "256.0.0.1", "1.2.3", "fd00::1", "1.2.3.4\n", "a.b.c.d", None]
    assert column(values, net.ipv4_to_int(F.col("s"))) == [167772161, 4294967295] + [None] * 6


def test_codes_and_counters(spark):
    row = spark.range(1).select(
        net.protocol_code(F.lit("TCP")).alias("tcp"), net.protocol_code(F.lit("x")).alias("none"),
        net.state_code(F.lit("FSR_SA")).alias("state"),
        net.total_packets(F.lit("12"), F.lit("3")).alias("sum"),
        net.total_packets(F.lit("12"), F.lit("3"), concatenate=True).alias("joined"),
        net.total_packets(F.lit("x"), F.lit("3")).alias("bad"),
    ).first()
    assert tuple(row) == (0, None, 30, 15.0, 123.0, None)


def test_ip_layer_is_the_first_one(spark):
    df = spark.createDataFrame(
        [(["eth", "ipv6", "ip"], ("a", "b"), ("c", "d")), (["eth", "arp"], ("a", "b"), None)],
        "layers array<string>, ip struct<src:string,dst:string>, ipv6 struct<src:string,dst:string>",
    )
    rows = df.select(net.ip_layer().alias("layer"), net.ip_field("dst").alias("dst")).collect()
    assert [tuple(r) for r in rows] == [("ipv6", "d"), (None, None)]


def test_label_encode_is_dense_per_window(spark):
    rows = [(0, "b"), (0, "a"), (0, "b"), (1, "z")]
    got = encode.label_encode(spark.createDataFrame(rows, "w int, c string"), ["w"])
    assert sorted(tuple(r) for r in got.collect()) == [(0, "a", 0), (0, "b", 1), (0, "b", 1), (1, "z", 0)]


def test_dense_code_per_scan_and_null(spark):
    rows = [("s", "b", "x"), ("s", "a", None), ("s", "b", "x"), ("t", "q", "y")]
    got = encode.dense_code(spark.createDataFrame(rows, "scan string, c string, d string"), ["c", "d"], "scan")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(
        map(str, [("s", 2, 1), ("s", 1, None), ("s", 2, 1), ("t", 1, 1)])
    )


@pytest.mark.parametrize("most", [0, 512])
def test_dense_code_equals_sorted_places(spark, monkeypatch, most):
    monkeypatch.setattr(encode, "MAP_VALUES", most)
    rows = [(None if k % 5 == 0 else f"s{k % 5 % 2}", f"v{k * 7919 % 211}", None if k % 3 else str(k % 17), k) for k in range(1500)]
    df = spark.createDataFrame(rows, "scan string, c string, d string, k int").repartition(7)
    seen = {}
    for scan, c, d, _ in rows:
        seen.setdefault((scan, "c"), set()).add(c)
        seen.setdefault((scan, "d"), set()).update({d} - {None})
    want = {k: (scan, 1 + sorted(seen[scan, "c"]).index(c), None if d is None else 1 + sorted(seen[scan, "d"]).index(d)) for scan, c, d, k in rows}
    got = encode.dense_code(df, ["c", "d"], "scan")
    assert got.columns == df.columns
    assert {r.k: (r.scan, r.c, r.d) for r in got.collect()} == want
    assert encode.dense_code(df.where("false"), ["c", "d"], "scan").count() == 0


def test_no_window_over_all_values_of_a_group(spark):
    values = spark.range(20000).select(F.lit("g").alias("g"), F.format_string("%05d", "id").alias("v"))
    ranks = encode.value_ranks(values, ["g"], "v")
    assert ranks.where(F.col("v").cast("int") + 1 != F.col("rank")).count() == 0 and ranks.count() == 20000
    windows = [line for line in ranks._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number" in line and "Window" in line]
    assert windows and all("_range" in line for line in windows)


def test_value_map_replaces_all_at_once(column):
    assert column(["1", ".init", "0", None], encode.value_map("s", {1: 0, ".init": 1})) == ["0", "1", "0", None]


def test_truthy(spark):
    df = spark.createDataFrame([(None,), (0,), (5,)], "v int")
    assert [r[0] for r in df.select(encode.truthy(F.col("v"))).collect()] == [0, 0, 1]


def test_ipv4_of_numbered_hosts(column):
    """Tables that number more than 65,536 hosts write 10.0.256.0 and on."""
    values = ["10.0.300.5", "10.0.0.1", "255.255.256.0", "256.0.0.1", "1.2.3", "fd00::10.0.1.2", "a.b.c.d", None]
    want = [(10 << 24) + 300 * 256 + 5, 167772161] + [None] * 6
    assert column(values, net.ipv4_to_int(F.col("s"), carry=True)) == want
    assert column(["10.0.300.5"], net.ipv4_to_int(F.col("s"))) == [None]
