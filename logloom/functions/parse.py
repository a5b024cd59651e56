"""Syslog, CEF and container log lines as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.timeutil import RFC3339, instant, utc_text
from logloom.schema import FACILITIES, SEVERITIES

_PRI = r"^<(\d{1,3})>"
_RFC5424 = r"(?s)^(?:<\d{1,3}>)?[1-9]\d{0,2} (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+) ?(.*)$"
_RFC3164 = r"(?s)^(?:<\d{1,3}>)?\s*([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\S+) (\S+) (?:([^\s:\[]+)(?:\[([^\]\n]*)\])?: ?)?(.*)$"


def _named(names, number: Column) -> Column:
    return F.when(number.between(0, len(names) - 1), F.get(F.array(*map(F.lit, names)), number.cast("int")))


def severity_to_num(severity: Column) -> Column:
    """0 for emerg to 7 for debug; null for any other name."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0).cast("bigint")) - 1


def severity_of(pri: Column) -> Column:
    return F.when(pri.between(0, 191), _named(SEVERITIES, pri.bitwiseAND(F.lit(7))))


def facility_of(pri: Column) -> Column:
    return F.when(pri.between(0, 191), _named(FACILITIES, F.shiftright(pri, 3)))


def looks_like_timestamp(text: Column) -> Column:
    return F.coalesce((F.octet_length(text) >= 19) & text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.lit(False))


def cef_ext_value(ext: Column, key: str) -> Column:
    """The value of key in a CEF extension: up to the next key=, trimmed; null if absent or empty."""
    pattern = rf"(?s)(?:^| ){re.escape(key)}=(.*?)(?= [^ =]*=|$)"
    return F.nullif(F.trim(F.regexp_extract(ext, pattern, 1)), F.lit(""))


def truncate_utf8(text: Column, limit: int) -> Column:
    """The longest beginning of text of at most `limit` bytes that ends between characters."""
    if limit < 1:
        return F.when(text.isNotNull(), F.lit(""))
    data = text.cast("binary")
    inside = lambda at: F.conv(F.hex(F.substring(data, at, 1)), 16, 10).cast("int").between(0x80, 0xBF)  # noqa: E731  within a character
    # If the first byte left out goes on with a character, that character's beginning goes as well.
    end = F.when(~inside(limit + 1), limit).when(~inside(limit), limit - 1).when(~inside(limit - 1), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(data, F.lit(1), end).cast("string"))


def source_addr_ip(addr: Column) -> Column:
    """The address without its port; [v6]:port gives v6; all else is unchanged."""
    v6 = F.regexp_extract(addr, r"^\[([^\]]+)\]:\d+$", 1)
    return F.when(addr.rlike(r"^\[[^\]]+\]:\d+$"), v6).when(addr.rlike(r"^[^:\[\]]+:\d+$"), F.regexp_replace(addr, r":\d+$", "")).otherwise(addr)


def megabytes(size: Column) -> Column:
    return F.when(size.isNotNull(), F.format_string("%.2f", size / 1048576.0))


def _nil(text: Column) -> Column:
    return F.nullif(F.nullif(text, F.lit("-")), F.lit(""))


def bound(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _header(raw: Column) -> Column:
    """Time, host, app, process id and message of a line, as an array; of one in neither format only the message."""
    # No field but the last can hold a line break, so one match of a pattern gives all of them.
    fields = lambda pattern, groups: F.split(F.regexp_replace(raw, pattern, "\n".join(f"${g}" for g in groups)), "\n", 5)
    none = F.lit(None).cast("string")
    return F.when(raw.rlike(_RFC5424), fields(_RFC5424, (1, 2, 3, 4, 7))).when(raw.rlike(_RFC3164), fields(_RFC3164, (1, 2, 3, 4, 5))).otherwise(F.array(none, none, none, none, F.regexp_replace(raw, _PRI, "")))


def _time(stamp: Column, received_at: Column) -> Column:
    """The instant of a header's time; null if it is none."""
    dated = lambda year: F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), F.regexp_replace(stamp, " +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    ahead = lambda this: F.when(this > received_at + F.expr("INTERVAL 1 DAY"), F.coalesce(dated(F.year(received_at) - 1), this)).otherwise(this)
    return F.when(stamp.rlike("^[A-Z]"), bound(dated(F.year(received_at)), ahead)).otherwise(instant(stamp))


#: Byte limits of what a line with CEF in it may set.
CEF_LIMITS = {"hostname": 255, "app_name": 128, "message": 8192}


def _cef_fields(raw: Column) -> Column:
    """hostname, app_name and message of a CEF line, from its header and extension; null if the header is not whole."""

    def read(parts: Column) -> Column:
        ext = F.get(parts, F.lit(7))
        host = F.coalesce(cef_ext_value(ext, "UNIFIdeviceName"), _nil(F.get(parts, F.lit(2))))
        message = F.coalesce(cef_ext_value(ext, "msg"), F.array_join(parts, "|"))
        return F.when(F.size(parts) >= 8, F.struct(host.alias("hostname"), F.get(parts, F.lit(5)).alias("app_name"), message.alias("message")))

    return bound(F.split(F.regexp_extract(raw, r"(?s)(CEF:.*)$", 1), r"[|]", 8), read)


def parse_syslog(raw: Column, source_ip: Column, received_at: Column) -> Column:
    """A struct of the log fields of a syslog line.

    RFC 5424 lines, else RFC 3164 ones (also with an ISO time), else the line is the message of host unknown. A missing
    or impossible PRI gives severity info and no facility; a missing time the receipt time. A time without a year gets
    that of receipt, or the one before if it would lie over a day ahead. A line whose host looks like a time and that holds
    CEF: is read as CEF: host, app and message come from its header and extension if those are whole, else from the line
    as it stands, and are cut to their byte limits in either case.
    """

    def fields(head: Column) -> Column:
        host, app, message = _nil(head[1]), _nil(head[2]), head[4]
        is_cef = raw.contains("CEF:") & (looks_like_timestamp(host) | looks_like_timestamp(F.regexp_replace(raw, _PRI, "")))
        return F.struct(head.alias("head"), host.alias("hostname"), app.alias("app_name"), message.alias("message"), F.when(is_cef, F.struct(_cef_fields(raw).alias("found"))).alias("cef"))

    def render(line: Column) -> Column:
        pri = F.nullif(F.regexp_extract(raw, _PRI, 1), F.lit("")).cast("int")
        cut = lambda c: F.when(line["cef"].isNull(), line[c]).otherwise(bound(F.coalesce(line["cef"]["found"][c], line[c]), lambda x: truncate_utf8(x, CEF_LIMITS[c])))
        return F.struct(
            utc_text(F.coalesce(_time(line["head"][0], received_at), received_at)).alias("timestamp"),
            F.coalesce(cut("hostname"), F.lit("unknown")).alias("hostname"),
            facility_of(pri).alias("facility"),
            F.coalesce(severity_of(pri), F.lit("info")).alias("severity"),
            cut("app_name").alias("app_name"),
            _nil(line["head"][3]).alias("process_id"),
            cut("message").alias("message"),
            raw.alias("raw"),
            source_ip.alias("source_ip"),
        )

    return bound(bound(_header(raw), fields), render)


def container_app(project: Column, service: Column, name: Column) -> Column:
    """project/service/name, service/name or name."""
    return F.when(service.isNotNull() & project.isNotNull(), F.concat_ws("/", project, service, name)).when(service.isNotNull(), F.concat_ws("/", service, name)).otherwise(name)


def container_name(names: Column, container_id: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(names, "^/", ""), F.lit("")), F.left(container_id, F.lit(12)))


def parse_container_line(host: Column, container_id: Column, name: Column, project: Column, service: Column, stream: Column, line: Column, received_at: Column) -> Column:
    """A struct of the log fields of a container's line; null for other streams than stdout and stderr and for empty lines.

    The time before the first space is kept verbatim if it is RFC 3339, else the line is all message and the time that of receipt.
    """
    severity = F.when(stream == "stdout", "info").when(stream == "stderr", "warning")

    def fields(text: Column) -> Column:
        # The part before the first space if that is a time, else null.
        head = F.regexp_extract(text, r"(?s)^(\S+) ", 1)
        return bound(F.struct(text.alias("text"), F.when(instant(head).isNotNull(), head).alias("head")), render)

    def render(parts: Column) -> Column:
        message = F.when(parts["head"].isNull(), parts["text"]).otherwise(F.regexp_replace(parts["text"], r"(?s)^\S+ ", ""))
        return F.struct(
            F.coalesce(parts["head"], utc_text(received_at)).alias("timestamp"),
            host.alias("hostname"),
            F.lit("local0").alias("facility"),
            severity.alias("severity"),
            container_app(project, service, name).alias("app_name"),
            F.left(container_id, F.lit(12)).alias("process_id"),
            message.alias("message"),
            line.alias("raw"),
            F.concat(F.lit("docker://"), host, F.lit("/"), container_id, F.lit("/"), stream).alias("source_ip"),
        )

    found = bound(F.regexp_replace(line, r"[\r\n]+$", ""), fields)
    return F.when(severity.isNotNull(), bound(found, lambda x: F.when(x["message"] != "", x)))
