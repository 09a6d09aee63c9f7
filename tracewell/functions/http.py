"""HTTP messages, trace headers and routes as column expressions.

Payloads are bytes. Prefix tests read them as ISO-8859-1, which never fails; the request and
status lines must be valid UTF-8, else the message has no parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE"]
REQUEST_PREFIX = "^(?:" + "|".join(METHODS) + ") "
CAPTURED = 2048  # bytes of a payload that a capture keeps


def latin(payload: Column) -> Column:
    return F.decode(payload, "ISO-8859-1")


def clipped(payload: Column) -> Column:
    """The captured part of a payload."""
    return F.substring(payload, 1, CAPTURED)


def passes_prefilter(payload: Column) -> Column:
    """Cheap test on two bytes, passed by all that the exact tests pass."""
    heads = sorted({m[:2] for m in METHODS} | {"HT"})
    return latin(F.substring(payload, 1, 2)).isin(heads)


def is_request(payload: Column) -> Column:
    return F.coalesce(latin(payload).rlike(REQUEST_PREFIX), F.lit(False))


def is_response(payload: Column) -> Column:
    return F.coalesce(latin(payload).startswith("HTTP/"), F.lit(False))


def is_http(payload: Column) -> Column:
    return is_request(payload) | is_response(payload)


def _first_line(payload: Column) -> Column:
    """The text before the first CRLF; null without one, or if it isn't UTF-8."""
    at = F.locate("\r\n", latin(payload))
    line = F.substring(payload, F.lit(1), at - 1)
    return F.when(at > 0, F.try_validate_utf8(line.cast("string")))


def parse_request(payload: Column) -> Column:
    """struct(method, path, version), or null."""
    parts = F.split(_first_line(payload), " ", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("method"), parts[1].alias("path"), parts[2].alias("version")))


def parse_response(payload: Column) -> Column:
    """struct(version, status, reason), or null; the status lies in 100 to 599."""
    parts = F.split(_first_line(payload), " ", 3)
    status = F.when(parts[1].rlike("^[+]?[0-9]{1,9}$"), parts[1].try_cast("int"))
    good = (F.size(parts) >= 2) & status.between(100, 599)
    return F.when(good, F.struct(parts[0].alias("version"), status.alias("status"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")).alias("reason")))


def parse_headers(payload: Column) -> Column:
    """map of lower-case names; of equal names the last counts.

    Lines end at a CRLF; an empty line ends the headers; an unterminated last line doesn't
    count; lines without a colon or a name are passed over.
    """
    # What follows the first line, from its CRLF on: a second CRLF there is the empty line.
    head = F.split(F.regexp_replace(latin(payload), "(?s)^.*?\r\n", "\r\n"), "\r\n\r\n", 2)
    text = F.when(F.size(head) == 2, F.concat(head[0], F.lit("\r\n"))).otherwise(head[0])
    lines = F.split(text, "\r\n", -1)
    whole = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    pairs = F.transform(F.filter(whole, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    named = F.filter(pairs, lambda p: p["key"] != "")
    # Of equal names the last: keep a pair if no later one has its name.
    kept = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(kept)


def header_value(text: Column, name: str) -> Column:
    """The last value of one header of a message (text as of latin), without a map of all; null without one.

    The same as header(parse_headers(..), name), for names of letters.
    """
    head = F.concat(F.substring_index(text, "\r\n\r\n", 1), F.when(text.contains("\r\n\r\n"), "\r\n").otherwise(""))
    return F.trim(F.try_element_at(F.regexp_extract_all(head, F.lit(rf"(?is)\r\n\x20*{name}\x20*:((?:(?!\r\n).)*)(?=\r\n)"), 1), F.lit(-1)))


def header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name.lower()))


def content_length(headers: Column) -> Column:
    value = header(headers, "content-length")
    return F.when(value.rlike("^[+]?[0-9]+$"), value.try_cast("bigint"))


def is_error_status(status: Column) -> Column:
    return status >= 400


def is_server_error(status: Column) -> Column:
    return status >= 500


TRACEPARENT = r"^0*([0-9a-fA-F]{1,2})-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-([0-9a-fA-F]{2})$"


def parse_traceparent(value: Column) -> Column:
    """struct(version, trace_id, parent_hex, flags), or null; zero ids are refused."""
    text = F.trim(value)
    part = lambda k: F.lower(F.regexp_extract(text, TRACEPARENT, k))
    good = text.rlike(TRACEPARENT) & (part(2) != "0" * 32) & (part(3) != "0" * 16)
    return F.when(good, F.struct(F.conv(part(1), 16, 10).cast("int").alias("version"), part(2).alias("trace_id"), part(3).alias("parent_hex"), F.conv(part(4), 16, 10).cast("int").alias("flags")))


def hex_to_long(value: Column) -> Column:
    """16 hex digits as a signed long with the same bits."""
    return F.conv(value, 16, -10).cast("bigint")


def unsigned_text(value: Column) -> Column:
    """A long printed as the unsigned number of the same bits."""
    return F.conv(F.hex(value), 16, 10)


def sampled(flags: Column) -> Column:
    return flags.bitwiseAND(1) == 1


ID_LIKE = "^(?:[0-9]+|[0-9A-Fa-f]{16,}|[A-Za-z0-9_-]{32,})$"


def normalize_route(path: Column) -> Column:
    """Path without query and fragment, id-like segments as :id."""
    bare = F.substring_index(F.substring_index(path, "?", 1), "#", 1)
    segments = F.transform(F.split(bare, "/", -1), lambda s: F.when(s.rlike(ID_LIKE), F.lit(":id")).otherwise(s))
    return F.when((bare == "") | (bare == "/"), F.lit("/")).otherwise(F.array_join(segments, "/"))
