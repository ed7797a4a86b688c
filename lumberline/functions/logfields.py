"""Column functions of log lines: level, time, masks, paths, sizes and other small projections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.columns import once

LEVEL_WORD = r"\b(ERROR|WARN|INFO|DEBUG)\b"
# Bit of each level, MIME types by extension, time patterns of lines in their order.
LEVEL_BITS = {"error": 1, "warn": 2, "warning": 2, "info": 4, "debug": 8, "trace": 16}
MIME_TYPES = {"log": "text/plain", "txt": "text/plain", "json": "application/json", "xml": "application/xml", "gz": "application/gzip", "zip": "application/zip"}
_D, _S, _E, _C = r"\d{4}-\d{2}-\d{2}", r"\d{4}/\d{2}/\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}:\d{2}:\d{2}"
TIME_PATTERNS = tuple(f"{day}{gap}{_C}{frac}" for day, gap in ((_D, "T"), (_D, " "), (_E, " "), (_S, " ")) for frac in (r"\.\d{3}", ""))
_PATTERN_FORMATS = (("yyyy-MM-dd'T'HH:mm:ss",),) * 2 + (("yyyy-MM-dd HH:mm:ss",),) * 2 + (("dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss"),) * 2 + (("yyyy/MM/dd HH:mm:ss",),) * 2
# Formats of a time by themselves, in their order; those of the first group may have a fraction.
FRACTION_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
PLAIN_FORMATS = ("dd-MM-yyyy HH:mm:ss", "MM-dd-yyyy HH:mm:ss", "yyyyMMdd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm")
_SHAPES = {
    "yyyy-MM-dd'T'HH:mm:ss": f"^{_D}T{_C}$", "yyyy-MM-dd HH:mm:ss": f"^{_D} {_C}$", "dd/MM/yyyy HH:mm:ss": f"^{_E} {_C}$", "MM/dd/yyyy HH:mm:ss": f"^{_E} {_C}$",
    "yyyy/MM/dd HH:mm:ss": f"^{_S} {_C}$", "dd-MM-yyyy HH:mm:ss": rf"^\d{{2}}-\d{{2}}-\d{{4}} {_C}$", "MM-dd-yyyy HH:mm:ss": rf"^\d{{2}}-\d{{2}}-\d{{4}} {_C}$",
    "yyyyMMdd HH:mm:ss": rf"^\d{{8}} {_C}$", "dd/MMM/yyyy:HH:mm:ss": rf"^\d{{2}}/[A-Z][a-z]{{2}}/\d{{4}}:{_C}$", "yyyy-MM-dd'T'HH:mm": rf"^{_D}T\d{{2}}:\d{{2}}$", "yyyy-MM-dd HH:mm": rf"^{_D} \d{{2}}:\d{{2}}$",
}


def level(content: Column) -> Column:
    """The leftmost level word of a line in lower case; ``debug`` where there is none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(content, LEVEL_WORD, 1)), F.lit("")), F.lit("debug"))


def level_mask(name: Column) -> Column:
    t, out = F.lower(F.trim(name)), F.lit(0)
    for word, bit in LEVEL_BITS.items():
        out = F.when(t == word, bit).otherwise(out)
    return out


def parse_time(text: Column) -> Column:
    """A time without zone, by the first format that fits (day first before month first); RFC 3339 last; else null."""
    t = F.trim(text)
    base, frac = F.regexp_replace(t, r"\.\d+$", ""), F.regexp_extract(t, r"\.(\d+)$", 1)
    micros = F.when(frac != "", F.substring(F.rpad(frac, 6, "0"), 1, 6).cast("bigint")).otherwise(F.lit(0))

    def shaped(c: Column, fmt: str) -> Column:
        return F.when(c.rlike(_SHAPES[fmt]), F.try_to_timestamp(c, F.lit(fmt)))

    first = F.coalesce(*[shaped(base, f) for f in FRACTION_FORMATS])
    first = F.timestamp_micros(F.unix_micros(first) + micros)
    zoned = F.when(t.rlike(rf"^{_D}[Tt ]{_C}(\.\d+)?([Zz]|[+-]\d{{2}}:\d{{2}})$"), t.try_cast("timestamp"))
    return F.coalesce(first, *[shaped(t, f) for f in PLAIN_FORMATS], zoned).cast("timestamp_ntz")


def time_text(content: Column) -> Column:
    """The first of the patterns' first matches that is a time, as text; empty where there is none."""
    found = []
    for p, fmts in zip(TIME_PATTERNS, _PATTERN_FORMATS, strict=True):
        m = F.regexp_extract(content, f"({p})", 1)
        valid = F.coalesce(*[F.try_to_timestamp(F.substring(m, 1, 19), F.lit(f)) for f in fmts]).isNotNull()
        found.append(F.when((m != "") & valid, m))
    return F.coalesce(*found, F.lit(""))


def time_unix(text: Column) -> Column:
    """Epoch seconds: of a number as it is (of 13 digits or more as milliseconds), else of the parsed time."""
    t = F.trim(text)
    number = t.try_cast("bigint")
    return F.when(t.rlike(r"^[+-]?\d+$"), F.when(F.length(t) >= 13, (number / 1000).cast("bigint")).otherwise(number)).otherwise(F.unix_seconds(parse_time(text).cast("timestamp")))


def iso(epoch: Column) -> Column:
    """Epoch seconds as RFC 3339; 0 and null give null."""
    return F.when(epoch != 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def mime_type(path: Column) -> Column:
    e, out = extension(path), F.lit(None).cast("string")
    for ext, kind in MIME_TYPES.items():
        out = F.when(e == ext, kind).otherwise(out)
    return out


def real_path(digest: Column) -> Column:
    return F.concat(F.lit("cas://"), digest)


def child_path(parent: Column, name: Column) -> Column:
    return F.concat_ws("/", parent, name)


def human_size(total: Column) -> Column:
    """Bytes as whole megabytes, or gigabytes with a decimal from 1024 MB."""
    mb = F.floor(total / 1048576)
    return F.when(mb >= 1024, F.format_string("%.1fGB", mb / 1024)).otherwise(F.format_string("%dMB", mb))


def slug(name: Column) -> Column:
    """A workspace name as it goes into an id."""
    s = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 38)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _decoded(raw: bytes) -> tuple[str, str]:
    """Text and encoding of bytes that are no UTF-8; a U+FFFD that the bytes have themselves is no replacement."""
    text = raw.decode("utf-8", "replace")
    if text.count("\ufffd") - raw.count(b"\xef\xbf\xbd") > 0.3 * len(text):
        for codec, label in (("gbk", "GBK"), ("cp1252", "Windows-1252")):
            try:
                return raw.decode(codec), label
            except UnicodeDecodeError:
                continue
    return text, "UTF-8-Lossy"


def decode_bytes(content: Column) -> Column:
    """Struct ``text, encoding`` of bytes: UTF-8, else with replacements, else GBK, else Windows-1252; null of null.

    More than 30 % replacements try the other encodings.  A valid row's bytes stay in the JVM: a worker gets a null.
    """

    @F.pandas_udf("text string, encoding string")
    def slow(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if b is None else _decoded(b) for b in raw], columns=["text", "encoding"])

    valid = F.call_function("is_valid_utf8", content.cast("string"))
    bad = slow(F.when(~valid, content))
    utf8 = F.struct(content.cast("string").alias("text"), F.lit("UTF-8").alias("encoding"))
    return F.when(valid, utf8).when(content.isNotNull(), bad)


def decode_column(df: DataFrame, content: str, out: str) -> DataFrame:
    """``df`` with ``out``, the struct of ``decode_bytes``; only rows whose bytes are no UTF-8 go through a worker."""
    valid = F.coalesce(F.call_function("is_valid_utf8", F.col(content).cast("string")), F.lit(True))
    good = df.where(valid).withColumn(out, F.when(F.col(content).isNotNull(), F.struct(F.col(content).cast("string").alias("text"), F.lit("UTF-8").alias("encoding"))))
    return good.unionByName(df.where(~valid).withColumn(out, decode_bytes(F.col(content))))


def with_fields(lines: DataFrame) -> DataFrame:
    """``lines`` with ``ts_text, ts, level, level_mask``; each expression is computed once for a line."""
    d = once(lines, "ts_text", time_text(F.col("content")))
    d = d.withColumn("ts", parse_time(F.col("ts_text"))).withColumn("level", level(F.col("content")))
    return d.withColumn("level_mask", level_mask(F.col("level")))
