"""Log lines to entries: record starts by header expressions, continuation lines by cumulative grouping.

A line is a header if, after an optional byte-order mark, one of an ordered cascade of layouts matches at its very
start.  Each layout is one anchored expression whose named parts are brought into one canonical row, so a line costs
one matching expression and one rewrite, all inside the JVM.  Lines of a file are handled in blocks of ``BLOCK`` line
numbers: a file of any length is spread over many tasks, and what crosses a block's edge (the next header of a later
block, the second line of a header on the block's last line) comes from a table with one row for each block.

Defined cases: rows with a null ``file_path`` or ``line_number`` have no place in any file and are left out; a null
``content`` is an empty line; repeated rows of a line count once; lines ahead of a file's first header belong to no
entry; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.functions.columns import once
from lumberline.session import cut

BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
_SEP = "\x01"

# Byte-order marks as characters: itself, its swap, and the three UTF-8 bytes read in common one-byte encodings.
BOM_FORMS = ("﻿", "￾", "ï»¿", "Ã¯Â»Â¿", "∩╗┐", "´╗┐", "п»ї", "я╗┐", "О╩©", "ď»ż", "ο»Ώ", "Ôªø", "锘�", "锘", "���")
_BOM = "(?:" + "|".join(BOM_FORMS) + ")?"

_MON = "(?<month>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DOW = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_YEAR, _MM, _DD = "(?<year>\\d{4})", "(?<month>0[1-9]|1[0-2])", "(?<day>0[1-9]|[12]\\d|3[01])"
_CLOCK = "(?<hour>[01]?\\d|2[0-3]):(?<minute>[0-5]\\d):(?<second>[0-5]\\d|60)"
_FRAC = "(?:[.,](?<frac>\\d{1,9}))?"
_TZ = " ?(?<tz>Z|UTC|GMT|[+-]\\d\\d:?\\d\\d)?"
_ISO = f"{_YEAR}-{_MM}-{_DD}[ T]{_CLOCK}{_FRAC}{_TZ}"
_YMD = f"{_YEAR}/{_MM}/{_DD} {_CLOCK}{_FRAC}{_TZ}"


def _lv(n: int | str = "") -> str:
    return f"(?<level{n}>[A-Za-z]{{1,9}})"


def _co(pattern: str, n: int | str = "") -> str:
    return f"(?<component{n}>{pattern})"



FIELDS = ("year", "month", "day", "hour", "minute", "second", "frac", "tz", "ampm", "level", "component", "message", "epoch")


@dataclass(frozen=True)
class Family:
    """Layouts that share a beginning, as one expression with a named group for each field.

    ``test`` is a cheap look at single characters that sends a line to the family.  A field that each of several
    alternatives has is in groups with a number (``level1``, ``level2``); it is what their groups have together.
    """

    name: str
    test: str
    pattern: str

    @property
    def regex(self) -> str:
        return f"(?s)^{self.pattern}$"

    @property
    def rewrite(self) -> str:
        groups = re.findall(r"\(\?<([a-z]+\d*)>", self.pattern)
        return _SEP + self.name + "".join(_SEP + "".join(f"${{{g}}}" for g in groups if g.rstrip("0123456789") == f) for f in FIELDS)


_TAIL = "(?: (?<message>.*))?"
_DATED = "|".join((
    f"\\[{_lv(1)} *\\] {_co('[^ ]+', 1)} -",  # [LEVEL] component - message
    f"{_lv(2)} +\\[[^\\]]*\\] {_co('[^ ]+', 2)} -",  # LEVEL [thread] component - message
    f"\\x1b\\[[0-9;]*m{_lv(3)} *\\x1b\\[[0-9;]*m {_co('[^ ]+', 3)} >",  # coloured LEVEL component > message
    f"<{_lv(4)}> \\({_co('[^)]*', 4)}\\)",  # <LEVEL> (component) message
    f"{_lv(5)} {_co('[^ :]+', 5)}:",  # level component: message
))
_QUOTED = "\"(?:[^\"\\\\]|\\\\.)*+\"?"
FAMILIES = (
    Family("dated", "substr(content, 5, 1) = '-' AND substr(content, 8, 1) = '-'", f"{_ISO} (?:{_DATED}){_TAIL}"),
    Family("slashed", "substr(content, 5, 1) = '/'", f"{_YMD} (?:(?<level1>[A-Z])/{_co('[^( ]+', 1)}\\( *\\d+\\):|\\[{_lv(2)}\\] \\d+#\\d+: {_co('[^ ]+', 2)}:){_TAIL}"),
    Family("logfmt", "startswith(content, 'time=') OR startswith(content, 'ts=')", f"(?:time|ts)=\"?{_ISO}\"? level=\"?{_lv()}\"? (?:component|src|logger|module)=\"?{_co('[^ \"]+')}\"? (?:[^ =]+=[^ \"]+ )*?msg=(?<message>{_QUOTED}|[^ ]*).*"),
    Family("device", "substr(content, 3, 1) = '-'", f"{_MM}-{_DD} {_CLOCK}{_FRAC} +\\d+ +\\d+ (?<level>[A-Z]) {_co('[^ ]+?')} *:{_TAIL}"),
    Family("piped", "substr(content, 3, 1) = '/'", f"{_DD}/{_MM}/{_YEAR} {_CLOCK}{_FRAC}{_TZ} \\| {_lv()} *\\| {_co('[^ |]+')} *\\|{_TAIL}"),
    Family("syslog", "substr(content, 1, 1) = '<'", f"<(?<level>\\d{{1,3}})>1 {_ISO} [^ ]+ {_co('[^ ]+')} [^ ]+ [^ ]+ (?:-|(?:\\[(?:[^\\]\\\\]|\\\\.)*+\\])+){_TAIL}"),
    Family("web", "substr(content, 1, 1) = '['", f"\\[{_DOW} {_MON} (?<day>[ 0-3]\\d) {_CLOCK}{_FRAC} {_YEAR}\\] \\[{_co('[^:\\]]+')}:{_lv()}\\] \\[pid [^\\]]*\\]{_TAIL}"),
    Family("twoline", "substr(content, 4, 1) = ' ' AND (substr(content, 7, 1) = ',' OR substr(content, 6, 1) = ',')", f"{_MON} (?<day>[ 0-3]?\\d), {_YEAR} {_CLOCK}{_FRAC} (?<ampm>[AP]M) {_co('[^ ]+')} [^ ]+\\s*"),
    Family("bsd", "substr(content, 4, 1) = ' '", f"{_MON} (?<day>[ 0-3]\\d) {_CLOCK} [^ ]+ {_co('[^ \\[:]+')}(?:\\[\\d+\\])?: {_lv()}:{_TAIL}"),
    Family("letter", "substr(content, 6, 1) = ' ' AND substr(content, 9, 1) = ':'", f"(?<level>[A-Z]){_MM}{_DD} {_CLOCK}{_FRAC} +\\d+ {_co('[^ :]+')}:\\d+\\]{_TAIL}"),
    Family("compact", "substr(content, 9, 1) = ' ' AND substr(content, 12, 1) = ':'", f"{_YEAR}{_MM}{_DD} {_CLOCK}{_FRAC}{_TZ} {_lv()} \\({_co('[^)]*')}\\){_TAIL}"),
    Family("epoch", "substr(content, 10, 1) = '.' OR substr(content, 11, 1) = '.' OR substr(content, 12, 1) = '.'", f"(?<epoch>\\d{{9,11}})\\.(?<frac>\\d{{1,9}}) {_co('[^ /]+')}/{_lv()} ::{_TAIL}"),
)

# The level words, numbers and letters of each level.
LEVEL_NAMES = {
    "fatal": ("fatal", "critical", "crit", "emerg", "emergency", "alert", "panic", "0", "1", "2", "60", "f", "c"),
    "error": ("error", "err", "severe", "3", "50", "e"),
    "warn": ("warn", "warning", "4", "40", "w"),
    "info": ("info", "notice", "config", "5", "6", "30", "i", "n"),
    "debug": ("debug", "fine", "finer", "7", "20", "d"),
    "trace": ("trace", "finest", "verbose", "10", "t", "v"),
}
_SECOND = "(?s)^(SEVERE|WARNING|INFO|CONFIG|FINEST|FINER|FINE): (.*)$"
_JSON_SCHEMA = "ts string, `@timestamp` string, time string, timestamp string, level string, severity string, logger string, component string, module string, msg string, message string"


def level_name(token: Column) -> Column:
    """The level a word, number or letter stands for; null if it stands for none."""
    t, out = F.lower(F.trim(token)), None
    for name, words in LEVEL_NAMES.items():
        out = F.when(t.isin(*words), name) if out is None else out.when(t.isin(*words), name)
    return out


def _num(c: Column) -> Column:
    return F.when(c != "", F.trim(c).cast("bigint"))


def _frac_ms(c: Column) -> Column:
    return F.coalesce(_num(F.rpad(F.substring(c, 1, 3), 3, "0")), F.lit(0))


def _month(c: Column) -> Column:
    names = F.lit("JanFebMarAprMayJunJulAugSepOctNovDec")
    return F.when(c.rlike("^[A-Z]"), ((F.position(c, names) + 2) / 3).cast("bigint")).otherwise(_num(c))


def _day_ms(year: Column, month: Column, day: Column) -> Column:
    """Milliseconds to a day, for any day 1-31 without a failing date."""
    return (F.unix_date(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))) + day - 1).cast("bigint") * 86_400_000


def _offset_ms(tz: Column) -> Column:
    t = F.regexp_replace(tz, ":", "")
    ms = (F.substring(t, 2, 2).cast("bigint") * 60 + F.substring(t, 4, 2).cast("bigint")) * 60_000
    return F.when(tz.rlike("^[+-]"), F.when(F.substring(t, 1, 1) == "-", -ms).otherwise(ms)).otherwise(F.lit(0))


def _header_parts() -> Column:
    """The canonical parts of ``content`` (mark, layout, then ``FIELDS``), or null where no layout matches."""
    c, out = F.col("content"), F.lit(None).cast("string")
    for fam in reversed(FAMILIES):
        out = F.when(F.expr(fam.test), F.regexp_replace(c, fam.regex, fam.rewrite)).otherwise(out)
    return F.split(F.when(~F.startswith(c, F.lit(_SEP)), out), _SEP, len(FIELDS) + 2)


def _json_parts(j: Column) -> Column:
    """The same parts of a structured line that ``_JSON_SCHEMA`` has read."""
    at = F.coalesce(j["ts"], j["@timestamp"], j["timestamp"], j["time"])
    level, comp = F.coalesce(j["level"], j["severity"]), F.coalesce(j["logger"], j["component"], j["module"])
    time = F.split(F.regexp_replace(at, f"^{_ISO}$", _SEP.join(f"${{{n}}}" for n in FIELDS[:8])), _SEP)
    number = at.rlike("^\\d{12,14}$")
    none = F.array(*[F.lit("")] * 6)
    parts = F.when(number, F.concat(none, F.array(F.right(at, F.lit(3)), F.lit("")))).when(F.size(time) == 8, time)
    epoch = F.when(number, F.regexp_replace(at, "\\d{3}$", "")).otherwise("")
    rest = F.array(F.lit(""), level, comp, F.coalesce(j["msg"], j["message"], F.lit("")), epoch)
    return F.when(level.isNotNull() & comp.isNotNull(), F.concat(F.array(F.lit(""), F.lit("json")), parts, rest))


def small_methods(df: DataFrame) -> None:
    """Let stages whose generated method is too large for the JIT compiler run as split expressions instead.

    The cascade makes a long method; above 8000 bytes of bytecode the JVM would interpret it.
    """
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def parse_lines(lines: DataFrame) -> DataFrame:
    """``file_path, line_number, content`` with header columns; one row in, one row out, no shuffle.

    Adds ``blk, layout, ts_ms, month, day, level, component, message``; ``layout`` is null for continuation lines and
    ``second`` for the second line of a two-line header, whose level and message it carries.
    """
    small_methods(lines)
    c = F.coalesce(F.col("content"), F.lit(""))
    d = lines.where(F.col("file_path").isNotNull() & F.col("line_number").isNotNull())
    c = F.when(F.ascii(c) > 127, F.regexp_replace(c, f"^{_BOM}", "")).otherwise(c)
    d = d.select("file_path", "line_number", F.shiftright("line_number", BLOCK_BITS).alias("blk"), c.alias("content"))
    read = F.from_json("content", _JSON_SCHEMA, {"allowUnquotedControlChars": "true"})
    d = once(d, "_j", F.when(F.startswith("content", F.lit('{"')), read))
    d = once(d, "_h", F.when(F.col("_j").isNotNull(), _json_parts(F.col("_j"))).otherwise(_header_parts()))
    d = d.withColumn("_h", F.when(F.size("_h") == len(FIELDS) + 2, F.col("_h")))
    f = {n: F.col("_h")[i + 2] for i, n in enumerate(FIELDS)}
    hour = _num(f["hour"])
    hour = F.when(f["ampm"] == "PM", hour % 12 + 12).when(f["ampm"] == "AM", hour % 12).otherwise(hour)
    tod = ((hour * 60 + _num(f["minute"])) * 60 + _num(f["second"])) * 1000 + _frac_ms(f["frac"]) - _offset_ms(f["tz"])
    year, month, day = _num(f["year"]), _month(f["month"]), _num(f["day"])
    ts = F.when(f["epoch"] != "", _num(f["epoch"]) * 1000 + _frac_ms(f["frac"])).when(year.isNotNull(), _day_ms(year, month, day) + tod).otherwise(tod)
    token = f["level"]
    level = F.when(F.col("_h")[1] == "syslog", level_name((_num(token) % 8).cast("string"))).otherwise(level_name(token))
    second = F.col("_h").isNull() & F.col("content").rlike(_SECOND)
    bare = year.isNull() & (F.col("_h")[1] != "epoch") & (f["epoch"] == "")
    d = d.select(
        "file_path", "line_number", "blk", "content",
        F.when(second, "second").otherwise(F.col("_h")[1]).alias("layout"),
        ts.alias("ts_ms"),
        F.when(bare, month).cast("int").alias("month"), F.when(bare, day).cast("int").alias("day"),
        F.when(second, level_name(F.regexp_extract("content", _SECOND, 1))).otherwise(level).alias("level"),
        f["component"].alias("component"),
        F.when(second, F.regexp_extract("content", _SECOND, 2)).when(F.col("_h")[1] == "logfmt", F.regexp_replace(F.regexp_replace(f["message"], '^"|"$', ""), "\\\\(.)", "$1")).otherwise(f["message"]).alias("message"),
    )
    # A line whose level token stands for no level is no header.
    known = F.col("layout").isin("second", "twoline") | F.col("level").isNotNull()
    return d.withColumn("layout", F.when(known, F.col("layout")))


def is_head(layout: Column) -> Column:
    return layout.isNotNull() & (layout != "second")


def _file_years(files: DataFrame) -> DataFrame:
    """Year of each path's ``modified_time``; of several files at a path the one with the smallest id counts."""
    t = files.where(F.col("virtual_path").isNotNull() & F.col("modified_time").isNotNull())
    t = t.groupBy(F.col("virtual_path").alias("file_path")).agg(F.min_by("modified_time", "id").alias("_m"))
    return t.select("file_path", F.year(F.timestamp_seconds("_m")).alias("year"))


def block_years(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``file_path, blk, year`` of each block of the files whose year is known, so that no file's rows come together."""
    ends = lines.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.max("line_number").alias("_m"))
    d = ends.join(_file_years(files), "file_path")
    return d.select("file_path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright("_m", BLOCK_BITS))).alias("blk"), "year")


def _timed(d: DataFrame) -> Column:
    year = F.coalesce(F.col("year"), F.lit(1970))
    return F.when(F.col("month").isNull(), F.col("ts_ms")).otherwise(_day_ms(year, F.col("month"), F.col("day")) + F.col("ts_ms"))


def _groups(lines: DataFrame, files: DataFrame, texts: bool, message: bool) -> DataFrame:
    """Each block's lines in groups: a row for each header with the lines up to the next in its block, and one (``grp``
    0) for the lines ahead of the block's first header, which belong to an entry of an earlier block.

    The running count of headers in a block is the number of a line's group.  One shuffle, on (file, block).
    ``at_end``: whether it is the block's last group.  ``text`` (with ``texts``): the lines in order, joined.
    """
    d, head, second = parse_lines(lines), is_head(F.col("layout")), F.col("layout") == "second"
    parts = ["layout", "ts_ms", "month", "day", "level", "component"]
    keep = [F.when(F.col("layout").isNotNull(), F.col("message")).alias("message")] if message or texts else []
    d = d.select("file_path", "blk", "line_number", *parts, *keep, *(["content"] if texts else [])).repartition("file_path", "blk")
    w = Window.partitionBy("file_path", "blk").orderBy("line_number")
    d = d.withColumn("_p", F.lag(F.struct("line_number", "layout")).over(w)).where(F.col("_p").isNull() | (F.col("_p.line_number") != F.col("line_number")))
    one = F.when(head, 1).otherwise(0)
    d = d.withColumn("grp", F.sum(one).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(one).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    two = ["line_number", "level", *(["message"] if message or texts else [])]
    more = []
    if texts:
        after = (F.col("_p.layout") == "twoline") & (F.col("_p.line_number") + 1 == F.col("line_number"))
        text = F.when(head, F.when(F.col("layout") != "twoline", F.col("message"))).when(second & after, F.col("message")).otherwise(F.col("content"))
        some = F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("line_number", text.alias("t"))))), lambda x: x["t"])
        more = [F.when(F.size(some) > 0, F.concat_ws("\n", some)).alias("text")]
    g = d.groupBy("file_path", "blk", "grp").agg(
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.first(F.col("grp") == F.col("_all")).alias("at_end"),
        F.max(F.when(head, F.struct(*parts, *(["message"] if message or texts else [])))).alias("h"), F.min(F.when(second, F.struct(*two))).alias("two"), *more,
    )
    g = g.join(block_years(lines, files), ["file_path", "blk"], "left")
    here = (F.col("h.layout") == "twoline") & (F.col("two.line_number") == F.col("first_line") + 1)
    d = g.select("*", "h.ts_ms", "h.month", "h.day")
    said = [F.when(here, F.col("two.message")).otherwise(F.col("h.message")).alias("message")] if message or texts else []
    ahead = F.when((F.col("grp") == 0) & (F.col("first_line") == F.shiftleft("blk", BLOCK_BITS)) & (F.col("two.line_number") == F.col("first_line")), F.col("two"))
    return d.select(
        "file_path", "blk", "grp", "at_end", "first_line", "last_line", _timed(d).alias("ts_ms"), F.when(here, F.col("two.level")).otherwise(F.col("h.level")).alias("level"), F.col("h.component").alias("component"), *said,
        (F.col("h.layout") == "twoline").alias("twoline"), ahead.alias("ahead"), *(["text"] if texts else []),
    )


def _edges(groups: DataFrame) -> DataFrame:
    """A row for each block: ``file_path, blk``, ``next_head`` (first header of any later block), ``max_line`` (of the
    file), ``ahead`` (level and message of the next block's first line where it is the second of a header), ``owner``
    (line and block of the header that the lines ahead of the block's first belong to)."""
    b = groups.groupBy("file_path", "blk").agg(
        F.min(F.when(F.col("grp") > 0, F.col("first_line"))).alias("_f"), F.max(F.when(F.col("grp") > 0, F.struct(F.col("first_line").alias("line"), "blk"))).alias("_o"),
        F.max("last_line").alias("_m"), F.max("ahead").alias("_a"),
    )
    w = Window.partitionBy("file_path").orderBy("blk")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    nxt = F.lead(F.struct("blk", "_a")).over(w)
    return b.select(
        "file_path", "blk", F.first("_f", ignorenulls=True).over(after).alias("next_head"), F.last("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("max_line"),
        F.when(nxt["blk"] == F.col("blk") + 1, nxt["_a"]).alias("ahead"), F.last("_o", ignorenulls=True).over(before).alias("owner"),
    )


def _entries(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """The groups that have a header, as whole entries: only the last of each block can go on in a later one."""
    d = groups.where(F.col("grp") > 0)
    inner, last = d.where(~F.col("at_end")).drop("ahead"), d.where(F.col("at_end")).drop("ahead")
    e = last.join(edges.drop("owner"), ["file_path", "blk"])
    over = F.col("twoline") & F.col("ahead").isNotNull() & (F.col("ahead.line_number") == F.col("first_line") + 1)
    e = e.withColumn("last_line", F.coalesce(F.col("next_head") - 1, F.col("max_line"))).withColumn("over", F.coalesce(over, F.lit(False)))
    for c in ("level", "message"):
        if c in e.columns:
            e = e.withColumn(c, F.when(F.col("over"), F.col(f"ahead.{c}")).otherwise(F.col(c)))
    return inner.withColumn("over", F.lit(False)).unionByName(e.drop("next_head", "max_line", "ahead"))


def log_entries(lines: DataFrame, files: DataFrame, message: bool = True) -> DataFrame:
    """One row for each entry: ``file_path, first_line, last_line, ts_ms, level, component[, message]`` (of the header).

    The lines cross one exchange, on (file, block); what crosses a block's edge is worked out from a row for each block.
    """
    groups = cut(lines.sparkSession, _groups(lines, files, False, message), "entry-groups")
    columns = ["file_path", "first_line", "last_line", "ts_ms", "level", "component", *(["message"] if message else [])]
    return _entries(groups, _edges(groups)).select(*columns)


def entry_messages(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``log_entries`` with the whole message: the header's and its continuation lines, joined by newlines.

    What later blocks hold of an entry is one piece of text for each; no block waits for another.  A message is as
    long as its entry.
    """
    groups = cut(lines.sparkSession, _groups(lines, files, True, True), "entry-groups")
    edges = _edges(groups)
    pieces = groups.where(F.col("grp") == 0).join(edges.where(F.col("owner").isNotNull()).select("file_path", "blk", "owner"), ["file_path", "blk"])
    rest = pieces.groupBy("file_path", F.col("owner.line").alias("first_line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_line", "text"))), lambda x: x["text"]).alias("rest"))
    e = _entries(groups, edges)
    # The second line of a header that ends its block is the first of the pieces: it goes in as the message it holds.
    first = F.when(F.col("over"), F.regexp_replace(F.col("rest")[0], _SECOND, "$2")).otherwise(F.col("rest")[0])
    later = F.concat(F.array(first), F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))))
    whole = F.when(F.col("twoline") & F.col("over"), F.concat_ws("\n", later)).otherwise(F.concat_ws("\n", F.array("text"), later))
    e = e.join(rest, ["file_path", "first_line"], "left").withColumn("message", F.when(F.col("rest").isNull(), F.col("text")).otherwise(whole))
    return e.select("file_path", "first_line", "last_line", "ts_ms", "level", "component", "message")
