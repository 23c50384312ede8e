"""Program logs of mixed layouts into entries with timestamp, level, component and message (problem 3).

Each line is reduced to its shape: names, runs of digits and runs of blanks become one symbol each, and the first
``SHAPE_SYMBOLS`` symbols are the line's signature.  A layout is told by how it begins, up to its clock: 12 symbols at most,
however long its names and numbers are, so the bound cuts no header.  Each distinct signature is resolved to an extraction
rule once; the most frequent ``MAX_RULES`` of them go out as a broadcast table, whose size those two constants bound,
and a line whose signature is not in it is resolved in place, so the result does not depend on that bound either.  The
rule then takes the whole line apart.

Lines without an own timestamp belong to the entry last begun above them.  Lines are put in order within blocks of
``BLOCK_LINES`` line numbers of a file, and each block gives its entries, with its first lines apart if they continue an
entry of a block above.  Only those first lines and each block's last entry are put in order by file, so one huge file
spreads over as many tasks as it has blocks.  The message is joined within blocks first, then over the blocks of an entry.

Defined results: repeated deliveries of a line (same file and line number) count once; lines above the first entry of
a file belong to none and do not come out; rows with a null file or line number cannot be placed and do not come out; a
null text is a blank line; a line whose timestamp is no date is a continuation; a timestamp without year in a file
without any collection time stays null; an entry without level is ``NONE``; an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHAPE_SYMBOLS = 16
FIRST_LOOK = 48
MAX_RULES = 20_000
BLOCK_LINES = 4096

#: Layouts (fixed values): name, pattern of the signature, pattern of the line with its replacement into
#: timestamp, level, component and message, split by the separator below.
_SEP = "\x01"
_LAYOUTS = [
    ("bracket", r"^\[a a 9 9:9:9", r"^\[\w{3} (\w{3}) +(\d+) (\d\d:\d\d:\d\d)(?:\.\d+)? (\d{4})\] \[([\w.-]+):(\w+)\](?: \[pid \d+[^\]]*\])? ?(.*)$", ("$4-$1-$2 $3", "$6", "$5", "$7")),
    ("letter", r"^a 9:9:9", r"^([DIWEF])(\d\d)(\d\d) (\d\d:\d\d:\d\d)(?:\.\d+)? +\d+ ([\w./-]+):\d+\] ?(.*)$", ("0000-$2-$3 $4", "$1", "$5", "$6")),
    ("thread", r"^9-9-9 9:9:9", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)(?:[,.]\d+)? \[[^\]]*\] +(\w+) +([\w.$-]+) +- ?(.*)$", ("$1", "$2", "$3", "$4")),
    ("epoch", r"^9(\.9)? ", r"^(\d{9,13})(?:\.\d+)? ([\w.-]+)/(\w+): ?(.*)$", ("$1", "$3", "$2", "$4")),
    ("pipe", r"^9/a/9:9:9:9 ", r"^(\d\d?)/(\w{3})/(\d{4}):(\d\d:\d\d:\d\d) ([+-]\d{4}) ?\| ?(\w+) ?\| ?([\w.-]+) ?\| ?(.*)$", ("$3-$2-$1 $4 $5", "$6", "$7", "$8")),
    ("zoned", r"^9-9-9a:9:9", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:[,.]\d+)?(Z|[+-]\d\d:?\d\d)? ([\w.-]+) (\w+): ?(.*)$", ("$1 $2", "$4", "$3", "$5")),
    ("syslog", r"^a 9 9:9:9 ", r"^([A-Z][a-z]{2}) +(\d+) (\d\d:\d\d:\d\d) \S+ ([^\s\[:]+)(?:\[\d+\])?: (?:<(\w+)> ?)?(.*)$", ("0000-$1-$2 $3", "$5", "$4", "$6")),
    ("pairs", r"^a=", None, None),
    ("object", r'^\{ ?"', None, None),
]
#: Names under which the parts of an entry go in key=value lines and JSON objects (fixed values).
_KEYS = {
    "ts": ("time", "ts", "t", "timestamp"),
    "level": ("level", "lvl", "severity"),
    "component": ("component", "comp", "logger"),
    "message": ("message", "msg", "text"),
}
#: What programs write for a level (fixed values).
LEVELS = {
    "DEBUG": ("D", "DEBUG", "TRACE"),
    "INFO": ("I", "INFO", "NOTICE"),
    "WARN": ("W", "WARN", "WARNING"),
    "ERROR": ("E", "ERR", "ERROR"),
    "FATAL": ("F", "FATAL", "CRIT", "CRITICAL", "EMERG", "EMERGENCY", "ALERT", "PANIC"),
}
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _shape(line: Column) -> Column:
    """Names ``a``, digits ``9``, blanks one space, other signs as they are, those beyond ASCII ``~``."""
    shape = F.regexp_replace(line, r"[a-zA-Z_][a-zA-Z0-9_.$-]*+", "a")
    shape = F.regexp_replace(shape, r"[0-9]++", "9")
    shape = F.regexp_replace(shape, r"\s++", " ")
    return F.regexp_replace(F.substring(shape, 1, SHAPE_SYMBOLS), r"[^ -~]", "~")


def _with_signatures(lines: DataFrame) -> DataFrame:
    """``lines`` with ``sig``, the shape of the first SHAPE_SYMBOLS symbols.

    Most lines show these within their first characters; those that do not are looked at whole, so the result is that of whole lines.
    Of an indented line, which begins no entry, the first blank is enough.
    """
    first = F.substring("text", 1, 1)
    lines = lines.withColumn("sig", F.when(first.isin("", " ", "\t"), F.lit(" ")).otherwise(_shape(F.substring("text", 1, FIRST_LOOK))))
    seen = (F.length("sig") >= SHAPE_SYMBOLS) | (F.length("text") <= FIRST_LOOK) | F.col("sig").startswith(" ")
    return lines.withColumn("sig", F.when(seen, F.col("sig")).otherwise(_shape(F.col("text"))))


def resolve(sig: Column) -> Column:
    """The name of the layout that a signature is of, ``-`` if of none."""
    rule = F.lit("-")
    for name, shape, _, _ in reversed(_LAYOUTS):
        rule = F.when(sig.rlike(shape), F.lit(name)).otherwise(rule)
    return rule


def _found_pair(line: Column, part: str) -> Column:
    """What stands behind the first of the part's keys in a key=value line, with its quotes."""
    return F.regexp_extract(line, rf'(?:^|\s)(?:{"|".join(_KEYS[part])})=("(?:[^"\\]|\\.)*"|\S*)', 1)


def _unquoted(found: Column) -> Column:
    """A value without its double quotes; in them, a backslash escapes."""
    return F.when(found.startswith('"'), F.regexp_replace(F.regexp_replace(found, r'^"|"\s*$', ""), r"\\(.)", "$1")).otherwise(found)


def _taken_apart(lines: DataFrame) -> DataFrame:
    """``lines`` with ``parts``: [timestamp text, level text, component, message], or null where the line does not bear them.

    In steps, as what is used twice within one expression is computed twice.
    """
    rule, line, flat = F.col("rule"), F.col("text"), F.lit(None).cast("string")
    for name, _, pattern, parts in _LAYOUTS:
        if pattern:
            flat = F.when(rule == name, F.regexp_replace(line, r"(?s)" + pattern, "\x02" + _SEP.join(parts))).otherwise(flat)
    pairs = F.when(rule == "pairs", F.array(*[_found_pair(line, p) for p in _KEYS]))
    lines = lines.withColumns({"flat": flat, "pairs": pairs, "keyed": F.when(rule == "object", F.from_json(line, "map<string,string>"))})
    regular = F.when(F.col("flat").startswith("\x02"), F.split(F.substring("flat", 2, 2**31 - 1), _SEP, 4))
    keyed = F.array(*[F.coalesce(*[F.try_element_at("keyed", F.lit(k)) for k in _KEYS[p]], F.lit("")) for p in _KEYS])
    parts = F.when(rule == "pairs", F.transform("pairs", _unquoted)).when(rule == "object", keyed).otherwise(regular)
    return lines.withColumn("parts", parts).drop("flat", "pairs", "keyed")


def _level(text: Column) -> Column:
    text = F.upper(text)
    out = F.lit("NONE")
    for name, written in LEVELS.items():
        out = F.when(text.isin(*written), F.lit(name)).otherwise(out)
    return out


def _with_clock(lines: DataFrame, text: Column) -> DataFrame:
    """``lines`` with ``at``, the epoch second of a timestamp text, null where it is none, and ``yearless``, whether it bears no year (0000): it is then read as of 2000, a leap year.

    By places within the text, as a pattern would have to be matched and its groups read; the cast reads clock, zone and fraction.
    """
    lines = lines.withColumn("stamp", F.translate(F.trim(text), ",", "."))
    stamp = F.col("stamp")
    name = F.substring(stamp, 6, 3)
    month = F.floor((F.nullif(F.instr(F.lit(_MONTHS), name), F.lit(0)) + 2) / 3).cast("string")
    lines = lines.withColumn("stamp", F.when(name.rlike("^[A-Z]"), F.concat(F.substring(stamp, 1, 5), F.lpad(month, 2, "0"), F.substring(stamp, 9, 64))).otherwise(stamp))
    lines = lines.withColumn("yearless", stamp.startswith("0000-"))
    sign = lambda place: F.substring(stamp, place, 1).isin("+", "-")
    zoned = stamp.endswith("Z") | sign(-5) | sign(-6)
    dated = F.concat(F.when(F.col("yearless"), F.concat(F.lit("2000"), F.substring(stamp, 5, 64))).otherwise(stamp), F.when(zoned, F.lit("")).otherwise(F.lit("Z")))
    # a date alone would be cast too: there has to be a clock of two colons
    begin = F.substring(stamp, 1, 19)
    has_clock = F.length(begin) - F.length(F.replace(begin, F.lit(":"), F.lit(""))) == 2
    return lines.withColumn("at", F.when(has_clock, F.unix_seconds(dated.try_cast("timestamp")))).drop("stamp")


def _count(digits: Column) -> Column:
    """Epoch seconds from the digits of a number; milli-, micro- and nanoseconds are told from seconds by their length."""
    length = F.length(digits)
    return F.substring(digits, F.lit(1), length - F.when(length > 17, 9).when(length > 14, 6).when(length > 11, 3).otherwise(0)).try_cast("long")


def _nearest(at: Column, near: Column) -> Column:
    """The second ``at`` of the year 2000 in the year that brings it nearest to ``near``; null if no year around has such a day."""
    date = lambda second: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int"))  # noqa: E731  (of no time zone)
    options = []
    for d in (0, -1, 1):
        begun = F.try_make_timestamp(F.year(date(near)) + d, F.month(date(at)), F.day(date(at)), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
        then = F.unix_seconds(begun) + F.pmod(at, F.lit(86400))
        options.append(F.when(then.isNotNull(), F.struct(F.abs(then - near).alias("away"), then.alias("at"))))
    return F.least(*options)["at"]


def _with_rules(lines: DataFrame) -> DataFrame:
    lines = _with_signatures(lines)
    common = lines.groupBy("sig").agg(F.count(F.lit(1)).alias("lines")).orderBy(F.desc("lines"), "sig").limit(MAX_RULES)
    rules = common.select(F.col("sig").alias("known_sig"), resolve(F.col("sig")).alias("known_rule"))
    joined = lines.join(F.broadcast(rules), F.col("sig") == F.col("known_sig"), "left")
    return joined.withColumn("rule", F.coalesce("known_rule", resolve(F.col("sig")))).drop("sig", "known_sig", "known_rule")


def log_entries(df: DataFrame, file: str = "log_file", number: str = "version", text: str = "s_val", collected: str = "t_val", tie: str = "tuple_id", block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per entry: ``log_file, first_version, last_version, ts, level, component, message, layout``.

    ``collected`` is the epoch second at which a line was read; it gives the year where a timestamp has none (of a line
    without it, the nearest line above, else below, that has one).  The message is the header's text and the
    following lines, joined by line feeds; it is built only where it is selected.
    """
    block = F.expr(f"n div {int(block_lines)}")
    placed = df.select(F.col(f"`{file}`").alias("file"), F.col(f"`{number}`").cast("long").alias("n"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{collected}`").cast("long").alias("read_at"), F.col(f"`{tie}`").alias("tie"))
    placed = placed.where("file is not null and n is not null")
    lines = _with_rules(placed)
    lines = _taken_apart(lines)
    lines = lines.withColumn("digits", F.when(F.col("rule").isin("epoch", "pairs", "object"), F.regexp_extract(F.col("parts")[0], r"^\s*0*(\d{9,19})(?:\.\d+)?\s*$", 1)))
    lines = _with_clock(lines, F.when(F.coalesce("digits", F.lit("")) == "", F.col("parts")[0]))
    lines = lines.withColumn("known", F.coalesce(_count(F.col("digits")), F.col("at")))
    is_head = F.col("known").isNotNull()
    entry = F.when(is_head, F.struct("known", "yearless", _level(F.col("parts")[1]).alias("level"), F.col("parts")[2].alias("component"), F.col("rule").alias("layout")))
    said = F.when(is_head, F.col("parts")[3]).otherwise(F.col("text"))
    lines = lines.select("file", block.alias("block"), "n", "tie", "read_at", entry.alias("entry"), said.alias("said"))

    order = Window.partitionBy("file", "block").orderBy("n", "tie")
    above, below = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    within = (
        lines.withColumn("before", F.lag("n").over(order))
        .withColumn("near", F.coalesce(F.last("read_at", True).over(above), F.first("read_at", True).over(below)))
        .withColumn("here", F.max(F.when(F.col("entry").isNotNull(), F.col("n"))).over(above))
        .where(~F.col("before").eqNullSafe(F.col("n")))
        .withColumn("near", F.when(F.col("entry").isNotNull(), F.col("near")))
    )
    # what a block holds of each entry; without ``here``, the lines above its first head
    spoken = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]), "\n")
    held = within.groupBy("file", "block", "here").agg(F.max("n").alias("last"), F.max("entry").alias("entry"), F.max("near").alias("near"), spoken.alias("said"))
    # the collection times of the blocks around, for blocks that have none
    times = placed.groupBy("file", block.alias("block")).agg(F.max("read_at").alias("some"))
    by_file = Window.partitionBy("file").orderBy("block")
    around = F.coalesce(F.last("some", True).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.first("some", True).over(by_file.rowsBetween(0, Window.unboundedFollowing)))
    held = held.join(times.select("file", "block", around.alias("far")), ["file", "block"])
    ts = F.when(F.col("entry.yearless"), _nearest(F.col("entry.known"), F.coalesce("near", "far"))).otherwise(F.col("entry.known"))
    head = F.when(F.col("entry").isNotNull(), F.struct(ts.alias("ts"), F.col("entry.level").alias("level"), F.col("entry.component").alias("component"), F.col("entry.layout").alias("layout")))
    # what may go on beyond a block, or comes from above it, is put in order by file; all else is whole
    open_ = F.col("here").isNull() | (F.col("here") == F.max("here").over(Window.partitionBy("file", "block")))
    held = held.select("file", "block", "here", "last", head.alias("head"), "said", F.when(open_, F.lit(-1)).otherwise(F.col("block")).alias("place"))
    owner = F.last("here", True).over(Window.partitionBy("file", "place").orderBy("block", F.asc_nulls_first("here")).rowsBetween(Window.unboundedPreceding, 0))
    owned = held.withColumn("first", owner).where(F.col("first").isNotNull())
    message = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last", "said"))), lambda x: x["said"]), "\n")
    entries = owned.groupBy("file", "place", "first").agg(F.max("last").alias("last"), F.max("head").alias("head"), message.alias("message"))
    return entries.select(
        F.col("file").alias("log_file"),
        F.col("first").alias("first_version"),
        F.col("last").alias("last_version"),
        F.col("head.ts").alias("ts"),
        F.col("head.level").alias("level"),
        F.col("head.component").alias("component"),
        "message",
        F.col("head.layout").alias("layout"),
    )
