"""Layouts of log lines, found by shape signature.

The head of a line is collapsed to a *signature* (runs of digits ``9``, words
``a``, level words ``L``, the rest as it stands), by built-in functions.  Each
distinct signature is resolved to a layout of the catalogue below once; the
layout's field rule is then applied to all lines that have it together.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Level words of common logging systems and the level they stand for.
LEVELS = {
    "TRACE": "TRACE", "FINEST": "TRACE", "VERBOSE": "TRACE", "T": "TRACE", "TRC": "TRACE",
    "DEBUG": "DEBUG", "DBG": "DEBUG", "D": "DEBUG", "FINE": "DEBUG",
    "INFO": "INFO", "INFORMATION": "INFO", "INF": "INFO", "I": "INFO", "NOTICE": "INFO",
    "WARN": "WARNING", "WARNING": "WARNING", "WRN": "WARNING", "W": "WARNING",
    "ERROR": "ERROR", "ERR": "ERROR", "E": "ERROR", "SEVERE": "ERROR",
    "CRITICAL": "CRITICAL", "CRIT": "CRITICAL", "C": "CRITICAL", "ALERT": "CRITICAL", "EMERG": "CRITICAL", "PANIC": "CRITICAL",
    "FATAL": "FATAL", "F": "FATAL", "FTL": "FATAL",
}
LEVEL_WORDS = sorted((w for w in LEVELS if len(w) > 1), key=len, reverse=True)

#: Colour codes (terminal escape sequences).
ANSI = "\x1b\\[[0-9;]*[A-Za-z]"
#: Tokens of a head that a signature covers. No shape below looks further: a time has at most six, a level one, and at most four more follow.
HEAD_TOKENS = 12
_TIME_KEYS, _LEVEL_KEYS = ("ts", "time", "timestamp", "t", "datetime"), ("level", "lvl", "severity")
_VALUE = r'(?:"(?:[^"\\]|\\.)*+"|[^\s"]*+)'
#: Heads of lines: all leading ``key=value`` pairs, or tokens of which one in brackets may hold blanks.
PAIRS = rf"^(?>[A-Za-z_][\w.\-]*+={_VALUE}(?:[ \t]++|$))++"
TOKENS = r"^(?>(?>\[[^\]\n]*+\][^ \t\n]*+|[^ \t\n]++)[ \t]*+){0,%d}" % HEAD_TOKENS
_INITIALS = "".join(sorted({w[0] for w in LEVEL_WORDS}))
_WORD = rf"(?i)(?<![A-Za-z0-9_])(?=[{_INITIALS}])(?:%s)(?![A-Za-z0-9_])"
#: Collapsing of a head, in order. A run of 48 characters of names is longer than any time: it stands for one word.
COLLAPSE = (
    (r"[A-Za-z0-9_$+/.\-]{48,}", "a"),
    (_WORD % "|".join(LEVEL_WORDS), "\x01"),
    (r"[A-Za-z_$]+", "a"),
    (r"[0-9]+", "9"),
    ("\x01", "L"),
    (r"\[(?![^\]]*9:9)[^\]]* [^\]]*\]", "[~]"),
)
#: The same for pairs: keys of times and levels are told apart, other pairs are one ``a=~`` however many stand together.
COLLAPSE_PAIRS = (
    (rf"(?i)(?<![^ \t])(?:{'|'.join(_TIME_KEYS)})=", "\x02="),
    (rf"(?i)(?<![^ \t])(?:{'|'.join(_LEVEL_KEYS)})=", "\x03="),
    *COLLAPSE[:5],
    ("\x02", "T"),
    ("\x03", "V"),
    (r'(?<![^ \t])[^ \t=]+=(?:"(?!9|a, 9|a  ?9 9:9)(?:[^"\\]|\\.)*+"|(?!"|9|L(?:[ \t]|$))[^ \t]*+)(?=[ \t]|$)', "a=~"),
    (r"[ \t]+", " "),
    (r"(?:(?<![^ ])a=~ ){2,}", "a=~ "),
)


#: A collapsed head to the end of its last level word, and what is behind.
BEHIND = r"^(.*L[^ \t]*)(.*)$"


def with_signature(df: DataFrame, line: str, out: str) -> DataFrame:
    """Add the shape signature of a line's head; of a line that starts with a brace it is ``{``, of one that no layout begins like it is empty.

    A column per step, so that no step is evaluated twice.
    """

    def collapsed(head: str, steps: tuple) -> Column:
        c = F.regexp_extract(line, head, 0)
        for pattern, token in steps:
            c = F.regexp_replace(c, pattern, token)
        return c

    first = F.substring(line, 1, 1)
    kind = F.when(first == "{", 0).when(~first.rlike(r"[A-Za-z0-9\[<_]"), 1).when(F.col(line).rlike(r"^[A-Za-z_][\w.\-]*="), 2).otherwise(3)
    df = df.withColumn("_kind", kind).withColumn("_head", F.when(F.col("_kind") == 2, collapsed(PAIRS, COLLAPSE_PAIRS)).when(F.col("_kind") == 3, collapsed(TOKENS, COLLAPSE)))
    # behind the last level word only brackets, dashes and line numbers of a few tokens tell layouts apart
    head, after = F.col("_head"), F.regexp_extract("_head", BEHIND, 2)
    for pattern, token in ((r"(?<![^ \t])\[[^\]]*\](?![^ \t])", "[~]"), (r"(?<![^ \t])(?!\[~\]|-(?:[ \t]|$))(-?)[^ \t]+?(:9)?(?=[ \t]|$)", "$1a$2")):
        after = F.regexp_replace(after, pattern, token)
    cut = F.concat(F.regexp_extract(head, BEHIND, 1), F.regexp_extract(after, r"^[ \t]*(?:[^ \t]+[ \t]*){0,5}", 0))
    no_level = F.when(head.rlike("^(?:a9 9:9:|<9>)"), F.regexp_extract(head, r"^(?:[^ \t]+[ \t]*){0,6}", 0)).otherwise("")
    tokens = F.when(~head.contains("L"), no_level).when(~head.startswith("L"), cut).when(head.rlike(r"^L +\|"), F.regexp_extract(head, r"^(?:[^|]*\|){1,3}", 0)).otherwise("")
    return df.withColumn(out, F.when(F.col("_kind") == 0, "{").when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, head).otherwise(tokens)).drop("_kind", "_head")


_T = (
    r"(?:9[-/.]9[-/.]9[a :]9:9(?::9)?(?:[.,]9)?(?: ?(?:[+-]9(?::9)?|a))?"
    r"|9a9(?:[.,]9)?a?|9/[9a]/9[: ]9:9:9(?:[.,]9)?(?: a)?(?: [+-]9)?|a, 9 a 9 9:9:9(?: (?:a|[+-]9))?|a  ?9 9:9:9|9(?:\.9)?)"
)
_W = r"[aL9][aL9.\-/@]*"


class Layout(NamedTuple):
    name: str
    shape: re.Pattern
    fields: str | None


def _l(name: str, shape: str, fields: str | None) -> Layout:
    return Layout(name, re.compile(shape), f"(?s){fields}" if fields else None)


_LV = r"(?P<level>" + "|".join(LEVEL_WORDS) + r")"
#: Each layout: what its signature looks like, and where its fields stand in the line.
LAYOUTS = (
    _l("json", r"^\{", None),
    _l("klog", r"^a9 9:9:9\.9 +9 [^ \]]+:9\]", r"^(?P<level>[A-Z])(?P<ts>\d{4} \d\d:\d\d:\d\d\.\d+) +\d+ (?P<component>[^\s\]]+):\d+\] ?(?P<message>.*)$"),
    _l("tabbed", rf"^{_T}\tL[ \t]", rf"(?i)^(?P<ts>[^\t]+)\t{_LV}(?: [^\t]*)?\t(?P<component>[^\t]*?)(?::\d+)?\t[^\t]*\t(?P<message>.*)$"),
    _l("logger", rf"^{_T} +L +\[[^\]]*\] +[^ ]+ - ", rf"(?i)^(?P<ts>[^\[]+?) +{_LV} +\[[^\]]*\] +(?P<component>\S+) - (?P<message>.*)$"),
    _l("spaced", rf"^{_T} +L +[^ ]+ +[^ ]+ +[^ ]+:9 +[^ ]+", rf"(?i)^(?P<ts>\S.*?) +{_LV} +\S+ +\S+ +(?P<component>[^\s:]+):\d+ +\S+(?: (?P<message>.*))?$"),
    _l("syslog", r"^(?:<9>)?a  ?9 9:9:9 [^ ]+ [^ \[:]+(?:\[9\])?: +\[L\]", rf"(?i)^(?:<\d+>)?(?P<ts>[a-z]{{3}} [ \d]\d \d\d:\d\d:\d\d) \S+ (?P<component>[^\s\[:]+)(?:\[\d+\])?: +\[{_LV}\] ?(?P<message>.*)$"),
    _l("priority", r"^<9>a  ?9 9:9:9 [^ ]+ [^ \[:]+(?:\[9\])?:", r"(?i)^<(?P<priority>\d+)>(?P<ts>[a-z]{3} [ \d]\d \d\d:\d\d:\d\d) \S+ (?P<component>[^\s\[:]+)(?:\[\d+\])?: ?(?P<message>.*)$"),
    _l("named", rf"^\[{_T}\] [^ ]+ \(L\)", rf"(?i)^\[(?P<ts>[^\]]+)\] (?P<component>\S+) \({_LV}\) ?(?P<message>.*)$"),
    _l("dashed", rf"^\[{_T}\] +L +-", rf"(?i)^\[(?P<ts>[^\]]+)\] +{_LV} +- ?(?P<message>.*)$"),
    _l("piped", rf"^L +\| +{_T} +\| +[^ |]* *\|", rf"(?i)^{_LV} +\| +(?P<ts>[^|]+?) +\| +(?P<component>[^|]*?) *\| ?(?P<message>.*)$"),
    _l("keyed", rf"^(?:[aTV]=\"?{_T}\"? [aTV]=L|[aTV]=L [aTV]=\"?{_T}\"?|(?=(?:[^ ]* )*T=\"?{_T}\"?(?: |$))(?=(?:[^ ]* )*V=L(?: |$)).*)(?: |$)", None),
    _l("plain", rf"^\[?{_T}\]?[ \t\-]+\[?L\]?(?![A-Za-z0-9_=])", rf"(?i)^\[?(?P<ts>[^\[\]]+?)\]?[ \t\-]+\[?{_LV}\]?\b[ \t:]*(?P<message>.*)$"),
)


def layout_of(sig: str) -> int:
    """Index of the layout of a signature, -1 for a continuation line."""
    return next((i for i, layout in enumerate(LAYOUTS) if layout.shape.match(sig)), -1)


# The keys under which JSON records hold a field, in order of precedence. A pair is a key of a nested object.
JSON_KEYS = {
    "ts": ("time", "timestamp", "@timestamp", "asctime", "datetime", "ts", ("attributes", "time")),
    "level": ("level", "levelname", "severity", "severity_text", "log.level", ("log", "level"), ("attributes", "level")),
    "component": ("microservice", "service.name", "service_name", "service", ("resource", "service.name"), ("attributes", "service.name"), ("service", "name"), "component", "logger", "logger_name", "program"),
    "message": ("message", "body", "msg", "event", ("attributes", "message"), "exception.message", ("exception", "message")),
}
_KEYED = {
    "ts": _TIME_KEYS, "level": _LEVEL_KEYS, "component": ("component", "logger", "service", "program", "caller"),
    "message": ("msg", "message"),
}
_PAIR = re.compile(r'([A-Za-z_][\w.\-]*)=("(?:[^"\\]|\\.)*"|\S*)')
_ESCAPES = re.compile(r"\\(.)", re.S)
_ANSI = re.compile(ANSI)
# Syslog severities 0 to 7.
_PRIORITIES = ("FATAL", "CRITICAL", "CRITICAL", "ERROR", "WARNING", "INFO", "INFO", "DEBUG")


class Entry(NamedTuple):
    """Fields of one entry."""

    parse_format: str
    parse_status: str
    ts_text: str
    severity_text: str
    component: str
    body: str


class _Text(str):
    """The text of a JSON number as it stands."""


def _refuse(x: str):
    raise ValueError(x)


def _json_text(v) -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _first(record: dict, keys: tuple) -> str | None:
    for k in keys:
        v = record.get(k) if isinstance(k, str) else (record[k[0]].get(k[1]) if isinstance(record.get(k[0]), dict) else None)
        if v is None or v == "" or isinstance(v, dict) and k == "service":
            continue
        return _json_text(v)
    return None


def severity(text: str | None) -> str:
    """One of the seven levels, INFO for none or an unknown one."""
    return LEVELS.get((text or "").strip().upper(), "INFO")


def clean_text(text: str) -> str:
    """Without colour codes and without blanks at line ends."""
    if "\x1b" in text:
        text = _ANSI.sub("", text)
    return "\n".join(x.rstrip() for x in text.split("\n"))


def _unquote(v: str) -> str:
    if len(v) < 2 or v[0] != '"' or v[-1] != '"':
        return v
    try:
        return json.loads(v)
    except ValueError:
        return _ESCAPES.sub(lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), v[1:-1])


def parse_json(text: str) -> Entry:
    try:
        record = json.loads(text, parse_float=_Text, parse_int=_Text, parse_constant=_refuse)
        if not isinstance(record, dict):
            raise ValueError("not an object")
    except (ValueError, RecursionError):
        return Entry("text", "degraded", "", "INFO", "", text)
    get = lambda k: _first(record, JSON_KEYS[k])
    body = get("message")
    return Entry("json", "ok", (get("ts") or "").strip(), severity(get("level")), (get("component") or "").strip(), clean_text(text if body is None else body).rstrip())


def parse_keyed(text: str) -> Entry:
    """Fields of an entry whose first line are ``key=value`` pairs."""
    head, newline, rest = text.partition("\n")
    pairs: dict[str, str] = {}
    for k, v in _PAIR.findall(head):
        pairs.setdefault(k.lower(), v)
    get = lambda k: next((_unquote(pairs[x]) for x in _KEYED[k] if x in pairs), None)
    message = get("message")
    body = (head if message is None else clean_text(message)) + newline + rest
    return Entry("text", "ok", get("ts") or "", severity(get("level")), get("component") or "", body.rstrip())


_PARSERS = {"json": parse_json, "keyed": parse_keyed}
_LINES = r"(?s)^(?P<head>[^\n]*)(?P<rest>.*)$"


def _canonical(levels: pa.Array) -> pa.Array:
    """:func:`severity` of each of the few different level words."""
    coded = pc.dictionary_encode(levels)
    names = pa.array([severity(x) for x in coded.dictionary.to_pylist()], pa.string())
    return pc.fill_null(names.take(coded.indices), "INFO")


def _extracted(layout: Layout, text: pa.Array) -> list[pa.Array]:
    """Fields of entries of one layout: its rule on all first lines together, which is message only where the rule does not fit."""
    lines = pc.extract_regex(text, _LINES)
    head, rest = (pc.struct_field(lines, i) for i in (0, 1))
    got = pc.extract_regex(head, layout.fields)
    fits = got.is_valid()
    names = [f.name for f in got.type]
    field = lambda k: pc.struct_field(got, names.index(k)) if k in names else pa.nulls(len(text), pa.string())
    filled = lambda k: pc.utf8_trim_whitespace(pc.fill_null(field(k), ""))
    if "priority" in names:
        levels = pa.array([_PRIORITIES[int(p) % 8] if p else None for p in field("priority").to_pylist()], pa.string())
    else:
        levels = _canonical(field("level"))
    body = pc.if_else(fits, pc.binary_join_element_wise(pc.fill_null(field("message"), ""), rest, ""), text)
    n = len(text)
    return [pa.repeat("text", n), pa.repeat("ok", n), filled("ts"), pc.fill_null(levels, "INFO"), filled("component"), pc.utf8_rtrim_whitespace(body)]


def parse_entries(text: pa.Array, layout: pa.Array) -> pa.StructArray:
    """Fields of entries (all their lines, cleaned) by the layout of their first line: each layout's entries together. -1 is message only."""
    text = pc.utf8_rtrim_whitespace(pc.fill_null(text.cast(pa.string()), ""))
    parts, places = [], []
    for k in pc.unique(layout).to_pylist():
        at = pc.indices_nonzero(pc.equal(layout, k))
        some = text.take(at)
        if k < 0:
            n = len(some)
            cols = [pa.repeat("text", n), pa.repeat("ok", n), pa.repeat("", n), pa.repeat("INFO", n), pa.repeat("", n), some]
        elif LAYOUTS[k].fields is None:
            cols = [pa.array(c, pa.string()) for c in zip(*map(_PARSERS[LAYOUTS[k].name], some.to_pylist()))]
        else:
            cols = _extracted(LAYOUTS[k], some)
        parts.append(pa.StructArray.from_arrays(cols, names=list(Entry._fields)))
        places.append(at)
    if not parts:
        return pa.StructArray.from_arrays([pa.array([], pa.string())] * len(Entry._fields), names=list(Entry._fields))
    back = pc.sort_indices(pa.concat_arrays(places))
    return pa.concat_arrays(parts).take(back)
