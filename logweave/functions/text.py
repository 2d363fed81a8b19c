"""Scalar text functions: normalisation, headlines, exceptions, severities, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of variable text, in the order in which they are replaced.
ANSI = "\x1b\\[[0-9;]*m"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"""\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s"']+"""
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
ISO_TIME = r"\b\d{4}-\d{2}-\d{2}[T ][0-2]\d:[0-5]\d:[0-5]\d(?:[.,]\d+)?(?:Z|[+-][0-2]\d:?[0-5]\d)?\b"
OLD_TIME = r"\b\d{4}/\d{2}/\d{2}:[0-2]\d:[0-5]\d:[0-5]\d\b"
IPV4 = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b"
PORT = r"(\bport[=: ]|:)(\d{2,5})(/?)"
PATH = r"/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+"
HEX = r"\b0x[0-9a-fA-F]+\b"
BLOBS = ((32, "<TRACE_ID>"), (24, "<OBJECT_ID>"), (16, "<SPAN_ID>"))
SOME_BLOB = r"[A-Za-z0-9]{16}"
NUMBER = r"(?<![A-Za-z0-9_.])-?\d+(?:\.\d+)?(?![A-Za-z0-9_.])"
PREFIX_HEX = r"(?<![A-Za-z0-9_-])([A-Za-z]{2,15}_)[0-9a-fA-F]{6,40}(?![A-Za-z0-9_-])"
LONG_ID = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]{16,}(?![A-Za-z0-9_-])"
EXCEPTION = r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception|Timeout|Failure))\b"
HEADLINE_CUT = r"(?i)\b(?:payload|body|data|context|args|extra|details|metadata|response|request|message|content|kwargs|params)\s*[:=\[\{(]"
ISO_DATE_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?\z"
TRACEBACK = "Traceback (most recent call last):"
ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL")
SEVERITY_NUMBERS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARNING": 13, "ERROR": 17, "CRITICAL": 21, "FATAL": 21}
SERVER_KINDS = (("gunicorn", "gunicorn"), ("granian", "granian"), ("kafka", "kafka"), ("mongo", "mongo"), ("chroot", "chroot"))


def blob_pattern(n: int) -> str:
    """A run of exactly n hex characters and the character after it; of two runs one character apart only the first is found,
    since none may begin where the match before ended (``\\G``). Look-behind keeps the scan from stopping at every character."""
    return rf"(?<![0-9a-fA-F])(?:^|(?!\G))([0-9a-fA-F]{{{n}}})([^0-9a-fA-F]|\z)"


def normalize_steps() -> list[tuple[str, list[tuple[str, str]]]]:
    """(text that must occur, or a pattern after ``~``; replacements) in order."""
    return [
        ("@", [(EMAIL, "<EMAIL>")]),
        ("://", [(URL, "<URL>")]),
        ("-", [(UUID, "<UUID>"), (ISO_TIME, "<TIMESTAMP>"), (OLD_TIME, "<TIMESTAMP>")]),
        (".", [(IPV4, "<IP>")]),
        (":", [(IPV6, "<IP>"), (PORT, "$1<PORT>$3")]),
        ("/", [(PATH, "<PATH>")]),
        ("0x", [(HEX, "<HEX>")]),
        ("~[0-9]", [(blob_pattern(n), f"{token}$2") for n, token in BLOBS] + [(NUMBER, "<NUM>"), (PREFIX_HEX, "$1<HEX>"), (LONG_ID, "<ID>")]),
    ]


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def _replaced(name: str, steps: list[tuple[str, str]]) -> Column:
    c = F.col(name)
    for pattern, token in steps:
        c = F.regexp_replace(c, pattern, token)
    return c


def with_normalized(df: DataFrame, text: str, out: str = "normalized_template") -> DataFrame:
    """Add the template of a text column: variable parts replaced by placeholders. Null stays null.

    One column per gate, so each gate tests what the step before gave and no
    expression is evaluated twice.  Write or checkpoint the result before
    filtering on it: a filter is pushed below the columns and repeats them.
    """
    df = df.withColumn(out, F.when(F.contains(F.col(text), F.lit("\x1b")), strip_ansi(F.col(text))).otherwise(F.col(text)))
    for gate, steps in normalize_steps():
        if gate[0] != "~":
            df = df.withColumn(out, F.when(F.col(out).contains(gate), _replaced(out, steps)).otherwise(F.col(out)))
            continue
        # the gate holds for the whole group as the text was before it; blobs and ids are runs of 16 letters and digits at least, which no step makes
        n = len(BLOBS)
        number, prefix, long_id = steps[n:]
        df = df.withColumn("_gate", F.col(out).rlike(gate[1:])).withColumn("_long", F.col("_gate") & F.col(out).rlike(SOME_BLOB))
        for when, some in ((F.col("_long"), steps[:n]), (F.col("_gate"), [number]), (F.col("_gate") & F.col(out).contains("_"), [prefix]), (F.col("_long"), [long_id])):
            df = df.withColumn(out, F.when(when, _replaced(out, some)).otherwise(F.col(out)))
        df = df.drop("_gate", "_long")
    return df.withColumn(out, _one_space(F.col(out)))


def _one_space(c: Column) -> Column:
    """Runs of blanks that are not one space already become one, then the ends are cut."""
    return F.trim(F.regexp_replace(c, r"[\t\n\x0B\f\r]\s*| \s+", " "))


def normalized(c: Column) -> Column:
    """The template of a text as one expression, for texts that few rows have: parts of it are evaluated more than once.

    Most gates only save time; those for addresses with ports and for digits decide what is replaced.
    """

    def apply(x: Column, steps: list[tuple[str, str]]) -> Column:
        for pattern, token in steps:
            x = F.regexp_replace(x, pattern, token)
        return x

    x = strip_ansi(c)
    for gate, steps in normalize_steps():
        if gate == ":":
            x = F.when(F.contains(x, F.lit(gate)), apply(x, steps)).otherwise(x)
        elif gate[0] == "~":
            x = F.when(x.rlike(gate[1:]), apply(x, steps)).otherwise(x)
        else:
            x = apply(x, steps)
    return _one_space(x)


def first_line(c: Column) -> Column:
    """The first line that is not blank, trimmed."""
    return F.regexp_replace(F.regexp_extract(c, r"[^\s][^\n]*", 0), r"\s+\z", "")


def cut_headline(normalized: Column) -> Column:
    """Headline before variable content, at most 200 characters."""
    head = F.when(normalized.rlike(r"[:=\[{(]"), F.split(normalized, HEADLINE_CUT, 2)[0]).otherwise(normalized)
    return F.rtrim(F.substring(head, 1, 200), F.lit(",: -"))


def exception_type(c: Column) -> Column:
    """The last exception class named in a text."""
    some = F.contains(c, F.lit("Error")) | F.contains(c, F.lit("Exception")) | F.contains(c, F.lit("Timeout")) | F.contains(c, F.lit("Failure"))
    return F.when(some, F.try_element_at(F.regexp_extract_all(c, F.lit(EXCEPTION), F.lit(1)), F.lit(-1)))


def error_kind(body: Column, severity: Column, exception: Column) -> Column:
    return F.when(exception.isNotNull(), exception).when(body.contains(TRACEBACK), "traceback").when(severity.isin(*ERROR_LEVELS), "log_error").otherwise("none")


def canonical_severity(c: Column) -> Column:
    """WARN is WARNING; unknown (also lower-case) names are INFO."""
    return F.when(c == "WARN", "WARNING").when(c.isin(*SEVERITY_NUMBERS), c).otherwise("INFO")


def severity_number(c: Column) -> Column:
    out = F.lit(9)
    for name, n in SEVERITY_NUMBERS.items():
        out = F.when(c == name, n).otherwise(out)
    return out.cast("long")


def server_kind(raw: Column, service: Column) -> Column:
    text = F.lower(F.concat_ws(" ", raw, service))
    out = None
    for needle, kind in SERVER_KINDS:
        out = F.when(text.contains(needle), kind) if out is None else out.when(text.contains(needle), kind)
    return out


def trim_sample(c: Column, n: int = 140) -> Column:
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n - 1), F.lit("…"))).otherwise(one)


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9._-]+", "-"), r"^-+|-+\z", ""))


def scenario(run_id: Column, pattern: str | None = None) -> Column:
    """Scenario of a run id: of an own pattern (its first group), of ``E2E_<name>``, ``bench`` of ``BENCH_``, else ``default``."""
    e2e = F.lower(F.regexp_extract(run_id, r"(?i)^E2E_([A-Za-z0-9]+)", 1))
    base = F.when(e2e != "", e2e).when(run_id.rlike(r"(?i)^BENCH[_\-]"), "bench").otherwise("default")
    if pattern:
        own = F.lower(F.regexp_extract(run_id, pattern, 1))
        base = F.when(own != "", own).otherwise(base)
    return base


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))


def shingles(c: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    t = word_tokens(c)
    pairs = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda w, i: F.concat(F.get(t, i), F.lit(" "), w))
    return F.array_distinct(F.concat(t, pairs))


def jaccard(a: Column, b: Column) -> Column:
    """1 of two empty sets, 0 of one empty one."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of ISO date-times (a comma before the fraction too), read as UTC where they have no zone; null for others."""
    return F.unix_micros(F.when(c.rlike(ISO_DATE_TIME), F.try_to_timestamp(F.regexp_replace(c, ",", ".")))) / F.lit(1_000_000.0)


def prettify_traceback(c: Column) -> Column:
    """A traceback on one line with its structure back: header, each ``File`` line and the code below it on lines of their own. Texts with line feeds stay."""
    t = F.regexp_replace(c, r"(Traceback \(most recent call last\):)\s*", "\n$1\n")
    t = F.regexp_replace(t, r"\s*(File \"[^\"]+\", line \S+?, in \S+)\s*", "\n  $1\n    ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n[ \t]*\n", "\n")
    return F.when(c.isNull(), "").when(c.contains("\n"), c).otherwise(F.regexp_replace(t, r"^\s+|\s+\z", ""))
