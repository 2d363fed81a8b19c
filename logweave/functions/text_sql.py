"""The text functions in SQL, for checking results against another engine."""

from __future__ import annotations

from logweave.functions import text as T


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace(x: str, pattern: str, token: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(token.replace('$1', chr(92) + '1').replace('$3', chr(92) + '3'))}, 'g')"


_RUNS = r"regexp_extract_all(t, '[A-Za-z0-9_.]+|[^A-Za-z0-9_.]+')"
#: Numbers and masks need look-around, which the other engine lacks: its text is cut into runs of word characters instead.
NUMBERS = rf"""array_to_string(list_transform({_RUNS}, lambda x, i:
  case when regexp_full_match(x, '\d+(\.\d+)?') then '<NUM>'
       when x[-1:] = '-' and (i = 1 or length(x) >= 2) and regexp_full_match(coalesce({_RUNS}[i + 1], ''), '\d+(\.\d+)?') then x[:-2]
       else x end), '')"""
MASKS = r"""array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z0-9_-]+|[^A-Za-z0-9_-]+'), lambda x:
  case when regexp_full_match(x, '[A-Za-z]{2,15}_[0-9a-fA-F]{6,40}') then regexp_extract(x, '^[A-Za-z]+_') || '<HEX>'
       when regexp_full_match(x, '[A-Za-z0-9]{16,}') and regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[0-9]') then '<ID>'
       else x end), '')"""


def normalized(source: str, text: str, keep: str) -> str:
    """A query giving columns ``keep`` and ``t``, the template of column ``text`` of ``source``."""
    step = f"select {keep}, {_replace(text, T.ANSI, '')} t from {source}"
    for gate, steps in T.normalize_steps():
        hit = f"regexp_matches(t, '{gate[1:]}')" if gate[0] == "~" else f"contains(t, {quoted(gate)})"
        if gate[0] != "~":
            x = "t"
            for p, token in steps:
                x = _replace(x, p, token)
            step = f"select {keep}, case when {hit} then {x} else t end t from ({step})"
            continue
        x = "t"
        for n, token in T.BLOBS:  # without look-around the character before is part of the match
            x = _replace(x, rf"(^|[^0-9a-fA-F])([0-9a-fA-F]{{{n}}})(\z|[^0-9a-fA-F])", f"$1{token}$3")
        step = f"select {keep}, {hit} digits, case when {hit} then {x} else t end t from ({step})"
        step = f"select {keep}, digits, case when digits then {NUMBERS} else t end t from ({step})"
        step = f"select {keep}, case when digits then {MASKS} else t end t from ({step})"
    return f"select {keep}, regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') t from ({step})"


def first_line(x: str) -> str:
    return rf"regexp_replace(regexp_extract({x}, '[^\s][^\n]*'), '\s+$', '')"


def cut_headline(x: str) -> str:
    head = f"regexp_split_to_array({x}, {quoted(T.HEADLINE_CUT)})[1]"
    return f"regexp_replace(substring({head}, 1, 200), '[,: -]+$', '')"


def exception_type(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted(T.EXCEPTION)}, 1)[-1]"


def error_kind(body: str, severity: str, exception: str) -> str:
    return f"case when {exception} is not null then {exception} when contains({body}, {quoted(T.TRACEBACK)}) then 'traceback' when {severity} in ('ERROR','CRITICAL','FATAL') then 'log_error' else 'none' end"


def scenario(x: str) -> str:
    e = f"lower(regexp_extract({x}, '(?i)^E2E_([A-Za-z0-9]+)', 1))"
    return f"case when {e} <> '' then {e} when regexp_matches({x}, '(?i)^BENCH[_-]') then 'bench' else 'default' end"


def shingles(x: str) -> str:
    t = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_]+')"
    return f"list_distinct(list_concat({t}, list_transform({t}[2:], lambda w, i: {t}[i] || ' ' || w)))"


def epoch_seconds(x: str) -> str:
    """Exact only for texts that both engines read alike: full ISO date-times."""
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?$"
    return f"case when regexp_matches({x}, '{iso}') then epoch_us(try_cast(replace({x}, ',', '.') as timestamptz)) / 1000000.0 end"
