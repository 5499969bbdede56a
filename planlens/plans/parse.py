"""Plan text to steps, in three dialects, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import PLAN

_EMPTY = f"cast(array() as {PLAN})"


#: SQL: runs of characters that mean nothing to the splitter, or one that may.
_TOKENS = r"""'[^\'"(),\\[\\]{}]+|[\\s\\S]'"""


#: SQL: argument lists whose commas outside of quotes all separate, and the pieces
#: of one. Longer lists are folded, as Java matches groups by recursion.
_FLAT, _PIECE, _FLAT_LENGTH = (
    r"""'^(?:[^\'"(){}\\[\\]]++|\'[^\']*+\'|"[^"]*+"|\\{\\{\\d++\\}\\})*+$'""",
    r"""'(?:[^,\'"(){}\\[\\]]++|\'[^\']*+\'|"[^"]*+"|\\{\\{\\d++\\}\\})++'""",
    2000,
)


def split_args(args: str, robust: bool = False) -> str:
    """SQL: the pieces of an argument list, cut at commas outside of quotes and
    brackets. ``robust`` keeps the depth from going below zero. Lists without
    brackets other than references are cut by one pattern, others by a fold;
    the pattern leaves out empty pieces, which hold no parameter."""
    close = "greatest(s.d - 1, 0)" if robust else "s.d - 1"
    fold = f"""aggregate(regexp_extract_all(args, {_TOKENS}, 0),
      named_struct('d', 0, 'q', '', 'cur', '', 'out', cast(array() as array<string>)),
      (s, c) -> case
        when s.q <> '' then named_struct('d', s.d, 'q', if(c = s.q, '', s.q), 'cur', concat(s.cur, c), 'out', s.out)
        when c in ('"', '\\'') then named_struct('d', s.d, 'q', c, 'cur', concat(s.cur, c), 'out', s.out)
        when c in ('(', '[', '{{') then named_struct('d', s.d + 1, 'q', '', 'cur', concat(s.cur, c), 'out', s.out)
        when c in (')', ']', '}}') then named_struct('d', {close}, 'q', '', 'cur', concat(s.cur, c), 'out', s.out)
        when c = ',' and s.d = 0 then named_struct('d', 0, 'q', '', 'cur', '', 'out', concat(s.out, array(s.cur)))
        else named_struct('d', s.d, 'q', '', 'cur', concat(s.cur, c), 'out', s.out) end,
      s -> concat(s.out, array(s.cur)))"""
    return f"transform(array({args}), args -> if(length(args) < {_FLAT_LENGTH} and args rlike {_FLAT}, regexp_extract_all(args, {_PIECE}, 0), {fold}))[0]"


def params(args: str, robust: bool = False) -> str:
    """SQL: array of ``(k, v)`` in order of first use; the last value of a key wins."""
    value = "btrim(substr(p, instr(p, '=') + 1))"
    if robust:
        value = rf"""regexp_replace(regexp_replace({value}, '(?<!\\{{)\\{{(\\s*\\d+\\s*)\\}}(?!\\}})', '{{{{$1}}}}'), '^(?i)(?:var|result|output|out|r|x|step|s)_?(\\d+)$', '{{{{$1}}}}')"""
    pairs = f"transform(filter({split_args(args, robust)}, p -> instr(p, '=') > 0), p -> named_struct('k', btrim(substr(p, 1, instr(p, '=') - 1)), 'v', {value}))"
    return f"""transform(array({pairs}), a -> if(size(array_distinct(a.k)) = size(a), a, transform(array_distinct(a.k),
      k -> named_struct('k', k, 'v', element_at(filter(a, p -> p.k = k), -1).v))))[0]"""


def _number(steps: str) -> str:
    return f"transform({steps}, (s, i) -> named_struct('pos', i, 'step_id', s.step_id, 'tool_name', s.tool_name, 'params', s.params, 'output_variable', s.output_variable))"


#: SQL: a call after an equals sign, to its last bracket at the line's end.
_AFTER = r"'=\\s*[^(]+\\(.*\\)(?=\\s*$)'"


def _called(c: str) -> tuple[str, str]:
    """SQL: (tool, arguments) of what ``_AFTER`` matches: up to its first bracket, and from there to its last."""
    at = f"instr({c}, '(')"
    return f"btrim(substr({c}, 2, {at} - 2), ' \t')", f"substr({c}, {at} + 1, length({c}) - {at} - 1)"


def _strict(text: str) -> str:
    # what ends a line is left to the patterns: trimming it takes as long as one of them
    lines = rf"filter(transform(split({text}, '\n'), l -> if(startswith(l, 'Step '), l, ltrim(' \t\r\n', l))), l -> startswith(l, 'Step '))"
    # each pattern runs once a line
    found = rf"transform({lines}, l -> named_struct('n', regexp_extract(l, '^Step (\\d+):', 1), 'o', regexp_extract(l, '(\\{{\\{{\\d+\\}}\\}})\\s*=', 1), 'c', regexp_extract(l, {_AFTER}, 0)))"
    tool, args = _called("x.c")
    step = f"named_struct('pos', i, 'step_id', cast(x.n as int), 'tool_name', {tool}, 'params', {params(args)}, 'output_variable', x.o)"
    return f"transform(filter({found}, x -> x.n <> '' and x.o <> '' and x.c <> ''), (x, i) -> {step})"


def _lenient(text: str) -> str:
    form = r"'^Step\\s+(\\d+)\\s*:\\s*(?:\\{\\{\\d+\\}\\}\\s*=\\s*)?([A-Za-z_]\\w*)\\s*\\((.*)\\)\\s*$'"
    lines = rf"filter(transform(split({text}, '\n'), l -> btrim(l, ' \t\r\n')), l -> l rlike {form})"
    n = f"cast(regexp_extract(l, {form}, 1) as int)"
    step = f"named_struct('step_id', {n}, 'tool_name', regexp_extract(l, {form}, 2), 'params', {params(f'regexp_extract(l, {form}, 3)')}, 'output_variable', concat('{{{{', {n}, '}}}}'))"
    return _number(f"transform({lines}, l -> {step})")


#: A step header of the robust dialect: noise, a keyword, a number, punctuation, the rest.
HEADER = r"'^(?i)[\\s>*#`•·-]*(?:Step|Action|Call|Operation|Plan|Stage)\\s+(\\d+)\\s*[:.)—–>-]\\s*`?(?:\\*+)?\\s*(.*)$'"
_ASSIGN = r"'^(?i)(?:\\{\\{\\s*\\d+\\s*\\}\\}|\\{\\s*\\d+\\s*\\}|(?:var|result|output|out|r|x|step|s)_?\\d+)\\s*=\\s*(.+)$'"
_VAR = r"'^\\D*(\\d+)[^=]*='"
_CALL = r"'^([^(]+)\\((.*?)\\)?\\s*$'"


def _mixed(text: str) -> str:
    """Strict, but a line without an assignment gets its step's variable."""
    named = rf"l rlike '\\{{\\{{\\d+\\}}\\}}\\s*='"
    bare = r"'^Step \\d+:\\s*([a-zA-Z_]\\w*)\\((.*)\\)\\s*$'"
    call = r"'=\\s*([^(]+)\\((.*)\\)\\s*$'"
    lines = rf"filter(transform(split({text}, '\n'), l -> btrim(l, ' \t\r\n')), l -> l rlike '^Step (\\d+):' and if({named}, l rlike '=\\s*[^(]+\\(.*\\)\\s*$', l rlike {bare}))"
    part = lambda i: f"if({named}, regexp_extract(l, {call}, {i}), regexp_extract(l, {bare}, {i}))"
    n = r"cast(regexp_extract(l, '^Step (\\d+):', 1) as int)"
    variable = rf"if({named}, regexp_extract(l, '(\\{{\\{{\\d+\\}}\\}})\\s*=', 1), concat('{{{{', {n}, '}}}}'))"
    step = f"named_struct('step_id', {n}, 'tool_name', btrim({part(1)}), 'params', {params(part(2))}, 'output_variable', {variable})"
    return _number(f"transform({lines}, l -> {step})")


def _robust(text: str) -> str:
    clean = rf"if(contains({text}, '```'), replace(regexp_replace({text}, '```[a-zA-Z0-9_+-]*\n?', ''), '```', ''), {text})"
    # no group that is asked for first can be empty, so that an empty one is no match and each pattern runs once a group
    rows = rf"filter(transform(split({clean}, '\n'), l -> named_struct('l', btrim(l), 'n', regexp_extract(btrim(l), {HEADER}, 1))), r -> r.n <> '')"
    rows = rf"transform({rows}, r -> named_struct('n', cast(r.n as int), 'body', regexp_replace(regexp_extract(r.l, {HEADER}, 2), '[`*;.\\s]+$', '')))"
    rows = rf"transform({rows}, r -> named_struct('n', r.n, 'body', r.body, 'said', regexp_extract(r.body, {_ASSIGN}, 1)))"
    rows = rf"transform({rows}, r -> named_struct('n', r.n, 'id', if(r.said <> '', cast(regexp_extract(r.body, {_VAR}, 1) as int), r.n), 'call', if(r.said <> '', r.said, r.body)))"
    rows = rf"filter(transform({rows}, r -> named_struct('n', r.n, 'id', r.id, 'call', r.call, 'tool', regexp_extract(r.call, {_CALL}, 1))), r -> r.tool <> '')"
    step = f"named_struct('pos', i, 'step_id', r.n, 'tool_name', btrim(r.tool), 'params', {params(f"trim(trailing ')' from regexp_extract(r.call, {_CALL}, 2))", True)}, 'output_variable', concat('{{{{', r.id, '}}}}'))"
    return f"transform({rows}, (r, i) -> {step})"


def parse_plan(column: str, dialect: str = "strict") -> Column:
    """Steps of the plan text in ``column``; null text and text without steps
    give an empty array. Lines that do not parse are skipped.

    strict: ``Step N: {{N}} = tool(k=v, ...)``. lenient: the assignment may be
    missing; used where strict finds nothing. mixed: the assignment may be missing
    in any line. robust: also fences, bullets, other
    keywords, ``{N}`` and ``var0`` variables, unclosed calls."""
    text = f"coalesce({column}, '')"
    if dialect == "strict":
        return F.coalesce(F.expr(_strict(text)), F.expr(_EMPTY))
    if dialect == "lenient":
        return F.expr(f"transform(array({_strict(text)}), strict -> if(size(strict) > 0, strict, {_lenient(text)}))[0]")
    if dialect == "mixed":
        return F.expr(_mixed(text))
    if dialect == "robust":
        return F.expr(_robust(text))
    raise ValueError(f"no dialect {dialect}")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` plus column ``name``, computed once a row. The optimizer copies a
    projected expression to where it is used, and a parse used in a nested loop
    would run there over and over; a generator's output is not copied."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def diagnostics(column: str) -> Column:
    """Counters of a text: headers seen, strict lines, missing assignments,
    other variable forms, unclosed calls, fences."""
    text = f"coalesce({column}, '')"
    head = f"btrim(l) rlike {HEADER}"
    body = f"regexp_extract(btrim(l), {HEADER}, 2)"
    counts = {
        "headers": head,
        "strict_lines": r"btrim(l) rlike '^Step \\d+:\\s*\\{\\{\\d+\\}\\}\\s*=\\s*[^(]+\\(.*\\)\\s*$'",
        "missing_assign": f"{head} and not {body} rlike {_ASSIGN}",
        "alt_var": rf"{head} and {body} rlike {_ASSIGN} and not {body} rlike '^\\{{\\{{\\d+\\}}\\}}'",
        "unclosed": rf"{head} and {body} rlike '\\(' and not {body} rlike '\\)[`*;.\\s]*$'",
        "fences": "l rlike '```'",
    }
    return F.expr("named_struct(" + ", ".join(rf"'{k}', size(filter(split({text}, '\n'), l -> {v}))" for k, v in counts.items()) + ")")


def count_steps(column: str) -> Column:
    """Lines with ``Step N:`` and an equals sign."""
    return F.expr(rf"size(filter(split(coalesce({column}, ''), '\n'), l -> l rlike 'Step \\d+:' and instr(l, '=') > 0))")


def format_plan(steps: str) -> Column:
    """Canonical text of steps: the inverse of the strict parser."""
    args = "array_join(transform(s.params, p -> concat(p.k, '=', p.v)), ', ')"
    return F.expr(rf"array_join(transform({steps}, s -> concat('Step ', s.step_id, ': ', s.output_variable, ' = ', s.tool_name, '(', {args}, ')')), '\n')")
