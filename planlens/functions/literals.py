"""Python literals and VARIANT, both ways, as Catalyst expressions.

``json_of_literal`` folds over a literal's tokens with a stack of open brackets and
writes JSON; ``literal`` is its VARIANT. ``python_repr`` writes JSON as Python would
print it: its tokens change one by one, and nesting needs no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE, _TWO = r"'(?:[^'\\\n]|\\[\s\S])*+'", r'"(?:[^"\\\n]|\\[\s\S])*+"'
_LONG = r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|" + r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""'
_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?"
#: Strings, numbers, names (and what runs on from a number), spaces, any other character.
_TOKENS = rf"[rRuU]?(?:{_LONG}|{_ONE}|{_TWO})|(?:{_NUMBER})[\w.]*|[^\W\d]\w*|\s+|[\s\S]"
_ESCAPES = r"\\(?:\r\n|[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[\s\S])|[^\\]+"


def _quoted(c: Column) -> Column:
    """A text between JSON's quotes, without them."""
    whole = F.to_json(F.array(c))
    return F.substr(whole, F.lit(3), F.length(whole) - 4)


def _let(value: Column, body) -> Column:
    """``body(value)``, where ``value`` is computed once."""
    return F.transform(F.array(value), body)[0]


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _character(code: Column) -> Column:
    """A code point as JSON escapes; null beyond the last one and for halves of pairs."""
    over = code - 0x10000
    pair = F.concat(_unit(0xD800 + F.shiftright(over, 10)), _unit(0xDC00 + over.bitwiseAND(0x3FF)))
    return F.when((code >= 0xD800) & (code < 0xE000), F.lit(None)).when(code < 0x10000, _unit(code)).when(code <= 0x10FFFF, pair)


def _escape(t: Column) -> Column:
    """JSON for one escape of a Python string, or for a run without any; null if Python refuses it."""
    simple = {"\\'": "'", '\\"': '\\"', "\\\\": "\\\\", "\\n": "\\n", "\\r": "\\r", "\\t": "\\t", "\\b": "\\b", "\\f": "\\f", "\\a": "\\u0007", "\\v": "\\u000b", "\\\n": "", "\\\r\n": ""}
    out = F.when(~t.startswith("\\"), _quoted(t))
    for python, text in simple.items():
        out = out.when(t == python, F.lit(text))
    number = lambda base, at: F.conv(F.substr(t, F.lit(at)), base, 10).cast("bigint")
    out = out.when(t.rlike(r"^\\[0-7]"), _character(number(8, 2))).when(t.rlike(r"^\\[xuU][0-9a-fA-F]{2}"), _character(number(16, 3)))
    return out.when(t.rlike(r"^\\[xuUN]") | (t == "\\"), F.lit(None)).otherwise(F.concat(F.lit("\\\\"), _quoted(F.substr(t, F.lit(2)))))


def _string(t: Column) -> Column:
    """JSON's text for a string token; null if it has an escape that Python refuses."""
    bare = F.regexp_replace(t, "^[rRuU]", "")
    wide = bare.startswith("'''") | bare.startswith('"""')
    body = F.when(wide, F.substr(bare, F.lit(4), F.length(bare) - 6)).otherwise(F.substr(bare, F.lit(2), F.length(bare) - 2))
    parts = F.transform(F.regexp_extract_all(body, F.lit(_ESCAPES), F.lit(0)), _escape)
    plain = F.when(F.lower(F.substr(t, F.lit(1), F.lit(1))) == "r", _quoted(body)).when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
    return F.concat(F.lit('"'), plain, F.lit('"'))


def _number(t: Column) -> Column:
    """JSON's text for a number token: floats with an exponent; null if it is none."""
    clean = F.lower(F.replace(t, F.lit("_"), F.lit("")))
    based = lambda digits, base: F.conv(digits, base, 10)  # noqa: E731 - up to 64 bits
    rest = F.substr(clean, F.lit(3))
    value = F.when(clean.startswith("0x") & (F.length(rest) <= 16), based(rest, 16)).when(clean.startswith("0b") & (F.length(rest) <= 64), based(rest, 2)).when(clean.startswith("0o") & (F.length(rest) <= 21), based(rest, 8))
    value = value.when(clean.rlike("^(?:[1-9][0-9]*|0+)$"), F.regexp_replace(clean, "^0+(?=.)", ""))
    mantissa, power = F.regexp_extract(clean, "^([0-9.]+)", 1), F.regexp_extract(clean, "e(.+)$", 1)
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_replace(mantissa, r"^\.", "0."), r"\.$", ""), "^0+(?=[0-9])", "")
    real = F.concat(mantissa, F.lit("e"), F.when(power == "", "0").otherwise(F.regexp_replace(power, r"^\+", "")))
    value = value.when(clean.rlike(r"^[0-9.]+(?:e[+-]?[0-9]+)?$") & clean.rlike("[.e]"), real)
    return F.when(t.rlike(rf"^(?:{_NUMBER})$"), value)


_FRAME = "struct<kind:string,comma:boolean,key:string,keys:array<string>,vals:array<string>>"


def json_of_literal(c: Column) -> Column:
    """JSON for the text of a Python literal, or null.

    Strings (raw, triple-quoted, adjacent ones joined, with all escapes but names),
    numbers with a sign, True, False, None, lists, tuples and dicts, nested at will.
    Tuples become lists; dict keys of other kinds become text as ``json.dumps`` writes
    them, and of equal keys the last value stays at the first one's place. Null: what
    ``ast.literal_eval`` refuses, and bytes, sets, complex numbers, comments, halves of
    surrogate pairs and containers as keys, which JSON lacks; whole numbers in bases 2, 8 and 16 beyond 64 bits.
    """
    none = F.lit(None).cast("string")

    def frame(kind: Column) -> Column:
        return F.struct(kind.alias("kind"), F.lit(False).alias("comma"), none.alias("key"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("vals")).cast(_FRAME)

    def state(stack: Column, value: Column, kind: Column, sign: Column, ok: Column) -> Column:
        return F.struct(stack.cast(f"array<{_FRAME}>").alias("s"), value.cast("string").alias("v"), kind.cast("string").alias("t"), sign.cast("string").alias("g"), ok.cast("boolean").alias("ok"))

    def put(f: Column, value: Column, comma: Column) -> Column:
        """A frame with one more value, under its key if it is a dict."""
        at = F.array_position(f["keys"], f["key"])
        known = f["key"].isNotNull() & (at > 0)
        vals = F.when(known, F.transform(f["vals"], lambda x, i: F.when(i == at - 1, value).otherwise(x))).otherwise(F.array_append(f["vals"], value))
        keys = F.when(f["key"].isNull() | known, f["keys"]).otherwise(F.array_append(f["keys"], f["key"]))
        return F.struct(f["kind"].alias("kind"), comma.alias("comma"), none.alias("key"), keys.alias("keys"), vals.alias("vals"))

    def closed(f: Column, one: Column) -> Column:
        """(v, t): what a finished frame is; ``one`` is the kind of a single value."""
        items = F.array_join(f["vals"], ",")
        pairs = F.array_join(F.zip_with(f["keys"], f["vals"], lambda k, v: F.concat(k, F.lit(":"), v)), ",")
        single = (f["kind"] == "(") & ~f["comma"] & (F.size(f["vals"]) == 1)
        text = F.when(single, f["vals"][0]).when(f["kind"] == "{", F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(F.concat(F.lit("["), items, F.lit("]")))
        return F.struct(text.alias("v"), F.when(single, one).otherwise("c").alias("t"))

    bad = state(F.array(), none, none, none, F.lit(False))
    signed = lambda s, v: F.when(s["g"] == "-", F.concat(F.lit("-"), v)).otherwise(v)

    def step(s: Column, t: Column) -> Column:
        top = F.element_at(s["s"], -1)
        under = F.slice(s["s"], 1, F.size(s["s"]) - 1)
        free, unsigned = s["v"].isNull(), s["g"].isNull()
        value = lambda v, kind: _let(v, lambda x: F.when(x.isNull(), bad).otherwise(state(s["s"], x, F.lit(kind), none, F.lit(True))))
        push = state(F.array_append(s["s"], frame(t)), none, none, none, F.lit(True))
        is_dict, has_key = top["kind"] == "{", top["key"].isNotNull()
        fits = ~free & (~is_dict | has_key)
        comma = _let(put(top, s["v"], F.lit(True)), lambda f: state(F.array_append(under, f), none, none, none, F.lit(True)))
        plain = F.when(s["v"].contains("e") & (s["t"] == "n"), _python_float(s["v"])).otherwise(s["v"])
        text = F.when(s["t"] == "s", s["v"]).otherwise(F.concat(F.lit('"'), plain, F.lit('"')))
        keyed = F.struct(top["kind"].alias("kind"), top["comma"].alias("comma"), text.alias("key"), top["keys"].alias("keys"), top["vals"].alias("vals"))
        colon = state(F.array_append(under, keyed), none, none, none, F.lit(True))
        pair = F.when(t == ")", "(").when(t == "]", "[").otherwise("{")
        may_end = unsigned & (F.size(s["s"]) > 1) & (top["kind"] == pair) & (fits | (free & ~has_key))
        ended = _let(F.when(free, top).otherwise(put(top, s["v"], top["comma"])), lambda f: _let(closed(f, s["t"]), lambda r: state(under, r["v"], r["t"], none, F.lit(True))))
        is_string = t.rlike("^[rRuU]?['\"]")
        joined = _let(_string(t), lambda x: F.when(x.isNull(), bad).otherwise(state(s["s"], F.concat(F.substr(s["v"], F.lit(1), F.length(s["v"]) - 1), F.substr(x, F.lit(2))), F.lit("s"), none, F.lit(True))))
        return (
            F.when(~s["ok"], s)
            .when(t.rlike(r"^\s"), s)
            .when(is_string & (F.length(t) > 1), F.when(free & unsigned, value(_string(t), "s")).when(s["t"] == "s", joined).otherwise(bad))
            .when(t.rlike(r"^[0-9]|^\.[0-9]"), F.when(free, value(signed(s, _number(t)), "n")).otherwise(bad))
            .when(t.isin("True", "False", "None"), F.when(free & unsigned, value(F.when(t == "None", "null").otherwise(F.lower(t)), "w")).otherwise(bad))
            .when(t.isin("+", "-"), F.when(free & unsigned, state(s["s"], none, none, t, F.lit(True))).otherwise(bad))
            .when(t.isin("(", "[", "{"), F.when(free & unsigned, push).otherwise(bad))
            .when(t == ",", F.when(fits & unsigned, comma).otherwise(bad))
            .when(t == ":", F.when(~free & is_dict & ~has_key & (s["t"] != "c"), colon).otherwise(bad))
            .when(t.isin(")", "]", "}"), F.when(may_end, ended).otherwise(bad))
            .otherwise(bad)
        )

    # the whole text stands in a bracket of its own, so that "1, 2" is a tuple
    start = state(F.array(frame(F.lit("("))), none, none, none, F.lit(True))
    end = F.aggregate(F.regexp_extract_all(F.regexp_replace(c, r"^[ \t]+", ""), F.lit(_TOKENS), F.lit(0)), start, step)

    def whole(s: Column) -> Column:
        last = F.element_at(s["s"], 1)
        some = s["v"].isNotNull() | (F.size(last["vals"]) > 0)
        return F.when(s["ok"] & s["g"].isNull() & (F.size(s["s"]) == 1) & some, closed(F.when(s["v"].isNull(), last).otherwise(put(last, s["v"], last["comma"])), F.lit("c"))["v"])

    return _let(end, whole)


def literal(c: Column) -> Column:
    """The VARIANT of a Python literal, or null: see ``json_of_literal``. Objects keep
    their keys by name; whole numbers of over 38 digits become doubles."""
    return F.try_parse_json(json_of_literal(c))


def literal_or_text(c: Column) -> Column:
    """The VARIANT of a literal; of other texts the text, without quotes that enclose it."""
    plain = F.when(F.trim(c).rlike(r"""^(?:'[\s\S]*'|"[\s\S]*")$"""), F.regexp_replace(F.trim(c), r"""^.|.$""", "")).otherwise(F.trim(c))
    return F.when(c.isNotNull(), F.coalesce(literal(c), F.try_parse_json(F.concat(F.lit('"'), _quoted(plain), F.lit('"')))))


def _python_string(c: Column) -> Column:
    """``repr`` of a text."""
    double = c.contains("'") & ~c.contains('"')
    quote = F.when(double, '"').otherwise("'")

    def part(p: Column) -> Column:
        code = lambda p: F.conv(F.hex(F.encode(p, "UTF-32")), 16, 10).cast("bigint")
        wide = lambda n, size, mark: F.concat(F.lit(mark), F.lpad(F.lower(F.hex(n)), size, "0"))
        hexed = _let(code(p), lambda n: F.when(n < 0x100, wide(n, 2, "\\x")).when(n < 0x10000, wide(n, 4, "\\u")).otherwise(wide(n, 8, "\\U")))
        return F.when(p == "\\", F.lit("\\\\")).when(p == "'", F.when(double, "'").otherwise("\\'")).when(p == "\n", "\\n").when(p == "\r", "\\r").when(p == "\t", "\\t").when(p.rlike(r"^[\p{C}\p{Z}&&[^ ]]"), hexed).otherwise(p)

    parts = F.regexp_extract_all(c, F.lit(r"[\p{C}\p{Z}&&[^ ]]|[\\']|[^\p{C}\p{Z}\\']+| +"), F.lit(0))
    as_it_is = (double | ~c.contains("'")) & ~c.rlike(r"[\p{C}\p{Z}&&[^ ]]|\\")
    return F.concat(quote, F.when(as_it_is, c).otherwise(F.array_join(F.transform(parts, part), "")), quote)


def _python_float(t: Column) -> Column:
    """``repr`` of a double given as text: its shortest digits, with an exponent below 1e-4 and from 1e16."""
    x = t.cast("double")
    tried = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda p: F.call_function("format_string", F.concat(F.lit("%."), p.cast("string"), F.lit("e")), F.abs(x)))
    shortest = F.coalesce(F.get(F.filter(tried, lambda s: s.cast("double") == F.abs(x)), 0), F.element_at(tried, -1))

    def written(s: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(s, r"^([0-9.]+)e", 1), r"\.", "")
        digits = F.regexp_replace(digits, r"(?<=.)0+$", "")
        power = F.regexp_extract(s, r"e([+-]\d+)$", 1).cast("int")
        size = F.length(digits)
        plain = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).when(size <= power + 1, F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)))
        head = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""))
        long_ = F.concat(head, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        return F.concat(F.when(t.startswith("-"), "-").otherwise(""), F.when(x == 0, "0.0").when((power < -4) | (power >= 16), long_).otherwise(plain))

    # no two decimals of up to 15 digits are one double, so that theirs are the shortest; 19 places hold them from 1e-4 on
    few = (F.length(F.substring_index(F.lower(t), "e", 1)) <= 15) & (F.abs(x) >= 1e-4) & (F.abs(x) < 1e15)
    exact = F.regexp_replace(F.regexp_replace(t.try_cast("decimal(38,19)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(few, exact).otherwise(_let(shortest, written))


_JSON = r'"(?:[^"\\]|\\.)*+"|[\[\]{},:]|[^"\[\]{},:\s]+'


def python_repr(c: Column) -> Column:
    """A JSON text (or VARIANT, by ``to_json``) as Python prints the value: null and
    words as None, True and False, texts in Python's quotes, numbers with a point or an
    exponent as floats. The order of keys is the text's. Null for null."""

    def token(t: Column) -> Column:
        plain = F.substr(t, F.lit(2), F.length(t) - 2)
        text = F.when(t.rlike(r"[\\\x00-\x1f]"), F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0]).otherwise(plain)
        return (
            F.when(t.startswith('"'), _let(text, _python_string))
            .when(t == ",", ", ").when(t == ":", ": ").when(t == "true", "True").when(t == "false", "False").when(t == "null", "None")
            .when(t.rlike("^-?[0-9]+[.eE]"), _python_float(t))
            .otherwise(t)
        )

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_JSON), F.lit(0)), token), "")
