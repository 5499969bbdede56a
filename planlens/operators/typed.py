"""Plans of numbers in Catalyst: a fold over steps with the outputs so far.

A value is a whole number (64 bits) or a double, as in Python: whole numbers stay whole
under sums, differences and products, and divisions make doubles. What needs more, such as
texts, lists, wider numbers, other parameter names or functions whose last digit differs
between libraries, is left to the interpreter that knows all of Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlens.functions.literals import python_repr

_ARG = "struct<k:string,i:bigint,d:double,lost:boolean,odd:boolean>"
_VALUE = "struct<slot:int,i:bigint,d:double>"
_STATE = f"struct<status:string,step:int,left:boolean,vals:array<{_VALUE}>>"
#: Whole numbers beyond this are no exact doubles.
_EXACT = 1 << 53


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _real(x: Column) -> Column:
    """A value as a double; null if it is no exact one."""
    return F.coalesce(x["d"], F.when(F.abs(x["i"]) <= _EXACT, x["i"].cast("double")))


def _result(i: Column | None = None, d: Column | None = None, error: Column | None = None) -> Column:
    return F.struct(F.lit(None).cast("bigint").alias("i") if i is None else i.cast("bigint").alias("i"), F.lit(None).cast("double").alias("d") if d is None else d.cast("double").alias("d"), (F.lit(False) if error is None else F.coalesce(error, F.lit(False))).alias("error"))


def _same(whole: Callable[..., Column], real: Callable[..., Column]) -> Callable[..., Column]:
    """Whole if all arguments are; null where 64 bits do not hold it."""

    def call(*xs: Column) -> Column:
        all_whole = _all(*(x["i"].isNotNull() for x in xs))
        return F.when(all_whole, _result(i=whole(*(x["i"] for x in xs)))).otherwise(_result(d=real(*map(_real, xs))))

    return call


def _all(*cs: Column) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def _float(real: Callable[..., Column], zero: int | None = None) -> Callable[..., Column]:
    """A double; an error if the argument at ``zero`` is 0."""
    return lambda *xs: F.when(_real(xs[zero]) == 0, _result(error=F.lit(True))).otherwise(_result(d=real(*map(_real, xs)))) if zero is not None else _result(d=real(*map(_real, xs)))


def _modulo(x: Column, y: Column) -> Column:
    whole = x["i"].isNotNull() & y["i"].isNotNull()
    rest = F.when(y["i"] != 0, x["i"] % y["i"])
    return F.when(whole & (y["i"] == 0), _result(error=F.lit(True))).when(whole, _result(i=F.when((rest != 0) & ((rest < 0) != (y["i"] < 0)), rest + y["i"]).otherwise(rest))).otherwise(_result())


_add, _sub, _mul = F.try_add, F.try_subtract, F.try_multiply
_PI = math.pi
_product = _same(_mul, lambda a, b: a * b)
#: Parameter names and meaning of what is done here.
TOOLS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "add": (("arg_0", "arg_1"), _same(_add, lambda a, b: a + b)),
    "subtract": (("arg_0", "arg_1"), _same(_sub, lambda a, b: a - b)),
    "multiply": (("arg_0", "arg_1"), _product),
    "divide": (("arg_0", "arg_1"), _float(lambda a, b: F.try_divide(a, b), 1)),
    "speed": (("distance", "time"), _float(lambda a, b: F.try_divide(a, b), 1)),
    "remainder": (("a", "b"), _modulo),
    "reminder": (("a", "b"), _modulo),
    "negate": (("number",), _same(lambda a: _sub(F.lit(0).cast("bigint"), a), lambda a: -a)),
    "inverse": (("number",), _float(lambda a: F.try_divide(F.lit(1.0), a), 0)),
    "negate_prob": (("prob",), _same(lambda a: _sub(F.lit(1).cast("bigint"), a), lambda a: 1 - a)),
    "floor": (("x",), lambda x: F.when(x["i"].isNotNull(), _result(i=x["i"])).otherwise(_result(i=F.when(F.abs(x["d"]) < _EXACT, F.floor(x["d"]))))),
    "rectangle_area": (("length", "width"), _product),
    "rectangle_perimeter": (("length", "width"), _same(lambda a, b: _mul(F.lit(2).cast("bigint"), _add(a, b)), lambda a, b: 2 * (a + b))),
    "square_area": (("side",), _same(lambda a: _mul(a, a), lambda a: a * a)),
    "square_perimeter": (("side_length",), _same(lambda a: _mul(F.lit(4).cast("bigint"), a), lambda a: 4 * a)),
    "square_edge_by_perimeter": (("perimeter",), _float(lambda a: a / 4)),
    "square_edge_by_area": (("area",), lambda x: F.when(_real(x) < 0, _result(error=F.lit(True))).otherwise(_result(d=F.sqrt(_real(x))))),
    "surface_cube": (("side_length",), _same(lambda a: _mul(_mul(F.lit(6).cast("bigint"), a), a), lambda a: 6 * a * a)),
    "triangle_area": (("base", "height"), _float(lambda a, b: 0.5 * a * b)),
    "rhombus_area": (("diagonal1", "diagonal2"), _float(lambda a, b: 0.5 * a * b)),
    "circle_area": (("radius",), _float(lambda r: _PI * r * r)),
    "circumface": (("radius",), _float(lambda r: 2 * _PI * r)),
    "surface_sphere": (("radius",), _float(lambda r: 4 * _PI * r * r)),
    "volume_cylinder": (("radius", "height"), _float(lambda r, h: _PI * r * r * h)),
    "volume_cone": (("radius", "height"), _float(lambda r, h: _PI * r * r * h / 3)),
}


def _named(args: Column, name: str) -> Column:
    return F.filter(args, lambda a: a["k"] == name)[0]


def _argument(p: Column, vals: Column) -> Column:
    """A parameter's value: a numeral, or an output; ``lost`` if there is none yet, ``odd`` if it is neither."""
    text = F.trim(p["v"])
    slot = F.regexp_extract(text, r"^\{\{(\d{1,9})\}\}$", 1)
    is_ref, is_whole, is_real = slot != "", text.rlike(r"^-?(?:0|[1-9][0-9]{0,17})$"), text.rlike(r"^-?[0-9]+\.[0-9]+$")
    none = F.lit(None)
    row = lambda i, d, lost, odd: F.struct(p["k"].alias("k"), i.alias("i"), d.alias("d"), lost.alias("lost"), odd.alias("odd")).cast(_ARG)
    no = F.lit(False)
    found = _let(F.get(F.filter(vals, lambda v: v["slot"] == slot.try_cast("int")), 0), lambda v: row(v["i"], v["d"], v["slot"].isNull(), no))
    return F.when(is_ref, found).when(is_whole, row(text.try_cast("bigint"), none, no, no)).when(is_real, row(none, text.try_cast("double"), no, no)).otherwise(row(none, none, no, F.lit(True)))


def run(steps: Column, known: list[str], most: int) -> Column:
    """``(left, exec_status, exec_output, exec_failed_step)`` of a plan; ``left``: it is
    not for this fold. ``known`` are all tools that exist."""
    none = F.lit(None)
    state = lambda status, step, left, vals: F.struct(status.cast("string").alias("status"), step.cast("int").alias("step"), left.cast("boolean").alias("left"), vals.alias("vals")).cast(_STATE)
    no, yes = F.lit(False), F.lit(True)

    def outcome(tool: Column, args: Column) -> Column:
        """The result of a call; null if it is left."""
        out = F.when(F.lit(False), _result())
        for name, (params, fn) in TOOLS.items():
            fits = (tool == name) & (F.size(args) == len(params)) & _all(*(F.array_contains(args["k"], k) for k in params))
            out = out.when(fits, fn(*(_named(args, k) for k in params)))
        return out

    def step(s: Column, x: Column) -> Column:
        tool = F.trim(x["tool_name"])
        ended = lambda status: state(F.lit(status), x["step_id"], no, s["vals"])
        left = state(none, none, yes, s["vals"])
        slot = F.coalesce(F.regexp_extract(F.trim(F.coalesce(x["output_variable"], F.lit(""))), r"^\{\{(\d{1,9})\}\}$", 1).try_cast("int"), x["step_id"])

        def call(args: Column) -> Column:
            def settle(r: Column) -> Column:
                value = F.struct(slot.alias("slot"), r["i"].alias("i"), r["d"].alias("d")).cast(_VALUE)
                bad = r.isNull() | (r["i"].isNull() & (r["d"].isNull() | F.isnan(r["d"])))
                return F.when(F.coalesce(r["error"], no), ended("call_error")).when(bad, left).otherwise(state(none, none, no, F.concat(F.array(value), s["vals"])))

            first = F.exists(args, lambda a: a["lost"])
            return F.when(F.exists(args, lambda a: a["odd"]), left).when(first, ended("unresolved_ref")).otherwise(_let(outcome(tool, args), settle))

        live = _let(F.transform(x["params"], lambda p: _argument(p, s["vals"])), call)
        return F.when(s["left"] | s["status"].isNotNull(), s).when(~tool.isin(known), ended("unknown_tool")).otherwise(live)

    start = state(none, none, no, F.array().cast(f"array<{_VALUE}>"))
    row = lambda left, status, output, failed: F.struct(left.alias("left"), status.cast("string").alias("exec_status"), output.cast("string").alias("exec_output"), failed.cast("int").alias("exec_failed_step"))

    def end(s: Column) -> Column:
        last = s["vals"][0]
        shown = F.coalesce(last["i"].cast("string"), python_repr(F.when(F.abs(last["d"]) < float("inf"), last["d"].cast("string")).otherwise(F.when(last["d"] > 0, "1e999").otherwise("-1e999"))))
        return F.when(s["left"], row(yes, none, none, none)).when(s["status"].isNotNull(), row(no, s["status"], none, s["step"])).otherwise(row(no, F.lit("ok"), shown, none))

    return (
        F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, row(no, F.lit("parse_empty"), none, none))
        .when(F.size(steps) > most, row(no, F.lit("timeout"), none, none))
        .otherwise(_let(F.aggregate(steps, start, step), end))
    )
