"""Error injection: each injector maps steps to ``(steps, changed)`` in Catalyst.

Choices that need no chance follow fixed orders; where a choice is free it is the
least by md5, so that reruns and other engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse import once
from .schema import ERROR_TYPES, INCOMPATIBLE

#: SQL: a quote within a text.
_QUOTE = "\\'"
_HAS = "exists(s.params, p -> p.v like '%{{%')"


def _step(s: str, **new: str) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {new.get(f, f'{s}.{f}')}" for f in ("pos", "step_id", "tool_name", "params", "output_variable")) + ")"


def _renumber(steps: str) -> str:
    return f"transform({steps}, (s, i) -> {_step('s', pos='i')})"


def _set(s: str, k: str, v: str) -> str:
    """The step with parameter ``k`` set to ``v``."""
    return _step(s, params=f"transform({s}.params, p -> if(p.k = {k}, named_struct('k', p.k, 'v', {v}), p))")


def _at(steps: str, i: str, new: str) -> str:
    """The steps with that at ``i`` (computed once) replaced by ``new`` of it."""
    return f"transform(array({i}), i0 -> transform({steps}, (s, j) -> if(j = i0, {new}, s)))[0]"


def _nearest_middle(steps: str, condition: str, least: int = 0) -> str:
    """Position nearest the middle (ties: the earlier) whose step meets ``condition``; null if none."""
    found = f"filter(transform({steps}, (s, i) -> named_struct('d', abs(i - size({steps}) div 2), 'i', i, 'ok', {condition})), x -> x.ok and x.i >= {least})"
    return f"array_min(transform({found}, x -> named_struct('d', x.d, 'i', x.i))).i"


_WHOLE, _NUMBER = "'^-?[0-9]+$'", "'^-?[0-9]+([.][0-9]+)?$'"
#: SQL: a quoted text of over three characters without references.
_WORDY = "(p.v rlike '^([\\'\"]).*\\\\1$' and length(p.v) > 5 and p.v not like '%{{%')"


def _typo_target(s: str, i: str) -> str:
    """The parameter that a typo hits: in the first step a text or a number, later a number."""
    return f"get(filter({s}.params, p -> p.v rlike {_NUMBER} or ({i} = 0 and {_WORDY})), 0)"


def _typo(v: str) -> str:
    """A whole number plus one, another number plus a tenth of itself (0.1 at
    least), a text with an x in its middle."""
    x = f"cast({v} as double)"
    return f"""case when {v} rlike {_WHOLE} then cast(cast({v} as decimal(38,0)) + 1 as string)
      when {v} rlike {_NUMBER} then cast(round({x} + greatest(0.1D, abs({x}) * 0.1D), 6) as string)
      else concat(left({v}, length({v}) div 2), 'x', substr({v}, length({v}) div 2 + 1)) end"""


def _literal(s: str) -> str:
    return f"get(filter({s}.params, p -> p.v not like '%{{{{%'), 0)"


def injector(error_type: str, steps: str = "steps", tools: str = "all_tools", specs: str | None = None, types: str | None = None) -> Column:
    """``struct<steps, changed>`` for one error type. ``tools`` (names of the
    catalog) or ``specs`` (structs ``name, required``) is read by wrong_tool only:
    with specs, a tool that requires none of the step's parameters comes before
    one that requires some, and that before one that would accept them all."""
    return F.expr(_injector(error_type, steps, tools, specs, types))


def _injector(error_type: str, steps: str, tools: str = "all_tools", specs: str | None = None, types: str | None = None) -> str:
    n = f"size({steps})"
    if error_type == "type_mismatch":
        i = _nearest_middle(steps, f"{_literal('s')} is not null")
        wrong = f"if({_literal('s')}.v rlike '^-?[0-9.]+$', '\\'invalid_string\\'', '42')"
        if types:  # a declared type says what it does not accept
            declared = f"element_at({types}, concat(s.tool_name, '.', {_literal('s')}.k))"
            cases = " ".join(f"when '{t}' then '{v if v.isdigit() else _QUOTE + v + _QUOTE}'" for t, v in INCOMPATIBLE.items())
            wrong = f"coalesce(case {declared} {cases} end, {wrong})"
        new, where = _at(steps, i, _set("s", f"{_literal('s')}.k", wrong)), f"{i} is not null"
    elif error_type == "missing_dependency":
        i = _nearest_middle(steps, _HAS, 1)
        key = "get(filter(s.params, p -> p.v like '%{{%'), 0).k"
        new, where = _at(steps, i, _set("s", key, "'\\'hardcoded_value\\''")), f"{n} >= 2 and {i} is not null"
    elif error_type == "wrong_tool":
        held = "m.params.k"
        rank = f"case when size(t.required) = 0 then 2 when not arrays_overlap(t.required, {held}) then 0 when size(array_except(t.required, {held})) = 0 and size(array_except({held}, t.required)) = 0 then 2 else 1 end"
        # without requirements all are of one rank; the middle step and the pick are found once
        rank, name = (rank, "t.name") if specs else ("2", "t")
        pool = f"filter({specs or tools}, t -> {name} <> m.tool_name)"
        pick = f"transform(array(get({steps}, {n} div 2)), m -> array_min(transform({pool}, t -> named_struct('r', {rank}, 'h', md5(concat(m.tool_name, {name})), 't', {name}))).t)[0]"
        made = f"if(t is null, {steps}, transform({steps}, (s, j) -> if(j = {n} div 2, {_step('s', tool_name='t')}, s)))"
        return f"transform(array({pick}), t -> named_struct('steps', {made}, 'changed', {n} >= 1 and t is not null))[0]"
    elif error_type == "parameter_typo":
        i = f"array_min(filter(transform({steps}, (s, i) -> if({_typo_target('s', 'i')} is not null, i, null)), i -> i is not null))"
        key = _typo_target("s", "j")
        new, where = _at(steps, i, _set("s", f"{key}.k", _typo(f"{key}.v"))), f"{i} is not null"
    elif error_type == "circular_dependency":
        # per step its number and the first later one that refers to it; what follows names each value once
        named = "exists(array(concat('{{', i, '}}')), m -> exists(t.params, p -> contains(p.v, m)))"
        user = f"array_min(filter(transform({steps}, (t, j) -> if(j > i and {named}, j, null)), j -> j is not null))"
        used = f"transform({steps}, (s, i) -> if(i < {n} - 1 and size(s.params) > 0, named_struct('at', i, 'to', {user}), null))"
        last = f"array_max(filter(transform({steps}, (s, i) -> if(size(s.params) > 0, i, null)), i -> i is not null))"
        place = f"coalesce(array_min(filter({used}, x -> x.to is not null)), transform(array({last}), l -> named_struct('at', l, 'to', l))[0])"
        set_ = _set("s", "get(s.params, 0).k", "concat('{{', c.to, '}}')")
        made = f"if(ok, transform({steps}, (s, j) -> if(j = c.at, {set_}, s)), {steps})"
        return f"transform(array({place}), c -> transform(array({n} >= 2 and c.at is not null), ok -> named_struct('steps', {made}, 'changed', ok))[0])[0]"
    elif error_type == "inefficient_order":
        free = f"not exists(get({steps}, i + 1).params, p -> contains(p.v, s.output_variable))"
        i = f"array_min(filter(transform({steps}, (s, i) -> if(i < {n} - 1, if({free}, i, null), null)), i -> i is not null))"
        swapped = f"transform(array({i}), i0 -> transform({steps}, (s, j) -> if(j = i0, {steps}[i0 + 1], if(j = i0 + 1, {steps}[i0], s))))[0]"
        new, where = _renumber(swapped), f"{n} >= 2 and {i} is not null"
    elif error_type == "incomplete_plan":
        new, where = f"slice({steps}, 1, greatest({n} - 1, 0))", f"{n} > 1"
    elif error_type == "unnecessary_steps":
        ins = f"{n} div 2"
        bump = rf"array_join(transform(split(p.v, '(?=\\{{\\{{\\d)|(?<=\\d\\}}\\}})'), x -> if(x rlike '^\\{{\\{{\\d+\\}}\\}}$' and cast(regexp_extract(x, '(\\d+)', 1) as int) >= {ins}, concat('{{{{', cast(regexp_extract(x, '(\\d+)', 1) as int) + 1, '}}}}'), x)), '')"
        moved = f"transform(slice({steps}, {ins} + 1, {n}), (s, i) -> {_step('s', step_id=f'i + {ins} + 1', output_variable=f'''concat('{{{{', i + {ins} + 1, '}}}}')''', params=f'''transform(s.params, p -> named_struct('k', p.k, 'v', {bump}))''')})"
        extra = f"transform(slice({steps}, 1, 1), s -> {_step('s', step_id=ins, output_variable=f'''concat('{{{{', {ins}, '}}}}')''')})"
        new, where = _renumber(f"concat(slice({steps}, 1, {ins}), {extra}, {moved})"), f"{n} >= 2"
    elif error_type == "forward_reference":
        i = f"array_min(filter(transform({steps}, (s, i) -> if(i < {n} - 1 and size(s.params) > 0, i, null)), i -> i is not null))"
        new, where = _at(steps, i, _set("s", "get(s.params, 0).k", f"concat('{{{{', {i} + 1, '}}}}')")), f"{n} >= 2 and {i} is not null"
    else:
        new, where = steps, "true"
    return f"named_struct('steps', if({where}, {new}, {steps}), 'changed', {where})"


def inject(df: DataFrame, error_type: str, steps: str = "steps", types: str | None = None) -> DataFrame:
    """``df`` with ``injected`` and ``changed`` for one error type. ``types`` names a
    column that maps ``tool.parameter`` to its declared type, for type_mismatch."""
    out = once(df, "_i", injector(error_type, steps, types=types))
    return out.withColumn("injected", F.col("_i.steps")).withColumn("changed", F.col("_i.changed")).drop("_i")


def injector_v1(error_type: str, steps: str = "steps", tools: str = "all_tools") -> Column:
    """``struct<steps, changed>`` by the first family's rules: fixed places only,
    and the label stays on plans that it leaves as they are (``changed`` false)."""
    n, mid = f"size({steps})", f"(size({steps}) div 2)"
    first = "get(s.params, 0).k"
    if error_type == "type_mismatch":
        hit = "get(filter(s.params, p -> p.v not like '%{{%' and p.v rlike '^([\\'\"\\\\[]|-?[0-9])'), 0)"
        new = _at(steps, mid, _set("s", f"{hit}.k", f"if({hit}.v rlike '^[\\'\"]', '42', '\\'invalid_string\\'')"))
    elif error_type == "missing_dependency":
        new = _at(steps, f"if({mid} > 0, {mid}, -1)", _set("s", "get(filter(s.params, p -> p.v like '%{{%'), 0).k", "'\\'hardcoded_value\\''"))
    elif error_type == "parameter_typo":
        hit = f"get(filter(s.params, p -> {_WORDY}), 0)"
        new = _at(steps, "0", _set("s", f"{hit}.k", _typo(f"{hit}.v")))
    elif error_type == "circular_dependency":
        new = _at(steps, f"if({n} > 1, 0, -1)", _set("s", first, "'{{1}}'"))
    elif error_type == "inefficient_order":
        swapped = f"concat(slice({steps}, 1, greatest({n} - 2, 0)), slice({steps}, {n}, 1), slice({steps}, greatest({n} - 1, 1), 1))"
        new = f"if({n} < 3, {steps}, transform({swapped}, (s, i) -> {_step('s', pos='i', step_id='i')}))"
    elif error_type == "unnecessary_steps":
        moved = injector("unnecessary_steps", steps)  # same but for output variables, which stay stale here
        made = moved["steps"]
        stale = F.transform(made, lambda s, i: F.when(i > F.expr(mid), s.withField("output_variable", F.get(F.col(steps), i - 1)["output_variable"])).otherwise(s))
        return F.struct(F.when(moved["changed"], stale).otherwise(F.col(steps)).alias("steps"), moved["changed"].alias("changed"))
    elif error_type == "forward_reference":
        new = _at(steps, f"if({n} > 2, 1, -1)", _set("s", first, "'{{2}}'"))
    else:
        return injector(error_type, steps, tools)
    return F.expr(f"named_struct('steps', {new}, 'changed', {new} <> {steps})")


def inject_first(df: DataFrame, order: list[str], steps: str = "steps") -> DataFrame:
    """The first error type of ``order`` that changes the plan; else the plan as it is, labelled none."""
    results = F.array(*(F.struct(F.lit(t).alias("t"), injector(t, steps).alias("r")) for t in order))
    hit = F.get(F.filter(results, lambda x: x["r"]["changed"]), F.lit(0))
    return once(df, "_h", hit).withColumn("injected", F.coalesce("_h.r.steps", steps)).withColumn("injected_type", F.coalesce("_h.t", F.lit("none"))).drop("_h")


def compound(df: DataFrame, errors: list[str], steps: str = "steps") -> DataFrame:
    """Several injectors in a fold, truncation last; ``changed`` if all applied."""
    ordered = sorted(errors, key=lambda e: (e == "incomplete_plan", ERROR_TYPES.index(e)))
    out = df.withColumn("injected", F.col(steps)).withColumn("changed", F.lit(True))
    for e in ordered:
        out = once(out, "_i", injector(e, "injected")).withColumn("injected", F.col("_i.steps")).withColumn("changed", F.col("changed") & F.col("_i.changed")).drop("_i")
    return out


def compound_tried(df: DataFrame, k: int, errors: tuple[str, ...] = ERROR_TYPES[1:], tries: int = 25, key: str = "plan_id", steps: str = "steps") -> DataFrame:
    """``df`` with ``injected``, ``errors`` (as applied) and ``tried`` (from 0): ``k`` distinct
    injectors on each plan, of the first of ``tries`` draws in which all of them change it.
    Plans for which no draw does have no row.

    A draw takes the ``k`` least types by md5 of key, draw and type, truncation last. Draws are
    made in a fold within the plan's row, until one does. Columns of ``df`` stay; the three new
    ones are replaced.
    """
    order = sorted(errors, key=lambda e: (e == "incomplete_plan", ERROR_TYPES.index(e)))
    ranked = ", ".join(f"named_struct('h', md5(concat_ws('|', cast({key} as string), cast(t as string), '{e}')), 'e', '{e}')" for e in errors)
    kinds = f"array({', '.join(f"'{e}'" for e in order)})"
    drawn = f"transform(array(slice(array_sort(array({ranked})), 1, {k}).e), d -> filter({kinds}, e -> array_contains(d, e)))[0]"
    made = f"named_struct('injected', r{k}.steps, 'errors', e, 'tried', t)"
    for i in range(k, 0, -1):
        one = " ".join(f"when '{e}' then {_injector(e, f'r{i - 1}.steps')}" for e in errors)
        made = f"transform(array(case e[{i - 1}] {one} end), r{i} -> if(r{i}.changed, {made}, null))[0]"
    draw = f"transform(array({drawn}), e -> transform(array(named_struct('steps', {steps})), r0 -> {made})[0])[0]"
    base = df.drop("injected", "errors", "tried")
    kind = f"struct<injected:{dict(df.dtypes)[steps]},errors:array<string>,tried:int>"
    first = f"aggregate(sequence(0, {tries} - 1), cast(null as {kind}), (f, t) -> if(f is not null, f, cast({draw} as {kind})))"
    return once(base, "_f", F.expr(first)).where("_f is not null").select(*base.columns, "_f.*")


def quota_slots(n: int, shares: dict[str, float]) -> list[str]:
    """Labels of ``n`` candidates: the gold plan, each type's quota of the rest, then the types in turn; cut to ``n``."""
    rest = n - 1
    slots = ["none"] + [t for t, p in shares.items() if t != "none" for _ in range(max(1, int(rest * p)))]
    types = [t for t in shares if t != "none"]
    slots += [types[i % len(types)] for i in range(n - len(slots)) if types]
    return slots[:n]


def candidates(gold: DataFrame, n: int, shares: dict[str, float], steps: str = "steps") -> DataFrame:
    """``n`` candidates of each gold plan: columns of ``gold`` plus slot,
    error_type, injected and changed, by ``quota_slots``. ``gold`` needs
    ``all_tools`` (sorted names) if wrong_tool is among the shares."""
    slots = F.array(*(F.struct(F.lit(i).alias("slot"), F.lit(t).alias("error_type"), injector(t, steps).alias("r")) for i, t in enumerate(quota_slots(n, shares))))
    out = gold.select("*", F.explode(slots).alias("_c"))
    return out.select(*gold.columns, "_c.slot", "_c.error_type", F.col("_c.r.steps").alias("injected"), F.col("_c.r.changed").alias("changed"))
