r"""Plan lines out of what models write: extraction, repair and candidates.

All are Catalyst expressions over a text column. Patterns are Java's; lines are
trimmed of blanks, tabs and carriage returns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A step line: its number, what it assigns to (if anything) and its call.
_STEP = r"^Step (\d+):\s*(?:([^\s=(]+)\s*=\s*)?([A-Za-z_]\w*\(.*\))\s*$"
#: What follows each ``Candidate N:`` mark, up to the next one.
_MARKED = r"(?s)Candidate\s*\d+\s*:\s*(.*?)(?=Candidate\s*\d+\s*:|\z)"
_BLANK = " \t\r\n"


def lines(text: Column) -> Column:
    """The trimmed lines of a text; none for null."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_BLANK)))


def step_lines(text: Column) -> Column:
    """Only the lines that begin with ``Step N:``."""
    return F.array_join(F.filter(lines(text), lambda x: x.rlike(r"^Step \d+:")), "\n")


def react_plan(text: Column) -> Column:
    """Step lines of a text of thoughts and actions; ``action:`` before a step is dropped."""
    bare = F.transform(lines(text), lambda x: F.regexp_replace(x, r"^(?i)action:\s*", ""))
    return F.array_join(F.filter(bare, lambda x: x.rlike(r"^Step \d+:")), "\n")


def assign(line: Column) -> Column:
    """A step line with its ``{{N}} =`` put in where the model left it out; other lines as they are."""
    bare = line.rlike(r"^\s*Step\s+\d+\s*:.*$") & ~line.rlike(r"^\s*Step\s+\d+\s*:\s*\{\{\d+\}\}\s*=")
    made = F.btrim(F.regexp_replace(line, r"^\s*Step\s+0*(\d+)\s*:\s*(.*?)\s*$", "Step $1: {{$1}} = $2"))
    return F.when(bare, made).otherwise(line)


def canonical_step(line: Column) -> Column:
    """A trimmed line in canonical form: as it is, with another variable's name
    replaced, or with the variable put in. Null if it is no step."""
    part = lambda k: F.regexp_extract(line, _STEP, k)
    made = F.concat(F.lit("Step "), part(1), F.lit(": {{"), part(1), F.lit("}} = "), part(3))
    known = F.when(part(2).rlike(r"^\{\{\d+\}\}$"), line).when(part(2).rlike(r"^([A-Za-z_]\w*)?$"), made)
    return F.when(part(1) != "", known)


def first_step(text: Column) -> Column:
    """The first line of a text that has a canonical form, in that form."""
    return F.get(F.filter(F.transform(lines(text), canonical_step), lambda x: x.isNotNull()), F.lit(0))


def call_key(line: Column) -> Column:
    """What tells calls apart: all after the first equals sign, in lower case and
    single blanks. Empty if there is none."""
    return F.lower(F.regexp_replace(F.btrim(F.regexp_extract(line, r"(?s)^[^=]*=\s*(.+?)\s*$", 1), F.lit(_BLANK)), r"\s+", " "))


def candidates(text: Column, n: int, prior: Column | None = None) -> Column:
    """Step lines proposed after ``Candidate N:`` marks, at most ``n``, or the one
    entry ``COMPLETE``. A call made before (``prior``: array of step lines) or
    proposed before is left out. Without any such candidate all lines are tried."""
    body = F.coalesce(text, F.lit(""))
    done = body.rlike(r"(?m)(?i)^\s*Candidate\s*\d+\s*:\s*COMPLETE\b")
    before = F.filter(F.transform(prior if prior is not None else F.array().cast("array<string>"), call_key), lambda x: x != "")

    def fresh(found: Column) -> Column:
        keyed = F.transform(found, lambda x: F.struct(call_key(x).alias("key"), x.alias("line")))
        valid = F.filter(keyed, lambda x: x["line"].isNotNull() & (x["key"] != "") & ~F.array_contains(before, x["key"]))
        start = F.array().cast("array<struct<key:string,line:string>>")
        return F.aggregate(valid, start, lambda a, x: F.when(F.exists(a, lambda y: y["key"] == x["key"]), a).otherwise(F.concat(a, F.array(x))))["line"]

    marked = F.transform(F.regexp_extract_all(body, F.lit(_MARKED), F.lit(1)), first_step)
    listed = fresh(marked)
    found = F.when(F.size(listed) > 0, listed).otherwise(fresh(F.transform(lines(body), canonical_step)))
    return F.when(done, F.array(F.lit("COMPLETE"))).otherwise(F.slice(found, 1, n))


def decision(text: Column, step: Column) -> Column:
    """``conclusion``, ``give up`` or ``caller`` by the last ``Next:`` line and
    the keyword that comes first in it; ``caller`` without one and at step 0."""
    plain = F.transform(lines(text), lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"^\*+\s*", ""), r"\s*\*+$", ""))
    said = F.try_element_at(F.filter(plain, lambda x: x.startswith("next:")), F.lit(-1))
    end, stop = F.instr(said, "conclusion"), F.regexp_instr(said, F.lit("give ?up"))
    told = F.when((end > 0) & ((stop == 0) | (end < stop)), "conclusion").when(stop > 0, "give up").otherwise("caller")
    return F.when(step == 0, "caller").otherwise(F.coalesce(told, F.lit("caller")))


def repair(line: Column, step: Column, tool: Column) -> Column:
    """A broken line rebuilt around the expected tool: the arguments are what is in
    its parentheses, else what follows its colon if that has an equals sign; else null."""
    inside = F.when(line.rlike(r"\(.*\)\s*$"), F.btrim(F.regexp_extract(line, r"\((.*)\)\s*$", 1)))
    tail = F.regexp_extract(line, r":\s*(.*)$", 1)
    args = F.coalesce(inside, F.when(line.rlike(r":\s*.*$") & tail.contains("="), tail))
    number = step.cast("string")
    return F.concat(F.lit("Step "), number, F.lit(": {{"), number, F.lit("}} = "), tool, F.lit("("), args, F.lit(")"))


def label_refs(value: Column, labels: Column) -> Column:
    """``$var_N.field$`` references as ``{{index}}``, where ``labels`` (array of
    names like ``$var_1`` or ``$var1``) has the label in either form; others stay.
    Arguments as JSON text are read as text too: labels hold nothing that JSON escapes,
    so every string at any depth, and every key, is reached without taking them apart."""
    plain = F.transform(labels, lambda x: F.replace(F.replace(x, F.lit("$var_"), F.lit("")), F.lit("$var"), F.lit("")))
    pieces = F.regexp_extract_all(value, F.lit(r"\$var_?\d+\.\w+\$|[^$]+|\$"), F.lit(0))
    form = r"^\$var_?(\d+)\.\w+\$$"

    def piece(p: Column) -> Column:
        at = F.array_position(plain, F.regexp_extract(p, form, 1))
        return F.when(p.rlike(form) & (at > 0), F.concat(F.lit("{{"), (at - 1).cast("string"), F.lit("}}"))).otherwise(p)

    return F.array_join(F.transform(pieces, piece), "")


#: The predictions that an annotation may hold.
PREDICTIONS = ("yes", "likely_yes", "uncertain", "likely_no", "no")


def annotation(score: Column, prediction: Column, confidence: Column, raw: Column | None = None) -> Column:
    """An annotation's fields (as text) in their ranges: score 0 to 100 (50 if it
    is no whole number), confidence 0 to 1 (0.5), a known prediction (uncertain).
    Where the score is 50, ``raw`` text may tell it by ``quality_score: n``."""
    whole = F.coalesce(score.try_cast("int"), F.lit(50))
    q = F.greatest(F.lit(0), F.least(F.lit(100), whole))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.try_cast("double"), F.lit(0.5))))
    p = F.when(prediction.isin(*PREDICTIONS), prediction).otherwise("uncertain")
    found = F.lit(None).cast("int")
    if raw is not None:
        told = F.regexp_extract(raw, r'"?\bquality_score\b"?\s*:\s*([0-9]{1,3})', 1).try_cast("int")
        found = F.when(told.isNotNull(), F.least(F.lit(100), told))
    rescued = (q == 50) & found.isNotNull()
    return F.struct(F.when(rescued, found).otherwise(q).alias("quality_score"), p.alias("success_prediction"), F.when(rescued, F.greatest(c, F.lit(0.2))).otherwise(c).alias("confidence"), rescued.alias("rescued"))
