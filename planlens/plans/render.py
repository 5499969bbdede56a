"""Steps and tools as text: the plan strings of prompts and training rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlens.functions.literals import python_repr


def literal(value: Column) -> Column:
    """Text as a quoted literal: single quotes, double ones if only single ones
    occur in it; backslashes and line ends are escaped."""
    body = F.replace(F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(value.contains("'") & ~value.contains('"'), F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.when(value.contains("'"), single).otherwise(F.concat(F.lit("'"), body, F.lit("'"))))


def plan_string(steps: Column, anywhere: bool = False, first: int = 0) -> Column:
    """Steps whose values are typed (``params`` of structs ``k, v, is_text``) as
    plan text. A text value is quoted unless it is a reference, or with
    ``anywhere`` holds one; step numbers begin at ``first``."""

    def value(p: Column) -> Column:
        ref = p["v"].contains("{{") if anywhere else p["v"].startswith("{{") & p["v"].endswith("}}")
        return F.concat(p["k"], F.lit("="), F.when(p["is_text"] & ~ref, literal(p["v"])).otherwise(p["v"]))

    def line(s: Column) -> Column:
        args = F.array_join(F.transform(s["params"], value), ", ")
        return F.concat(F.lit("Step "), (s["step_id"] + first).cast("string"), F.lit(": "), s["output_variable"], F.lit(" = "), s["tool_name"], F.lit("("), args, F.lit(")"))

    return F.array_join(F.transform(steps, line), "\n")


def typed_plan_string(steps: Column) -> Column:
    """Steps whose values are JSON (``params`` of structs ``k, v``, as ``to_json`` writes
    a VARIANT) as plan text, each value as Python prints it: texts in quotes, references
    too, floats with a point, None, True and False, nested lists and objects."""

    def line(s: Column) -> Column:
        args = F.array_join(F.transform(s["params"], lambda p: F.concat(p["k"], F.lit("="), python_repr(p["v"]))), ", ")
        return F.concat(F.lit("Step "), s["step_id"].cast("string"), F.lit(": "), s["output_variable"], F.lit(" = "), s["tool_name"], F.lit("("), args, F.lit(")"))

    return F.array_join(F.transform(steps, line), "\n")


def tool_list(tools: Column, marks: bool = True) -> Column:
    """``Available Tools`` of a prompt: structs ``name, params (array of name,
    type), required``, the first of a name only. ``marks`` tells required ones."""
    start = F.filter(tools, lambda t: F.lit(False))
    unique = F.aggregate(tools, start, lambda a, t: F.when(F.exists(a, lambda u: u["name"] == t["name"]), a).otherwise(F.concat(a, F.array(t))))

    def line(t: Column) -> Column:
        mark = lambda p: F.when(F.array_contains(t["required"], p["name"]), " (required)").otherwise("") if marks else F.lit("")
        args = F.transform(t["params"], lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["type"], F.lit("any")), mark(p)))
        return F.concat(F.lit("- "), t["name"], F.lit("("), F.array_join(args, ", "), F.lit(")"))

    return F.array_join(F.concat(F.array(F.lit("Available Tools:")), F.transform(unique, line)), "\n")


def chat(system: Column, user: Column) -> Column:
    """A prompt as messages."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", system), message("user", user))


def defaults(params: Column, required: Column, types: Column) -> Column:
    """``params`` (structs ``k, v``) with the required ones that are missing, as
    literals by type: 0, 0.0, False, [], {} or an empty text."""
    have = params["k"]
    blank = lambda t: F.when(t == "integer", "0").when(t == "number", "0.0").when(t == "boolean", "False").when(t == "array", "[]").when(t == "object", "{}").otherwise("''")
    made = F.transform(F.array_except(required, have), lambda k: F.struct(k.alias("k"), blank(F.coalesce(types[k], F.lit("any"))).alias("v")))
    return F.concat(params, made)


def with_expected(steps: Column, outputs: Column) -> Column:
    """Steps with ``expected_output`` by position; null beyond the known outputs."""
    return F.transform(steps, lambda s, i: F.struct(s["step_id"].alias("step_id"), s["tool_name"].alias("tool_name"), F.get(outputs, i).alias("expected_output")))


def masked_labels(prompt: Column, answer: Column, most: int, ignore: int = -100) -> Column:
    """``ids, labels`` of a training row: the prompt's tokens are ignored, the row
    is cut at ``most``; null if the prompt alone reaches it."""
    ids = F.slice(F.concat(prompt, answer), 1, most)
    labels = F.slice(F.concat(F.transform(prompt, lambda _: F.lit(ignore)), answer.cast("array<int>")), 1, most)
    return F.when(F.size(prompt) < most, F.struct(ids.alias("ids"), labels.alias("labels")))


#: What a judge is asked for a plan, and the form of its answer.
JUDGE_REQUEST = """Query: {query}

{tools}

Plan to Evaluate:
{plan}

Please evaluate this plan and provide:
1. Quality score (0-100)
2. Success prediction (yes/likely_yes/uncertain/likely_no/no)
3. Detailed reasoning
4. List of issues (if any)
5. Confidence (0.0-1.0)

Format your response as JSON:
{{
  "quality_score": <int>,
  "success_prediction": "<string>",
  "reasoning": "<string>",
  "issues": [...],
  "confidence": <float>
}}"""


def judge_request(query: Column, tools: Column, plan: Column) -> Column:
    """The user's message to a judge; ``tools`` as ``tool_list`` writes them. Nulls are empty."""
    values = {"query": query, "tools": tools, "plan": plan}
    parts = re.split(r"(?<!\{)\{(\w+)\}(?!\})", JUDGE_REQUEST)
    text = lambda i, p: F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p.replace("{{", "{").replace("}}", "}"))
    return F.concat(*(text(i, p) for i, p in enumerate(parts)))
