"""The engine in SQL: views of a corpus and a table function that parses plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from planlens.plans import corpus
from planlens.plans.parse import _lenient, _mixed, _robust, _strict


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Table functions ``parse_plan``, ``parse_plan_lenient``, ``parse_plan_mixed``
    and ``parse_plan_robust`` over a text (a row per step, evaluated in Catalyst),
    and, given a folder of tables, the views ``plan_steps``, ``plans`` and ``tools``."""
    columns = "pos INT, step_id INT, tool_name STRING, params ARRAY<STRUCT<k: STRING, v: STRING>>, output_variable STRING"
    forms = {"": _strict, "_lenient": _lenient, "_mixed": _mixed, "_robust": _robust}
    for suffix, form in forms.items():
        body = form(f"coalesce(parse_plan{suffix}.plan_text, '')")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION parse_plan{suffix}(plan_text STRING) RETURNS TABLE({columns}) RETURN SELECT s.* FROM (SELECT explode({body}) AS s)")
    if sf_dir is not None:
        corpus.raw_steps(spark, sf_dir).createOrReplaceTempView("plan_steps")
        corpus.plans(spark, sf_dir).createOrReplaceTempView("plans")
        corpus.catalog(spark, sf_dir).createOrReplaceTempView("tools")
