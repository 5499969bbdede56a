"""Types and small dimensions of the plan model."""

from __future__ import annotations

STEP = "struct<pos:int,step_id:int,tool_name:string,params:array<struct<k:string,v:string>>,output_variable:string>"
PLAN = f"array<{STEP}>"
ANNOTATION = (
    "struct<quality_score:int,success_prediction:string,reasoning:string,confidence:double,"
    "issues:array<struct<type:string,severity:string,step:int,description:string,suggestion:string,points_deducted:int>>>"
)
ENVELOPE = (
    "metadata map<string,string>, data array<struct<query_id:bigint,sample_id:string,query:string,"
    "plan:struct<steps:array<struct<step_id:int,tool_name:string,parameters:string,output_variable:string,expected_output:string>>,error_type:string>,"
    f"annotation:{ANNOTATION}>>"
)

#: Candidate slots of a query, in order.
ERROR_TYPES = (
    "none", "type_mismatch", "missing_dependency", "wrong_tool", "parameter_typo",
    "circular_dependency", "inefficient_order", "incomplete_plan", "unnecessary_steps", "forward_reference",
)

#: Categories of error types.
CATEGORIES = {
    "Argument-level": ("parameter_typo", "type_mismatch"),
    "Dependency": ("missing_dependency", "circular_dependency", "forward_reference"),
    "Structural": ("wrong_tool", "inefficient_order", "unnecessary_steps", "incomplete_plan"),
}

#: Least score of each prediction.
PREDICTION_BANDS = ((90, "yes"), (75, "likely_yes"), (50, "uncertain"), (25, "likely_no"), (0, "no"))

#: Points a severity costs.
SEVERITY_POINTS = {"critical": 30, "high": 20, "medium": 10, "low": 5}

#: Words that do not count in functional tool matching.
STOP_WORDS = (
    "what", "is", "the", "of", "in", "a", "an", "and", "or", "to", "how", "many", "who", "which", "are", "was", "were",
    "be", "been", "at", "on", "for", "with", "that", "this", "it", "its", "from",
)

#: A literal that no parameter of the type accepts.
INCOMPATIBLE = {"number": "invalid_string", "integer": "invalid_string", "string": "42", "array": "invalid_string", "object": "invalid_string", "boolean": "invalid_string"}

#: Bin edges of the expected calibration error, as linspace makes them.
ECE_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)
