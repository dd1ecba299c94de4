"""Table layouts. Open-ended values (tool arguments, contexts) are JSON strings."""

from __future__ import annotations

ATTEMPT_KEY = ["run_id", "scenario_id", "attempt"]

TOOL_CALL = "struct<name:string,arguments:string,result:string>"

CHECK = (
    "check_pos int, check_id string, type string, severity string, regulations array<string>, "
    "patterns array<string>, case_sensitive boolean, must_appear boolean, scope string, "
    "pii_types array<string>, rubric string, judge_pass_if string, min_length int, max_length int, "
    "max_latency_ms double"
)

CHECKS = f"scenario_id string, {CHECK}"

SCENARIOS = (
    "file_name string, scenario_id string, title string, description string, label string, tags array<string>, "
    "regulations array<string>, context string, customer_turns array<string>"
)

SCRIPTS = f"scenario_id string, persona string, entry_pos int, text string, tool_calls array<{TOOL_CALL}>"

REGULATIONS = "file_pos bigint, id string, name string, authority string, summary string, url string"

TURNS = (
    "run_id string, scenario_id string, attempt int, turn int, role string, content string, "
    f"tool_calls array<{TOOL_CALL}>"
)

USAGE = (
    "run_id string, scenario_id string, attempt int, source string, check_pos int, prompt_tokens bigint, "
    "completion_tokens bigint, cost_usd double, latency_ms double, model_calls bigint"
)

JUDGE_RESPONSES = (
    "run_id string, scenario_id string, attempt int, check_pos int, check_id string, content string, "
    "latency_ms double"
)

RUNS = (
    "run_id string, created_at timestamp, agent_model string, judge_model string, pass_rate double, "
    "total_runs bigint, violations bigint, payload string"
)

AUDIT_EVENTS = "event_id string, created_at timestamp, event_type string, details string"

CHECK_RESULT = (
    "struct<check_pos:int,check_id:string,type:string,passed:boolean,severity:string,"
    "regulations:array<string>,message:string,evidence:string>"
)

# The JSON shape of one catalog file: a scenario with its checks and scripted replies.
CATALOG_FILE = (
    "id string, title string, description string, label string, tags array<string>, regulations array<string>, "
    "context string, customer_turns array<string>, "
    "checks array<struct<id:string,type:string,severity:string,regulations:array<string>,patterns:array<string>,"
    "case_sensitive:boolean,must_appear:boolean,scope:string,pii_types:array<string>,rubric:string,"
    "judge_pass_if:string,min_length:int,max_length:int,max_latency_ms:double>>, "
    "scripts struct<compliant:array<struct<text:string,tool_calls:array<struct<name:string,arguments:string>>>>,"
    "naive:array<struct<text:string,tool_calls:array<struct<name:string,arguments:string>>>>>"
)

# The JSON shape of a recorded run, one object per attempt. Configuration and metrics are open-ended and stay JSON text.
USED = "struct<prompt_tokens:bigint,completion_tokens:bigint,model_calls:bigint,cost_usd:double,latency_ms:double>"

RECORDED_ATTEMPT = (
    "run_id string, created_at string, agent_model string, judge_model string, scenario_id string, title string, "
    "label string, attempt int, passed boolean, "
    f"turns array<struct<role:string,content:string,tool_calls:array<{TOOL_CALL}>>>, "
    f"check_results array<{CHECK_RESULT}>, "
    f"model string, usage {USED}, agent_usage {USED}, judge_usage {USED}, configuration string, metrics string"
)
