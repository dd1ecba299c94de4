"""Small turns and check tables for the tests."""

from auditlake.schemas import TURNS
from auditlake.session import local_table


def turns_table(spark, turns):
    """Turns of one attempt: (role, content) or (role, content, [(tool, arguments, result)])."""
    rows = [("r", "s", 0, i, t[0], t[1], [tuple(c) for c in t[2]] if len(t) > 2 else []) for i, t in enumerate(turns)]
    return spark.createDataFrame(rows, TURNS)


CHECK_COLUMNS = (
    "scenario_id string, check_pos int, check_id string, type string, severity string, regulations array<string>, "
    "patterns array<string>, case_sensitive boolean, must_appear boolean, scope string, pii_types array<string>, "
    "rubric string, judge_pass_if string, min_length int, max_length int, max_latency_ms double"
)


def check_table(spark, *checks):
    """Checks of scenario "s" from dicts; what a dict leaves out is null."""
    names = [c.split()[0] for c in CHECK_COLUMNS.split(", ")]
    rows = []
    for pos, check in enumerate(checks):
        given = {"scenario_id": "s", "check_pos": pos, "check_id": f"c{pos}"} | check
        rows.append(tuple(given.get(n) for n in names))
    return local_table(spark, rows, CHECK_COLUMNS)
