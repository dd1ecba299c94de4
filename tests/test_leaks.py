"""A secret planted at each depth is reported with its path."""

import json

import pytest

from auditlake.operators.leaks import leak_paths, texts_of_rows

SCHEMA = (
    "id int, plain string, n int, one struct<a:string,b:struct<c:string,d:int>>, list array<string>, deep array<struct<x:array<string>,y:int>>, "
    "m map<string,string>, mm map<string,array<struct<z:string>>>, doc string, numbers array<int>"
)
MAIL = "jane@example.org"
CLEAN = (1, "fine", 5, ("ok", ("ok", 1)), ["ok"], [(["ok"], 1)], {"k": "ok"}, {"k": [("ok",)]}, '{"a": ["ok", {"b": 1}]}', [1])


def planted(i, value):
    row = list(CLEAN)
    row[i] = value
    return tuple(row)


CASES = [
    (planted(1, f"mail {MAIL}"), "plain"), (planted(3, (MAIL, None)), "one.a"), (planted(3, ("ok", (MAIL, 1))), "one.b.c"), (planted(4, ["ok", None, MAIL]), "list[2]"),
    (planted(5, [([], 1), (["ok", MAIL], 2)]), "deep[1].x[1]"), (planted(6, {"k": MAIL}), "m[k]"), (planted(6, {MAIL: "ok"}), "m.keys"), (planted(7, {"q": [("ok",), (MAIL,)]}), "mm[q][1].z"),
    (planted(8, json.dumps({"a": ["ok", {"b": MAIL}]})), "doc:$.a[1].b"), (planted(8, json.dumps({MAIL: 1})), "doc:$.keys"), (planted(8, json.dumps([4111111111111111])), "doc:$[0]"),
    (planted(1, json.dumps(["café " + MAIL])), "plain:$[0]"), (planted(8, "{no json " + MAIL), "doc"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_a_leak_is_reported_with_its_path(spark, case):
    row, path = CASES[case]
    found = leak_paths(spark.createDataFrame([CLEAN, (2, *row[1:])], SCHEMA), ["id"]).collect()
    assert [(r.id, r.path) for r in found] == [(2, path)]
    assert found[0].type in ("email", "credit_card") and MAIL not in found[0].preview


def test_texts_of_rows_without_any(spark):
    nothing = tuple([9] + [None] * 9)
    assert texts_of_rows(spark.createDataFrame([nothing], SCHEMA), ["id"]).count() == 0
    assert texts_of_rows(spark.createDataFrame([(1, 2)], "id int, n int"), ["id"]).count() == 0
    assert leak_paths(spark.createDataFrame([], SCHEMA), ["id"]).count() == 0


def test_every_text_is_searched_once_and_repeated_findings_keep_their_paths(spark):
    row = planted(4, [MAIL, MAIL])
    assert sorted(r.path for r in leak_paths(spark.createDataFrame([row], SCHEMA), ["id"]).collect()) == ["list[0]", "list[1]"]
