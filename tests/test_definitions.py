"""Reports and schemas from files, and the templates in them."""

import datetime
import json

import pytest
from colligo.plans import definitions, templates
from colligo.plans.reports import Registry
from colligo.sources import schemas


def rendered(text, **values):
    return templates.render(templates.parse(text), values)


def test_parameters_are_bound():
    assert rendered("a = {{x}} AND b = '{{ x }}'", x="it's") == ("a = :x AND b = :x", {"x": "it's"})
    assert rendered("a LIKE '%{{x}}_{{y}}' OR a = '{x}'", x="u", y=3) == ("a LIKE concat('%', CAST(:x AS STRING), '_', CAST(:y AS STRING), '') OR a = '{x}'", {"x": "u", "y": 3})
    assert rendered("x = {{x}};", x=None) == ("x = :x", {"x": None})


def test_blocks():
    text = "SELECT 1 WHERE 1 = 1 {? AND a >= {{low}} {? AND a <= {{high}} ?} ?}{? AND b ?}"
    assert rendered(text, low=1, high=2) == ("SELECT 1 WHERE 1 = 1  AND a >= :low  AND a <= :high   AND b", {"low": 1, "high": 2})
    assert rendered(text, low=1, high=None)[1] == {"low": 1}
    assert rendered(text, low=None, high=2) == ("SELECT 1 WHERE 1 = 1  AND b", {})


def test_what_looks_like_a_template_but_is_none():
    text = "SELECT '{? it''s ?}', `{{q}}`, \"{{r}}\" -- {{gone}} {?\n/* {{gone}} ' */ FROM t"
    sql, bound = rendered(text)
    assert bound == {} and "'{? it''s ?}', `{{q}}`, \"{{r}}\"" in sql and "gone" not in sql


@pytest.mark.parametrize(("text", "said"), [("a\n{? b", "line 2: a block is not closed"), ("a ?}", "does not fit"), ("{{a b}}", "does not fit"), ("x = 'a", "does not fit"), ("/* x", "does not fit")])
def test_faults_are_told(text, said):
    with pytest.raises(ValueError, match=said):
        templates.parse(text)


def test_values_never_become_text(spark):
    lines = spark.createDataFrame([("a", 1), ("b' OR '1'='1", 2)], "k string, v int")
    report = definitions.definition({"name": "r", "requires": ["lines"], "parameters": [{"name": "k"}], "sql": "SELECT v FROM lines WHERE 1 = 1 {? AND k = '{{k}}' ?} ORDER BY v"})
    run = lambda **p: [r["v"] for r in Registry([report]).run("r", {"lines": lines}, p).data.collect()]
    assert run() == [1, 2] and run(k="b' OR '1'='1") == [2] and run(k="'; DROP VIEW lines --") == []


def test_folder(spark, tmp_path):
    """Good definitions of a folder are registered, each bad one is told."""
    good = {"name": "by_day", "description": "d", "category": "c", "tags": ["x"], "requires": {"shifts": ["day"]}, "parameters": [{"name": "since", "type": "date"}, {"name": "least", "type": "integer", "default": 1}], "sql": "SELECT day, count(*) AS n FROM shifts WHERE 1=1 {? AND day >= '{{since}}' ?} GROUP BY day HAVING count(*) >= {{least}}"}
    (tmp_path / "a.json").write_text(json.dumps([good, good | {"name": "bad", "sql": "SELECT {{other}}"}, {"name": "empty"}, 5]))
    (tmp_path / "b.yaml").write_text("name: all\nsql: |\n  SELECT 'é' AS x\n")
    (tmp_path / "c.yml").write_text("a: [")
    (tmp_path / "d.txt").write_text("not read")
    registry, errors = definitions.load(spark, str(tmp_path))
    assert registry.names() == ["all", "by_day"] and sorted(errors) == ["a.json#1", "a.json#2", "a.json#3", "c.yml"]
    assert "undeclared parameters: other" in errors["a.json#1"] and registry.get("by_day").tags == ["x"]
    shifts = spark.createDataFrame([(datetime.date(2024, 1, d),) for d in (1, 1, 2, 3)], "day date")
    run = lambda **p: registry.run("by_day", {"shifts": shifts}, p)
    assert run().row_count == 3 and run(since="2024-01-02").row_count == 2 and run(least="2").row_count == 1
    assert "since" in run(since="x").error or "Invalid" in run(since="x").error
    assert registry.run("by_day", {}).error == "not loaded: shifts" and registry.run("all", {}).data.first()["x"] == "é"
    assert definitions.load(spark, f"{tmp_path}/none")[0].names() == []


def test_schemas_from_files(spark, tmp_path):
    own = {"name": "visits", "vertical": "v", "fields": [{"name": "day", "type": "date", "required": True, "target_format": "YYYY-MM-DD", "aliases": ["date"], "description": "day of it"}, {"name": "minutes", "target_unit": "minutes"}]}
    (tmp_path / "a.json").write_text(json.dumps(own))
    (tmp_path / "b.json").write_text(json.dumps({"name": "x"}))
    documents, _ = definitions.read_documents(spark, str(tmp_path))
    fields, errors = schemas.from_documents(spark, documents, {"v": {"terminology": {"day": ["fecha", "date"]}, "field_contexts": {"day": {"semantic_description": "when"}}}})
    assert list(errors) == ["b.json"]
    assert [tuple(r) for r in fields.orderBy("field_position").collect()] == [("v", "visits", 0, "day", "date", True, "YYYY-MM-DD", ["date", "fecha"], "day of it when"), ("v", "visits", 1, "minutes", "string", False, "minutes", [], None)]
