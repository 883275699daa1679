"""Answers of a model: what is accepted, and how names are matched."""

import pytest

from sourceloom.operators import analysis as op


def parsed(spark, answers, parse=op.parse_enhanced):
    rows = spark.createDataFrame(list(enumerate(answers)), "path int, response string")
    good, rejected = parse(rows)
    found = {r.path: r.analysis.asDict(recursive=True) for r in good.collect()}
    assert sorted([*found, *(r.path for r in rejected.collect())]) == list(range(len(answers)))
    return found


METRICS = '{"Impact":1.0,"Type":2.50,"impact":3,"x":1e3,"y":"A"}'
WANTED = {"Impact": "1.0", "Type": "2.5", "impact": "3", "x": "1000.0", "y": "A"}


def test_keys_of_maps_stay(spark):
    refs = '{"Components":["a"],"components":["B",1,null]}'
    spelled = [("code_quality_metrics", "cross_references"), ("Code_Quality_Metrics", "CROSS_references")]
    found = parsed(spark, [f'{{"{m}":{METRICS},"{r}":{refs}}}' for m, r in spelled])
    for k in range(2):
        assert found[k]["code_quality_metrics"] == WANTED
        assert found[k]["cross_references"] == {"Components": ["a"], "components": ["B", "1", ""]}
        assert found[k]["insights"] == [] and found[k]["architectural_patterns"] == []


def test_names_match_by_path(spark):
    text = '{"INSIGHTS":[{"Type":"t","IMPACT":"High","components":["Type"]},null,{"impact":"a","Impact":"b","description":{"Type":1}}],"Other":1}'
    (found,) = parsed(spark, [text]).values()
    assert found["insights"] == [
        {"type": "t", "description": "", "impact": "High", "components": ["Type"]},
        {"type": "", "description": "", "impact": "", "components": []},
        {"type": "", "description": '{"Type":1}', "impact": "a", "components": []},
    ]


def test_last_spelling_counts(spark):
    found = parsed(spark, ['{"Insights":[],"insights":[{"type":"last"}]}', '{"insights":[{"Type":"first"}],"Insights":[]}'])
    assert [len(found[k]["insights"]) for k in range(2)] == [1, 0]


@pytest.mark.parametrize("name", ["insights", "Insights"])
def test_rejected_whole(spark, name):
    bad = [
        f'{{"{name}":[]}}}}', f'{{"{name}":[]}} x', f'{{"{name}":[]}},"b":2', f'{{"{name}":[]}}],"x":[{{}}', f'[{{"{name}":[]}}]', f'{{"{name}":[]',
        f'```json\n{{"{name}":[]}}\n```', f'{{"{name}":"x"}}', f'{{"{name}":["x"]}}', f'{{"{name}":{{}}}}', f"{{'{name}':[]}}", f'{{"{name}":[],"code_quality_metrics":[]}}',
        f'{{"{name}":[],"cross_references":{{"a":"b"}}}}', f'{{"{name}":[],"code_quality_metrics":{{"a":NaN}}}}', f'{{"{name}":[{{"components":"x"}}]}}', f'{{"{name}":[]}}{{}}',
    ]
    assert parsed(spark, [*bad, None, "", "{", f' {{"{name}":[]}}\n']).keys() == {len(bad) + 3}


def test_first_schema(spark):
    texts = [
        '{"Purpose":"p","Components":[{"Name":"A","dependencies":["a.B"],"notable_features":null},null],"relationships":[{"From":"A","to":"B"}],"insights":["Type"]}',
        '{"purpose":"p","components":[{"name":"A","dependencies":["a.B"]},{}],"relationships":[{"from":"A","to":"B"}],"insights":["Type"]}',
    ]
    found = parsed(spark, texts, op.parse_analysis)
    assert found[0] == found[1]
    assert found[0]["components"][0]["dependencies"] == ["a.B"] and found[0]["relationships"] == [{"from": "A", "to": "B", "type": ""}]


def test_quotes_inside_texts_are_no_names(spark):
    text = '{"purpose":"\\"Purpose\\": x, Type\\":","components":[]}'
    assert parsed(spark, [text], op.parse_analysis)[0]["purpose"] == '"Purpose": x, Type":'
