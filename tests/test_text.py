import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.prompts import render


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_strip_matches_python(spark):
    edges = ["", " ", " ", " ", "\u001c", "\u001f", "\u0085", "\t\n", "　", "​"]
    texts = [a + "x y" + b for a in edges for b in edges] + edges
    got = values(spark, [(t,) for t in texts], "t string", T.strip(F.col("t")))
    assert [g[0] for g in got] == [t.strip() for t in texts]


def test_worked_examples_follow_the_rules(spark):
    good = [
        "Sintiéndose perdido inicialmente", "Luchando por entender la iconografía", "Abandonando el proceso",
        "Navegando expectativas no declaradas", '[in vivo] "adivinando el futuro"', "reading aloud",
    ]
    bad = ["salario bajo", "tristeza", "[in vivo] sin comillas", "ing", ""]
    got = values(spark, [(x,) for x in good + bad], "c string", T.is_action_code(F.col("c")))
    assert [g[0] for g in got] == [True] * len(good) + [False] * len(bad)
    spanish = values(spark, [("reading aloud",)], "c string", T.is_action_code(F.col("c"), english=False))
    assert spanish == [(False,)]


def test_code_violations(spark):
    rows = [(["Buscando x", "tema"],), (["Buscando x"] * 4,), ([None],), ([],), (None,)]
    got = values(spark, rows, "c array<string>", F.transform(T.code_violations(F.col("c")), lambda v: v["rule"]))
    assert [g[0] for g in got] == [["not_a_gerund"], ["too_many_codes"], ["null_code"], [], []]


def test_action_labels_first_three_distinct(spark):
    rows = [("going, going on and running; corriendo, saltando y andando",), ("nothing? no: ing",), ("",), (None,)]
    got = values(spark, rows, "t string", T.action_labels(F.col("t")))
    assert [g[0] for g in got] == [["going", "running", "corriendo"], ["nothing"], [], None]


def test_json_text_equals_python(spark):
    texts = ['plain', 'quo"te', "back\\slash", "new\nline\ttab", "ñandú — ok", "", "a/b"]
    got = values(spark, [(t,) for t in texts], "t string", T.json_scalar(F.col("t")))
    assert [g[0] for g in got] == [json.dumps(t, ensure_ascii=False) for t in texts]
    assert values(spark, [(None,)], "t string", T.json_scalar(F.col("t"))) == [("null",)]


def test_indented_json_equals_python(spark):
    got = values(
        spark, [("7", "qué\n")], "id string, text string",
        T.indented_object({"id": T.json_scalar(F.col("id")), "text": T.json_scalar(F.col("text")), "codes": F.lit("[]")}),
    )
    assert got[0][0] == json.dumps({"id": "7", "text": "qué\n", "codes": []}, indent=2, ensure_ascii=False)
    items = F.transform("a", lambda x: T.indented_object({"code_id": T.json_scalar(x)}, level=1))
    lists = values(spark, [(["p", "q"],), ([],)], "a array<string>", T.indented_list(items))
    assert [x[0] for x in lists] == [json.dumps([{"code_id": c} for c in a], indent=2) for a in (["p", "q"], [])]


def test_render_is_format(spark):
    template = 'Name: {name}, again {name}. {{"keep": {{}}}} {other}'
    got = values(spark, [("x", None)], "a string, b string", render(template, {"name": F.col("a"), "other": F.col("b")}))
    assert got[0][0] == template.format(name="x", other="")
    with pytest.raises(KeyError):
        render("{missing}", {})


def test_small_expressions(spark):
    got = values(
        spark, [(["a", "b"], "", "abcdef")], "q array<string>, d string, t string",
        T.bullets(F.col("q")), T.or_default(F.col("d"), "none"), T.preview(F.col("t"), 3), T.section(F.lit("T"), F.col("t")),
    )
    assert got == [("- a\n- b", "none", "abc", "**T**\n\nabcdef")]


def test_strip_is_that_of_python_and_looks_at_the_ends_alone(spark):
    points = [chr(n) for n in range(1, 0x3100)]
    rows = [(c + "a" + c + c + "b" + c,) for c in points] + [(" 　\n",), ("",), (None,), ("a  ",), ("\r\n\x1ca\x85\r\n",)]
    df = spark.createDataFrame(rows, "s string").select("s", T.strip(F.col("s")).alias("t"))
    assert [r for r in df.collect() if r.t != (None if r.s is None else r.s.strip())] == []
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
