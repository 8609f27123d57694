import json
import re

from pyspark.sql import functions as F

from codeloom.functions import parsing
from codeloom.operators import contracts as C

PROBES = [
    'Sure:\n```json\n{"a": [1, 2]}\n```\nbye', 'x {"a":1} y', '[{"a":1}]', "no json", "", None, '{"a":1} and {"b":2}',
    'note [see] {"a":1}', "{}", "[]", "```json\n{\"a\":", '{"a": "}"} tail', '```json[1]``` {"b":2}', '{"a":1}}', "[1, 2", '{"a": nope}',
    '```json\n\n[ {"a": {"b": [1]}} ]\n\n```', "null", '"text"', "{'a': 1}", '{"a":1,}', "[null]", '{"ñ": "é"}',
]


def literal(text):
    """What the extraction means, written out in Python."""
    match = re.search(r"```json\s*(\{.*\}|\[.*\])\s*```|(\{.*\}|\[.*\])", text or "", re.DOTALL)
    if not match:
        return "no_json", None
    try:
        value = json.loads(match.group(1) or match.group(2))
    except json.JSONDecodeError:
        return "unparsable", None
    return ("ok" if value else "empty_json"), value


def test_extraction_matches_literal_form(spark):
    df = spark.createDataFrame(list(enumerate(PROBES)), "n int, r string")
    out = parsing.with_parsed(df, "r").select("n", "status", F.to_json("value").alias("v")).orderBy("n").collect()
    for row, text in zip(out, PROBES):
        status, value = literal(text)
        assert row.status == status, text
        if status == "ok":
            assert json.loads(row.v) == value


def errors(spark, contract, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "n int, j string").withColumn("v", parsing.parse_strict(F.col("j")))
    return [r[0] for r in df.orderBy("n").select(C.errors_of(contract, F.col("v"))).collect()]


def test_coding_contract(spark):
    good = '{"id_fragmento":"1","fragmento_original":"t","codigos_abiertos":["a"]'
    cases = {
        good + "}": [],
        good + ',"error":null,"extra":5}': [],
        good + ',"error":3}': ["$.error:type"],
        '{"id_fragmento":1,"fragmento_original":"t","codigos_abiertos":[]}': ["$.id_fragmento:type"],
        '{"id_fragmento":"1","fragmento_original":"t"}': ["$.codigos_abiertos:missing"],
        '{"id_fragmento":"1","fragmento_original":"t","codigos_abiertos":"a"}': ["$.codigos_abiertos:type"],
        '{"id_fragmento":"1","fragmento_original":null,"codigos_abiertos":["a",2,null]}':
            ["$.fragmento_original:null", "$.codigos_abiertos[1]:type", "$.codigos_abiertos[2]:type"],
        "[1]": ["$:type"],
    }
    assert errors(spark, C.CODING_RESULT, list(cases)) == list(cases.values())


def test_lenient_scalars(spark):
    def record(new, count="1"):
        return f'{{"is_new":{new},"count":{count}}}'

    contract = C.Record({"is_new": C.Key(C.BOOLEAN), "count": C.Key(C.INTEGER, required=False, nullable=True, default="1L")})
    cases = [
        ("true", "5", True, 5), ('"yes"', '"5"', True, 5), ('"OFF"', "5.0", False, 5), ("0", '" 7 "', False, 7), ("1", '"5.0"', True, 5),
        ("1.0", "null", True, None), ("true", "9007199254740993", True, 9007199254740993),
    ]
    df = spark.createDataFrame([(n, record(a, b)) for n, (a, b, _, _) in enumerate(cases)], "n int, j string")
    split = C.validate(df.withColumn("value", parsing.parse_strict(F.col("j"))), contract, keep=("n",))
    got = [(r.is_new, r["count"]) for r in split.valid.orderBy("n").collect()]
    assert got == [(x, y) for _, _, x, y in cases]
    assert errors(spark, contract, [record("2"), record('"maybe"'), record("true", "5.5"), record("true", '"x"'), '{"is_new":null}']) == [
        ["$.is_new:type"], ["$.is_new:type"], ["$.count:type"], ["$.count:type"], ["$.is_new:null"],
    ]


def test_axial_contract_and_defaults(spark):
    item = '{"description":"d","evidence_insight_ids":["1"]}'
    prop = '{"property_name":"p","property_description":"d","dimensional_range":"r"}'
    docs = [
        f'{{"paradigm_model":{{"context":[{item}]}},"properties_and_dimensions":[{prop}]}}',
        '{"paradigm_model":{}}',
        '{"properties_and_dimensions":[]}',
        '{"paradigm_model":{"context":[{"evidence_insight_ids":[1]}]}}',
        '{"paradigm_model":{"context":null}}',
    ]
    assert errors(spark, C.AXIAL_RESULT, docs) == [
        [], [], ["$.paradigm_model:missing"],
        ["$.paradigm_model.context[0].description:missing", "$.paradigm_model.context[0].evidence_insight_ids[0]:type"],
        ["$.paradigm_model.context:null"],
    ]


def test_list_response_is_all_or_nothing(spark):
    good = '{"category_name":"c","is_new":true,"description":"d"}'
    df = spark.createDataFrame([(1, f"[{good},{good}]"), (2, f'[{good},{{"category_name":"c"}}]'), (3, good), (4, None)], "batch long, r string")
    split = C.validate_list_responses(df, C.CATEGORY_RESULT, "r", ("batch",))
    assert sorted((r.batch, r.pos, len(r.code_assignments)) for r in split.valid.collect()) == [(1, 0, 0), (1, 1, 0)]
    assert sorted((r.batch, r.reason) for r in split.rejects.collect()) == [(2, "bad_type"), (3, "bad_type"), (4, "no_json")]
