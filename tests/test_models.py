"""Asking models: errors that pass, and analyses united in rounds."""


import pytest

from codeloom.operators import model, uniting

FAST = model.Retry(first_wait=1.0, longest_wait=5.0, batch=8)


def test_only_listed_errors_are_waited_out():
    met, waits, sizes = set(), [], []

    def call(items):
        sizes.append(len(items))
        for x in items:
            if x % 10 == 3 and x not in met:
                met.add(x)
                raise TimeoutError("later")
            if x % 10 == 7:
                raise ValueError("never")
        return [x * 2 for x in items]

    answers, errors = model.retrying(call, list(range(30)), FAST, waits.append)
    assert answers == [None if x % 10 == 7 else x * 2 for x in range(30)]
    assert errors == ["ValueError: never" if x % 10 == 7 else None for x in range(30)]
    assert waits == [1.0] and max(sizes) == 8  # the second round found nothing that passes


def test_tries_end_and_waits_grow():
    asked, waits = [], []

    def call(items):
        asked.append(list(items))
        if "bad" in items:
            raise ConnectionError("down")
        return [x.upper() for x in items]

    answers, errors = model.retrying(call, ["a", "bad", "b"], FAST, waits.append)
    assert answers == ["A", None, "B"] and errors == [None, "ConnectionError: down", None]
    assert waits == [1.0, 2.0, 4.0, 5.0] and sum("bad" in x for x in asked) == FAST.tries


def test_an_answer_too_few_is_an_error_of_its_items():
    answers, errors = model.retrying(lambda items: items[:1] if len(items) > 1 else [], ["a"], FAST, lambda s: None)
    assert answers == [None] and errors == ["ValueError: 0 answers to 1 items"]
    assert model.retrying(lambda items: 1 / 0, [], FAST) == ([], [])


def test_calls_keep_their_distance():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 3))
        now[0] += s

    model.retrying(lambda items: items, list(range(4)), FAST._replace(batch=2, interval=0.5), sleep, lambda: now[0])
    assert waits == [0.5]


def test_embedding_retries_inside_tasks(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None), (4, " "), (5, "cccc")], "k long, label string")

    def embedder(texts, met=[]):  # noqa: B006
        if "b" in texts and not met:
            met.append(1)
            raise TimeoutError("later")
        if "cccc" in texts:
            raise KeyError("x")
        return [[float(len(t))] for t in texts]

    got = model.embed(df.coalesce(1), "label", embedder, model.Retry(first_wait=0.0), "error").collect()
    assert sorted((r.k, r.embedding, r.error) for r in got) == [(1, [2.0], None), (2, [1.0], None), (3, None, None), (4, None, None), (5, None, "KeyError: 'x'")]


# Uniting ------------------------------------------------------------------------------------------

ITEM = "array<struct<description:string,evidence_insight_ids:array<string>>>"
PROPERTY = "array<struct<property_name:string,property_description:string,dimensional_range:string,evidence_insight_ids:array<string>>>"
MODEL = ",".join(f"{c}:{ITEM}" for c in uniting.COMPONENTS)
AXIAL = f"category_id string, category_name string, part long, analysis struct<paradigm_model:struct<{MODEL}>,properties_and_dimensions:{PROPERTY}>, ord long"


def analysis(context=(), properties=()):
    lists = {c: [] for c in uniting.COMPONENTS} | {"context": [(d, list(ids)) for d, ids in context]}
    return (tuple(lists[c] for c in uniting.COMPONENTS), [("p", d, "low to high", list(ids)) for d, ids in properties])


def united(spark, rows, responder):
    done = uniting.unite(spark.createDataFrame(rows, AXIAL), responder, "{category_name}##{analyses_json}")
    found = {r.category_id: r for r in done.valid.collect()}
    assert done.valid.count() == len(found) and all(r.part == 0 for r in found.values())
    told = {c: ([(x.description, x.evidence_insight_ids) for x in r.analysis.paradigm_model.context], [(x.property_description, x.evidence_insight_ids) for x in r.analysis.properties_and_dimensions]) for c, r in found.items()}
    return told, sorted(tuple(r) for r in done.rejects.collect())


def by_description():
    """A model that unites items told alike, and leaves out one."""

    def responder(prompts, models):
        import json as j

        out = []
        for p in prompts:
            name, body = p.split("##")
            told = {}
            for x in j.loads(body)["paradigm_model"]["context"]:
                if x["description"] != "odd one":
                    told.setdefault(x["description"], []).extend(x["evidence_insight_ids"])
            items = [{"description": d, "evidence_insight_ids": ids + ["9.context.9", "made up"]} for d, ids in sorted(told.items())]
            out.append("?" if name == "Silent" else j.dumps({"paradigm_model": {"context": items}}))
        return out

    return responder


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 8])
def test_parts_become_one_analysis_with_all_evidence(spark, parts):
    rows = [("c", "C", 10 * k, analysis([("same", [f"i{k}", "shared"]), *([("odd one", ["o"])] if k == 1 else [])]), 4) for k in range(parts)]
    rows.append(("d", "D", 0, analysis([("alone", ["x"])], [("prop", ["y", "z"])]), 5))
    told, rejects = united(spark, rows, by_description())
    expected = [("same", sorted({"shared", *(f"i{k}" for k in range(parts))}))] + ([("odd one", ["o"])] if parts > 1 else [])
    assert told["c"] == (expected, []) and told["d"] == ([("alone", ["x"])], [("prop", ["y", "z"])]) and rejects == []


def test_unusable_answers_keep_every_item(spark):
    rows = [("s", "Silent", k, analysis([(f"d{k}", [f"i{k}"])], [(f"q{k}", ["e"])]), 1) for k in range(3)] + [("e", "E", k, analysis(), 2) for k in range(2)]
    told, rejects = united(spark, rows, by_description())
    assert told["s"] == ([(f"d{k}", [f"i{k}"]) for k in range(3)], [(f"q{k}", ["e"]) for k in range(3)])
    assert told["e"] == ([], []) and [(c, turn, part) for c, turn, part, _ in rejects] == [("s", 1, 0), ("s", 2, 0)]


def test_evidence_does_not_travel_in_prompts(spark):


    def responder(prompts, models):
        import json as j

        out = []
        for p in prompts:
            assert "secret" not in p
            items = j.loads(p.split("##")[1])["paradigm_model"]["context"]
            out.append(j.dumps({"paradigm_model": {"context": [{"description": "u", "evidence_insight_ids": [i for x in items for i in x["evidence_insight_ids"]]}]}}))
        return out

    told, _ = united(spark, [("c", "C", k, analysis([("d", [f"secret {k}"])]), 1) for k in range(4)], responder)
    assert told["c"][0] == [("u", [f"secret {k}" for k in range(4)])]
