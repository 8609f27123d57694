import json

import pytest

from codeloom.operators import contracts
from codeloom.sources import readers, writers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_jsonl_fails_on_a_bad_line_and_skips_blank_ones(spark, tmp_path):
    good = put(tmp_path / "good.jsonl", '{"id":"1","text":"a"}\n\n{"id":"2"}\n')
    assert sorted((r.id, r.text) for r in readers.read_jsonl(spark, good).collect()) == [("1", "a"), ("2", None)]
    bad = put(tmp_path / "bad.jsonl", '{"id":"1"}\n{"id":\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, bad).collect()
    assert readers.read_jsonl_or_empty(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_checkpoint_sets_corrupt_lines_aside(spark, tmp_path):
    path = put(tmp_path / "c.jsonl", '{"id":"1","codigos_abiertos":["a"]}\n{"id":"2","cod\n\n{"id":"3","error":"e"}\n')
    rows, corrupt = readers.read_checkpoint(spark, path)
    assert sorted((r.id, r.codigos_abiertos, r.error) for r in rows.collect()) == [("1", ["a"], None), ("3", None, "e")]
    assert [r.line for r in corrupt.collect()] == ['{"id":"2","cod']
    assert readers.read_checkpoint(spark, str(tmp_path / "none")).valid.count() == 0


def test_checked_jsonl(spark, tmp_path):
    lines = ['{"id_fragmento":"1","fragmento_original":"t","unified_code_ids":["c"]}', '{"id_fragmento":1,"fragmento_original":"t"}', "oops"]
    path = put(tmp_path / "i.jsonl", "\n".join(lines))
    valid, rejects = readers.read_jsonl_checked(spark, path, contracts.INSIGHT)
    assert [(r.id_fragmento, r.unified_code_ids) for r in valid.collect()] == [("1", ["c"])]
    assert {r.line: r.errors for r in rejects.collect()} == {lines[1]: ["$.id_fragmento:type"], "oops": ["$:unparsable"]}


def test_codebook_document(spark, tmp_path):
    book = {"codes": [{"id": "a", "label": "A", "embedding": [1, 2.5]}, {"id": "b", "label": "B", "count": None}], "metadata": {"embedding_dim": 2}}
    path = put(tmp_path / "codebook.json", json.dumps(book, indent=2))
    got = readers.read_codebook(spark, path).orderBy("ord").collect()
    assert [(r.id, r.embedding, r["count"], r.ord) for r in got] == [("a", [1.0, 2.5], 1, 0), ("b", None, None, 1)]
    assert readers.read_codebook(spark, str(tmp_path / "none.json")).count() == 0
    for text in ('{"codes": [{"id": 1, "label": "A"}]}', "{broken"):
        with pytest.raises(Exception):
            readers.read_codebook(spark, put(tmp_path / "bad.json", text)).collect()


def test_categories_document(spark, tmp_path):
    rows = [{"category_id": "cat_1", "category_name": "A", "code_assignments": [{"code_id": "x"}]}, {"category_id": 2, "category_name": "B"}]
    path = put(tmp_path / "cats.json", json.dumps(rows, indent=4))
    valid, rejects = readers.read_categories(spark, path)
    assert [(r.ord, r.category_id, [a.code_id for a in r.code_assignments]) for r in valid.collect()] == [(0, "cat_1", ["x"])]
    assert [(r.ord, r.errors) for r in rejects.collect()] == [(1, ["$.category_id:type"])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("2", "ñ")], "id string, text string")
    path = str(tmp_path / "out")
    writers.write_jsonl(df, path)
    writers.append_jsonl(df.limit(1), path)
    assert readers.read_jsonl(spark, path).count() == 3
    lines = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "out").glob("part-*"))
    assert '"text":null' in lines and "ñ" in lines
    one = writers.write_version(df, str(tmp_path / "v"), 3)
    writers.write_version(df.limit(1), str(tmp_path / "v"), 3)
    assert spark.read.parquet(one).count() == 1
    csv = str(tmp_path / "csv")
    df.write.option("header", "true").csv(csv)
    assert readers.read_table(spark, csv, "csv").columns == ["id", "text"]


def test_what_is_written_is_read_back(spark, tmp_path):
    from codeloom.operators import codebook as cb
    from codeloom.sources import writers

    book = spark.createDataFrame([("i1", "l1", "d", [0.5, 1.0], 3, 1), ("i2", "l2", None, None, 1, 2)], cb.SCHEMA)
    writers.write_codebook(book, str(tmp_path / "book"), 2)
    back = readers.read_codebook(spark, str(tmp_path / "book")).orderBy("ord").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in book.orderBy("ord").collect()]
    assert readers.read_embedding_dim(spark, str(tmp_path / "book")) == 2
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.json").write_text('{"id": "i1", "label": 4}\n')
    with pytest.raises(Exception, match="label"):
        readers.read_codebook(spark, str(tmp_path / "broken")).collect()
    named = spark.createDataFrame([("c1", "C", [("i1",)], 0), ("c2", None, [], 1)], "category_id string, category_name string, code_assignments array<struct<code_id:string>>, ord long")
    writers.write_categories(named, str(tmp_path / "cats"))
    valid, rejects = readers.read_categories(spark, str(tmp_path / "cats"))
    assert [(r.ord, r.category_id) for r in valid.collect()] == [(0, "c1")] and [r.ord for r in rejects.collect()] == [1]
    (tmp_path / "cats.json").write_text('{"a": [\n 1]}')
    valid, rejects = readers.read_categories(spark, str(tmp_path / "cats.json"))
    assert valid.count() == 0 and [r.errors for r in rejects.collect()] == [["$:not_a_list"]]


def test_a_failing_prompt_fails_alone(spark):
    from codeloom.operators import model

    asked = spark.createDataFrame([(str(k), f"p{k}") for k in range(20)], "id string, prompt string").coalesce(1)

    def responder(prompts, models):
        if "p7" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    got = {r.id: (r.response, r.error) for r in model.respond(asked, responder).collect()}
    assert got["7"] == (None, "ValueError: no") and all(got[str(k)] == (f"P{k}", None) for k in range(20) if k != 7)

    def embedder(texts):
        if "p3" in texts:
            raise ValueError("no")
        return [[1.0]] * len(texts)

    assert [r.id for r in model.embed(asked, "prompt", embedder).where("embedding IS NULL").collect()] == ["3"]


def test_a_repeated_append_replaces_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "sink")
    of = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "id string, text string")
    assert readers.read_appended(spark, path).collect() == []
    writers.append_once(of("1", "2"), path, "a")
    writers.append_once(of("3"), path, "b")
    writers.append_once(of("1", "4"), path, "a")
    assert sorted((r.id, r.run_id) for r in readers.read_appended(spark, path).collect()) == [("1", "a"), ("3", "b"), ("4", "a")]
    writers.append_once(of(), path, "b")
    of("9").write.json(f"{path}/data/torn")  # a run that ended before its entry was written
    assert sorted(r.id for r in readers.read_appended(spark, path).collect()) == ["1", "4"]
