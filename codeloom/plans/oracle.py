"""The registered queries once more, as plain SQL over the given tables.

Shared inputs are common table expressions; :func:`sql` puts the ones a query needs in front.
"""

from __future__ import annotations

from codeloom.operators import report
from codeloom.plans import catalog as c

STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"
BLOCK = r"""(?s)```json\s*(\{.*\}|\[.*\])\s*```|(\{.*\}|\[.*\])"""


def strip(x: str) -> str:
    return STRIP.format(x)


def text(s: str) -> str:
    """A Python string as an SQL literal."""
    body = s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n")
    return f"E'{body}'"


VIEWS: dict[str, tuple[list[str], str]] = {
    "insights_src": ([], """
        SELECT doc_id AS src_ord,
          CASE WHEN doc_id % 17 = 5 THEN NULL WHEN doc_id % 19 = 7 THEN '   '
               ELSE '  ' || CAST(doc_id - (CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END) AS VARCHAR) || ' ' END AS id_raw,
          CASE WHEN doc_id % 23 = 3 THEN NULL WHEN doc_id % 29 = 4 THEN ' ' ELSE ' ' || text || ' ' END AS text_raw,
          CASE WHEN doc_id % 13 = 2 THEN NULL ELSE lang END AS method_raw, source AS source_raw
        FROM documents"""),
    "normalised": (["insights_src"], f"""
        SELECT *, CASE WHEN id IS NULL THEN 'null_id' WHEN id = '' THEN 'blank_id'
                       WHEN text IS NULL THEN 'null_text' WHEN text = '' THEN 'blank_text' END AS reason
        FROM (SELECT src_ord, {strip('id_raw')} AS id, {strip('text_raw')} AS text,
                coalesce({strip('method_raw')}, 'unknown') AS method, coalesce({strip('source_raw')}, 'unknown') AS source
              FROM insights_src)"""),
    "clean": (["normalised"], "SELECT src_ord, id, text, method, source FROM normalised WHERE reason IS NULL"),
    "metadata": (["clean"], "SELECT id, arg_max(method, src_ord) AS method, arg_max(source, src_ord) AS source FROM clean GROUP BY id"),
    "occurrences": ([], r"""
        SELECT doc_id, label, min(p) AS p FROM (
          SELECT doc_id, unnest(l) AS label, unnest(range(len(l))) AS p
          FROM (SELECT doc_id, regexp_extract_all(text, '\b(\p{L}{2,}(?:ing|ando|endo|iendo))\b', 1) AS l FROM documents))
        GROUP BY doc_id, label"""),
    "open_codes": (["occurrences"], """
        SELECT doc_id, pos, label FROM (
          SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS pos FROM occurrences) WHERE pos <= 3"""),
    "codes": (["open_codes"], """
        SELECT label, 'code_' || substr(sha256(label), 1, 32) AS code_id, n, row_number() OVER (ORDER BY label) AS ord
        FROM (SELECT label, count(*) AS n FROM open_codes GROUP BY label)"""),
    "established": (["codes"], "SELECT * FROM codes WHERE n > 1"),
    "category_codes": (["codes"], """
        SELECT 'cat_' || CAST(length(label) % 11 + 1 AS VARCHAR) AS category_id, code_id FROM codes
        UNION SELECT 'cat_7', code_id FROM codes WHERE label LIKE '%er%'"""),
    "categories": (["category_codes"], "SELECT DISTINCT category_id, CASE category_id " + " ".join(
        f"WHEN 'cat_{n + 1}' THEN {text(x[0])}" for n, x in enumerate(report.CLUSTERS) if n < 10
    ) + " ELSE 'Otros' END AS category_name FROM category_codes"),
    "evidence": (["open_codes", "codes"], """
        SELECT k.code_id, CAST(o.doc_id AS VARCHAR) AS id_fragmento, o.pos FROM open_codes o JOIN codes k ON k.label = o.label"""),
    "axial_items": (["evidence", "category_codes"], """
        SELECT DISTINCT c.category_id,
          CASE CAST(e.id_fragmento AS INT) % 6 WHEN 0 THEN 'causal_conditions' WHEN 1 THEN 'context'
            WHEN 2 THEN 'intervening_conditions' WHEN 3 THEN 'action_strategies' WHEN 4 THEN 'consequences'
            ELSE 'properties_and_dimensions' END AS component,
          CASE WHEN CAST(e.id_fragmento AS INT) % 37 = 0 THEN 'missing_' || e.id_fragmento ELSE e.id_fragmento END AS insight_id
        FROM evidence e JOIN category_codes c ON c.code_id = e.code_id"""),
    "cited": (["axial_items"], "SELECT DISTINCT category_id, insight_id FROM axial_items"),
    "resolved": (["cited"], """
        SELECT r.category_id, r.insight_id, coalesce(nullif(d.text, ''), 'Referenced insight text not found for ID: ' || r.insight_id) AS text,
          nullif(d.text, '') IS NOT NULL AS found
        FROM cited r LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.insight_id"""),
    "measured": (["resolved"], """
        SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY category_id ORDER BY md5(insight_id), insight_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_chars FROM resolved"""),
    "parts": (["measured"], """
        SELECT category_id, insight_id, text, CAST(running_chars AS BIGINT) AS running_chars,
          running_chars <= 100000 AS within_budget, CAST(floor((running_chars - n) / 100000) AS BIGINT) AS part FROM measured"""),
    "responses": (["open_codes"], r"""
        SELECT doc_id, CASE doc_id % 9
          WHEN 0 THEN E'Sure:\n```json\n' || js || E'\n```\nDone.' WHEN 1 THEN 'Result: ' || js WHEN 2 THEN 'no json here'
          WHEN 3 THEN NULL WHEN 4 THEN E'```json\n' || substr(js, 1, 30) WHEN 5 THEN '{}' WHEN 6 THEN js || ' and ' || js
          WHEN 7 THEN replace(js, '"id_fragmento":"' || CAST(doc_id AS VARCHAR) || '"', '"id_fragmento":' || CAST(doc_id AS VARCHAR))
          ELSE 'note [see] ' || js END AS response
        FROM (SELECT d.doc_id, '{"id_fragmento":"' || CAST(d.doc_id AS VARCHAR) || '","fragmento_original":"doc '
            || CAST(d.doc_id AS VARCHAR) || '","codigos_abiertos":[' || coalesce(o.ls, '') || '],"extra":1}' AS js
          FROM documents d LEFT JOIN (SELECT doc_id, string_agg('"' || label || '"', ',' ORDER BY pos) AS ls FROM open_codes GROUP BY doc_id) o
            ON o.doc_id = d.doc_id)"""),
    "extracted": (["responses"], f"""
        SELECT doc_id, coalesce(nullif(regexp_extract(response, '{BLOCK}', 1), ''), nullif(regexp_extract(response, '{BLOCK}', 2), '')) AS block
        FROM responses"""),
    "parsed": (["extracted"], """
        SELECT doc_id, block, CASE WHEN block IS NULL THEN 'no_json' WHEN NOT json_valid(block) THEN 'unparsable'
          WHEN block IN ('{}', '[]') THEN 'empty_json' ELSE 'ok' END AS status FROM extracted"""),
    "judged": (["parsed"], """
        SELECT doc_id, block, CASE WHEN status <> 'ok' THEN status
          WHEN json_type(CASE WHEN status = 'ok' THEN block END, '$.id_fragmento') <> 'VARCHAR' THEN 'bad_type' ELSE 'ok' END AS status FROM parsed"""),
    "coding": (["judged"], """
        SELECT doc_id, block ->> '$.id_fragmento' AS id_fragmento, block ->> '$.fragmento_original' AS fragmento_original,
          array_to_string(block ->> '$.codigos_abiertos[*]', '|') AS codes, CAST(NULL AS VARCHAR) AS error
        FROM judged WHERE status = 'ok'"""),
    "done": ([], """
        SELECT CASE WHEN lang = 'en' THEN CAST(doc_id AS VARCHAR) ELSE '' END AS id, CAST(doc_id AS VARCHAR) AS id_fragmento
        FROM documents WHERE source IN ('src1', 'src2', 'src3')"""),
    "category_items": (["open_codes"], """
        SELECT d.doc_id, CAST(0 AS BIGINT) AS pos, d.lang AS category_name,
          d.doc_id % 6 = 1 AS is_new, d.source AS description,
          CASE WHEN d.doc_id % 6 = 5 THEN 0 ELSE coalesce(o.n, 0) END AS n_codes
        FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM open_codes GROUP BY doc_id) o ON o.doc_id = d.doc_id
        WHERE d.doc_id % 6 IN (0, 1, 5)
        UNION ALL SELECT doc_id, 1, source, true, 'second', 0 FROM documents WHERE doc_id % 6 = 1"""),
    "category_assignments": (["open_codes"], """
        SELECT d.lang AS category_name, o.label AS code_id, d.doc_id AS batch, 0 AS pos, o.pos - 1 AS code_pos
        FROM documents d JOIN open_codes o ON o.doc_id = d.doc_id WHERE d.doc_id % 6 IN (0, 1)"""),
    "category_numbers": (["category_items"], """
        SELECT category_name, arg_min(description, (doc_id, pos)) AS description, 'cat_' || CAST(row_number() OVER (ORDER BY min((doc_id, pos))) AS VARCHAR) AS category_id
        FROM category_items GROUP BY category_name"""),
    "grams": (["codes"], """
        SELECT ord, label, g, count(*) AS w FROM (SELECT ord, label, substr(label, unnest(range(1, length(label) - 1)), 3) AS g FROM codes)
        GROUP BY ord, label, g"""),
    "norms": (["grams"], "SELECT ord, sum(w * w) AS n FROM grams GROUP BY ord"),
    # Place in the merge order: established codes first, then the others.
    "turns": (["codes"], "SELECT label, code_id, n, ord, row_number() OVER (ORDER BY n = 1, label) AS turn FROM codes"),
    "label_sims": (["grams", "norms"], """
        SELECT a.ord AS x, b.ord AS y, sum(a.w * b.w) / sqrt(max(na.n) * max(nb.n)) AS sim
        FROM grams a JOIN grams b ON a.g = b.g AND a.ord <> b.ord JOIN norms na ON na.ord = a.ord JOIN norms nb ON nb.ord = b.ord
        GROUP BY a.ord, b.ord"""),
    "code_matches": (["label_sims", "codes"], f"""
        SELECT a.label, b.label AS code_label, b.ord AS code_ord, s.sim FROM label_sims s
        JOIN codes a ON a.ord = s.x AND a.n = 1 JOIN codes b ON b.ord = s.y AND b.n > 1 WHERE s.sim >= {c.LABEL_THETA}"""),
    "vectors": ([], "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"),
    "seeds": (["codes"], """
        SELECT label AS keyword, 'seed_' || left(label, 1) AS category_name, row_number() OVER (ORDER BY left(label, 1), label) AS seed_ord
        FROM codes WHERE n >= 3"""),
    "seed_sims": (["grams", "norms", "seeds", "codes"], f"""
        SELECT k.code_id, s.category_name, s.seed_ord, x.sim FROM (
          SELECT a.ord AS x, b.ord AS y, sum(a.w * b.w) / sqrt(max(na.n) * max(nb.n)) AS sim
          FROM grams a JOIN grams b ON a.g = b.g JOIN norms na ON na.ord = a.ord JOIN norms nb ON nb.ord = b.ord
          WHERE b.label IN (SELECT keyword FROM seeds) GROUP BY a.ord, b.ord) x
        JOIN codes k ON k.ord = x.x JOIN codes kk ON kk.ord = x.y JOIN seeds s ON s.keyword = kk.label WHERE x.sim >= {c.SEED_CUTOFF}"""),
    "seed_fit": (["seed_sims"], """
        SELECT code_id, arg_max(category_name, (sim, -seed_ord)) AS category_name, max(sim) AS score FROM seed_sims GROUP BY code_id"""),
    "narratives": ([], r"""
        SELECT conv_id AS category_id, CAST(floor(turn / 1000) AS BIGINT) AS part, count(*) AS n_blocks,
          string_agg('**' || role || E'**\n\n' || text, E'\n\n---\n\n' ORDER BY turn) AS narrative
        FROM conversations WHERE role <> 'system' AND text <> '' GROUP BY 1, 2"""),
    # "conv 7" and the fixed text around it, 8 million characters to a part.
    "sections": (["narratives"], """
        SELECT row_number() OVER (ORDER BY category_id, part) AS p, 'conv ' || CAST(category_id AS VARCHAR) AS category_name, narrative,
          sum(length(narrative) + length(CAST(category_id AS VARCHAR)) + 5) OVER (ORDER BY category_id, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            - length(narrative) - length(CAST(category_id AS VARCHAR)) - 5 AS before,
          row_number() OVER (ORDER BY category_id, part) - 1 AS n_before FROM narratives"""),
    "report_sections": (["sections"], "SELECT *, CAST(floor((before + n_before * 13) / 8000000) AS BIGINT) AS part FROM sections"),
    "corpus_sections": (["sections"], f"SELECT *, CAST(floor((before + n_before * {len('## CATEGORÍA: ') + 6 + len(report.RULE)}) / 8000000) AS BIGINT) AS part FROM sections"),
    "report_parts": (["report_sections"], f"""
        SELECT part, count(*) AS n_sections, (CASE WHEN part = 0 THEN {text(report.REPORT_HEAD)} ELSE '' END)
          || string_agg('### ' || category_name || E'\\n\\n' || narrative || E'\\n\\n---\\n\\n', '' ORDER BY p) AS report FROM report_sections GROUP BY part"""),
    "clusters": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"({text(a)}, '{b}', {n}, {m})" for a, b, n, m in report.CLUSTERS
    ) + ") AS t(category_name, cluster, cluster_ord, category_ord)"),
    # The scripted coder's one label per text, and its category.
    "scripted": ([], """
        SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text, length(text) % 7 = 0 AS late, label, 'length ' || CAST(length(label) % 5 AS VARCHAR) AS category
        FROM (SELECT *, (""" + "[" + ", ".join(f"'{w}'" for w in c.CODE_WORDS) + f"""])[length(text) % {len(c.CODE_WORDS)} + 1] || ' ' || lpad(CAST(length(text) % 100 AS VARCHAR), 2, '0') AS label FROM documents)"""),
    # Evidence of a category in requests of 100,000 characters, and what is told of a request in pieces of that size.
    "told": (["evidence", "category_codes", "categories"], """
        SELECT *, CAST(floor((sum(n) OVER (PARTITION BY category_id, part ORDER BY md5(id), id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n) / 100000) AS BIGINT) AS piece
        FROM (SELECT p.*, length(d.text) AS n, CAST(floor((sum(length(d.text)) OVER (PARTITION BY category_id ORDER BY md5(id), id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(d.text)) / 100000) AS BIGINT) AS part
              FROM (SELECT DISTINCT c.category_id, k.category_name, CAST(substr(c.category_id, 5) AS BIGINT) AS ord, e.id_fragmento AS id FROM evidence e
                    JOIN category_codes c ON c.code_id = e.code_id JOIN categories k ON k.category_id = c.category_id) p
              JOIN documents d ON CAST(d.doc_id AS VARCHAR) = p.id)"""),
    "stream_turns": (["open_codes", "codes"], """
        SELECT c.label, c.code_id, c.n, c.ord, row_number() OVER (ORDER BY c.n = 1, CASE WHEN c.n = 1 THEN b.batch END, c.label) AS turn
        FROM codes c JOIN (SELECT label, min(doc_id % 3) AS batch FROM open_codes GROUP BY label) b ON b.label = c.label"""),
    "stream_labels": (["codes"], "SELECT label, code_id, 1 AS n, ord, ord AS turn FROM codes"),
}


def sql(views: list[str], body: str) -> str:
    needed: list[str] = []

    def visit(name: str) -> None:
        for v in VIEWS[name][0]:
            visit(v)
        if name not in needed:
            needed.append(name)

    for v in views:
        visit(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in needed)
    return f"WITH RECURSIVE {ctes}\n{body}" if needed else body


def greedy(nodes: str, pairs: str, forced: str = "0", tag: str = "") -> str:
    """CTEs of the one-by-one merge: ``nodes(t)`` numbered from 1, ``pairs(x, y, sim)`` with y < x.

    The first ``forced`` nodes are leaders whatever they resemble. The result is ``merged(x, y, sim)``.
    """
    return f""",
        gp{tag} AS ({pairs}), gn{tag} AS (SELECT t, {forced} AS forced FROM ({nodes})),
        nb{tag} AS (SELECT n.t, n.forced, coalesce(list(p.y) FILTER (p.y IS NOT NULL), []) AS js FROM gn{tag} n LEFT JOIN gp{tag} p ON p.x = n.t GROUP BY n.t, n.forced),
        g{tag}(t, ls) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
          SELECT n.t, CASE WHEN n.t > n.forced AND list_has_any(g.ls, n.js) THEN g.ls ELSE list_append(g.ls, n.t) END FROM g{tag} g JOIN nb{tag} n ON n.t = g.t + 1),
        lead{tag} AS (SELECT unnest(ls) AS t FROM g{tag} WHERE t = (SELECT max(t) FROM g{tag})),
        merged{tag} AS (
          SELECT t AS x, t AS y, CAST(NULL AS DOUBLE) AS sim FROM lead{tag}
          UNION ALL SELECT x, arg_max(y, (sim, -y)), max(sim) FROM gp{tag}
            WHERE y IN (SELECT t FROM lead{tag}) AND x NOT IN (SELECT t FROM lead{tag}) GROUP BY x)"""


def merge_vectors(theta: float) -> str:
    pairs = f"SELECT a.t AS x, b.t AS y, list_cosine_similarity(a.e, b.e) AS sim FROM nv a JOIN nv b ON b.t < a.t WHERE list_cosine_similarity(a.e, b.e) >= {theta}"
    return sql(["vectors"], "").rstrip() + """,
        nv AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS t FROM vectors)""" + greedy("SELECT t FROM nv", pairs) + """
        SELECT a.vec_id, b.vec_id AS code_vec_id, round(m.sim, 6) AS sim FROM merged m JOIN nv a ON a.t = m.x JOIN nv b ON b.t = m.y"""


def merge_labels(turns: str, forced: str, body: str) -> str:
    pairs = f"""SELECT a.turn AS x, b.turn AS y, s.sim FROM label_sims s JOIN {turns} a ON a.ord = s.x JOIN {turns} b ON b.ord = s.y
        WHERE b.turn < a.turn AND s.sim >= {c.LABEL_THETA}"""
    return sql([turns, "label_sims"], "").rstrip() + greedy(f"SELECT turn AS t FROM {turns}", pairs, forced) + body


def study_run() -> str:
    """Merge the labels of the clean insights, fit the codes to the seeds, group the rest, count."""
    pairs = "SELECT a.{0} AS x, b.{0} AS y, s.sim FROM label_sims s JOIN {1} a ON a.ord = s.x JOIN {1} b ON b.ord = s.y WHERE b.{0} < a.{0} AND s.sim >= {2}"
    return (
        sql(["clean", "metadata", "open_codes", "codes", "label_sims", "seed_fit"], "").rstrip()
        + """,
        mine AS (SELECT i.id, o.label FROM open_codes o JOIN clean i ON i.src_ord = o.doc_id),
        lab AS (SELECT label, code_id, ord, row_number() OVER (ORDER BY label) AS turn FROM codes WHERE label IN (SELECT label FROM mine))"""
        + greedy("SELECT turn AS t FROM lab", pairs.format("turn", "lab", c.LABEL_THETA), tag="_a")
        + """,
        united AS (SELECT a.label, b.code_id FROM merged_a m JOIN lab a ON a.turn = m.x JOIN lab b ON b.turn = m.y),
        rest AS (SELECT *, row_number() OVER (ORDER BY label) AS t FROM lab
          WHERE code_id IN (SELECT code_id FROM united) AND code_id NOT IN (SELECT code_id FROM seed_fit))"""
        + greedy("SELECT t FROM rest", pairs.format("t", "rest", c.SEED_CUTOFF), tag="_b")
        + """,
        groups AS (SELECT code_id, category_name AS category_id FROM seed_fit
          UNION ALL SELECT a.code_id, b.label FROM merged_b m JOIN rest a ON a.t = m.x JOIN rest b ON b.t = m.y)
        SELECT k.category_id, count(DISTINCT u.code_id) AS n_codes, count(DISTINCT i.id) AS n_insights, count(DISTINCT p.source) AS n_sources
        FROM mine i JOIN united u ON u.label = i.label LEFT JOIN groups k ON k.code_id = u.code_id LEFT JOIN metadata p ON p.id = i.id
        GROUP BY k.category_id"""
    )


LABEL_MAP = """
        SELECT a.label, b.code_id, CASE WHEN m.x <> m.y THEN 'similar' WHEN a.n > 1 THEN 'exact' ELSE 'new' END AS match_kind, round(m.sim, 6) AS sim
        FROM merged m JOIN {0} a ON a.turn = m.x JOIN {0} b ON b.turn = m.y"""

QUOTED = "CAST(to_json({0}) AS VARCHAR)"

_coding_prompt = (
    text(c.CODING_TEMPLATE.split("{json_input}")[0].replace("{{", "{").replace("}}", "}"))
    + """ || E'{\\n  "id_fragmento": "' || CAST(doc_id AS VARCHAR) || E'",\\n  "fragmento_original": ' || """
    + QUOTED.format("text")
    + """ || E',\\n  "codigos_abiertos": []\\n}' || E'\\n'"""
)



def pipeline_rerun() -> str:
    """Three runs of the scripted models: the first lacks the texts that fail, the second makes up for them, the third has nothing to do."""
    parts = """(SELECT count(*) FROM (SELECT DISTINCT category, floor(before / 100000) FROM (
        SELECT category, sum(length(text)) OVER (PARTITION BY category ORDER BY md5(id), id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(text) AS before
        FROM scripted WHERE {0})))"""
    first, every = "NOT late", "true"
    counts = sql(["scripted"], f"""
        , a AS (SELECT count(*) AS n, count(*) FILTER (late) AS f, count(DISTINCT label) AS l, count(DISTINCT label) FILTER ({first}) AS l1,
          count(DISTINCT category) AS c, count(DISTINCT category) FILTER ({first}) AS c1, {parts.format(every)} AS p, {parts.format(first)} AS p1 FROM scripted)""")
    runs = {
        (1, "done"): {"coding": ("n", "n - f"), "codebook": ("0", "l1"), "categorize": ("ceil(l1 / 50)", "c1"), "enrich": ("0", "n - f"), "axial": ("p1", "p1")},
        (2, "done"): {"coding": ("f", "f"), "codebook": ("0", "l - l1"), "categorize": ("ceil(l / 50)", "c"), "enrich": ("0", "f"), "axial": ("p", "p")},
        (3, "skipped"): {"coding": ("0", "f"), "codebook": ("0", "l - l1"), "categorize": ("0", "c"), "enrich": ("0", "f"), "axial": ("0", "p")},
    }
    rows = [
        f"SELECT CAST({run} AS BIGINT) AS run, '{phase}' AS phase, '{status}' AS status, CAST({asked} AS BIGINT) AS asked, CAST({n} AS BIGINT) AS rows FROM a"
        for (run, status), phases in runs.items()
        for phase, (asked, n) in phases.items()
    ]
    return counts + "\n" + " UNION ALL ".join(rows)


ORACLES: dict[str, str] = {
    "ingest_clean": sql(["clean"], "SELECT * FROM clean"),
    "ingest_rejects": sql(["normalised"], "SELECT src_ord, reason FROM normalised WHERE reason IS NOT NULL"),
    "ingest_report": sql(["normalised"], """
        SELECT count(*) AS total_insights, count(*) FILTER (reason IS NULL) AS processed_insights, count(*) FILTER (reason IS NOT NULL) AS warnings,
          count(*) FILTER (reason = 'null_id') AS n_null_id, count(*) FILTER (reason = 'blank_id') AS n_blank_id,
          count(*) FILTER (reason = 'null_text') AS n_null_text, count(*) FILTER (reason = 'blank_text') AS n_blank_text,
          count(*) FILTER (reason IS NULL) > 0 AS metadata_generated FROM normalised"""),
    "ingest_without_metadata": sql(["normalised"], """
        SELECT count(*) AS total_insights, count(*) FILTER (reason IS NULL) AS processed_insights, count(*) FILTER (reason IS NOT NULL) AS warnings,
          count(*) FILTER (reason = 'null_id') AS n_null_id, count(*) FILTER (reason = 'blank_id') AS n_blank_id,
          count(*) FILTER (reason = 'null_text') AS n_null_text, count(*) FILTER (reason = 'blank_text') AS n_blank_text,
          false AS metadata_generated FROM normalised"""),
    "ingest_metadata": sql(["metadata"], "SELECT * FROM metadata"),
    "metadata_registry_file": sql(["metadata"], "SELECT * FROM metadata"),
    "source_check": sql(["insights_src"], """
        SELECT count(*) AS n_rows, count(*) FILTER (id_raw IS NULL OR text_raw IS NULL) AS n_null_rows, count(*) > 0 AS is_valid,
          '' AS missing_metadata_columns FROM insights_src"""),
    "insight_texts": sql(["clean"], "SELECT id, md5(arg_max(text, src_ord)) AS text_md5 FROM clean GROUP BY id"),
    "fragments": sql(["clean"], "SELECT src_ord, id AS id_fragmento, length(text) AS n_chars, CAST(0 AS BIGINT) AS n_codes FROM clean"),
    "jsonl_round_trip": "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5 FROM documents",
    "jsonl_append": "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS text FROM documents",
    "checkpoint_scan": sql(["open_codes"], """
        SELECT CAST(d.doc_id AS VARCHAR) AS id, count(o.label) AS n_codes FROM documents d LEFT JOIN open_codes o ON o.doc_id = d.doc_id
        WHERE d.doc_id % 7 <> 3 GROUP BY d.doc_id"""),
    "checkpoint_corrupt": """
        SELECT line, count(*) AS n FROM (SELECT substr('{"id":"' || CAST(doc_id AS VARCHAR) || '","codigos_abiertos"', 1, 12) AS line
        FROM documents WHERE doc_id % 7 = 3) GROUP BY line""",
    "codebook_file": sql(["codes"], """
        SELECT code_id AS id, label, CAST(NULL AS VARCHAR) AS description, n AS count, ord, CAST(768 AS BIGINT) AS embedding_dim FROM codes"""),
    "codebook_round_trip": sql(["codes"], """
        SELECT code_id AS id, label, 'a "label"' || chr(10) || label AS description, length(label) / 4.0::DOUBLE AS first, n AS count, ord,
          CAST(2 AS BIGINT) AS embedding_dim FROM codes"""),
    "categories_round_trip": sql(["categories", "category_codes"], """
        SELECT CAST(substr(c.category_id, 5, 2) AS BIGINT) AS ord, CASE WHEN c.category_id <> 'cat_3' THEN any_value(c.category_name) END AS category_name,
          CASE WHEN c.category_id <> 'cat_3' THEN count(*) END AS n_codes, c.category_id <> 'cat_3' AS valid
        FROM categories c JOIN category_codes k ON k.category_id = c.category_id GROUP BY c.category_id"""),
    "model_failures": """
        SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(text) % 11 <> 0 THEN CAST(length(text) AS VARCHAR) || ' characters' END AS response,
          CASE WHEN length(text) % 11 = 0 THEN 'ValueError: bad prompt' END AS error FROM documents""",
    "coding_run": sql(["clean"], """
        SELECT id, md5(text) AS text_md5, CASE WHEN length(text) % 7 <> 0 THEN 'length ' || CAST(length(text) AS VARCHAR) END AS code,
          CASE WHEN length(text) % 7 = 0 THEN 'invalid response' END AS error FROM clean"""),
    "merge_embedded": sql(["codes"], """
        SELECT label, CASE WHEN c > 0 THEN 'code_' || substr(sha256(first), 1, 32) END AS code_id,
          CASE WHEN c = 0 THEN 'no_embedding' WHEN label = first THEN 'new' ELSE 'similar' END AS match_kind,
          CASE WHEN c > 0 AND label <> first THEN 1.0::DOUBLE END AS sim
        FROM (SELECT label, length(label) % 7 AS c, min(label) OVER (PARTITION BY length(label) % 7) AS first FROM codes)"""),
    "categorize_run": sql(["codes"], """
        SELECT 'length ' || CAST(length(label) % 5 AS VARCHAR) AS category_name, code_id, unnest(CASE WHEN contains(label, 'er') THEN ['all', 'some'] ELSE ['all'] END) AS codes
        FROM codes"""),
    "block_order": """
        SELECT 'cat_' || CAST(conv_id % 11 AS VARCHAR) AS category_id, row_number() OVER (PARTITION BY conv_id % 11 ORDER BY conv_id, turn, role, text) - 1 AS pos,
          role AS title, md5(text) AS text_md5 FROM conversations WHERE text IS NOT NULL""",
    "report_parts": f"""
        SELECT part, count(*) AS n_corpus, count(*) AS n_report FROM (
          SELECT CAST(floor((sum(n) OVER (ORDER BY doc_id) - n) / {c.REPORT_PART_CHARS}) AS BIGINT) AS part
          FROM (SELECT doc_id, length(source) + length(text) + {report.SECTION_OVERHEAD} AS n FROM documents)) GROUP BY part""",
    "failed_sink": sql(["judged"], """
        SELECT CAST(j.doc_id AS VARCHAR) AS id, CAST(j.doc_id AS VARCHAR) AS original_id, md5(d.text) AS text_md5, j.status AS error, 'r1' AS run_id
        FROM judged j JOIN documents d ON d.doc_id = j.doc_id WHERE j.status <> 'ok'"""),
    "open_codes": sql(["open_codes"], "SELECT * FROM open_codes"),
    "label_counts": sql(["codes"], "SELECT label, n FROM codes"),
    "distinct_labels": sql(["codes"], "SELECT label FROM codes"),
    "code_rule_violations": sql(["occurrences"], r"""
        , listed AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos FROM occurrences
          UNION ALL SELECT d.doc_id, d.lang, (SELECT count(*) FROM occurrences o WHERE o.doc_id = d.doc_id) FROM documents d)
        SELECT doc_id, pos, label AS code, 'not_a_gerund' AS rule FROM listed
        WHERE NOT regexp_matches(label, '^(?i:\pL*(ando|endo|iendo|ándo|éndo|iéndo)(me|te|se|nos|os|la|las|le|les|lo|los)*|\pL{2,}ing)(\PL|$)')
        UNION ALL SELECT doc_id, count(*), NULL, 'too_many_codes' FROM listed GROUP BY doc_id HAVING count(*) > 3"""),
    "resume_pending": sql(["done"], """
        SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS src_ord FROM documents
        WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT coalesce(nullif(id, ''), id_fragmento) FROM done)"""),
    "resume_union": "SELECT CAST(doc_id AS VARCHAR) AS id, source IN ('src1', 'src2', 'src3') AS from_checkpoint FROM documents",
    "response_extract": sql(["parsed"], "SELECT doc_id, md5(block) AS block_md5, status FROM parsed"),
    "response_rejects": sql(["judged"], "SELECT status AS reason, count(*) AS n FROM judged WHERE status <> 'ok' GROUP BY status"),
    "coding_valid": sql(["coding"], "SELECT * FROM coding"),
    "echo_mismatch": sql(["coding"], """
        SELECT c.doc_id, c.id_fragmento <> CAST(d.doc_id AS VARCHAR) AS id_changed, c.fragmento_original <> 'doc ' || CAST(CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id ELSE d.n_chars END AS VARCHAR) AS text_changed
        FROM coding c JOIN documents d ON d.doc_id = c.doc_id
        WHERE c.id_fragmento <> CAST(d.doc_id AS VARCHAR) OR c.fragmento_original <> 'doc ' || CAST(CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id ELSE d.n_chars END AS VARCHAR)"""),
    "record_merge": sql(["coding"], """
        SELECT c.doc_id, d.lang, c.fragmento_original, c.id_fragmento FROM coding c JOIN documents d ON d.doc_id = c.doc_id"""),
    "error_projection": sql(["open_codes"], """
        SELECT d.doc_id, CASE WHEN d.lang <> 'en' THEN 0 ELSE count(o.label) END AS n_codes, CASE WHEN d.lang <> 'en' THEN 'unsupported' END AS error
        FROM documents d LEFT JOIN open_codes o ON o.doc_id = d.doc_id GROUP BY d.doc_id, d.lang"""),
    "category_valid": sql(["category_items"], "SELECT * FROM category_items"),
    "category_rejects": """
        SELECT doc_id, 'bad_type' AS reason, CASE doc_id % 6 WHEN 2 THEN '$[0].is_new:type' WHEN 3 THEN '$[0].description:missing' ELSE '$:type' END AS errors
        FROM documents WHERE doc_id % 6 IN (2, 3, 4)""",
    "axial_valid": """
        SELECT doc_id, CAST(doc_id AS VARCHAR) AS insight_id FROM documents WHERE doc_id % 5 = 0
        UNION ALL SELECT doc_id, CAST(doc_id + 1 AS VARCHAR) FROM documents WHERE doc_id % 5 = 0""",
    "axial_rejects": """
        SELECT doc_id, 'bad_type' AS reason, CASE doc_id % 5 WHEN 1 THEN '$.paradigm_model:missing'
          WHEN 2 THEN '$.paradigm_model.causal_conditions[0].evidence_insight_ids[1]:type'
          ELSE '$.properties_and_dimensions[0].property_name:missing' END AS errors
        FROM documents WHERE doc_id % 5 IN (1, 2, 3)""",
    "codebook_invalid": """
        SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 4 = 2 THEN '$.embedding:type' END,
          CASE WHEN doc_id % 7 IN (2, 5) THEN '$.count:type' END) AS errors
        FROM documents WHERE doc_id % 4 = 2 OR doc_id % 7 IN (2, 5)""",
    "codebook_valid": """
        SELECT doc_id, 'code_' || CAST(doc_id AS VARCHAR) AS id, lang AS label,
          CAST(CASE doc_id % 7 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 3 THEN NULL WHEN 4 THEN 1 ELSE 6 END AS BIGINT) AS count,
          CASE WHEN doc_id % 4 = 1 THEN CAST(4.0 AS DOUBLE) END AS vector_sum
        FROM documents WHERE NOT (doc_id % 4 = 2 OR doc_id % 7 IN (2, 5))""",
    "insight_valid": """
        SELECT CAST(doc_id AS VARCHAR) AS id_fragmento, source AS fragmento_original, CASE WHEN doc_id % 3 = 1 THEN '' ELSE lang END AS ids
        FROM documents WHERE doc_id % 5 <> 2 AND doc_id % 7 <> 4""",
    "insight_rejects": """
        SELECT errors, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN doc_id % 5 = 2 THEN '$.id_fragmento:type' END,
          CASE WHEN doc_id % 7 = 4 THEN '$.fragmento_original:null' END) AS errors FROM documents) WHERE errors <> '' GROUP BY errors""",
    "category_contract_rejects": """
        SELECT doc_id, CAST(0 AS BIGINT) AS pos, '$.category_id:missing' AS errors FROM documents WHERE doc_id % 6 <> 4
        UNION ALL SELECT doc_id, 1, '$.category_id:missing' FROM documents WHERE doc_id % 6 = 1""",
    "label_exact_match": sql(["established"], "SELECT label, code_id FROM established"),
    "label_new": sql(["codes"], "SELECT label FROM codes WHERE n = 1"),
    "label_pairs_sparse": sql(["code_matches"], "SELECT label, code_label, round(sim, 6) AS sim FROM code_matches"),
    "nearest_code": sql(["code_matches"], """
        SELECT label, arg_max(code_label, (sim, -code_ord)) AS code_label, round(max(sim), 6) AS sim FROM code_matches GROUP BY label"""),
    "vector_pairs": sql(["vectors"], """
        , firsts AS (SELECT label, min(vec_id) AS vec_id, arg_min(e, vec_id) AS e FROM vectors GROUP BY label)
        SELECT v.vec_id, f.vec_id AS code_vec_id, round(list_cosine_similarity(v.e, f.e), 6) AS sim FROM vectors v JOIN firsts f
          ON list_cosine_similarity(v.e, f.e) >= 0.2"""),
    "merge_vectors_030": merge_vectors(0.30),
    "merge_vectors_090": merge_vectors(0.90),
    "merge_labels": merge_labels("turns", "(SELECT count(*) FROM codes WHERE n > 1)", LABEL_MAP.format("turns")),
    "merge_labels_first_run": merge_labels("stream_labels", "0", LABEL_MAP.format("stream_labels")),
    "codebook_counts": merge_labels("turns", "(SELECT count(*) FROM codes WHERE n > 1)", """
        SELECT b.code_id AS id, b.label, count(*) + max(CASE WHEN b.n > 1 THEN 1 ELSE 0 END) AS count
        FROM merged m JOIN turns b ON b.turn = m.y GROUP BY b.code_id, b.label"""),
    "code_ids": sql(["codes"], "SELECT label, code_id FROM codes"),
    "embed_labels": sql(["grams"], "SELECT label, g, w AS c FROM grams"),
    "enrich_insights": sql(["open_codes", "established"], """
        SELECT d.doc_id, coalesce(string_agg(k.code_id, ',' ORDER BY o.pos), '') AS code_ids, count(k.code_id) AS n_ids
        FROM documents d LEFT JOIN open_codes o ON o.doc_id = d.doc_id LEFT JOIN established k ON k.label = o.label GROUP BY d.doc_id"""),
    "unmatched_labels": sql(["open_codes", "codes"], """
        SELECT CAST(o.doc_id AS VARCHAR) AS id, o.pos, o.label FROM open_codes o JOIN codes k ON k.label = o.label WHERE k.n = 1"""),
    "evidence_index": sql(["evidence"], "SELECT * FROM evidence"),
    "evidence_by_category": sql(["evidence", "category_codes"], """
        SELECT DISTINCT c.category_id, e.id_fragmento FROM category_codes c JOIN evidence e ON e.code_id = c.code_id"""),
    "evidence_empty": sql(["evidence", "category_codes"], """
        SELECT DISTINCT category_id FROM category_codes WHERE category_id NOT IN (
          SELECT c.category_id FROM category_codes c JOIN evidence e ON e.code_id = c.code_id
          JOIN documents d ON CAST(d.doc_id AS VARCHAR) = e.id_fragmento WHERE d.lang = 'de')"""),
    "evidence_ids": sql(["cited"], "SELECT * FROM cited"),
    "evidence_text": sql(["resolved"], "SELECT category_id, insight_id, md5(text) AS text_md5, found FROM resolved"),
    "evidence_budget": sql(["resolved"], """
        SELECT category_id, count(*) AS n_evidence, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(*) FILTER (NOT found) AS n_missing,
          sum(length(text)) <= 100000 AS within_budget FROM resolved GROUP BY category_id"""),
    "evidence_parts": sql(["parts"], "SELECT category_id, insight_id, running_chars, within_budget, part FROM parts"),
    "unknown_evidence": sql(["cited"], "SELECT insight_id, category_id FROM cited WHERE insight_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)"),
    "lineage": sql(["evidence", "category_codes", "metadata"], """
        SELECT e.id_fragmento, e.pos, e.code_id, c.category_id, m.method, m.source FROM evidence e
        LEFT JOIN category_codes c ON c.code_id = e.code_id LEFT JOIN metadata m ON m.id = e.id_fragmento"""),
    "code_batches": sql(["codes"], "SELECT CAST(floor((ord - 1) / 50) AS BIGINT) AS batch, (ord - 1) % 50 AS pos, code_id FROM codes"),
    "categories_by_name": sql(["category_numbers", "category_assignments"], """
        SELECT n.category_name, n.description, count(DISTINCT a.code_id) AS n_codes FROM category_numbers n
        LEFT JOIN category_assignments a ON a.category_name = n.category_name GROUP BY n.category_name, n.description"""),
    "category_ids": sql(["category_numbers"], "SELECT category_id, category_name FROM category_numbers"),
    "category_first_codes": sql(["category_numbers", "category_assignments"], """
        SELECT n.category_id, a.code_id, arg_min(a.batch, (a.batch, a.code_pos)) AS batch, CAST(0 AS BIGINT) AS pos, arg_min(a.code_pos, (a.batch, a.code_pos)) AS code_pos
        FROM category_assignments a JOIN category_numbers n ON n.category_name = a.category_name GROUP BY n.category_id, a.code_id"""),
    "categories_by_id": sql(["open_codes"], """
        SELECT d.lang AS category_id, arg_min(d.source, d.doc_id) AS category_name, 'from ' || arg_min(d.source, d.doc_id) AS description,
          (SELECT count(DISTINCT o.label) FROM open_codes o JOIN documents x ON x.doc_id = o.doc_id WHERE x.lang = d.lang) AS n_codes
        FROM documents d GROUP BY d.lang"""),
    "nested_categories": sql(["categories", "category_codes"], """
        SELECT g.category_id, CAST(0 AS BIGINT) AS part, g.category_name, md5(string_agg(c.code_id, ',' ORDER BY c.code_id)) AS codes_md5, count(*) AS n_codes
        FROM categories g JOIN category_codes c ON c.category_id = g.category_id GROUP BY g.category_id, g.category_name"""),
    "best_fit_keywords": sql(["seed_fit"], "SELECT code_id, category_name, round(score, 6) AS score FROM seed_fit"),
    "emergent_codes": sql(["seed_fit", "label_sims", "codes"], "").rstrip() + """,
        rest AS (SELECT *, row_number() OVER (ORDER BY label) AS t FROM codes WHERE code_id NOT IN (SELECT code_id FROM seed_fit))""" + greedy(
        "SELECT t FROM rest",
        f"SELECT a.t AS x, b.t AS y, s.sim FROM label_sims s JOIN rest a ON a.ord = s.x JOIN rest b ON b.ord = s.y WHERE b.t < a.t AND s.sim >= {c.SEED_CUTOFF}",
    ) + " SELECT a.code_id, b.label AS leader FROM merged m JOIN rest a ON a.t = m.x JOIN rest b ON b.t = m.y",
    "best_fit_vectors": sql(["vectors"], """
        , cells AS (SELECT label, unnest(e) AS v, unnest(range(len(e))) AS k FROM vectors),
        centers AS (SELECT label, list(CAST(CAST(v AS FLOAT) AS DOUBLE) ORDER BY k) AS e FROM (SELECT label, k, avg(v) AS v FROM cells GROUP BY label, k) GROUP BY label),
        scored AS (SELECT v.vec_id, c.label, list_cosine_similarity(v.e, c.e) AS s FROM vectors v CROSS JOIN centers c)
        SELECT vec_id AS item_id, arg_max(label, (s, -label)) AS category, round(max(s), 4) AS score FROM scored WHERE s >= 0.1 GROUP BY vec_id"""),
    "orphan_codes": sql(["codes", "category_codes"], """
        SELECT code_id, label FROM codes WHERE code_id NOT IN (SELECT code_id FROM category_codes WHERE category_id <> 'cat_6')"""),
    "unknown_codes": sql(["established", "category_codes"], "SELECT category_id, code_id FROM category_codes WHERE code_id NOT IN (SELECT code_id FROM established)"),
    "multi_category_codes": sql(["category_codes"], "SELECT code_id, count(*) AS n_categories FROM category_codes GROUP BY code_id HAVING count(*) > 1"),
    "prompt_coding": f"SELECT CAST(doc_id AS VARCHAR) AS id, md5({_coding_prompt}) AS prompt_md5 FROM documents",
    "prompt_category_batch": sql(["codes"], """
        SELECT batch, md5(E'Questions:\\n- What do people do?\\n- What holds them back?\\nKnown: [\\n  {\\n    "category_name": "Hábitos",\\n    "description": "Rutinas"\\n  }\\n]\\nCodes: {\\n  '
          || string_agg('"' || code_id || '": "' || label || '"', E',\\n  ' ORDER BY ord) || E'\\n}\\nAnswer as [{"category_name": "..."}].\\n[\\n  '
          || string_agg(E'{\\n    "code_id": "' || code_id || E'"\\n  }', E',\\n  ' ORDER BY ord) || E'\\n]\\n') AS prompt_md5
        FROM (SELECT *, CAST(floor((ord - 1) / 50) AS BIGINT) AS batch FROM codes) GROUP BY batch"""),
    "prompt_axial": sql(["parts", "categories"], f"""
        SELECT p.category_id, p.part, md5('Category ' || any_value(g.category_name) || E' (No hay descripción disponible.). Cite ids, as {{"paradigm_model": {{}}}}.\\n[\\n  '
          || string_agg(E'{{\\n    "id_fragmento": ' || {QUOTED.format('p.insight_id')} || E',\\n    "fragmento_original": ' || {QUOTED.format('p.text')} || E'\\n  }}', E',\\n  ' ORDER BY p.running_chars)
          || E'\\n]\\n') AS prompt_md5
        FROM parts p JOIN categories g ON g.category_id = p.category_id GROUP BY p.category_id, p.part"""),
    "replay_respond": sql(["responses"], """
        SELECT CAST(doc_id AS VARCHAR) AS id, md5(response) AS response_md5, CASE WHEN response IS NULL THEN 'no_response' END AS error FROM responses"""),
    "model_respond": """
        SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(text) % 5 <> 0
            THEN (CASE WHEN lang = 'fr' THEN 'advanced:' ELSE 'default:' END) || CAST(length(text) AS VARCHAR) END AS response,
          CAST(NULL AS VARCHAR) AS error FROM documents""",
    "retry_rejects": """
        SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(text) % 5 <> 0 THEN CAST(length(text) AS VARCHAR) END AS response,
          CAST(CASE WHEN length(text) % 5 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempt
        FROM documents""",
    "full_narrative": sql(["narratives"], "SELECT category_id, part, md5(narrative) AS narrative_md5, n_blocks FROM narratives"),
    "corpus_text": sql(["corpus_sections"], f"""
        SELECT part, count(*) AS n_sections, md5((CASE WHEN part = 0 THEN E'\\n\\n{report.RULE}\\n\\n' ELSE '' END)
          || string_agg('## CATEGORÍA: ' || category_name || E'\\n\\n' || narrative || E'\\n\\n{report.RULE}\\n\\n', '' ORDER BY p)) AS corpus_md5
        FROM corpus_sections GROUP BY part"""),
    "fallback_report": sql(["report_parts"], "SELECT part, md5(report) AS report_md5, n_sections FROM report_parts"),
    "report_file": sql(["report_parts"], r"""
        SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(left(report, length(report) - 1), E'\n')) AS line FROM report_parts) GROUP BY line"""),
    "synthesis_fallback": sql(["narratives"], """
        SELECT category_id, part, md5(CASE WHEN n_blocks > 3 THEN 'short ' || CAST(n_blocks AS VARCHAR) ELSE 'Error al procesar la categoría: ' || narrative END) AS narrative_md5
        FROM narratives"""),
    "narrative_blocks": sql(["axial_items"], "SELECT category_id, component, CAST(CASE component " + " ".join(
        f"WHEN '{k}' THEN {n + 1}" for n, k in enumerate(report.COMPONENT_TITLES)
    ) + " END AS BIGINT) AS block_ord, CASE component " + " ".join(
        f"WHEN '{k}' THEN {text(v)}" for k, v in report.COMPONENT_TITLES.items()
    ) + """ END AS title, CAST(0 AS BIGINT) AS part, string_agg(DISTINCT 'On ' || component || ' ' || CAST(length(insight_id) % 3 AS VARCHAR), ' ' ORDER BY 'On ' || component || ' ' || CAST(length(insight_id) % 3 AS VARCHAR)) AS text,
          string_agg(insight_id, ',' ORDER BY insight_id) AS ids
        FROM axial_items GROUP BY category_id, component"""),
    "cluster_rollup": sql(["categories", "category_codes", "clusters"], """
        SELECT coalesce(k.cluster, 'unassigned') AS cluster, CAST(coalesce(k.cluster_ord, 99) AS BIGINT) AS cluster_ord, count(DISTINCT g.category_id) AS n_categories,
          count(c.code_id) AS n_codes
        FROM categories g LEFT JOIN clusters k ON k.category_name = g.category_name LEFT JOIN category_codes c ON c.category_id = g.category_id GROUP BY 1, 2"""),
    "report_order": sql(["categories", "clusters"], """
        SELECT g.category_id, coalesce(k.cluster, 'unassigned') AS cluster, CAST(coalesce(k.cluster_ord, 99) AS BIGINT) AS cluster_ord,
          CAST(coalesce(k.category_ord, 99) AS BIGINT) AS category_ord
        FROM categories g LEFT JOIN clusters k ON k.category_name = g.category_name"""),
    "phase_totals": sql(["codes", "categories", "evidence", "narratives"], """
        SELECT 'insights' AS phase, count(*) AS n FROM documents UNION ALL SELECT 'codes', count(*) FROM codes UNION ALL
        SELECT 'categories', count(*) FROM categories UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'narratives', count(*) FROM narratives"""),
    "study_run": study_run(),
    "text_previews": "SELECT CAST(doc_id AS VARCHAR) AS id, left(text, 50) AS preview FROM documents",
    "csv_source": sql(["clean"], r"""
        SELECT src_ord, id, md5(regexp_replace(regexp_replace(text, '\r', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5, method, source FROM clean"""),
    "config_fit": sql(["seed_fit"], """
        SELECT code_id, category_name, round(score, 6) AS score FROM seed_fit UNION ALL SELECT DISTINCT lang, 'question', CAST(NULL AS DOUBLE) FROM documents WHERE lang IS NOT NULL"""),
    "offered_categories": sql(["category_numbers", "seeds"], """
        SELECT category_name, coalesce(description, '') AS description, 'known' AS offered FROM category_numbers
        UNION ALL SELECT DISTINCT category_name, 'a seed', 'seeds' FROM seeds"""),
    "merge_embedded_prior": sql(["codes"], """
        SELECT k.label, CASE WHEN k.n > 1 THEN k.code_id WHEN length(k.label) % 7 > 0 THEN coalesce(o.code_id, 'code_' || substr(sha256(f.label), 1, 32)) END AS code_id,
          CASE WHEN k.n > 1 THEN 'exact' WHEN length(k.label) % 7 = 0 THEN 'no_embedding' WHEN o.code_id IS NULL AND k.label = f.label THEN 'new' ELSE 'similar' END AS match_kind,
          CASE WHEN k.n = 1 AND length(k.label) % 7 > 0 AND (o.code_id IS NOT NULL OR k.label <> f.label) THEN 1.0::DOUBLE END AS sim
        FROM codes k LEFT JOIN (SELECT length(label) % 7 AS c, arg_min(code_id, label) AS code_id FROM codes WHERE n > 1 AND length(label) % 2 = 0 GROUP BY 1) o ON o.c = length(k.label) % 7
        LEFT JOIN (SELECT length(label) % 7 AS c, min(label) AS label FROM codes WHERE n = 1 GROUP BY 1) f ON f.c = length(k.label) % 7"""),
    "embed_retry": """
        SELECT doc_id, CASE WHEN n % 13 <> 0 AND n % 7 <> 0 AND n % 11 <> 0 THEN CAST(n AS DOUBLE) END AS first,
          CASE WHEN n % 13 = 0 THEN 'TimeoutError: later' WHEN n % 7 = 0 THEN 'ValueError: never' END AS error
        FROM (SELECT doc_id, length(text) AS n FROM documents)""",
    "append_once": """
        SELECT CAST(doc_id AS VARCHAR) AS id, md5(CASE WHEN lang = 'en' THEN upper(lang) ELSE text END) AS text_md5, CASE WHEN lang = 'en' THEN 'english' ELSE 'others' END AS run_id
        FROM documents WHERE lang IS NOT NULL""",
    "axial_run": sql(["told"], """
        SELECT category_id, category_name, ord, 'context' AS component, row_number() OVER (PARTITION BY category_id ORDER BY odd) - 1 AS pos,
          CASE WHEN odd THEN 'odd' ELSE 'even' END AS description, n_insights, 1 AS n_analyses
        FROM (SELECT category_id, category_name, ord, n % 2 = 1 AS odd, count(*) AS n_insights FROM told GROUP BY ALL)
        UNION ALL SELECT category_id, category_name, ord, 'properties_and_dimensions', 0, 'everything', count(*), 1 FROM told GROUP BY ALL"""),
    "narrate_run": sql(["told"], """
        SELECT category_id, category_name, ord, part, piece, count(*) AS n_insights, CAST(sum(n) AS BIGINT) AS n_characters FROM told GROUP BY ALL"""),
    "synthesis_run": f"""
        WITH placed AS (SELECT conv_id % 11 + 1 AS c, role, text, row_number() OVER (PARTITION BY conv_id % 11 ORDER BY conv_id, turn, role, text) - 1 AS pos FROM conversations),
        narratives AS (SELECT c, pos // 1000 AS part, string_agg('**' || role || E'**\n\n' || text, {text(report.BLOCK_SEPARATOR)} ORDER BY pos) AS t
          FROM placed WHERE role <> '' AND text <> '' GROUP BY 1, 2)
        SELECT CAST(0 AS BIGINT) AS part, {text(report.REPORT_HEAD)} || string_agg('### name ' || CAST(c AS VARCHAR) || E'\n\nadvanced: ' || CAST(length(t) AS VARCHAR)
          || E' characters\n\n---\n\n', '' ORDER BY c, part) AS report FROM narratives""",
    "pipeline_run": sql(["scripted"], """
        SELECT category AS category_name, count(DISTINCT label) AS n_codes, count(DISTINCT id) AS n_insights FROM scripted WHERE NOT late GROUP BY category
        UNION ALL SELECT 'results', count(*), count(*) FROM scripted WHERE NOT late
        UNION ALL SELECT 'invalid response', 0, count(*) FROM scripted WHERE late HAVING count(*) > 0"""),
    "pipeline_rerun": pipeline_rerun(),
    "stream_state_resume": sql(["open_codes"], """
        SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN max(length(d.text)) % 35 <> 0 THEN coalesce(string_agg(o.label, '|' ORDER BY o.pos), '') END AS codes,
          CASE WHEN max(length(d.text)) % 35 = 0 THEN 3 WHEN max(length(d.text)) % 7 = 0 THEN 1 ELSE 0 END AS n_failed, max(length(d.text)) % 35 = 0 AS final
        FROM documents d LEFT JOIN open_codes o ON o.doc_id = d.doc_id GROUP BY d.doc_id"""),
    "stream_codebook_log": merge_labels("stream_turns", "(SELECT count(*) FROM codes WHERE n > 1)", """
        SELECT a.label, b.code_id, CASE WHEN m.x <> m.y THEN 'similar' WHEN a.n > 1 THEN 'exact' ELSE 'new' END AS match_kind, round(m.sim, 6) AS sim,
          count(*) OVER (PARTITION BY b.code_id) + CASE WHEN b.n > 1 THEN 1 ELSE 0 END AS n_uses
        FROM merged m JOIN stream_turns a ON a.turn = m.x JOIN stream_turns b ON b.turn = m.y"""),
    "stream_resume": sql(["open_codes"], """
        SELECT CAST(d.doc_id AS VARCHAR) AS id, coalesce(string_agg(o.label, '|' ORDER BY o.pos), '') AS codes
        FROM documents d LEFT JOIN open_codes o ON o.doc_id = d.doc_id GROUP BY d.doc_id"""),
    "stream_codebook": merge_labels("stream_labels", "0", LABEL_MAP.format("stream_labels")),
}
