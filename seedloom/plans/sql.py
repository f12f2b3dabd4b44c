"""SQL for DuckDB: what each query must return, written apart from the operators."""

from __future__ import annotations

from seedloom.functions.text import BLANKS
from seedloom.operators.batches import TEMPLATE

_STRIP = "'" + BLANKS + "'"

_EX = """ex AS (
  SELECT example_id, file, task_kind, polarity, input, output, explanation FROM (
    SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY loaded_at) AS rn FROM examples WHERE example_id IS NOT NULL) WHERE rn = 1)"""

_MC = f"""{_EX},
mc0 AS (SELECT coalesce(file, '') AS file, task_kind, example_id AS seed_ord, input, output, explanation, string_split(input, '(A)') AS parts
  FROM ex WHERE polarity = 'positive' AND task_kind = 'Multiple Selection'),
mc1 AS (SELECT *, parts[1] AS head, parts[2] AS tail, string_split(parts[2], ' (') AS cuts FROM mc0),
mc2 AS (SELECT *, CASE WHEN len(cuts) >= 4 THEN [trim(cuts[1], {_STRIP}), trim(substr(cuts[2], 3), {_STRIP}), trim(substr(cuts[3], 3), {_STRIP}), trim(substr(cuts[4], 3), {_STRIP})] END AS options,
  CASE WHEN input IS NULL THEN 'no input' WHEN output IS NULL THEN 'no output' WHEN tail IS NULL THEN 'no (A)' WHEN len(cuts) < 4 THEN 'fewer than four options'
       WHEN output NOT IN ('A', 'B', 'C', 'D') THEN 'answer outside A-D' END AS reason FROM mc1),
mc AS (SELECT *, ascii(output) - 65 AS answer_idx FROM mc2 WHERE reason IS NULL)"""

_QA = f"""{_EX},
qa0 AS (SELECT coalesce(file, '') AS file, task_kind, example_id AS seed_ord, input, output, explanation, string_split(input, 'Question:') AS parts
  FROM ex WHERE polarity = 'positive' AND task_kind = 'Question answering'),
qa1 AS (SELECT *, parts[1] AS head, parts[2] AS question, substr(trim(parts[1], {_STRIP}), 7) AS fact,
  CASE WHEN input IS NULL THEN 'no input' WHEN output IS NULL THEN 'no output' WHEN parts[2] IS NULL THEN 'no Question:' END AS reason FROM qa0),
qa AS (SELECT * FROM qa1 WHERE reason IS NULL)"""


def _permuted(options: str, *key: str) -> str:
    hashed = f"md5(concat_ws(':', '0', {', '.join(f'({k})::VARCHAR' for k in key)}, i::VARCHAR))"
    return f"list_transform(list_sort(list_transform(range(0, len({options})), lambda i: {{'h': {hashed}, 'i': i, 'x': ({options})[i + 1]}})), lambda s: s.x)"


def _wrong(*key: str) -> str:
    return f"({_permuted("list_filter(['A', 'B', 'C', 'D'], lambda c: c <> output)", *key)})[1:2]"


def _labels(options: str) -> str:
    return " || ' ' || ".join(f"'({c})' || {options}[{k + 1}]" for k, c in enumerate("ABCD"))


_KEY = ("file", "task_kind", "seed_ord")
_BECAUSE = "'The correct answer is: ' || {right} || '. ' || 'x' || neg_slot || ': ' || explanation"
_NONE = "NULL::INT"

#: Variants, and shuffles with their new input, output and explanation.
_MC_FAN = f"""{_MC},
v AS (SELECT *, 'p' || variant || ': ' || head AS q FROM mc, (SELECT unnest(range(0, 10))::INT AS variant)),
w0 AS (SELECT *, {_permuted("options", *_KEY, "variant", "shuffle")} AS moved FROM v, (SELECT unnest(range(0, 2))::INT AS shuffle)),
w AS (SELECT file, task_kind, seed_ord, variant, shuffle, q || ' ' || {_labels("moved")} AS input, chr((64 + list_position(moved, options[answer_idx + 1]))::INT) AS output,
  'x' || shuffle || ': ' || explanation AS explanation FROM w0)"""

_QA_FAN = f"""{_QA},
f1 AS (SELECT *, head || ' Question: ' || 'p' || variant || ': ' || question AS fresh FROM qa, (SELECT unnest(range(0, 10))::INT AS variant)),
f3 AS (SELECT *, 'Fact: ' || 's' || variant || ': ' || fact || ' Question: ' || question AS fresh FROM qa, (SELECT unnest(range(0, 10))::INT AS variant)),
k AS (SELECT unnest(range(0, 2))::INT AS neg_slot)"""

_MC_POS = f"""SELECT file, task_kind, 'positive' AS polarity, 'M0' AS branch, seed_ord, {_NONE} AS variant, {_NONE} AS shuffle, {_NONE} AS neg_slot, input, output, explanation FROM mc
UNION ALL SELECT file, task_kind, 'positive', 'M2', seed_ord, variant, NULL, NULL, q || ' (A)' || tail, output, 'x2: ' || explanation FROM v
UNION ALL SELECT file, task_kind, 'positive', 'M4', seed_ord, variant, shuffle, NULL, input, output, explanation FROM w"""


def _negatives(rows: str, branch: str, key: tuple[str, ...], why: str, shuffle: str = "NULL", variant: str = "variant") -> str:
    wrong = _wrong(f"'{branch}'", *_KEY, *key)
    return f"""SELECT file, task_kind, 'negative' AS polarity, '{branch}' AS branch, seed_ord, {variant}::INT AS variant, {shuffle}::INT AS shuffle, neg_slot, input, wrong[neg_slot + 1] AS output, {why} AS explanation
FROM (SELECT *, {wrong} AS wrong FROM {rows}), (SELECT unnest(range(0, 2))::INT AS neg_slot)"""


_MC_NEG = " UNION ALL ".join(
    (
        _negatives("mc", "M1", (), _BECAUSE.format(right="output"), variant="NULL"),
        _negatives("v", "M3", ("variant",), "explanation"),
        _negatives("w", "M5", ("variant", "shuffle"), _BECAUSE.format(right="output"), shuffle="shuffle"),
    )
)

_QA_POS = f"""SELECT file, task_kind, 'positive' AS polarity, 'Q0' AS branch, seed_ord, {_NONE} AS variant, {_NONE} AS shuffle, {_NONE} AS neg_slot, input, output, explanation FROM qa
UNION ALL SELECT file, task_kind, 'positive', 'Q1', seed_ord, variant, NULL, NULL, fresh, output, 'x0: ' || explanation FROM f1
UNION ALL SELECT file, task_kind, 'positive', 'Q3', seed_ord, variant, NULL, NULL, fresh, output, 'x0: ' || explanation FROM f3"""
_QA_NEG = f"""SELECT file, task_kind, 'negative' AS polarity, 'Q2' AS branch, seed_ord, variant, {_NONE} AS shuffle, neg_slot, fresh AS input, 'not ' || neg_slot || ': ' || output AS output, {_BECAUSE.format(right="output")} AS explanation FROM f1, k
UNION ALL SELECT file, task_kind, 'negative', 'Q4', seed_ord, variant, NULL, neg_slot, fresh, 'not ' || neg_slot || ': ' || output, 'The correct answer is: ' || output || '. ' || 'x' || neg_slot || ': ' || 'x0: ' || explanation FROM f3, k"""

_SHOWN = "file, branch, seed_ord, variant, shuffle, neg_slot, input, output, explanation"


def _grams(column: str, n: int) -> str:
    t = f"list_filter(string_split(regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
    return t if n == 1 else f"list_transform(range(1, greatest(len({t}), 1)), lambda i: ({t})[i] || ' ' || ({t})[i + 1])"


def _rouge(n: int) -> str:
    return f"""WITH g AS (SELECT pair_id, {_grams("prediction", n)} AS p, {_grams("reference", n)} AS r FROM eval_pair),
u AS (SELECT pair_id, unnest(p) AS gram, 1 AS a, 0 AS b FROM g UNION ALL SELECT pair_id, unnest(r), 0, 1 FROM g),
h AS (SELECT pair_id, sum(least(a, b)) AS hit FROM (SELECT pair_id, gram, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL) GROUP BY pair_id)
SELECT g.pair_id, round(CASE WHEN coalesce(hit, 0) > 0 THEN 2.0::DOUBLE * hit / (len(p) + len(r)) ELSE 0.0 END, 6)::DOUBLE AS f1 FROM g LEFT JOIN h USING (pair_id)"""


_TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"

#: Longest common subsequence of both sides' tokens, row by row: the best length so far at each place of the reference.
_LCS = f"""l0 AS (SELECT pair_id, {_TOKENS.format(x="prediction")} AS p, {_TOKENS.format(x="reference")} AS r FROM eval_pair),
l1 AS (SELECT pair_id, p, r, 0 AS i, list_transform(r, lambda x: 0) AS best FROM l0
  UNION ALL SELECT pair_id, p, r, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda t: CASE WHEN r[t] = p[i + 1] THEN 1 + CASE WHEN t > 1 THEN best[t - 1] ELSE 0 END ELSE best[t] END)))
  FROM l1 WHERE i < len(p) AND len(r) > 0),
l2 AS (SELECT pair_id, round(CASE WHEN len(r) > 0 AND best[len(r)] > 0 THEN 2.0::DOUBLE * best[len(r)] / (len(p) + len(r)) ELSE 0.0 END, 12)::DOUBLE AS f FROM l1 WHERE i = len(p) OR len(r) = 0)"""


def _bleu() -> str:
    grams = [f"list_transform(range(1, len({{s}}) - {n - 2}), lambda i: array_to_string(({{s}})[i:i + {n - 1}], ' '))" for n in range(1, 5)]
    sides = " UNION ALL ".join(f"SELECT id, {n} AS n, '{s}' AS side, unnest({g.format(s=s)}) AS gram FROM t" for n, g in enumerate(grams, 1) for s in "pr")
    return f"""WITH t AS (SELECT row_number() OVER () AS id, {_TOKENS.format(x="prediction")} AS p, {_TOKENS.format(x="reference")} AS r FROM eval_pair),
c AS (SELECT id, n, gram, count(*) FILTER (side = 'p') AS a, count(*) FILTER (side = 'r') AS b FROM ({sides}) GROUP BY ALL),
o AS (SELECT n, sum(least(a, b)) AS hit, sum(a) AS had FROM c GROUP BY n),
s AS (SELECT sum(len(p)) AS given, sum(len(r)) AS wanted, count(*) AS pairs FROM t)
SELECT round(CASE WHEN pairs = 0 THEN NULL WHEN (SELECT min(hit) FROM o) = 0 OR (SELECT count(*) FROM o WHERE had > 0) < 4 THEN 0.0::DOUBLE ELSE exp(least(0.0, 1 - wanted::DOUBLE / given) + (SELECT sum(ln(hit::DOUBLE / had)) FROM o) / 4) END, 9) AS bleu, pairs FROM s"""


def _vectors(rows: str, key: str) -> str:
    """Numbers of token vectors: for each row of ``rows`` (key, token) the places of its runs of characters, summed by key."""
    return f"""SELECT {key}, dim, sum(sign)::DOUBLE AS v FROM (
  SELECT {key}, position(h[1] IN '0123456789abcdef') - 1 + CASE WHEN h[2] >= '8' THEN 16 ELSE 0 END AS dim, CASE WHEN h[3] >= '8' THEN 1 ELSE -1 END AS sign FROM (
    SELECT {key}, md5(substr('^' || token || '$', i, k)) AS h FROM (SELECT *, unnest(range(1, length(token) + 4 - k)) AS i FROM {rows}, (SELECT unnest([2, 3]) AS k)))) GROUP BY {key}, dim HAVING sum(sign) <> 0"""


_BERT = f"""t AS (SELECT pair_id, {_TOKENS.format(x="prediction")} AS p, {_TOKENS.format(x="reference")} AS r FROM eval_pair),
w AS (SELECT DISTINCT unnest(p || r) AS token FROM t),
v AS ({_vectors("w", "token")}),
n AS (SELECT token, sqrt(sum(v * v)) AS norm FROM v GROUP BY token),
pt AS (SELECT pair_id, unnest(p) AS token, unnest(range(0, len(p))) AS at FROM t), rt AS (SELECT pair_id, unnest(r) AS token, unnest(range(0, len(r))) AS at FROM t),
d AS (SELECT a.pair_id, a.at AS i, b.at AS j, coalesce((SELECT sum(x.v * y.v) FROM v x JOIN v y ON x.dim = y.dim WHERE x.token = a.token AND y.token = b.token) / nullif(na.norm * nb.norm, 0), 0) AS alike
  FROM pt a JOIN rt b USING (pair_id) LEFT JOIN n na ON na.token = a.token LEFT JOIN n nb ON nb.token = b.token),
pr AS (SELECT pair_id, avg(m) AS precision FROM (SELECT pair_id, i, max(alike) AS m FROM d GROUP BY ALL) GROUP BY pair_id),
re AS (SELECT pair_id, avg(m) AS recall FROM (SELECT pair_id, j, max(alike) AS m FROM d GROUP BY ALL) GROUP BY pair_id),
s AS (SELECT pair_id, coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM t LEFT JOIN pr USING (pair_id) LEFT JOIN re USING (pair_id))"""


#: Token vectors: each token's neighbours within three places, in a text without its common tokens, add the signs that their md5 names.
_FITTED = f"""dt AS (SELECT row_number() OVER () AS id, {_TOKENS.format(x="text")} AS t FROM documents),
dc AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM dt) GROUP BY token),
rare AS (SELECT token FROM dc WHERE n * 100 <= (SELECT sum(n) FROM dc)),
dp AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos FROM (SELECT id, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM dt) SEMI JOIN rare USING (token)),
dn AS (SELECT a.token, md5(b.token) AS h FROM dp a JOIN dp b ON a.id = b.id AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 AND a.pos <> b.pos),
dk AS (SELECT token, n FROM dc ORDER BY n DESC, token LIMIT 50000),
ds AS (SELECT token, (16 * (position(h[3 * k + 1] IN '0123456789abcdef') - 1) + position(h[3 * k + 2] IN '0123456789abcdef') - 1) % 64 AS dim, CASE WHEN h[3 * k + 3] >= '8' THEN 1 ELSE -1 END AS sign FROM dn, (SELECT unnest(range(0, 4)) AS k)),
dv AS (SELECT token, dim, sum(sign) AS v FROM ds SEMI JOIN dk USING (token) GROUP BY ALL),
fitted AS (SELECT token, n, dim, coalesce(v, 0) AS v FROM (SELECT token, n, unnest(range(0, 64)) AS dim FROM dk) LEFT JOIN dv USING (token, dim))"""


_PAGES = """pages AS (SELECT page_id, url, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY crawled_at DESC, url DESC NULLS LAST, text DESC NULLS LAST) AS rn
  FROM page_item WHERE page_id IS NOT NULL) WHERE rn = 1)"""

_LIST = "CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN []::JSON[] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


def _level(name: str, parent: str, code: str, path: str) -> str:
    """Nodes of a list below the nodes of a parent."""
    inner = "raw" if not path else f"json_extract(v, '{path}')"
    start = "''" if not path else "node_path"
    own = f"'{code}' || i" if not path else f"parent_path || '.{code}' || i"
    return f"""{name} AS (SELECT record_id, parent_path, {own} AS node_path, l[i + 1] AS v FROM (
  SELECT record_id, parent_path, l, unnest(range(0, len(l))) AS i FROM (SELECT record_id, {start} AS parent_path, {_LIST.format(x=inner)} AS l FROM {parent}))
  WHERE json_type(l[i + 1]) <> 'NULL')"""


def _rag(width: int, k: int) -> str:
    return f"""WITH {_PAGES},
chunks AS (SELECT page_id, c::INT AS chunk_no, substr(text, (c * {width} + 1)::BIGINT, {width}) AS chunk FROM (SELECT page_id, text, unnest(range(0, (length(text) + {width - 1}) // {width})) AS c FROM pages WHERE length(text) > 0)),
texts AS (SELECT page_id, chunk_no, chunk AS t FROM chunks UNION ALL SELECT page_id, -1, text FROM pages WHERE page_id % 100 = 0 AND text IS NOT NULL),
w AS (SELECT page_id, chunk_no, unnest({_TOKENS.format(x="t")}) AS token FROM texts),
v AS ({_vectors("w", "page_id, chunk_no")}),
n AS (SELECT page_id, chunk_no, sqrt(sum(v * v)) AS norm FROM v GROUP BY ALL),
asks AS (SELECT page_id, norm FROM n WHERE chunk_no = -1),
s AS (SELECT a.page_id AS asker, b.page_id, b.chunk_no, round(coalesce((SELECT sum(x.v * y.v) FROM v x JOIN v y ON x.dim = y.dim WHERE x.page_id = a.page_id AND x.chunk_no = -1 AND y.page_id = b.page_id AND y.chunk_no = b.chunk_no), 0) / (a.norm * b.norm), 9) AS sim
  FROM asks a JOIN n b ON b.chunk_no >= 0 AND b.page_id <> a.page_id),
r AS (SELECT *, row_number() OVER (PARTITION BY asker ORDER BY sim DESC, page_id, chunk_no) AS rank FROM s),
c AS (SELECT asker, string_agg(chunk, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN chunks USING (page_id, chunk_no) WHERE rank <= {k} GROUP BY asker)
SELECT page_id, context, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt FROM c JOIN pages ON page_id = asker"""


def _leaves(name: str) -> str:
    return f"WITH {_NODES} SELECT record_id, parent_path, node_path, v->>'Input' AS input, v->>'Output' AS output, v->>'Explanation' AS explanation FROM {name}"


_NODES = ",\n".join(
    (
        "raws AS (SELECT record_id, raw_json::JSON AS raw FROM instruction_files WHERE record_id IS NOT NULL AND json_valid(raw_json))",
        _level("tn", "raws", "t", ""),
        _level("cn", "tn", "c", '$."Instruction information".Categories'),
        _level("dn", "tn", "d", "$.Definition"),
        _level("nn", "tn", "n", '$."Negative Example"'),
        _level("pn", "tn", "p", '$."Positive Example"'),
        _level("vn", "pn", "v", "$.Variants"),
        _level("sn", "vn", "s", "$.Shuffles"),
    )
)

ORACLES: dict[str, str] = {
    "p5_found": f"WITH {_NODES} " + " UNION ALL ".join(f"SELECT record_id, parent_path, node_path FROM {n}" for n in ("tn", "cn", "dn", "nn", "pn", "vn", "sn")),
    "p5_task": f"WITH {_NODES} SELECT record_id, parent_path, node_path FROM tn",
    "p5_category": f"WITH {_NODES} SELECT record_id, parent_path, node_path, v->>'$' AS value FROM cn",
    "p5_definition": f"WITH {_NODES} SELECT record_id, parent_path, node_path, v->>'$' AS value FROM dn",
    "p5_positive": _leaves("pn"),
    "p5_negative": _leaves("nn"),
    "p5_variant": _leaves("vn"),
    "p5_shuffle": _leaves("sn"),
    "p5_rejects": "SELECT record_id, CASE WHEN raw_json IS NULL THEN 'no text' WHEN trim(raw_json) = '' THEN 'blank' ELSE 'no JSON' END AS reason FROM instruction_files WHERE record_id IS NOT NULL AND (raw_json IS NULL OR NOT json_valid(raw_json))",
    "mc_parse": f"""WITH {_MC} SELECT seed_ord, head, tail, options[1] AS option_a, options[2] AS option_b, options[3] AS option_c, options[4] AS option_d, answer_idx,
  substr(cuts[2], 1, 2) || substr(cuts[3], 1, 2) || substr(cuts[4], 1, 2) = 'B)C)D)' AS labels_ok FROM mc""",
    "qa_parse": f"WITH {_QA} SELECT seed_ord, head, fact, question FROM qa",
    "parse_rejects": f"WITH {_MC}, {_QA[len(_EX) + 2 :]} SELECT task_kind, reason, count(*) AS n FROM (SELECT task_kind, reason FROM mc2 UNION ALL SELECT task_kind, reason FROM qa1) WHERE reason IS NOT NULL GROUP BY ALL",
    "mc_shuffle": f"""WITH {_MC}, m AS (SELECT *, {_permuted("options", "seed_ord")} AS moved FROM mc)
  SELECT seed_ord, head || {_labels("moved")} AS input, chr((64 + list_position(moved, options[answer_idx + 1]))::INT) AS output FROM m""",
    "mc_distractors": f"""WITH {_MC}, m AS (SELECT seed_ord, output, {_wrong("'M1'", "seed_ord")} AS wrong FROM mc)
  SELECT seed_ord, output, neg_slot, wrong[neg_slot + 1] AS wrong FROM m, (SELECT unnest(range(0, 2))::INT AS neg_slot)""",
    "mc_augment_pos": f"WITH {_MC_FAN} SELECT {_SHOWN} FROM ({_MC_POS})",
    "mc_augment_neg": f"WITH {_MC_FAN} SELECT {_SHOWN} FROM ({_MC_NEG})",
    "qa_augment_pos": f"WITH {_QA_FAN} SELECT {_SHOWN} FROM ({_QA_POS})",
    "qa_augment_neg": f"WITH {_QA_FAN} SELECT {_SHOWN} FROM ({_QA_NEG})",
    "augment_counts": f"""WITH {_MC}, {_QA[len(_EX) + 2 :]}, b AS (SELECT * FROM (VALUES ('M0', 'positive', 1), ('M1', 'negative', 2), ('M2', 'positive', 10), ('M3', 'negative', 20), ('M4', 'positive', 20), ('M5', 'negative', 40),
  ('Q0', 'positive', 1), ('Q1', 'positive', 10), ('Q2', 'negative', 20), ('Q3', 'positive', 10), ('Q4', 'negative', 20)) t(branch, polarity, k)),
  s AS (SELECT 'M' AS b, task_kind, count(*) AS n FROM mc GROUP BY ALL UNION ALL SELECT 'Q', task_kind, count(*) FROM qa GROUP BY ALL)
  SELECT task_kind, polarity, branch, n * k AS n FROM b JOIN s ON s.b = substr(branch, 1, 1)""",
    "prompt_corpus": f"""WITH {_EX} SELECT example_id, coalesce(file, '') AS file, CASE WHEN task_kind = 'Multiple Selection' THEN 0 ELSE 1 END AS task_ord, CASE WHEN polarity = 'positive' THEN 0 ELSE 1 END AS polarity_ord,
  CASE WHEN polarity = 'positive' THEN input || chr(10) || 'The answer to the question is:' || chr(10) || output || chr(10) || 'The reason for the answer is: ' || coalesce(explanation, 'undefined')
  ELSE input || chr(10) || 'The answer to the question is definitely not the following:' || chr(10) || output || chr(10) || 'The reason for it''s not the answer is: ' || coalesce(explanation, 'undefined') END AS prompt
  FROM ex WHERE input IS NOT NULL AND output IS NOT NULL""",
    "holdout_split": f"""WITH {_EX} SELECT example_id, CASE WHEN row_number() OVER (ORDER BY md5('0:' || example_id)) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM ex""",
    "head_batches": f"""WITH {_EX}, h AS (SELECT * FROM ex WHERE input IS NOT NULL AND output IS NOT NULL ORDER BY example_id LIMIT 10)
  SELECT example_id, input || chr(10) || CASE WHEN polarity = 'positive' THEN 'The answer to the question is:' ELSE 'The answer to the question is definitely not the following:' END || chr(10) || output || chr(10)
  || CASE WHEN polarity = 'positive' THEN 'The reason for the answer is: ' ELSE 'The reason for it''s not the answer is: ' END || coalesce(explanation, 'undefined') AS prompt,
  ((row_number() OVER (ORDER BY example_id) - 1) // 4)::INT AS batch FROM h""",
    "row_by_index": f"WITH {_EX} SELECT example_id, polarity, row_number() OVER (ORDER BY example_id) - 1 AS row_index FROM ex",
    "option_top3": """SELECT example_id, CASE WHEN scores IS NOT NULL THEN array_to_string(list_transform(list_sort(list_transform(range(0, 4), lambda i: {'s': scores[i + 1], 'l': ['A', 'B', 'C', 'D'][i + 1]}), 'DESC', 'NULLS LAST')[1:3], lambda p: p.l), ' ') END AS top3 FROM option_scores""",
    "option_hits": """SELECT CASE WHEN scores IS NOT NULL THEN list_sort(list_transform(range(0, 4), lambda i: {'s': scores[i + 1], 'l': ['A', 'B', 'C', 'D'][i + 1]}), 'DESC', 'NULLS LAST')[1].l END AS best, pred, count(*) AS n FROM option_scores GROUP BY ALL""",
    "rouge1": _rouge(1),
    "rouge2": _rouge(2),
    "rouge_l": f"WITH RECURSIVE {_LCS} SELECT pair_id, round(f, 6) AS rouge_l, round(f, 6) AS rouge_l_sum FROM l2",
    "rouge": f"WITH RECURSIVE {_LCS}, one AS ({_rouge(1)}), two AS ({_rouge(2)}) SELECT (SELECT round(avg(f1), 6) FROM one) AS rouge1, (SELECT round(avg(f1), 6) FROM two) AS rouge2, round(avg(f), 6) AS rougeL, round(avg(f), 6) AS rougeLsum, count(*) AS pairs FROM l2",
    "bleu": _bleu(),
    "bertscore": f"WITH {_BERT} SELECT pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s",
    "mean_f1": f"WITH {_BERT} SELECT round(avg(f1), 6) AS mean_f1 FROM s",
    "token_vectors": f"WITH {_FITTED} SELECT token, n, string_agg(v::BIGINT::VARCHAR, ' ' ORDER BY dim) AS vector FROM fitted GROUP BY ALL",
    "loss_series": "SELECT run_id, e.step AS step, e.loss AS loss FROM (SELECT run_id, unnest(log_history) AS e FROM train_log) WHERE e IS NOT NULL",
    "trainer_state_read": "SELECT run_id, e.step AS step, e.loss AS loss FROM (SELECT run_id, unnest(log_history) AS e FROM train_log) WHERE e IS NOT NULL",
    "page_documents": f"WITH {_PAGES} SELECT page_id, coalesce(text, '') AS page_content, url AS source FROM pages",
    "page_chunks": f"""WITH {_PAGES} SELECT page_id, k::INT AS chunk_no, substr(text, (k * 200 + 1)::BIGINT, 200) AS chunk
  FROM (SELECT page_id, text, unnest(range(0, (length(text) + 199) // 200)) AS k FROM pages WHERE length(text) > 0)""",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim
  FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) SELECT query_id, rank::INT AS rank, id, round(sim, 6) AS similarity FROM r WHERE rank <= 4""",
    "rag_context": _rag(200, 4),
    "seed_prompt": f"""WITH {_QA}, f AS (SELECT file, string_agg(json_object('Input', input, 'Output', output, 'Explanation', coalesce(explanation, 'undefined'))::VARCHAR, ',' || chr(10) ORDER BY seed_ord) AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seed_ord) AS k FROM qa) WHERE k <= 2 GROUP BY file)
  SELECT c.file, replace(replace(replace('{TEMPLATE}', '{{website}}', website), '{{examples}}', coalesce(shown, '')), '{{wanted}}', '10') AS prompt
  FROM (SELECT file, min(website) AS website FROM catalog WHERE website IS NOT NULL GROUP BY file) c LEFT JOIN f ON f.file = c.file""",
    "written_seeds": f"""WITH {_QA} SELECT file, floor(seed_ord / 100)::BIGINT AS part, (row_number() OVER (PARTITION BY file, floor(seed_ord / 100) ORDER BY seed_ord) - 1)::INT AS seed_ord, input, output, explanation FROM qa""",
    "provider_requests": f"""WITH {_MC}, c AS (SELECT file, min(website) AS website FROM catalog WHERE website IS NOT NULL GROUP BY file)
  SELECT md5(concat_ws(':', '0', 'paraphrase_explanation', file, task_kind, seed_ord::VARCHAR, '2', coalesce(website, chr(2)), coalesce(explanation, chr(2)))) AS req_id, 'paraphrase_explanation' AS op, 2 AS draw, website AS site,
  json_object('input', input, 'output', output, 'explanation', explanation)::VARCHAR AS record, explanation AS text FROM mc LEFT JOIN c USING (file)""",
    "catalog_lookup": f"WITH {_EX} SELECT c.file, website, n FROM (SELECT file, count(*) AS n FROM ex GROUP BY file) e JOIN catalog c ON c.file = e.file",
    "nested_export": f"""WITH {_EX} SELECT coalesce(file, '') AS file, floor(example_id / 1000)::BIGINT AS part, task_kind, (count(*) FILTER (polarity = 'positive'))::INT AS positives, (count(*) FILTER (polarity = 'negative'))::INT AS negatives,
  md5(coalesce(string_agg(concat_ws('|', input, output, explanation), chr(10) ORDER BY example_id) FILTER (polarity = 'positive'), '')) AS positives_digest,
  md5(coalesce(string_agg(concat_ws('|', input, output, explanation), chr(10) ORDER BY example_id) FILTER (polarity = 'negative'), '')) AS negatives_digest
  FROM ex WHERE input IS NOT NULL AND output IS NOT NULL GROUP BY 1, 2, 3""",
    "file_round_trip": f"""WITH {_EX}, {_NODES},
  f AS (SELECT file, c.v->>'$' AS task_kind, min(d.v->>'$') AS definition FROM cn c JOIN dn d USING (record_id, parent_path) JOIN instruction_files USING (record_id) WHERE file IS NOT NULL GROUP BY ALL),
  e AS (SELECT coalesce(file, '') AS file, task_kind, polarity, (row_number() OVER (PARTITION BY coalesce(file, ''), floor(example_id / 100000), task_kind, polarity ORDER BY example_id) - 1)::INT AS seed_ord, input, output, explanation FROM ex WHERE input IS NOT NULL AND output IS NOT NULL)
  SELECT file, task_kind, coalesce(definition, '') AS definition, polarity, seed_ord, input, output, explanation FROM e LEFT JOIN f USING (file, task_kind)""",
    "answer_distribution": f"WITH {_MC} SELECT file, output AS answer, count(*) AS n FROM mc GROUP BY ALL",
    "answer_containment": f"""WITH {_QA} SELECT file, CASE WHEN contains(fact, output) THEN 'exact' WHEN contains(lower(fact), lower(output)) THEN 'ignoring case' ELSE 'no' END AS contained, count(*) AS n FROM qa GROUP BY ALL""",
}
