"""SQL for DuckDB: what the queries of this subpackage must return, written apart from the operators."""

from __future__ import annotations

import unicodedata

_WORDS = r"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

_POSITIVE = """pos AS (SELECT example_id, input, output, explanation FROM (
  SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY loaded_at) AS rn FROM examples WHERE polarity = 'positive' AND example_id IS NOT NULL) WHERE rn = 1)"""

_COPIES = f"""{_POSITIVE},
w AS (SELECT example_id, {_WORDS.format(x="input")} AS i, {_WORDS.format(x="output")} AS o, {_WORDS.format(x="explanation")} AS e FROM pos),
k AS (SELECT example_id, CASE WHEN i LIKE 'question %' AND position(' fact ' IN i) > 0 THEN substr(i, position(' fact ' IN i) + 1) || ' ' || substr(i, 1, position(' fact ' IN i) - 1) ELSE i END AS i, o, e FROM w),
g AS (SELECT example_id, min(example_id) OVER (PARTITION BY i, o, e) AS first_id FROM k)"""

_NEAR = f"""{_POSITIVE},
w AS (SELECT example_id, {_WORDS.format(x="input")} AS t FROM pos WHERE input IS NOT NULL),
t AS (SELECT t, min(example_id) AS tid FROM w WHERE t <> '' GROUP BY t),
l AS (SELECT tid, string_split(t, ' ') AS a FROM t),
s AS (SELECT DISTINCT tid, unnest(list_transform(range(1, greatest(len(a) - 1, 1)), lambda k: a[k] || ' ' || a[k + 1] || ' ' || a[k + 2])) AS g FROM l),
n AS (SELECT tid, count(*) AS n FROM s GROUP BY tid),
h AS (SELECT x.tid AS a, y.tid AS b, count(*) AS hit FROM s x JOIN s y ON x.g = y.g AND x.tid < y.tid GROUP BY ALL),
e AS (SELECT a, b FROM h JOIN n p ON p.tid = a JOIN n q ON q.tid = b WHERE hit >= 0.55 * (p.n + q.n - hit) - 1e-9),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS start, a AS node FROM both_ways UNION SELECT start, b FROM r JOIN both_ways ON a = node),
c AS (SELECT start AS tid, min(node) AS root FROM r GROUP BY start),
m AS (SELECT example_id, coalesce(root, t.tid) AS first_id FROM w JOIN t USING (t) LEFT JOIN c ON c.tid = t.tid)"""

# Characters with a look-alike that occur in such texts, in Unicode order, and what they look like.
_FROM = "µΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορЅІЈАВЕКМНОРСТУХаеорсухѕіјɡ‐‑K"
_TO = "μABEZHIKMNOPTYXvopSIJABEKMHOPCTYXaeopcyxsijg--K"
# Ligatures and number letters, whose form NFKC gives
_JOINED = "ﬀﬁﬂﬃﬄⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"


def _looks() -> str:
    text = r"regexp_replace(regexp_replace(text, '\p{Cf}', '', 'g'), '[\t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g')"
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    text = f"translate({text}, '{wide}', '{narrow}')"
    for c in _JOINED:
        text = f"replace({text}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    # a letter with an accent is mapped as its bare letter is
    for c in (*range(0xC0, 0x180), *range(0x386, 0x3CF), *range(0x400, 0x4FA)):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0] in _FROM:
            text = f"replace({text}, '{chr(c)}', '{unicodedata.normalize('NFC', _TO[_FROM.index(d[0])] + d[1:])}')"
    return f"translate({text}, '{_FROM}', '{_TO}')"


_LOOKS = f"look AS (SELECT doc_id, {_looks()} AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), g AS (SELECT doc_id, form, min(doc_id) OVER (PARTITION BY nfc_normalize(form)) AS first_id FROM look)"

ORACLES: dict[str, str] = {
    "p2_found": f"WITH {_COPIES} SELECT first_id, example_id AS copy_id FROM g WHERE example_id <> first_id",
    "p2_collapsed": f"WITH {_COPIES} SELECT first_id, count(*) AS copies FROM g GROUP BY first_id",
    "p3_found": f"WITH RECURSIVE {_NEAR} SELECT first_id, example_id AS member_id FROM m WHERE example_id <> first_id",
    "p6_check": "SELECT spec_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0::BIGINT AS torn, 0::BIGINT AS over, 0::BIGINT AS misfilled FROM pack_spec",
    "p7_check": "SELECT mix_name, source, true AS met, 0::BIGINT AS over, 0::BIGINT AS twice, 0::BIGINT AS foreign FROM mix_target",
    "p8_form": f"WITH {_LOOKS} SELECT g.doc_id, g.first_id, h.form FROM g JOIN g h ON h.doc_id = g.first_id",
    "p8_found": f"WITH {_LOOKS} SELECT first_id, doc_id AS copy_id FROM g WHERE doc_id <> first_id",
}
