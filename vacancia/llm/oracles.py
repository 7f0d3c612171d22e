"""DuckDB SQL of the operators that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

OP7 = rf"""WITH d AS (SELECT doc_id, {_words('text', ALNUM)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text', ALNUM)} AS w FROM benchmark),
known AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
seen AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM known) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s.n, i, item FROM seen s JOIN known t ON s.n = t.n AND s.k = t.k),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS listed FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id"""

OP8 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, q FROM (SELECT w.doc_id, unnest(range(p, p + 50)) AS q FROM w JOIN f ON w.k = f.k WHERE w.doc_id > f.first)),
c AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < q - 1) AS n_spans FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS before FROM r) GROUP BY 1),
a AS (SELECT doc_id, h, unnest(range(0, n)) AS q FROM d WHERE doc_id IN (SELECT doc_id FROM c)),
t AS (SELECT a.doc_id, string_agg(substr(h, 2 * a.q + 1, 2), '' ORDER BY a.q) AS kept FROM a LEFT JOIN r ON r.doc_id = a.doc_id AND r.q = a.q WHERE r.q IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN d.h ELSE coalesce(t.kept, '') END)) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP9 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text', SPACED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS root FROM d UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


# Unsigned crc32 of the decimal id, bit by bit: a byte of the id, then eight shifts (-1).
CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"

OP13 = f"""WITH RECURSIVE d AS (SELECT doc_id, 's' || source AS k, {_leaf("text")} AS leaf, CASE WHEN {CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed FROM documents),
l AS (SELECT doc_id, coalesce(k, '') AS k, leaf, changed, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (SELECT k, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM l UNION ALL SELECT k, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY k, lvl, i // 3, n),
s AS (SELECT k, h, row_number() OVER (ORDER BY encode(k)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, h, n FROM s UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, i // 3, n),
g AS (SELECT k, 0 AS part, lvl, i AS j, i // 3 AS up, h FROM t WHERE n > 1 UNION ALL SELECT '', 1, lvl, i, i // 3, h FROM u WHERE n > 1),
a AS (SELECT l.k, l.i, s.i AS si, s.h AS subroot FROM l JOIN s ON s.k = l.k),
p AS (SELECT a.k, a.i, g.part, g.lvl, g.h, g.j, CASE WHEN g.part = 0 THEN a.i // CAST(power(3, g.lvl) AS BIGINT) ELSE a.si // CAST(power(3, g.lvl) AS BIGINT) END AS own FROM a JOIN g ON (g.part = 0 AND g.k = a.k AND g.up = a.i // CAST(power(3, g.lvl + 1) AS BIGINT)) OR (g.part = 1 AND g.up = a.si // CAST(power(3, g.lvl + 1) AS BIGINT))),
q AS (SELECT k, i, row_number() OVER (PARTITION BY k, i ORDER BY part, lvl) AS step, coalesce(string_agg(h, '' ORDER BY j) FILTER (WHERE j < own), '') AS before, coalesce(string_agg(h, '' ORDER BY j) FILTER (WHERE j > own), '') AS after FROM p GROUP BY k, i, part, lvl),
f AS (SELECT k, i, 0 AS step, changed AS h FROM l UNION ALL SELECT f.k, f.i, f.step + 1, sha256(q.before || f.h || q.after) FROM f JOIN q ON q.k = f.k AND q.i = f.i AND q.step = f.step + 1),
e AS (SELECT k, i, arg_max(h, step) AS folded FROM f GROUP BY 1, 2),
r AS (SELECT k, i, string_agg(before || after, '' ORDER BY step) AS proof FROM q GROUP BY 1, 2),
root AS (SELECT h FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, a.subroot, root.h AS root, sha256(coalesce(r.proof, '')) AS proof_sha256, e.folded AS folded_root, e.folded = root.h AS verified FROM l JOIN a ON a.k = l.k AND a.i = l.i JOIN e ON e.k = l.k AND e.i = l.i LEFT JOIN r ON r.k = l.k AND r.i = l.i, root"""
