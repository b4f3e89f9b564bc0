"""DuckDB SQL for the queries whose whole result it expresses.

The others have none: fingerprints and tokens need functions that SQL lacks
(op7, op10, op11, op12), and classifiers, language models and forests are fitted (op2, op3,
op5, op8, op9, pipeline).
"""

from __future__ import annotations

from payspark.llm.chat_tree import END, LEARNT, START
from payspark.llm.decontaminate import WINDOW
from payspark.llm.fim import CUT_RATE, MIDDLE, PREFIX, SPM_RATE, SUFFIX
from payspark.llm.license_scan import LOWER, SEPARATORS, UPPER
from payspark.llm.substrings import LENGTH, PASSAGE

CONTROL = f"{END}{START}assistant ok"
#: What escaping adds to a text: one backslash for each start of a control string.
ADDED = r"len(regexp_extract_all({0}, '<\\*\|'))"
ROLE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"

CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, '{LEARNT}', '{CONTROL}')),
f AS (
  SELECT *, {len(START) + len(END) + 2} + length({ROLE}) + {ADDED.format(ROLE)} + length(text) + {ADDED.format("text")} AS size FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNT}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LEARNT}'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{SEPARATORS[1:]}')"
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
own AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM item) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, k, i FROM own JOIN item USING (k, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hit)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items, coalesce(ids, sha256('')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

REPEATS = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT *, CAST(length(h) / 2 AS BIGINT) AS n FROM t),
long AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT r, h, unnest(range(0, n - {LENGTH} + 1)) AS i FROM d WHERE n >= {LENGTH})),
short AS (SELECT r, md5(substr(h, 2 * i + 1, {2 * PASSAGE})) AS m FROM (SELECT r, h, unnest(range(0, n - {PASSAGE} + 1)) AS i FROM d WHERE n >= {PASSAGE})),
starts AS (SELECT r, i FROM long JOIN (SELECT m FROM long GROUP BY m HAVING count(*) > 1) USING (m)),
passages AS (SELECT DISTINCT r FROM short JOIN (SELECT m FROM short GROUP BY m HAVING count(*) > 1) USING (m)),
runs AS (SELECT r, i, CAST(i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH}, -1) AS INT) AS fresh FROM starts),
spans AS (
  SELECT r, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM runs) GROUP BY r, g),
gaps AS (
  SELECT r, a AS place, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS low, a AS high FROM spans
  UNION ALL SELECT r, n, max(z), n FROM spans JOIN d USING (r) GROUP BY r, n),
kept AS (SELECT r, sha256(unhex(string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY place))) AS sha FROM gaps JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha, sha256(unhex(h))) AS kept_sha256,
  CAST(passages.r IS NOT NULL AS BIGINT) AS repeats
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r) LEFT JOIN passages USING (r)
"""

DRAWN = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)" for k in range(4))
FORMS = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [{DRAWN}] AS d FROM t),
c AS (
  SELECT doc_id, text, u, n, least(d[1] % (n + 1), d[2] % (n + 1)) AS p, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS m,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR d[3] % 100 >= {CUT_RATE} THEN 'plain'
      WHEN d[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM x),
f AS (SELECT doc_id, text, n, form, array_to_string(u[1:p], '') AS prefix, array_to_string(u[p + 1:m], '') AS middle, array_to_string(u[m + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM f
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_tree": CHAT, "op4_decontaminate": CONTAMINATION, "op6_substring_dedup": REPEATS, "op13_middle_filling": FORMS}
