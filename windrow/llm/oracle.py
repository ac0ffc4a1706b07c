"""The queries of this subpackage as SQL, where SQL can express them."""

from __future__ import annotations

from windrow.llm.decontaminate import WINDOW

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {WORDS} AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM item, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS t(i) WHERE len(w) > 0
),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
hit AS (
  SELECT doc_id, i, size, item_id
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM pattern))
  JOIN pattern USING (size) WHERE array_to_string(w[i : i + size - 1], ' ') = gram
),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id
),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Runs of one, two or three lines, compared by the lines themselves; one or two lines must hold fifty words.
LINES = """
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
piece AS (
  SELECT doc_id, i, size, array_to_string(lines[i : i + size - 1], chr(10)) AS run
  FROM (SELECT *, unnest([1, 2, 3]) AS size FROM doc), unnest(range(1, len(lines) - size + 2)) AS t(i)
),
run AS (
  SELECT * FROM piece WHERE size = 3 OR len(regexp_extract_all(run, '[^\\x20\\x09-\\x0D]+')) >= 50
),
later AS (
  SELECT doc_id, i, size
  FROM (SELECT doc_id, i, size, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, i) AS nth FROM run)
  WHERE nth > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM later),
heads AS (SELECT doc_id, i, i - 1 = lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS goes_on FROM gone),
counts AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (goes_on IS NOT TRUE) AS n_runs, list(i) AS gone
  FROM heads GROUP BY doc_id
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
  sha256(coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10)), ''))
    AS kept_sha256
FROM doc LEFT JOIN counts USING (doc_id)
"""

# Five hex digits are four digits to base 32.
BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(sha, {5 * g + 1}, 5) AS BIGINT) >> {shift}) % 32 + 1, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)
WARC = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
named AS (SELECT *, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY sha, octet_length(encode(html))) AS first FROM page)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM named
"""


# Bytes of the decimal id and eight shifts after each, from the value that the checksum starts with.
CRC32_STEPS = """
  [4294967295] || flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
    lambda i: [512 + ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER), 1)), 0, 0, 0, 0, 0, 0, 0, 0]))
"""
CRC32 = f"""xor(list_reduce(list_transform({CRC32_STEPS}, lambda x: CAST(x AS BIGINT)),
  lambda c, s: CASE WHEN s >= 512 THEN xor(c, s - 512) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
CONVERSATIONS = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM turns
),
conv AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
made AS (
  SELECT c.conv_id, place, digest, text FROM conv c JOIN placed t ON t.conv_id = c.base AND place < h
  UNION ALL
  SELECT c.conv_id, place, digest, text FROM conv c JOIN placed t ON t.conv_id = c.conv_id AND place >= h
),
prefix AS (
  SELECT conv_id, row_number() OVER line AS depth, length(text) AS chars, md5(string_agg(digest, '') OVER line) AS name
  FROM made WINDOW line AS (PARTITION BY conv_id ORDER BY place)
),
member AS (
  SELECT *, lag(name, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM prefix
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM conv
),
node AS (
  SELECT name, any_value(depth) AS depth, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs
  FROM member GROUP BY name
),
child AS (SELECT up AS name, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT m.name, u.name AS low FROM member m JOIN member u ON m.conv_id = u.conv_id AND u.depth >= m.depth),
total AS (
  SELECT b.name, count(*) FILTER (c.n IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens
  FROM below b JOIN node n ON n.name = b.low LEFT JOIN child c ON c.name = b.low GROUP BY b.name
),
ends AS (
  SELECT name, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(name, depth) AS name FROM member GROUP BY conv_id) GROUP BY name
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM node n LEFT JOIN node p ON p.name = n.up LEFT JOIN child c ON c.name = n.name
  JOIN total t ON t.name = n.name LEFT JOIN ends e ON e.name = n.name
"""


def llm_sql() -> dict[str, str]:
    return {"op1_decontaminate": DECONTAMINATE, "op8_lines": LINES, "op9_warc": WARC, "op12_conversations": CONVERSATIONS}
