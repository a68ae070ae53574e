"""DuckDB SQL for the training-data queries whose results SQL can express."""

from __future__ import annotations

from .licences import ANCHORS, BLANK, MARKS, SIMILARITY, SPACE, TEMPLATES
from .secrets import ADDED, BASE

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DECONTAMINATE = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes)),
hit AS (SELECT DISTINCT doc_id, dw.n, i, item FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_SPACE}), {_LOW}) AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, pos, line, g.keeper IS NULL OR g.keeper = k.doc_id AS stays FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256 FROM f GROUP BY doc_id"""

SUBSTRINGS = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first ON first.k = win.k WHERE first_doc < win.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS text FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def secrets() -> str:
    """Matches and the pieces between them give the places, as in the query."""
    parts, rules = [], (*BASE, *ADDED)
    for rank, r in enumerate(rules):
        p = _quoted(r.pattern)
        found = f"regexp_extract_all(coalesce(text, ''), {p}, 0)"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, found[i] AS hit, grp[i] AS grp,
list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda g: length(g))), 0) AS begins
FROM (SELECT doc_id, found, grp, gaps, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, {found} AS found, regexp_extract_all(coalesce(text, ''), {p}, {r.group}) AS grp, string_split_regex(coalesce(text, ''), {p}) AS gaps FROM documents)) WHERE length(grp[i]) >= {r.least}""")
    span = "kind || ':' || begins::BIGINT::VARCHAR || ':' || (begins + length(hit))::BIGINT::VARCHAR"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY begins, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY begins, rank) FILTER (rank IS NOT NULL), '') AS spans
FROM documents AS d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def licences() -> str:
    templates = ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))
    # RE2 has no look-around: a mark is put at the ends of sentences and at full stops that aren't followed by a digit.
    terms = lambda x: f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({x}), '[.]([^0-9]|$)', ' \\1', 'g'), '[.]([^0-9]|$)', ' \\1', 'g'), '[^a-z0-9.]+'), lambda z: z <> '')"
    cut = lambda x: f"regexp_split_to_array(regexp_replace({x}, '([.;:])\\s+([A-Z])', '\\1' || chr(10) || '\\2', 'g'), '\\n')"
    longest = max(len(t) for _, t in TEMPLATES) + 40
    return f"""WITH t(id, licence, text) AS (VALUES {templates}), f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id::VARCHAR AS path, source || '/' || lang AS folder, coalesce(text, '') AS text FROM documents),
tt AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms("text")}) AS term FROM t) GROUP BY 1, 2), v AS (SELECT DISTINCT term FROM tt), n AS (SELECT count(*) AS n FROM f),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({terms("text")})) AS term FROM f) WHERE term IN (SELECT term FROM v) GROUP BY 1),
idf AS (SELECT v.term, ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) + 1 AS idf FROM v LEFT JOIN df ON df.term = v.term, n),
tw AS (SELECT id, tt.term, tf * idf AS w FROM tt JOIN idf ON idf.term = tt.term), tn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1),
fa AS (SELECT doc_id, text FROM f WHERE regexp_matches(lower(text), '{ANCHORS}')),
lined AS (SELECT doc_id, {cut("text")} AS parts FROM fa),
para AS (SELECT doc_id, nth, x FROM (SELECT doc_id, unnest(ps) AS x, unnest(range(len(ps))) AS nth FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(?m){MARKS}', '', 'g'), '{BLANK}') AS ps FROM fa)) WHERE contains(x, chr(10)) AND regexp_matches(lower(x), '{ANCHORS}')),
wrapped AS (SELECT doc_id, nth, {cut(f"regexp_replace(x, '{SPACE}', ' ', 'g')")} AS parts FROM para),
u AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts)))::VARCHAR AS pos FROM lined
  UNION ALL SELECT doc_id, unnest(parts), nth::VARCHAR || '/' || unnest(range(len(parts)))::VARCHAR FROM wrapped) WHERE regexp_matches(lower(line), '{ANCHORS}')),
uc AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest({terms("line")}) AS term FROM u) GROUP BY ALL),
uw AS (SELECT doc_id, pos, uc.term, tf * coalesce(idf, ln(n + 1.0::DOUBLE) + 1) AS w FROM uc LEFT JOIN idf ON idf.term = uc.term, n), un AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
c AS (SELECT uw.doc_id, uw.pos, tw.id, sum(uw.w * tw.w / tn.norm) AS dot FROM uw JOIN tw ON tw.term = uw.term JOIN tn ON tn.id = tw.id GROUP BY ALL),
s AS (SELECT c.doc_id, licence, round(dot / un.norm, 6) AS cosine FROM c JOIN un ON un.doc_id = c.doc_id AND un.pos = c.pos JOIN t ON t.id = c.id),
own AS (SELECT doc_id, max(cosine) AS cosine, max_by(licence, (cosine, licence)) AS own FROM s WHERE cosine >= {SIMILARITY} GROUP BY 1),
given AS (SELECT folder, min_by(own, (-cosine, path)) AS given FROM f JOIN own ON own.doc_id = f.doc_id WHERE NOT contains(trim(text), chr(10)) AND length(text) <= {longest} GROUP BY 1),
above AS (SELECT DISTINCT folder, far, chain[far + 1] AS above FROM (SELECT folder, chain, unnest(range(3)) AS far FROM (SELECT DISTINCT folder, [folder, split_part(folder, '/', 1), ''] AS chain FROM f))),
near AS (SELECT above.folder, min_by(above.above, far) AS above, min_by(given, far) AS given FROM above JOIN given ON given.folder = above.above GROUP BY 1)
SELECT f.doc_id, f.path, own, cosine, coalesce(own, near.given) AS licence, CASE WHEN own IS NOT NULL THEN 'own' WHEN near.given IS NOT NULL THEN '/' || near.above END AS origin
FROM f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN near ON near.folder = f.folder"""


