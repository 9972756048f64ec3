"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_PLAIN_WORDS = "coalesce(regexp_extract_all(" + _LOW + r", '[^\x20\x09-\x0D]+'), [])"

# texts with a backslash need full escaping, others here need none
CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
sized AS (
    SELECT *, contains(text, '\') AS conflict,
        replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>') AS escaped
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(4 + length(role) + 2 + length(CASE WHEN conflict THEN escaped ELSE text END) + 9)::BIGINT AS formatted_chars,
    max(CASE WHEN conflict THEN 2 ELSE 0 END)::INTEGER AS escape_level
FROM sized GROUP BY conv_id
"""

DECONTAMINATE = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS k, w[s : s + least(10, len(w)) - 1] AS g
    FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(s) WHERE len(w) > 0
),
docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
runs AS (
    SELECT doc_id, k, s, w[s : s + k - 1] AS g
    FROM (SELECT docs.*, k FROM docs, (SELECT DISTINCT k FROM windows)), unnest(range(1, len(w) - k + 2)) AS t(s)
),
hits AS (SELECT DISTINCT doc_id, s, k, item_id FROM runs JOIN windows USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(s, s + k)) AS t(p) GROUP BY doc_id),
found AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit,
    coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
    coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_PLAIN_WORDS.format("text")} AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, w[s : s + 3] AS g
    FROM docs, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(s) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
same AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM same JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * o >= 85 * (x.n + y.n - o)
),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM docs
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""

FILTERS = r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
firsts AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
known AS (
    SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
),
failed AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(known.toxic, 0) AS toxic,
        [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(docs.doc_id > first_id, false)] AS fails
    FROM docs JOIN firsts USING (t) LEFT JOIN known ON known.doc_id = docs.doc_id
),
cells AS (SELECT part, good, toxic, fails, count(*) AS n FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (SELECT filter_order, step, ks[step] AS own, ks[1 : step - 1] AS before FROM orders, unnest(range(1, 6)) AS t(step)),
played AS (
    SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fail,
        list_bool_or(list_transform(before, lambda k: fails[k])) AS gone,
        len(list_filter(fails, lambda x: x)) = 1 AS alone
    FROM cells, steps
),
counted AS (
    SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (NOT fail AND NOT coalesce(gone, false)), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (fail AND NOT coalesce(gone, false)), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fail AND alone), 0)::BIGINT AS unique_fails,
        coalesce(sum(n * good) FILTER (fail AND NOT coalesce(gone, false)), 0)::BIGINT AS good_lost,
        coalesce(sum(n * toxic) FILTER (fail AND NOT coalesce(gone, false)), 0)::BIGINT AS toxic_lost
    FROM played GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""

_TERMS = "coalesce(regexp_extract_all(" + _LOW + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), [])"

DIVERGENCE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS.format("text")} AS w
    FROM documents
),
words AS (SELECT doc, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_count FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_count) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT lang, source, coalesce(sum(c), 0) AS n
    FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL
),
rated AS (
    SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (g.n + 5 * l.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (lang_count + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
        FROM rated x JOIN rated y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, p - q FROM rated WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
    (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 50
"""

SQL = {
    "op2_chat_format": CHAT,
    "op4_decontaminate": DECONTAMINATE,
    "op6_jaccard_join": JACCARD,
    "op11_filter_potentials": FILTERS,
    "op12_count_cells": DIVERGENCE,
}
