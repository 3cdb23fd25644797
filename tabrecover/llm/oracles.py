"""SQL twins of the numbered queries, where SQL can express them.

Token ids, learned weights, edit distances and the walk round a ring are beyond
it; those queries are tested against libraries and brute force.
"""

from __future__ import annotations

from tabrecover.llm.chat import CONTROL
from tabrecover.llm.queries import CONTROL_CONVERSATION, NEAREST, QUERY_IDS, TOP_K, URL_RULES
from tabrecover.llm.url_filters import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"

NEAR = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s
    FROM split
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT a, y FROM reach JOIN links ON b = x
), named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_length(column: str) -> str:
    def found(s: str) -> str:
        return f"(length({column}) - length(replace({column}, {_literal(s)}, ''))) // {len(s)}"

    return " + ".join([f"length({column})", *(found(s) for s in ("\\", *CONTROL))])


CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL
        SELECT * FROM (VALUES {", ".join(f"({c}, {t}, {_literal(r)}, {_literal(x)})" for c, t, r, x in CONTROL_CONVERSATION)})
    )
), sized AS (
    SELECT *, 13 + {_escaped_length("role")} + {_escaped_length("text")} AS size,
        CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    sum(length(learned))::BIGINT AS loss_chars,
    sha256(string_agg(learned, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

# The tables hold no canonical or redirect links, so the aliases of a url are its spellings.
URLS = rf"""
WITH rules(action, rule_host, rule_path) AS (VALUES {", ".join(f"({_literal(a)}, {_literal(h)}, {_literal(p)})" for a, h, p in URL_RULES)}),
places AS (
    SELECT row_number() OVER () AS id, page_id, rest,
        translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), aliases AS (
    SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_\w+|ref|gclid|fbclid)(=|$)'))) AS kept,
        regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') AS place
    FROM places
), fits AS (
    SELECT id, arg_max(rule_host || rule_path, (length(rule_host || rule_path), action = 'allow')) AS rule,
        arg_max(action, (length(rule_host || rule_path), action = 'allow')) AS action
    FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY id
)
SELECT page_id, host, path, rule, coalesce(action,
    CASE WHEN host <> '' THEN min(action) OVER (PARTITION BY place || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END) END,
    'allow') AS verdict
FROM aliases LEFT JOIN fits USING (id)
"""

REPEATS = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS key
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
    FROM windows JOIN (SELECT key, min(doc_id) AS least FROM windows GROUP BY key) USING (key) WHERE least < doc_id
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

SEARCH = f"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL
), terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM split) GROUP BY ALL),
totals AS (SELECT count(*) AS n, avg(len(w)) AS average FROM split),
weights AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM terms, totals GROUP BY term, n),
scores AS (
    SELECT q.doc_id AS query_id, d.doc_id, sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len(w) / average))) AS score
    FROM terms q JOIN terms d USING (term) JOIN weights USING (term) JOIN split ON split.doc_id = d.doc_id, totals
    WHERE q.doc_id % 50 = 0 GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM scores
)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= {TOP_K}
"""

AUDIT = f"""
WITH split AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), facts AS (
    SELECT part, (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
        (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT AS c,
        regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS e,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
        doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
    FROM split
), cells AS (
    SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
    FROM facts GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
    SELECT filter_order, step, [strpos('ABCDE', substr(filter_order, i, 1)) FOR i IN range(1, step)] AS earlier,
        strpos('ABCDE', substr(filter_order, step, 1)) AS own
    FROM orders, range(1, 6) AS n(step)
), judged AS (
    SELECT part, filter_order, step, own, n, n_good, n_toxic, fails[own] = 1 AS failing, list_sum(fails) = 1 AS alone,
        len(list_filter(earlier, lambda i: fails[i] = 1)) = 0 AS present
    FROM cells, steps
), summed AS (
    SELECT part, filter_order, step::INTEGER AS step, own,
        coalesce(sum(n) FILTER (present AND NOT failing), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (present AND failing), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (NOT present AND failing), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (failing AND alone), 0)::BIGINT AS unique_fails,
        coalesce(sum(n_good) FILTER (present AND failing), 0)::BIGINT AS good_lost,
        coalesce(sum(n_toxic) FILTER (present AND failing), 0)::BIGINT AS toxic_lost
    FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed
"""

NEAREST_VECTORS = f"""
WITH v AS (
    SELECT row_number() OVER () AS nr, vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), lengths AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
scored AS (
    SELECT q.nr, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.size * c.size) AS score
    FROM lengths q JOIN lengths c ON len(q.e) = len(c.e) AND q.nr <> c.nr WHERE q.vec_id % {QUERY_IDS} = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {NEAREST}
"""

ORACLES: dict[str, str] = {
    "op3_minhash_forest": NEAR,
    "op4_chat_tree": CHAT,
    "op5_url_filters": URLS,
    "op6_substring_dedup": REPEATS,
    "op10_topk_search": SEARCH,
    "op12_filter_audit": AUDIT,
    "op13_nearest": NEAREST_VECTORS,
}
