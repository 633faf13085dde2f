"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licences import CUE, LOOSE_CUE, RULES, SENTENCES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOPK = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# DuckDB strings are UTF-8, so strlen is the payload's length in bytes
WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
    FROM m
"""


_BARE = "trim({}, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"


def lines_cte(docs: str, min_sites: int = 6) -> str:
    """CTEs up to `cleaned` (doc_id, text, n_lines, n_removed, and what else `docs` has)."""
    return f"""
    numbered AS (SELECT *, row_number() OVER () AS rn, string_split(text, chr(10)) AS parts FROM {docs}),
    opened AS (SELECT rn, source, {_BARE.format("line")} AS line, pos FROM (SELECT rn, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM numbered)),
    spread AS (SELECT line FROM opened WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {min_sites}),
    own AS (SELECT rn, count(*) AS n FROM opened WHERE line <> '' GROUP BY rn),
    hit AS (SELECT rn, list(pos) AS pos FROM opened JOIN spread USING (line) GROUP BY rn),
    judged AS (SELECT n.*, h.pos AS hits, h.pos IS NOT NULL AND len(h.pos) < o.n AS cut FROM numbered n LEFT JOIN hit h USING (rn) LEFT JOIN own o USING (rn)),
    cleaned AS (
        SELECT * EXCLUDE (text, parts, hits, cut, rn), coalesce(len(parts), 0)::BIGINT AS n_lines,
               CASE WHEN cut THEN len(hits) ELSE 0 END::BIGINT AS n_removed,
               CASE WHEN cut THEN array_to_string(list_filter(parts, lambda x, i: NOT list_contains(hits, i - 1)), chr(10)) ELSE text END AS text
        FROM judged
    )"""


LINES = "WITH" + lines_cte("documents") + " SELECT doc_id, n_lines, n_removed, text FROM cleaned"


def licences_sql() -> str:
    known = "CASE s " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in SENTENCES.items()) + " END"
    speaks = "regexp_matches(s, 'licen[cs]ed? under|under the terms of .*licen[cs]e|released under .*licen[cs]e')"
    cue = LOOSE_CUE
    normal = r"trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9.]+', ' ', 'g'), '\.+( |$)', ' ', 'g'), ' ')"
    sql = rf"""
    WITH t AS (SELECT doc_id, row_number() OVER () AS rn, replace(coalesce(text, ''), '!!', '') AS t FROM documents),
    o AS (SELECT rn, unnest(parts) AS x, unnest(range(len(parts))) AS pos FROM (
        SELECT rn, string_split_regex(t, '[.!?;:]+[ \t\r]*\n|[.!?]+ |\n') AS parts FROM t WHERE regexp_matches(lower(t), {_quoted(cue)}))),
    s AS (SELECT rn, pos, {normal} AS s FROM o),
    i AS (SELECT rn, pos, coalesce({known}, CASE WHEN {speaks} THEN 'UNKNOWN' END) AS i FROM s WHERE regexp_matches(s, {_quoted(CUE)})),
    g AS (SELECT rn, list(i ORDER BY pos) AS ids FROM i WHERE i IS NOT NULL GROUP BY rn),
    r0 AS (SELECT doc_id, coalesce(ids, []) AS ids, ' ' || array_to_string(list_transform(coalesce(ids, []), lambda x: x || ' '), ' ') AS rest, []::VARCHAR[] AS got FROM t LEFT JOIN g USING (rn))"""
    for n, (licence, needs) in enumerate(RULES):
        sign = _quoted(f" {'  '.join(needs)} ")
        sql += f",\n    r{n + 1} AS (SELECT doc_id, ids, replace(rest, {sign}, ' ') AS rest, CASE WHEN contains(rest, {sign}) THEN list_append(got, {_quoted(licence)}) ELSE got END AS got FROM r{n})"
    return sql + f"\n    SELECT doc_id, array_to_string(ids, ',') AS identifiers, array_to_string(list_sort(list_distinct(got)), ',') AS licences FROM r{len(RULES)}"


_ID = "(CASE WHEN conv_id % 11 = 4 THEN floor({0} / 4.0)::BIGINT * 4 ELSE {0} END)::VARCHAR"

# places by all chains of needs: a chain as long as a conversation has calls goes in a circle
TOOLCALLS = f"""
    WITH RECURSIVE asked AS (
        SELECT conv_id, {_ID.format("turn")} AS call_id, turn,
               CASE WHEN conv_id % 13 = 5 THEN [{_ID.format("(turn - 2)")}, {_ID.format("(turn + 2)")}] WHEN conv_id % 3 = 0 THEN [{_ID.format("(turn + 2)")}] ELSE [{_ID.format("(turn - 2)")}] END AS needs,
               CASE WHEN conv_id % 7 = 3 THEN '[' || coalesce(to_json(text), 'null') || ']' ELSE '{{' || concat_ws(',',
                   CASE WHEN conv_id % 7 = 1 THEN '"chars":"' || length(text) || '"' ELSE '"chars":' || length(text) END,
                   CASE WHEN conv_id % 7 = 2 THEN '"role":"user"' END, '"text":' || to_json(text)) || '}}' END AS arguments,
               concat_ws(',', CASE WHEN conv_id % 7 = 3 THEN 'not_object' WHEN text IS NULL THEN 'missing:chars,missing:text' WHEN conv_id % 7 = 1 THEN 'type:chars' END,
                   CASE WHEN conv_id % 7 = 2 THEN 'unknown:role' END) AS faults
        FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
    ),
    c AS (SELECT conv_id, call_id, min({{'turn': turn, 'arguments': arguments, 'faults': faults}}) AS c FROM asked GROUP BY 1, 2),
    size AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1),
    edge AS (SELECT DISTINCT a.conv_id, a.call_id, a.need FROM (SELECT conv_id, call_id, unnest(needs) AS need FROM asked) a JOIN c ON c.conv_id = a.conv_id AND c.call_id = a.need),
    chain AS (
        SELECT conv_id, call_id, call_id AS far, 0 AS steps FROM c
        UNION SELECT h.conv_id, h.call_id, e.need, h.steps + 1 FROM chain h JOIN edge e ON e.conv_id = h.conv_id AND e.call_id = h.far JOIN size s ON s.conv_id = h.conv_id WHERE h.steps < s.n
    ),
    placed AS (
        SELECT h.conv_id, h.call_id, CASE WHEN max(h.steps) < max(s.n) THEN max(f.c.turn + h.steps) END AS place
        FROM chain h JOIN c f ON f.conv_id = h.conv_id AND f.call_id = h.far JOIN size s ON s.conv_id = h.conv_id GROUP BY 1, 2
    ),
    r AS (
        SELECT conv_id, {_ID.format("(turn - 1)")} AS call_id, min({{'turn': turn, 'text': text}}) AS r
        FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2
    ),
    b AS (
        SELECT conv_id, call_id, c.turn AS call_turn, r.turn AS result_turn, c.arguments AS arguments, c.faults AS faults, r.text AS a,
               CASE WHEN c IS NULL THEN 'orphan' WHEN r IS NULL THEN 'unanswered' WHEN r.turn <= c.turn THEN 'early' ELSE 'linked' END AS status
        FROM c FULL JOIN r USING (conv_id, call_id)
    )
    SELECT conv_id, call_id, call_turn, result_turn, place, status, coalesce(faults, '') AS faults,
           '{{' || concat_ws(',',
               '"arguments":' || arguments, '"call_id":' || to_json(call_id), CASE WHEN a IS NOT NULL THEN '"content":' || to_json(a) END,
               '"conv_id":' || conv_id, CASE WHEN status <> 'orphan' THEN '"name":"ask"' END,
               '"place":' || place, '"status":"' || status || '"') || '}}' AS record
    FROM b LEFT JOIN placed USING (conv_id, call_id)
"""


# HUGEINT keeps products of counts and billions whole
DIVERGENCE = r"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rn, coalesce(text, '') AS text FROM documents),
    w AS (SELECT lang, source, rn, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT rn) >= 10),
    size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY 1),
    own AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept k USING (lang, term) GROUP BY 1, 2, 3),
    g AS (SELECT DISTINCT lang, source FROM d),
    room AS (SELECT lang, source, coalesce(any_value(size.v), 0) AS v, coalesce(sum(own.n), 0)::HUGEINT AS n FROM g LEFT JOIN own USING (lang, source) LEFT JOIN size USING (lang) GROUP BY 1, 2),
    p AS (
        SELECT r.lang, r.source, k.term, coalesce(o.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 2) // (r.n + 2 * r.v) AS p,
               1 + 1000000000::HUGEINT * (k.n + 2) // (s.n + 2 * s.v) AS q
        FROM room r JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN own o ON o.lang = r.lang AND o.source = r.source AND o.term = k.term
    ),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    said AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
    both_parts AS (FROM pairs UNION ALL FROM said),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
