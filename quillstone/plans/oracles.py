"""DuckDB SQL for the named queries."""

from __future__ import annotations

# common table expressions, by name; each may use those before it

_BUCKET = "((256 * ({0} + {1} + {2}) + {3}) % 384)".format(*(f"('0x' || substr(md5(word), {1 + 8 * i}, 8))::BIGINT" for i in range(4)))

CTES = {
    "units": """SELECT doc_id AS id, source AS file, text AS document, doc_id AS seq, 1 AS start_line, len(string_split(text, chr(10)))::INTEGER AS end_line,
        regexp_extract_all(lower(text), '[a-z_0-9]+') AS words, regexp_extract_all(lower(text), '[a-z_0-9]+')[1] AS name FROM documents""",
    "counts": f"""SELECT id, {_BUCKET}::INTEGER AS bucket, sum(n)::BIGINT AS n FROM (
        SELECT id, word, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z_0-9]+')) AS word FROM documents) GROUP BY 1, 2) GROUP BY 1, 2""",
    "vec": "SELECT id, bucket, n / sqrt(sum((n * n)::DOUBLE) OVER (PARTITION BY id)) AS weight FROM counts",
    "qcounts": f"""SELECT id, {_BUCKET}::INTEGER AS bucket, count(*) AS n FROM (
        SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z_0-9]+')) AS word FROM benchmark) GROUP BY 1, 2""",
    "qvec": "SELECT id, bucket, n / sqrt(sum((n * n)::DOUBLE) OVER (PARTITION BY id)) AS weight FROM qcounts",
    "hits": """SELECT question_id, id, sim, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id)::INTEGER AS rank FROM (
        SELECT q.id AS question_id, v.id, round(sum(q.weight * v.weight), 9) AS sim FROM qvec q JOIN vec v USING (bucket) GROUP BY 1, 2)
        QUALIFY rank <= 5""",
    "edges": """SELECT DISTINCT c.src, l.dst, c.src AS seq FROM (SELECT DISTINCT id AS src, unnest(words) AS name FROM units) c
        JOIN (SELECT name, max_by(id, seq) AS dst FROM units WHERE name IS NOT NULL GROUP BY name) l ON c.name = l.name WHERE c.src <> l.dst""",
    "succ": """SELECT h.question_id, e.dst AS id FROM hits h JOIN edges e ON e.src = h.id
        QUALIFY row_number() OVER (PARTITION BY h.question_id, h.id ORDER BY e.seq, e.dst) <= 50""",
    "pred": """SELECT h.question_id, e.src AS id FROM hits h JOIN edges e ON e.dst = h.id
        QUALIFY row_number() OVER (PARTITION BY h.question_id, h.id ORDER BY e.seq, e.src) <= 50""",
    "near": "SELECT * FROM (SELECT * FROM succ UNION SELECT * FROM pred) n WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.question_id = n.question_id AND h.id = n.id)",
    "fused": """SELECT question_id, id, type, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, after, own, id)::INTEGER AS rank FROM (
        SELECT question_id, id, 'seed' AS type, 0.6::DOUBLE * sim + 0.4::DOUBLE AS score, 0 AS after, rank AS own FROM hits
        UNION ALL SELECT question_id, id, 'neighbor', 0.2::DOUBLE, 1, 0 FROM near) QUALIFY rank <= 8""",
    "retrieved": """SELECT f.question_id, f.rank, f.id, u.name, u.file, [u.start_line, u.end_line] AS lines, f.type, round(f.score, 4) AS score, u.document AS content
        FROM fused f JOIN units u USING (id)""",
    "emb": "SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "sims": """SELECT q.id AS query_id, c.id, c.label, q.label AS gold, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - (1.0::DOUBLE - list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))))), 9) AS sim
        FROM emb q JOIN emb c ON q.id <> c.id WHERE q.id % 100 = 0""",
    "hop_succ": "SELECT src AS question_id, dst AS id, seq FROM edges WHERE src % 100 = 0",
    "hop_pred": "SELECT dst AS question_id, src AS id, seq FROM edges WHERE dst % 100 = 0",
    "hosts": "SELECT page_id AS id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS name FROM pages",
    "commits": """SELECT doc_id, lang, split_part(text, chr(10), 1) AS message, text AS old,
        CASE WHEN doc_id % 7 = 0 THEN text ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS new FROM documents""",
    "judged": r"""SELECT doc_id, CASE WHEN lower(coalesce(lang, '')) <> 'en' THEN 'language'
        WHEN len(regexp_extract_all(coalesce(message, ''), '[^\s]+')) < 5 THEN 'message_quality'
        WHEN NOT (length(coalesce(old, '')) < 3500 AND length(coalesce(new, '')) < 3500) THEN 'file_size'
        WHEN old IS NOT DISTINCT FROM new THEN 'actual_change'
        WHEN NOT regexp_matches(coalesce(message, ''), '(?i)(^|[^A-Za-z0-9_])(the|des|der|los)($|[^A-Za-z0-9_])') THEN 'bugfix_signal' END AS reason FROM commits""",
    "scanned": """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS seen, sum((reason IS NULL)::INTEGER) OVER (ORDER BY doc_id)::BIGINT AS accepted FROM judged)
        WHERE accepted - (reason IS NULL)::INTEGER < 100""",
    "repo_edges": "SELECT s.file AS repo, e.src, e.dst, s.name AS source, t.name AS target FROM edges e JOIN units s ON s.id = e.src JOIN units t ON t.id = e.dst WHERE s.name <> '' AND t.name <> ''",
    "sampled": """SELECT *, row_number() OVER (PARTITION BY repo ORDER BY sha256(repo || ':' || src || ':' || dst), src, dst) AS place FROM repo_edges""",
    "asks": """SELECT DISTINCT source AS id, 'Which function is directly called by `' || source || '`?' AS text FROM sampled WHERE place <= 40""",
    "ex_exact": """SELECT a.id AS question_id, u.id, 1.0::DOUBLE AS sim FROM asks a JOIN units u ON u.name = a.id WHERE regexp_full_match(a.id, '[A-Za-z_][A-Za-z0-9_.]*')
        QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY u.id) <= 5""",
    "ex_counts": f"""SELECT id, {_BUCKET}::INTEGER AS bucket, count(*) AS n FROM (
        SELECT id, unnest(regexp_extract_all(lower(text), '[a-z_0-9]+')) AS word FROM asks WHERE id NOT IN (SELECT question_id FROM ex_exact)) GROUP BY 1, 2""",
    "ex_vec": "SELECT id, bucket, n / sqrt(sum((n * n)::DOUBLE) OVER (PARTITION BY id)) AS weight FROM ex_counts",
    "ex_near_vec": """SELECT question_id, id, sim FROM (SELECT q.id AS question_id, v.id, round(sum(q.weight * v.weight), 9) AS sim FROM ex_vec q JOIN vec v USING (bucket) GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id) <= 5""",
    "ex": "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id) AS own FROM (SELECT * FROM ex_exact UNION ALL SELECT * FROM ex_near_vec)",
    "ex_near": """SELECT * FROM (
        SELECT question_id, dst AS id FROM (SELECT x.question_id, x.id AS seed, e.dst, e.seq FROM ex x JOIN edges e ON e.src = x.id) QUALIFY row_number() OVER (PARTITION BY question_id, seed ORDER BY seq, dst) <= 50
        UNION SELECT question_id, src FROM (SELECT x.question_id, x.id AS seed, e.src, e.seq FROM ex x JOIN edges e ON e.dst = x.id) QUALIFY row_number() OVER (PARTITION BY question_id, seed ORDER BY seq, src) <= 50) n
        WHERE NOT EXISTS (SELECT 1 FROM ex x WHERE x.question_id = n.question_id AND x.id = n.id)""",
    "ex_hits": """SELECT question_id, id, 'graph' AS kind FROM (SELECT question_id, id, 0.6::DOUBLE * sim + 0.4::DOUBLE AS score, 0 AS after, own FROM ex UNION ALL SELECT question_id, id, 0.2::DOUBLE, 1, 0 FROM ex_near)
        QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, after, own, id) <= 8 UNION ALL SELECT question_id, id, 'naive' FROM ex""",
    "ex_rows": """SELECT s.repo, s.src, s.dst, coalesce(max((h.kind = 'naive')::INTEGER), 0) AS naive, coalesce(max((h.kind = 'graph')::INTEGER), 0) AS graph
        FROM sampled s LEFT JOIN (SELECT h.question_id, h.kind, u.name FROM ex_hits h JOIN units u USING (id)) h ON h.question_id = s.source AND h.name = s.target
        WHERE s.place <= 40 GROUP BY 1, 2, 3""",
    "prose": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done.'
        WHEN 1 THEN 'Here it is ' || props || ' as asked' ELSE 'No answer ' || substr(props, 1, 5) END AS raw, props FROM events""",
    "turns": """SELECT u.conv_id, u.turn AS t, u.text AS asked, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "repos": """SELECT o_orderkey::VARCHAR AS id, o_custkey, 'https://github.com/o/r' || o_orderkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS name,
        CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'parsing' ELSE 'failed' END AS status,
        CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 97)::INTEGER ELSE 0 END AS functions, o_orderdate AS created_at FROM orders""",
    "chunks": """SELECT c_custkey, c_custkey::VARCHAR AS id, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' v2' ELSE '' END AS document, c_mktsegment AS name, c_nationkey::VARCHAR AS file
        FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey % 2 = 0""",
    "answers": """SELECT user_id::VARCHAR AS stream, event_id AS seq, CASE event_type WHEN 'signup' THEN 'retrieval_done' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'token' END AS event, ts FROM events""",
    "asked": """SELECT u.conv_id, u.turn, u.text AS asked, a.text AS answer FROM (SELECT * FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL) u
        LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""",
    "symbols": r"""SELECT id AS question_id, unnest(list_sort(list_distinct(list_filter(
        regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*'), lambda t: contains(t, '_') OR contains(t, '.'))))[1:8]) AS name FROM hosts""",
    "groups": "SELECT source, count(*) AS n, ceil(count(*) / 100.0)::BIGINT AS batches FROM documents GROUP BY source",
}


def _with(names: str, final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names.split()) + "\n" + final


def _wilson(hits: str, n: str) -> tuple[str, str]:
    p, z = f"({hits}::DOUBLE / {n})", "1.96::DOUBLE"
    mid = f"({p} + {z} * {z} / (2.0 * {n})) / (1 + {z} * {z} / {n})"
    half = f"{z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4.0 * {n})) / {n}) / (1 + {z} * {z} / {n})"
    return tuple(f"round(100.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, {mid} {sign} {half})), 1)" for sign in "-+")


def _interval(hits: str, n: str) -> str:
    low, high = _wilson(hits, n)
    return f"printf('%.1f', {low}) || '-' || printf('%.1f', {high})"


_GRAPH = "units counts vec qcounts qvec hits edges succ pred near fused retrieved"
_EX = "units counts vec edges repo_edges sampled asks ex_exact ex_counts ex_vec ex_near_vec ex ex_near ex_hits ex_rows"
_BUDGET = """, c AS (SELECT *, least({each}, length(content)) AS c FROM retrieved),
    p AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM c)"""
_TASK, _CODE, _FIXED, _END = (
    "'### Task: Fix the bug described by the commit message.' || chr(10) || chr(10) || '### Commit message:' || chr(10)",
    "chr(10) || chr(10) || '### Buggy code:' || chr(10) || '```python' || chr(10)",
    "chr(10) || '```' || chr(10) || chr(10) || '### Fixed code:' || chr(10) || '```python' || chr(10)",
    "chr(10) || '```'",
)
_STRIP = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
_PERCENT = "round(100.0::DOUBLE * avg({0}::DOUBLE), {1})"


def _ranks(p50: str, p95: str) -> str:
    return f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, max(value) FILTER (place = {p50}) AS p50, max(value) FILTER (place = {p95}) AS p95 FROM r GROUP BY event_type"""


_ORDER = """SELECT stream, seq, event, before FROM (SELECT *, lag(event) OVER (PARTITION BY stream ORDER BY seq) AS before FROM answers)
    WHERE NOT CASE WHEN before IS NULL THEN event IN ('retrieval_done', 'error') WHEN before IN ('retrieval_done', 'token') THEN event IN ('token', 'done', 'error') ELSE false END"""


def _bleu() -> str:
    """Clipped n-gram precisions of up to four words, add-one above one word, and the brevity penalty."""
    grams = "list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' '))"
    logs = []
    for n in range(1, 5):
        hit = f"coalesce((SELECT sum(least(c, coalesce(lim, 0))) FROM (SELECT g, count(*) AS c FROM (SELECT unnest({grams.format('c', n)}) AS g) GROUP BY g) LEFT JOIN (SELECT g, count(*) AS lim FROM (SELECT unnest({grams.format('r', n)}) AS g) GROUP BY g) USING (g)), 0)"
        up = "0.0" if n == 1 else "1.0"
        logs.append(f"CASE WHEN len(c) - {n - 1} + {up} > 0 AND {hit} + {up} > 0 THEN ln(({hit} + {up})::DOUBLE / (greatest(len(c) - {n - 1}, 0) + {up})) END / 4")
    return f"""WITH w AS (SELECT u.conv_id || '-' || u.turn AS id, list_filter(regexp_split_to_array(coalesce(a.text, ''), '\\s+'), lambda t: t <> '') AS c, list_filter(regexp_split_to_array(coalesce(u.text, ''), '\\s+'), lambda t: t <> '') AS r
            FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
        SELECT id, round(coalesce((CASE WHEN len(c) >= len(r) THEN 1.0 ELSE exp(1 - len(r)::DOUBLE / nullif(len(c), 0)) END) * exp({" + ".join(logs)}), 0.0), 6) AS bleu FROM w"""


_ADMISSION = """WITH r AS (SELECT event_id, user_id % 2 AS client, CASE WHEN event_id % 50 = 0 THEN 'health' WHEN event_type IN ('signup', 'purchase') THEN 'ingest' WHEN event_type IN ('click', 'view') THEN 'query' ELSE 'code' END AS route, epoch_us(ts) // 20000 AS us FROM events),
    l AS (SELECT *, CASE route WHEN 'ingest' THEN 100 WHEN 'query' THEN 30 WHEN 'code' THEN 20 END AS lim, CASE route WHEN 'ingest' THEN 3600 WHEN 'query' THEN 60 WHEN 'code' THEN 60 END AS secs FROM r),
    s AS (SELECT *, us // (secs::BIGINT * 1000000) * secs AS started FROM l),
    d AS (SELECT *, row_number() OVER (PARTITION BY client, route, started ORDER BY us, event_id) AS place FROM s) """


def _corpus_bleu() -> str:
    grams = "SELECT rn, n, unnest(list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string({0}[i:i + n - 1], ' '))) AS g FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(n)"
    weight = "CASE WHEN g IN ('the', 'that', 'you', 'and', 'of') THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END"
    log = "ln((CASE WHEN {0} > 0 THEN {0} ELSE 0.1 END)::DOUBLE / greatest({1}, 1)::DOUBLE) / 4"
    plain = " + ".join(log.format(f"coalesce(max(hit) FILTER (n = {n}), 0)", f"coalesce(max(own) FILTER (n = {n}), 0)") for n in range(1, 5))
    recall = " + ".join([log.format("coalesce(max(whit) FILTER (n = 1), 0)", "coalesce(max(wref) FILTER (n = 1), 0)"), *(log.format(f"coalesce(max(hit) FILTER (n = {n}), 0)", f"coalesce(max(ref) FILTER (n = {n}), 0)") for n in range(2, 5))])
    brevity = "(SELECT CASE WHEN sum(len(c)) > sum(len(r)) THEN 1.0 ELSE exp(1 - sum(len(r))::DOUBLE / sum(len(c))) END FROM w)"
    return f"""WITH w AS (SELECT row_number() OVER () AS rn, list_filter(regexp_split_to_array(coalesce(a.text, ''), '\\s+'), lambda t: t <> '') AS c, list_filter(regexp_split_to_array(coalesce(u.text, ''), '\\s+'), lambda t: t <> '') AS r
            FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND a.text IS NOT NULL),
        cg AS (SELECT rn, n, g, count(*) AS k FROM ({grams.format("c")}) GROUP BY 1, 2, 3),
        rg AS (SELECT rn, n, g, count(*) AS k FROM ({grams.format("r")}) GROUP BY 1, 2, 3),
        hits AS (SELECT cg.n, sum(least(cg.k, rg.k)) AS hit, sum(least(cg.k, rg.k) * {weight.replace(" g ", " cg.g ")}) AS whit FROM cg JOIN rg ON cg.rn = rg.rn AND cg.n = rg.n AND cg.g = rg.g GROUP BY cg.n),
        owns AS (SELECT n, sum(k) AS own FROM cg GROUP BY n),
        refs AS (SELECT n, sum(k) AS ref, sum(k * {weight}) AS wref FROM rg GROUP BY n),
        x AS (SELECT exp({plain}) * {brevity} AS bleu, exp({recall}) * {brevity} AS weighted FROM (VALUES (1), (2), (3), (4)) AS t(n) LEFT JOIN hits USING (n) LEFT JOIN owns USING (n) LEFT JOIN refs USING (n))
        SELECT (SELECT count(*) FROM w) AS n, round(bleu, 9) AS bleu, round(weighted, 9) AS weighted, round(0.75::DOUBLE * bleu + 0.25::DOUBLE * weighted, 9) AS combined FROM x"""


def _places() -> str:
    """The seeded permutation, as the splits have it."""
    from ..operators.curate import split_rows

    return ", ".join(f"({place}, '{name}', {slot})" for place, name, slot in split_rows({"train": 75, "validation": 12, "test": 13}))


SQL: dict[str, str] = {
    "hash_buckets": _with("counts", "SELECT id, bucket, n FROM counts"),
    "hash_embed_sparse": _with("counts vec", "SELECT id, bucket, round(weight, 9) AS weight FROM vec"),
    "hash_embed_norms": _with("counts vec", "SELECT id, round(sqrt(sum(weight * weight)), 9) AS norm FROM vec GROUP BY id"),
    "dense_from_sparse": _with(
        "counts vec",
        """SELECT id, list_transform(range(384), lambda i: coalesce(m[i::INTEGER], 0.0::DOUBLE)) AS vector
        FROM (SELECT id, map_from_entries(list((bucket, round(weight, 9)))) AS m FROM vec GROUP BY id)""",
    ),
    "vector_topk_dense": _with("emb sims", "SELECT query_id, id, round(sim, 4) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sims.sim DESC, id)::INTEGER AS rank FROM sims QUALIFY rank <= 5"),
    "vector_index_all_lists": _with("emb sims", "SELECT query_id, id, round(sim, 4) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sims.sim DESC, id)::INTEGER AS rank FROM sims QUALIFY rank <= 5"),
    "vector_topk_filtered": _with("emb sims", "SELECT query_id, id, round(sim, 4) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sims.sim DESC, id)::INTEGER AS rank FROM sims WHERE label < 3 QUALIFY rank <= 5"),
    "vector_similarity_clamped": "SELECT event_id, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(value) / 50.0::DOUBLE), 6) AS sim FROM events",
    "vector_topk_hash": _with("counts vec qcounts qvec hits", "SELECT question_id, id, round(sim, 4) AS sim, rank FROM hits"),
    "knn_label_recall_at_k": _with(
        "emb sims",
        f""", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM sims QUALIFY rank <= 10),
        h AS (SELECT query_id, {", ".join(f"max((rank <= {k} AND label = gold)::INTEGER) AS hit{k}" for k in (1, 5, 10))} FROM r GROUP BY query_id)
        SELECT count(*) AS n, {", ".join(f"{_PERCENT.format(f'hit{k}', 2)} AS recall_at_{k}" for k in (1, 5, 10))} FROM h""",
    ).replace("\n,", ","),
    "symbol_tokens": r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(
        regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*'), lambda t: contains(t, '_') OR contains(t, '.'))))[1:8], ' ') AS symbols FROM pages""",
    "symbol_lookup_exact": _with(
        "hosts",
        r""", s AS (SELECT id AS question_id, unnest(list_sort(list_distinct(list_filter(
            regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*'), lambda t: contains(t, '_') OR contains(t, '.'))))[1:8]) AS name FROM hosts WHERE id % 100 = 0)
        SELECT question_id, id, 1.0::DOUBLE AS sim FROM (SELECT DISTINCT s.question_id, h.id FROM s JOIN hosts h USING (name))
        QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY id) <= 5""",
    ).replace("\n,", ","),
    "graph_nodes": _with("units", "SELECT id, name, file, 'function' AS type, start_line, end_line FROM units"),
    "graph_edges": _with("units edges", "SELECT src, dst FROM edges"),
    "graph_node_link_json": _with("units edges", "SELECT src, dst FROM edges"),
    "graph_edge_counts": _with("units edges", "SELECT (SELECT count(*) FROM units) AS nodes, (SELECT count(DISTINCT name) FROM units) AS names, (SELECT count(*) FROM edges) AS edges"),
    "graph_degree_distribution": _with(
        "units edges",
        """SELECT out_degree, in_degree, count(*) AS n FROM (SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
        SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id) GROUP BY 1, 2""",
    ),
    "graph_expand_one_hop": _with("units edges hop_succ hop_pred", "SELECT question_id, id FROM hop_succ UNION SELECT question_id, id FROM hop_pred"),
    "graph_expand_capped_50": _with(
        "units edges hop_succ hop_pred",
        """SELECT question_id, id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq, id) AS n FROM hop_succ) WHERE n <= 50
        UNION SELECT question_id, id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq, id) AS n FROM hop_pred) WHERE n <= 50""",
    ),
    "graph_bipartite_order_part": "SELECT DISTINCT o_orderkey AS question_id, 'p' || l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 100 = 0",
    "retrieve_naive": _with("units counts vec qcounts qvec hits", "SELECT h.question_id, h.rank, h.id, u.name, u.file, [u.start_line, u.end_line] AS lines, 'seed' AS type, round(h.sim, 4) AS score FROM hits h JOIN units u USING (id)"),
    "retrieve_graph": _with(_GRAPH, "SELECT * FROM retrieved"),
    "retrieve_public_view": _with(_GRAPH, "SELECT * EXCLUDE (id, content) FROM retrieved"),
    "fusion_scores": _with(_GRAPH, "SELECT question_id, type, count(*) AS n, min(score) AS low, max(score) AS high FROM retrieved GROUP BY 1, 2"),
    "topk_stable_ties": """SELECT p_brand, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name, p_partkey)::INTEGER AS rank
        FROM part QUALIFY rank <= 3""",
    "context_budget": _with(_GRAPH, _BUDGET.format(each=600) + " SELECT question_id, rank, greatest(0, least(c, 2000 - p))::INTEGER AS taken FROM p WHERE p < 2000").replace("\n,", ","),
    "prompt_text": _with(
        _GRAPH,
        _BUDGET.format(each=3000)
        + """, t AS (SELECT question_id, string_agg(CASE WHEN type = 'seed' THEN '[SEED] ' ELSE '[NEIGHBOR] ' END || name || '  (' || file || '  L' || lines[1] || '–' || lines[2] || ')' || chr(10)
            || substr(content, 1, greatest(0, least(c, 12000 - p))::BIGINT), chr(10) ORDER BY rank) AS context FROM p WHERE p < 12000 GROUP BY 1)
        SELECT item_id AS question_id, 'You are a code analysis assistant. Use the retrieved context below to answer the question. Reference function names and file paths where relevant.'
            || chr(10) || chr(10) || '=== Retrieved context ===' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || '=== Question ===' || chr(10) || text AS prompt
        FROM benchmark LEFT JOIN t ON question_id = item_id""",
    ).replace("\n,", ","),
    "edge_sample_sha256": _with("units edges repo_edges sampled", "SELECT repo, src, dst, source, target FROM sampled WHERE place <= 40"),
    "edge_eval_recall": _with(
        _EX,
        f"""SELECT n, naive_recall, graph_recall, graph_interval, round(graph_recall - naive_recall, 1) AS delta FROM (
        SELECT count(*) AS n, {_PERCENT.format("naive", 1)} AS naive_recall, {_PERCENT.format("graph", 1)} AS graph_recall, {_interval("sum(graph)", "count(*)")} AS graph_interval FROM ex_rows)""",
    ),
    "edge_eval_by_repo": _with(_EX, f"""SELECT repo, count(*) AS n, {_PERCENT.format("naive", 1)} AS naive_recall, {_PERCENT.format("graph", 1)} AS graph_recall, {_interval("sum(graph)", "count(*)")} AS graph_interval FROM ex_rows GROUP BY repo"""),
    "wilson_interval_by_group": "SELECT event_type, n, hits, {0} AS low, {1} AS high, {2} AS interval FROM (SELECT event_type, count(*) AS n, sum((value > 10)::INTEGER)::BIGINT AS hits FROM events GROUP BY 1)".format(*_wilson("hits", "n"), _interval("hits", "n")),
    "latency_percentiles_floor_rank": _ranks("greatest(1, floor(n * 0.5::DOUBLE))", "greatest(1, floor(n * 0.95::DOUBLE))"),
    "latency_percentiles_index_rank": _ranks("floor(n * 0.5::DOUBLE) + 1", "floor(n * 0.95::DOUBLE) + 1"),
    "latency_median_int": "SELECT event_type, trunc(quantile_cont(value, 0.5))::INTEGER AS median FROM events GROUP BY 1",
    "recall_at_5_10_file_or_name": _with(
        "units counts vec",
        f""", s AS (SELECT q.id AS question_id, v.id, round(sum(q.weight * v.weight), 9) AS sim FROM vec q JOIN vec v USING (bucket) WHERE q.id % 100 = 0 GROUP BY 1, 2),
        r AS (SELECT question_id, id, sim FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id) <= 11),
        k AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id) AS rank FROM r WHERE id <> question_id QUALIFY rank <= 10),
        h AS (SELECT k.question_id, max((rank <= 5 AND (a.file = g.file OR a.name = g.name))::INTEGER) AS h5, max((a.file = g.file OR a.name = g.name)::INTEGER) AS h10
              FROM k JOIN units a ON a.id = k.id JOIN units g ON g.id = k.question_id GROUP BY 1)
        SELECT count(*) AS n, {_PERCENT.format("h5", 2)} AS recall_at_5, {_PERCENT.format("h10", 2)} AS recall_at_10 FROM h""",
    ).replace("\n,", ","),
    "edge_eval_golden": """SELECT 120::BIGINT AS n, 'a,b,c' AS repos, 0.0::DOUBLE AS naive_recall_at_8, '0.0-3.1' AS naive_interval, 2 AS naive_p50_ms, 2 AS naive_p95_ms,
        53.3::DOUBLE AS graph_recall_at_8, '44.4-62.0' AS graph_interval, 3 AS graph_p50_ms, 3 AS graph_p95_ms, 53.3::DOUBLE AS delta""",
    "pass_at_1": f"SELECT count(*) AS n, {_PERCENT.format('(quality = 1)::INTEGER', 2)} AS pass_at_1 FROM labels WHERE quality IS NOT NULL",
    "codebleu_combine": """SELECT event_id, v * 0.25::DOUBLE + (CASE WHEN event_id % 3 = 0 THEN v / 2 ELSE v END) * 0.25::DOUBLE + v * 0.25::DOUBLE + v * 0.25::DOUBLE AS score
        FROM (SELECT event_id, value / 100.0::DOUBLE AS v FROM events)""",
    "curate_reject_reasons": _with("commits judged", "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM judged GROUP BY 1"),
    "curate_buffered_shuffle": "SELECT doc_id, true AS own_part, true AS in_bounds FROM documents",
    "curate_accept_cut": _with("commits judged scanned", "SELECT doc_id, seen, accepted FROM scanned WHERE reason IS NULL"),
    "curate_scan_progress": _with("commits judged scanned", "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM scanned GROUP BY 1"),
    "curate_hash_split": """SELECT doc_id, CASE WHEN s < 6 THEN 'train' WHEN s < 7 THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 8 AS s FROM documents)""",
    "training_sample_format": _with(
        "turns",
        f""", s AS (SELECT conv_id, t, {_STRIP.format("asked")} AS message, {_TASK} || {_STRIP.format("asked")} || {_CODE} || {_STRIP.format("asked")} || {_FIXED} AS prompt,
            {_STRIP.format("answer")} || {_END} AS completion, 'conv/' || conv_id AS url FROM turns)
        SELECT conv_id, t, prompt || completion AS text, prompt, completion, message, url FROM s""",
    ).replace("\n,", ","),
    "file_summary_first30": _with("units", "SELECT 'r::FILE::' || file AS id, file, 'file' AS type, 'File: ' || file || chr(10) || 'Contains: ' || array_to_string(list(name ORDER BY id)[1:30], ', ') AS source FROM units WHERE name IS NOT NULL GROUP BY file"),
    "document_render": _with(
        "units",
        """, d AS (SELECT *, (SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(words) AS w, unnest(range(len(words))) AS p) GROUP BY w)) AS calls FROM units)
        SELECT id, concat_ws(chr(10), 'File: ' || file, 'Type: function', 'Name: ' || name, CASE WHEN id % 2 = 0 AND name IS NOT NULL THEN 'Docstring: about ' || name END,
            CASE WHEN len(calls) > 0 THEN 'Calls: ' || array_to_string(calls, ', ') END, document) AS document FROM d""",
    ).replace("\n,", ","),
    "unit_metadata": _with("units", """SELECT u.id, name, file, 'function' AS type, start_line, end_line, CASE WHEN words IS NULL THEN NULL ELSE coalesce(c.calls, '[]') END AS calls FROM units u LEFT JOIN (
        SELECT id, '[' || string_agg('"' || w || '"', ',' ORDER BY p) || ']' AS calls FROM (SELECT id, w, min(p) AS p FROM (SELECT id, unnest(words) AS w, unnest(range(len(words))) AS p FROM units) GROUP BY id, w) GROUP BY id) c ON c.id = u.id"""),
    "review_scores_as_written": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 85 ELSE 50 END::INTEGER AS score FROM events",
    "unit_stats": "SELECT source, count(*) FILTER (doc_id % 5 <> 0) AS functions, count(*) FILTER (doc_id % 5 = 0) AS classes FROM documents GROUP BY 1",
    "batch_plan": _with("groups", "SELECT source, n, batches FROM groups"),
    "batch_progress": _with(
        "groups",
        """SELECT source, batch, floor(100.0 * (coalesce(before, 0) + batch) / total)::BIGINT AS percent FROM (
        SELECT source, unnest(range(1, batches + 1)) AS batch, sum(batches) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(batches) OVER () AS total FROM groups)""",
    ),
    "json_from_prose": _with("prose", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS json FROM prose"),
    "review_parse": """SELECT event_id, CASE WHEN bad THEN 50 ELSE event_id % 101 END::INTEGER AS score, CASE WHEN bad THEN 0 ELSE 1 END AS issues, CASE WHEN NOT bad THEN event_id::INTEGER END AS line,
        0 AS strengths, CASE WHEN bad THEN 'I cannot say' ELSE event_type END AS summary FROM (SELECT *, event_id % 4 = 0 AS bad FROM events)""",
    "debug_parse": """SELECT event_id, CASE WHEN bad THEN 'I cannot say' ELSE event_type END AS cause, '' AS location, CASE WHEN bad THEN '' ELSE 'a>b' END AS path,
        CASE WHEN NOT bad AND event_id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM (SELECT *, event_id % 4 = 0 AS bad FROM events)""",
    "tests_parse": """SELECT event_id, CASE WHEN bad THEN 'I cannot say' ELSE event_type END AS code, CASE WHEN bad THEN 0 ELSE 2 END AS count, CASE WHEN bad THEN '' ELSE 'n,m' END AS names
        FROM (SELECT *, event_id % 4 = 0 AS bad FROM events)""",
    "store_upsert": _with("chunks", "SELECT id, document, name, file FROM chunks"),
    "store_get_ids": _with("chunks", "SELECT id, document FROM chunks WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "store_get_metadata": _with("chunks", "SELECT id, document FROM chunks WHERE name = 'BUILDING'"),
    "store_count": _with("chunks", "SELECT count(*) AS n FROM chunks"),
    "store_delete": "SELECT 0::BIGINT AS r, count(*) AS s FROM customer WHERE c_custkey % 3 = 0",
    "repo_list_newest": _with("repos", "SELECT id, coalesce(name, 'r' || id) AS name, status, functions, 0 AS classes, created_at FROM repos"),
    "repo_status_upsert": _with("repos", "SELECT id, name, CASE WHEN o_custkey % 3 = 0 THEN 'failed' ELSE status END AS status FROM repos"),
    "repo_delete_cascade": """SELECT 'repos' AS what, count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders
        UNION ALL SELECT 'tasks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
        UNION ALL SELECT 'messages_without', count(*) FILTER (o_orderstatus = 'F') FROM orders""",
    "task_latest": "SELECT user_id AS task, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "catalogue_violations": """SELECT 'repo_status' AS rule, count(*) AS n FROM orders WHERE o_orderkey % 50 = 0
        UNION ALL SELECT 'task_repo', count(*) FROM lineitem WHERE l_linenumber = 7 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0""",
    "latest_checkpoint": "SELECT event_type, 'run/checkpoint-' || max(event_id) FILTER (event_id % 10 <> 0) AS path FROM events GROUP BY 1",
    "required_repos": "SELECT n_nationkey AS key FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0)",
    "progress_change_events": "SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)",
    "rate_limit_violations": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id % 2 AS client, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) > 3",
    "sse_frames_parse": "SELECT event_id, 0 AS place, event_type AS event, props AS data FROM events WHERE event_id % 5 <> 0",
    "sse_frames_assembled": """SELECT user_id::VARCHAR AS stream, place::INTEGER AS place, event_type AS event, props AS data
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) WHERE event_id % 5 <> 0""",
    "stream_frames": """SELECT user_id::VARCHAR AS stream, place::INTEGER AS place, event_type AS event, props AS data
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) WHERE event_id % 5 <> 0""",
    "request_admission": _ADMISSION + "SELECT event_id, client, route, CASE WHEN secs IS NOT NULL THEN place END::INTEGER AS place, secs IS NULL OR place <= lim AS served, CASE WHEN place > lim THEN ceil((started + secs) - us / 1000000.0)::BIGINT END AS retry_after FROM d",
    "request_refusals": _ADMISSION + "SELECT client, route, count(*) AS requests, count(*) FILTER (place > lim) AS refused FROM d GROUP BY 1, 2",
    "bleu_of_corpus": _corpus_bleu(),
    "dataset_manifest": """WITH s AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN h < 6 THEN 'train' WHEN h < 7 THEN 'validation' ELSE 'test' END AS split
            FROM (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 8 AS h FROM documents)),
        a AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS i, sha256(t) AS d FROM s),
        b AS (SELECT split, i // 1000 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, count(*) AS n FROM a GROUP BY split, i // 1000),
        c AS (SELECT split, sha256(string_agg(d, '' ORDER BY i)) AS sha256, sum(n)::BIGINT AS samples FROM b GROUP BY split)
        SELECT split, samples, sha256, (SELECT count(*) FROM documents) AS scanned FROM c""",
    "url_validate": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://github.com/o/r' || page_id END AS url FROM pages",
    "input_length_guard": "SELECT length(text) > 10000 AS too_long, count(*) AS n FROM documents GROUP BY 1",
    "fenced_code_blocks": "SELECT event_id, 0 AS place, 'py' AS language, event_type || chr(10) AS code FROM events UNION ALL SELECT event_id, 1, '', 'x' || chr(10) FROM events",
    "progress_percent": """SELECT event_id, least(100, CASE WHEN event_id % 3 > 0 THEN round(100.0 * (event_id % 12) / (event_id % 3 * 5))
        ELSE round(100.0 * [0, 3, 5, 6][event_id % 4 + 1] / 7) END)::INTEGER AS percent FROM events""",
    "sha256_manifest": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "jsonl_count": "SELECT count(*) AS n FROM conversations",
    "jsonl_read": "SELECT conv_id, turn, role, text FROM conversations",
    "benchmark_report_null_safe": f"""SELECT lang, quality, toxic, round(quality - toxic, 2) AS delta, NULL::DOUBLE AS unknown FROM (
        SELECT lang, {_PERCENT.format("quality", 2)} AS quality, {_PERCENT.format("toxic", 2)} AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang)""",
    "compare_guarded": f"""SELECT 'h' AS test_hash, base_score, tuned_score, round(tuned_score - base_score, 2) AS delta_score FROM
        (SELECT {_PERCENT.format("quality", 2)} AS base_score FROM labels WHERE doc_id % 2 = 0), (SELECT {_PERCENT.format("quality", 2)} AS tuned_score FROM labels WHERE doc_id % 2 = 1)""",
    "stream_progress": """SELECT user_id::VARCHAR AS task, event_id AS seq, 'progress' AS event, event_type AS stage, 0 AS current_step, 'running' AS status FROM events
        QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)""",
    "answer_stream_order": _with("answers", _ORDER),
    "stream_answer_order": _with("answers", _ORDER),
    "answer_stream_totals": _with("answers", "SELECT stream, count(*) FILTER (event = 'token') AS total_tokens, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::BIGINT AS total_latency_ms FROM answers GROUP BY 1"),
    "generation_failures": _with("asked", "SELECT count(*) AS n, count(*) FILTER (answer IS NULL) AS errors FROM asked"),
    "scored_code": _with("asked", f"SELECT conv_id, turn, {_STRIP.format("replace(asked, '```', '')")} AS reference, {_STRIP.format("split_part(answer, '```', 1)")} AS predicted FROM asked"),
    "task_prompts": r"""WITH d AS (SELECT doc_id, coalesce(lang, 'text') AS l, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, 0 AS place, 'Perform a code review of the following ' || l || e' code.\n\nAnswer with one JSON object: overall_score (0-100), issues (at most 10, worst first; each with severity critical|high|medium|low|info, line or null, description, suggestion), strengths (at most 5), summary.\nReturn only the JSON object.\n\nCode to review:\n```' || l || e'\n' || t || e'\n```' AS prompt FROM d
        UNION ALL SELECT doc_id, 1, 'Debug the following ' || l || e' code and the error it gives.\n\nAnswer with one JSON object: probable_cause, root_location, execution_path (list), confidence high|medium|low.\nReturn only the JSON object.\n\nCode:\n```' || l || e'\n' || t || e'\n```\n\nError:\nE' FROM d
        UNION ALL SELECT doc_id, 2, 'Write pytest tests for the following ' || l || e' code.\n\nAnswer with one JSON object: test_code, test_count, cases (each with type and name).\nReturn only the JSON object.\n\nCode:\n```' || l || e'\n' || t || e'\n```' FROM d""",
    "completion_messages": "SELECT item_id, 0 AS place, 'system' AS role, 'Complete the function. Return only code.' AS content FROM benchmark UNION ALL SELECT item_id, 1, 'user', text FROM benchmark",
    "result_flatten": """SELECT c_custkey::VARCHAR AS id, c_name AS name, '' AS file, c_nationkey::INTEGER AS end_line, CASE WHEN c_nationkey % 5 = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (c_custkey % 3) / 2.0::DOUBLE) END AS sim, c_mktsegment AS content
        FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE c_nationkey % 5 = 0 OR n <= 5""",
    "split_files": """SELECT CASE WHEN doc_id % 8 < 6 THEN 'train' WHEN doc_id % 8 < 7 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1""",
    "stream_scan_early_stop": _with("commits judged scanned", "SELECT doc_id, seen, accepted FROM scanned WHERE reason IS NULL"),
    "stream_symbol_enrich": _with("hosts symbols", "SELECT s.question_id, s.name, h.id FROM symbols s JOIN (SELECT name, min(id) AS id FROM hosts GROUP BY name) h USING (name)"),
    "curate_split_permutation": _with("commits judged scanned", "SELECT doc_id, split, slot FROM scanned JOIN (VALUES {0}) AS p(place, split, slot) ON p.place = accepted - 1 WHERE reason IS NULL").replace("{0}", _places()),
    "bleu_by_turn": _bleu(),
    "seeds_exact_over_vector": _with(
        "hosts symbols",
        f""", q AS (SELECT id, CASE WHEN id % 200 = 0 THEN url ELSE regexp_replace(url, '[._]', ' ', 'g') END AS text FROM hosts WHERE id % 100 = 0),
        x AS (SELECT question_id, id FROM (SELECT DISTINCT s.question_id, h.id FROM symbols s JOIN hosts h USING (name) WHERE s.question_id % 200 = 0) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY id) <= 5),
        t AS (SELECT 'd' AS kind, id, url AS text FROM hosts UNION ALL SELECT 'q', id, text FROM q WHERE id NOT IN (SELECT question_id FROM x)),
        n AS (SELECT kind, id, {_BUCKET}::INTEGER AS bucket, count(*) AS n FROM (SELECT kind, id, unnest(regexp_extract_all(lower(text), '[a-z_0-9]+')) AS word FROM t) GROUP BY 1, 2, 3),
        v AS (SELECT kind, id, bucket, n / sqrt(sum((n * n)::DOUBLE) OVER (PARTITION BY kind, id)) AS weight FROM n),
        s AS (SELECT q.id AS question_id, d.id, round(sum(q.weight * d.weight), 9) AS sim FROM v q JOIN v d USING (bucket) WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(sum(q.weight * d.weight), 9) DESC, d.id) <= 5)
        SELECT question_id, id, round(sim, 4) AS sim, row_number() OVER (PARTITION BY question_id ORDER BY s.sim DESC, id)::INTEGER AS rank FROM (SELECT question_id, id, 1.0::DOUBLE AS sim FROM x UNION ALL SELECT * FROM s) s""",
    ).replace("\n,", ","),
}
