r"""SQL twins of the registered queries, for DuckDB on the same tables. RE2 has no lookaround, so boundaries are spelled out."""

_FILES = """f AS (SELECT doc_id AS path, coalesce(text, '') AS content, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 1 AS is_test FROM documents)"""
_DECLARED = r"""d AS (SELECT * FROM (SELECT path, is_test, regexp_extract(regexp_extract(content, '\A([^\r\n]*)', 1), '([A-Za-z0-9_$]+)', 1) AS name, content FROM f) WHERE name <> '')"""
_FILES = _FILES.replace("\\\\", "\\")
_LINES = r"""l AS (SELECT path, is_test, unnest(regexp_split_to_array(content, '\r?\n')) AS text, generate_subscripts(regexp_split_to_array(content, '\r?\n'), 1) AS line FROM f)"""
_JS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_KEYS = r"api[_-]?key|apikey|access[_-]?key|secret[_-]?key|client[_-]?secret|token|password|passwd|pwd|secret|auth[_-]?token"
_CONNECTION = rf"(?i)\b(postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|amqps)://[^{_JS}''\x22]+"
_AWS = r"\bAKIA[0-9A-Z]{16}\b"
_JWT = r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"
_VALUE = rf"[^{_JS}''\x22,;]+"
_ASSIGN = rf"(?i)\b((?:{_KEYS})[{_JS}]*[:=][{_JS}]*)(?:''{_VALUE}''|\x22{_VALUE}\x22|{_VALUE})"
_TRIM = rf"regexp_replace(regexp_replace(text, '^[{_JS}]+', ''), '[{_JS}]+$', '')"

_PATHS = r"""p AS (SELECT doc_id, 'src/' || CASE WHEN doc_id % 7 = 0 THEN 'node_modules' WHEN doc_id % 5 = 0 THEN 'dist' WHEN doc_id % 17 = 0 THEN '.ssh' ELSE source END || '/' || lang || '/' ||
    CASE WHEN doc_id % 11 = 0 THEN 'my-secret-' || doc_id WHEN doc_id % 13 = 0 THEN '.env.' || doc_id ELSE CAST(doc_id AS VARCHAR) END ||
    ['.ts', '.tsx', '.js', '.jsx', '.spec.ts', '.md', '.pem', '.generated.ts'][doc_id % 8 + 1] AS path FROM documents)"""
_NAME = "string_split(path, '/')[-1]"
_SENSITIVE = rf"""(regexp_matches({_NAME}, '^(\.env[^/]*|[^/]*\.(pem|key|cert|p12|pfx|keystore)|credentials\.json|[^/]*_credentials\.json|service-account[^/]*\.json|[^/]*secret[^/]*)$')
    OR regexp_matches(path, '(^|/)\.(ssh|aws)/[^/]*$'))"""
_URL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '\.html$', ''), '/$', '')"


def _contract() -> str:
    return rf"""e AS (SELECT page_id AS seq, CASE WHEN page_id % 40 = 0 THEN regexp_replace({_URL}, '/[^/]*$', '/:id') ELSE {_URL} END AS route,
        ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'][page_id % 5 + 1] AS method FROM pages WHERE page_id % 2 = 0),
    c AS (SELECT page_id AS seq, CASE WHEN page_id % 9 = 0 THEN '${{API}}' || {_URL} || '?q=1' ELSE {_URL} END AS url, ['GET', 'POST', 'PUT'][page_id % 3 + 1] AS method FROM pages WHERE page_id % 2 = 1),
    es AS (SELECT *, list_filter(string_split(string_split(route, '?')[1], '/'), lambda x: x <> '') AS r FROM e),
    cs AS (SELECT *, list_filter(string_split(string_split(regexp_replace(url, '^\$\{{[^}}]*\}}', ''), '?')[1], '/'), lambda x: x <> '') AS u FROM c),
    m AS (SELECT es.seq AS endpoint_seq, cs.seq AS call_seq, es.method = cs.method AS same_method FROM es, cs WHERE len(r) = len(u)
        AND len(list_filter(range(1, len(r) + 1), lambda i: NOT (r[i] LIKE ':%' OR regexp_matches(u[i], '^\$\{{.*\}}$') OR r[i] = u[i]))) = 0)"""


_EDGES = """e AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_orderkey * 10 + l_linenumber AS seq, CAST(l_partkey AS VARCHAR) AS target FROM lineitem)"""
_FINDINGS = r"""a AS (SELECT event_id AS seq, 'dead-code:unused-import' AS type, 'dead-code-detector' AS source_module, 'src/f' || (event_id // 25) || '.ts' AS path, CAST(event_id % 90 + 1 AS INT) AS line,
        'user ' || user_id AS description, 'eliminar' AS suggested_action, CASE WHEN event_id % 3 = 0 THEN 'alto' ELSE 'medio' END AS confidence FROM events WHERE event_type = 'view'
    UNION ALL SELECT event_id, CASE WHEN event_type = 'error' THEN 'precommit:linter' ELSE 'tip:multiple' END, 'pre-commit-reviewer', 'src/f' || (event_id // 25) || '.ts', NULL,
        '[' || ['error', 'advertencia', 'recomendación'][event_id % 3 + 1] || '] user ' || user_id, NULL, NULL FROM events WHERE event_type IN ('error', 'purchase')
    UNION ALL SELECT event_id, 'fb-comparator:missing-endpoint', 'frontend-backend-comparator', NULL, CAST(event_id AS INT), 'user ' || user_id, NULL, NULL FROM events WHERE event_type = 'click'),
    s AS (SELECT *, CASE WHEN description LIKE '[error]%' THEN 'Error' WHEN description LIKE '[advertencia]%' THEN 'Warning' WHEN description LIKE '[recomendación]%' THEN 'Information'
        WHEN confidence = 'alto' THEN 'Warning' ELSE 'Information' END AS severity FROM a),
    z AS (SELECT *, sha256(seq || '|' || type || '|' || description) AS id, CASE WHEN contains(lower(type), 'review') THEN 'review' WHEN contains(lower(type), 'tip') THEN 'tip'
        WHEN confidence IS NOT NULL THEN 'problema' ELSE 'recomendación' END AS kind FROM s)"""
_PAIRS = """k AS (SELECT user_id, event_type, (event_id % 5 = 0)::INT AS odd, max(CASE WHEN value >= 50 THEN 'string' WHEN value >= 20 THEN 'number' ELSE 'any' END) AS kind FROM events GROUP BY ALL),
    b AS (SELECT DISTINCT user_id FROM k WHERE odd = 0 AND user_id IN (SELECT user_id FROM k WHERE odd = 1) AND user_id % 3 <> 0)"""

_QUOTED = "|".join(rf"{q}(?s:[^{q}\\]|\\.)*(?:{q}|\\?\z)" for q in ("''", "\x22", "`"))
_CODE_TOKENS = rf"//[^\n]*\n?|(?s:/\*.*?(?:\*/|\z))|{_QUOTED}|[^/''\x22`()\[\]{{}}]+|(?s:.)"

_WINDOWS = rf"""{_FILES}, {_LINES}, t AS (SELECT path, line, {_TRIM} AS t FROM l),
        w AS (SELECT a.path, a.line AS s, [a.t, b.t, c.t, d.t, e.t] AS w FROM t a JOIN t b ON a.path = b.path AND b.line = a.line + 1 JOIN t c ON a.path = c.path AND c.line = a.line + 2
            JOIN t d ON a.path = d.path AND d.line = a.line + 3 JOIN t e ON a.path = e.path AND e.line = a.line + 4 WHERE '' NOT IN (a.t, b.t, c.t, d.t, e.t)),
        v AS (SELECT *, CAST(round(list_sum(list_transform(w, lambda x: length(x))) / 20.0) AS INT) AS bucket FROM w),
        x AS (SELECT a.bucket, a.path AS a_path, a.s AS a_start_line, a.s + 4 AS a_end_line, b.path AS b_path, b.s AS b_start_line, b.s + 4 AS b_end_line,
            CAST((a.w[1] = b.w[1])::INT + (a.w[2] = b.w[2])::INT + (a.w[3] = b.w[3])::INT + (a.w[4] = b.w[4])::INT + (a.w[5] = b.w[5])::INT AS INT) AS equal_lines
            FROM v a JOIN v b ON a.bucket = b.bucket AND (a.path < b.path OR a.path = b.path AND a.s + 4 < b.s))"""

SQL = {
    "event_validate": """SELECT event_id, CASE event_type WHEN 'view' THEN event_id % 130 <= 100 WHEN 'click' THEN event_id % 1200 BETWEEN 1 AND 1000 WHEN 'error' THEN event_id % 4 <> 0
        WHEN 'purchase' THEN event_id % 3 <> 0 ELSE false END AS valid FROM events""",
    "event_states": """SELECT event_id, CASE event_type WHEN 'view' THEN 'working' WHEN 'click' THEN 'success' WHEN 'error' THEN 'error' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'idle' ELSE 'sleeping' END ELSE 'idle' END AS state,
        CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END END AS bubble FROM events""",
    "finding_events": f"""WITH {_FINDINGS} SELECT seq, CASE WHEN type = 'precommit:linter' THEN 'error' ELSE 'warning' END AS kind,
        CASE WHEN type = 'precommit:linter' THEN 'Se detectó un posible secreto en ' || coalesce(path, 'archivo desconocido') ELSE description END AS message FROM s""",
    "tech_stack": """WITH n AS (SELECT ['react', 'express', 'left-pad', 'vite', 'vue', 'typescript', 'koa'] AS n, ['React (frontend)', 'Express (backend)', NULL, 'Vite (bundler)', 'Vue (frontend)', 'TypeScript', 'Koa (backend)'] AS l),
        p AS (SELECT c_custkey, i, c_custkey * (i + 1) % 7 + 1 AS k FROM customer, range(4) r(i)), d AS (SELECT c_custkey, k, min(i) AS i FROM p GROUP BY ALL)
        SELECT c_custkey, coalesce(string_agg(l[k], ', ' ORDER BY i), 'sin dependencias reconocidas') AS summary, string_agg(CASE WHEN k IN (2, 7) THEN n[k] END, ',' ORDER BY i) AS backend FROM d, n GROUP BY c_custkey""",
    "unused_names": rf"""WITH {_FILES}, {_DECLARED},
        t AS (SELECT is_test, unnest(regexp_extract_all(content, '[A-Za-z0-9_$]+')) AS token FROM f),
        n AS (SELECT token, count(*) FILTER (NOT is_test) AS r, count(*) FILTER (is_test) AS t FROM t GROUP BY token),
        o AS (SELECT d.*, len(list_filter(regexp_extract_all(regexp_split_to_array(content, '\r?\n')[1], '[A-Za-z0-9_$]+'), lambda x: x = d.name)) AS own FROM d),
        c AS (SELECT path, name, coalesce(r, 0) - CASE WHEN is_test THEN 0 ELSE own END AS n_real, coalesce(n.t, 0) - CASE WHEN is_test THEN own ELSE 0 END AS n_test FROM o LEFT JOIN n ON name = token),
        x AS (SELECT *, CASE WHEN n_real > 0 THEN NULL WHEN n_test > 0 THEN 'medio' ELSE 'alto' END AS confidence FROM c)
        SELECT *, CASE confidence WHEN 'alto' THEN 'eliminar' WHEN 'medio' THEN 'comentar' END AS suggested_action FROM x""",
    "word_refs": rf"""WITH {_FILES}, {_DECLARED}, {_LINES}, t AS (SELECT path, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS token FROM l),
        n AS (SELECT name, count(*) AS declared FROM d GROUP BY name), o AS (SELECT t.path AS used_in, line, token AS name, count(*) AS n FROM t GROUP BY ALL),
        x AS (SELECT name, used_in, line, n, declared - CASE WHEN line = 1 AND (used_in, name) IN (SELECT (path, name) FROM d) THEN 1 ELSE 0 END AS n_links FROM o JOIN n USING (name))
        SELECT 'declaration' AS kind, name, path, 1 AS line, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS n_links FROM d
        UNION ALL SELECT 'usage', name, used_in, CAST(line AS INT), n, n_links FROM x WHERE n_links > 0""",
    "redact_documents": rf"""WITH {_FILES}, r AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '{_CONNECTION}', '\1://[REDACTED]', 'g'), '{_AWS}', '[REDACTED]', 'g'), '{_JWT}', '\1[REDACTED]', 'g'),
        '{_ASSIGN}', '\1[REDACTED]', 'g') AS redacted FROM f) SELECT *, contains(redacted, '[REDACTED]') AS changed FROM r""",
    "secret_lines": rf"""WITH {_FILES}, {_LINES} SELECT path, line FROM l WHERE regexp_matches(text, '{_CONNECTION}') OR regexp_matches(text, '{_AWS}') OR regexp_matches(text, '{_JWT}') OR regexp_matches(text, '{_ASSIGN}')""",
    "sensitive_paths": f"WITH {_PATHS} SELECT doc_id, path, {_SENSITIVE} AS excluded FROM p",
    "gitignore_filter": rf"""WITH {_PATHS} SELECT doc_id, path, regexp_matches(path, '(^|/)[^/]*\.generated\.ts(/.*)?$') OR regexp_matches(path, '^src/src1/en(/.*)?$') OR regexp_matches(path, '^src/[^/]*/de/9[^/]\.js(/.*)?$')
        OR regexp_matches(path, '(^|/)dist/') AS ignored FROM p""",
    "indexable_files": rf"""WITH {_PATHS} SELECT doc_id, path, regexp_matches(path, '(?i)\.(test|spec)\.[cm]?[jt]sx?$') AS is_test FROM p
        WHERE regexp_matches(path, '\.(js|jsx|ts|tsx)$') AND NOT regexp_matches(path, '(^|[\\/])(node_modules|bower_components|\.pnp)([\\/]|$)') AND NOT {_SENSITIVE}""",
    "search_exact": "SELECT p_partkey AS seq, p_name AS name FROM part WHERE contains(lower(p_name), 'red')",
    "search_topk": """SELECT * FROM (SELECT p_partkey AS seq, p_name AS name, CAST(2 * contains(lower(p_name), 'red')::INT + contains(lower(p_name), 'o')::INT + contains(lower(p_name), 'a')::INT
        + contains(lower(p_name), 'e')::INT + contains(lower(p_name), 'i')::INT AS INT) AS score FROM part) WHERE score > 0 ORDER BY score DESC, seq LIMIT 8""",
    "suggestions": """SELECT p_name AS name, min(p_partkey) AS first_seq FROM part WHERE contains(lower(p_name), 'blue') OR contains('blue', lower(p_name)) OR contains(lower(p_name), 'green') OR contains('green', lower(p_name))
        GROUP BY p_name ORDER BY first_seq LIMIT 5""",
    "commented_runs": rf"""WITH {_FILES}, {_LINES}, g AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS island FROM l WHERE length(text) % 3 > 0)
        SELECT path, min(line) AS start_line, max(line) AS end_line, count(*) AS n_lines FROM g GROUP BY path, island HAVING count(*) >= 3""",
    "dup_windows": f"WITH {_WINDOWS} SELECT * FROM x WHERE equal_lines >= 4",
    "bracket_errors": rf"""WITH {_FILES}, h AS (SELECT path, translate(regexp_replace(content, '[A-Z\x{{C0}}-\x{{DE}}]', '(', 'g'), '.;:', ')[]') AS content FROM f),
        t AS (SELECT path, length(content) AS n, list_transform(regexp_extract_all(content, '{_CODE_TOKENS}'), lambda x: {{'stack': x, 'at': 0::BIGINT, 'e': -1::BIGINT, 'f': '', 'w': ''}}) AS x FROM h),
        r AS (SELECT path, n, list_reduce(x, lambda s, t: CASE WHEN s.e >= 0 THEN s
                WHEN t.stack IN ('(', '[', '{{') THEN {{'stack': s.stack || translate(t.stack, '([{{', ')]}}'), 'at': s.at + 1, 'e': -1::BIGINT, 'f': '', 'w': ''}}
                WHEN t.stack IN (')', ']', '}}') AND s.stack[-1] = t.stack THEN {{'stack': s.stack[:-2], 'at': s.at + 1, 'e': -1::BIGINT, 'f': '', 'w': ''}}
                WHEN t.stack IN (')', ']', '}}') THEN {{'stack': s.stack, 'at': s.at, 'e': s.at, 'f': t.stack, 'w': s.stack[-1]}}
                ELSE {{'stack': s.stack, 'at': s.at + length(t.stack), 'e': -1::BIGINT, 'f': '', 'w': ''}} END,
            {{'stack': '', 'at': 0::BIGINT, 'e': -1::BIGINT, 'f': '', 'w': ''}}) AS s FROM t)
        SELECT path, CASE WHEN s.e >= 0 THEN s.e ELSE n END AS "at", nullif(s.f, '') AS found, nullif(CASE WHEN s.e >= 0 THEN s.w ELSE s.stack[-1] END, '') AS expected FROM r WHERE s.e >= 0 OR s.stack <> ''""",
    "duplicate_blocks": f"""WITH RECURSIVE {_WINDOWS}, o AS MATERIALIZED (SELECT *, a_path || ':' || a_start_line AS a, b_path || ':' || b_start_line AS b,
            row_number() OVER (PARTITION BY bucket ORDER BY a_path, a_start_line, b_path, b_start_line) AS k FROM x WHERE equal_lines >= 4),
        q AS (SELECT DISTINCT bucket, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS used, false AS ok FROM o
            UNION ALL SELECT o.bucket, o.k, CASE WHEN f.ok THEN used || [a, b] ELSE used END, f.ok FROM q JOIN o ON o.bucket = q.bucket AND o.k = q.k + 1,
                LATERAL (SELECT NOT list_contains(used, a) AND NOT list_contains(used, b) AS ok) f)
        SELECT a_path, a_start_line, a_end_line, b_path, b_start_line, b_end_line, equal_lines FROM q JOIN o USING (bucket, k) WHERE ok""",
    "import_resolution": f"""WITH {_EDGES}, q AS (SELECT ['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'] AS x),
        k AS (SELECT DISTINCT target || x[CAST(target AS INT) % 9 + 1] AS path FROM e, q UNION SELECT DISTINCT target || '.jsx' FROM e WHERE CAST(target AS INT) % 4 = 0),
        c AS (SELECT path AS src, seq, target AS source, target || x[i] AS path, i FROM e, q, range(1, 10) r(i)), h AS (SELECT c.*, row_number() OVER (PARTITION BY src, seq, source ORDER BY i) AS n FROM c JOIN k USING (path))
        SELECT DISTINCT src, seq, source, path AS target FROM h WHERE n = 1""",
    "index_maintained": r"""WITH f AS (SELECT doc_id AS k, 'src/d' || doc_id || ['.ts', '.tsx', '.js', '/index.jsx', '.spec.ts'][doc_id % 5 + 1] AS path, doc_id % 5 = 4 AS is_test,
            CASE WHEN doc_id % 11 = 2 THEN NULL WHEN doc_id % 15 = 5 THEN 'only line' WHEN doc_id % 7 = 1 THEN coalesce(text, '') || chr(10) || 'changed'
                WHEN doc_id % 10 = 0 THEN coalesce(text, '') WHEN doc_id % 5 = 0 THEN NULL ELSE coalesce(text, '') END AS content FROM documents),
        l AS (SELECT path, k, unnest(regexp_split_to_array(content, '\r?\n')) AS text, generate_subscripts(regexp_split_to_array(content, '\r?\n'), 1) - 1 AS seq FROM f WHERE content IS NOT NULL),
        e AS (SELECT l.path, f.path AS target, seq FROM l JOIN f ON f.k = l.k + length(l.text) % 97 - 48 WHERE f.content IS NOT NULL AND NOT f.is_test),
        t AS (SELECT is_test, unnest(regexp_extract_all(content, '[A-Za-z0-9_$]+')) AS token FROM f WHERE content IS NOT NULL)
        SELECT 'edge' AS kind, path AS a, target AS b, CAST(seq AS BIGINT) AS n, CAST(NULL AS BIGINT) AS m FROM e
        UNION ALL SELECT 'orphan', path, NULL, NULL, NULL FROM f WHERE content IS NOT NULL AND NOT is_test AND path NOT IN (SELECT target FROM e)
        UNION ALL SELECT 'word', token, NULL, count(*) FILTER (NOT is_test), count(*) FILTER (is_test) FROM t GROUP BY token""",
    "heartbeat_gaps": """WITH e AS (SELECT DISTINCT user_id AS sender, epoch_us(ts) // 1000 AS t FROM events), n AS (SELECT *, lead(t) OVER (PARTITION BY sender ORDER BY t) AS f FROM e),
        g AS (SELECT * FROM n WHERE (f IS NULL OR f - t > 21600000) AND t + 21600000 <= (SELECT max(t) - 3600000 FROM e))
        SELECT sender, t AS last_seen, t + 21600000 AS lost_at, row_number() OVER (PARTITION BY sender ORDER BY t) AS times_lost FROM g""",
    "json_shapes": r"""WITH j AS (SELECT event_type AS grp, props::JSON AS j FROM events UNION ALL SELECT role, to_json({'turn': turn, 'text': coalesce(text, ''),
                'lines': list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN length(x) > 80 THEN to_json({'n': length(x), 'long': x}) ELSE to_json({'n': length(x)}) END)}) FROM conversations),
        t AS (SELECT grp, regexp_replace(replace(fullkey, '"', ''), '\[\d+\]', '[]', 'g') AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
            WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM j, json_tree(j)),
        c AS (SELECT grp, path, kind, count(*) AS n, regexp_replace(path, '\.[^.\[]*$', '') AS up FROM t GROUP BY ALL), h AS (SELECT *, sum(n) OVER (PARTITION BY grp, path) AS held FROM c)
        SELECT h.grp, h.path, h.kind, h.n, h.path = '$' OR coalesce(h.held = o.n AND NOT h.path LIKE '%]', false) AS always FROM h LEFT JOIN c o ON o.grp = h.grp AND o.path = h.up AND o.kind = 'object'""",
    "line_diffs": """WITH d AS (SELECT doc_id AS path, coalesce(text, '') AS text, lag(doc_id) OVER w AS other, lag(coalesce(text, '')) OVER w AS old FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
        SELECT path, other, CAST(len(string_split(old, chr(10))) AS INT) AS old_lines, CAST(len(string_split(text, chr(10))) AS INT) AS new_lines, sha256(old) AS old_sha256, sha256(text) AS new_sha256 FROM d WHERE other IS NOT NULL""",
    "import_graph": f"""WITH {_EDGES}, g AS (SELECT path, string_agg(target, ',' ORDER BY seq, target) AS targets, count(*) AS n FROM e GROUP BY path)
        SELECT x.path, coalesce(targets, '') AS targets, CAST(coalesce(n, 0) AS INT) AS n_targets FROM (SELECT path FROM e UNION SELECT target FROM e) x LEFT JOIN g USING (path)""",
    "related_files": f"""WITH {_EDGES} SELECT path, target AS related, 'imports' AS relation FROM e UNION ALL SELECT DISTINCT target, path, 'imported-by' FROM e WHERE path <> target""",
    "orphans": """SELECT CAST(p_partkey AS VARCHAR) AS path, 'alto' AS confidence, 'revisar-manualmente' AS suggested_action FROM part
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 1 AND l_returnflag = 'R')""",
    "route_match": f"WITH {_contract()} SELECT * FROM m",
    "unconsumed": f"WITH {_contract()} SELECT seq AS endpoint_seq, route AS endpoint_route, method AS endpoint_method FROM e WHERE seq NOT IN (SELECT endpoint_seq FROM m)",
    "missing": f"WITH {_contract()} SELECT seq AS call_seq, url AS call_url, method AS call_method FROM c WHERE seq NOT IN (SELECT call_seq FROM m)",
    "near_miss": rf"""WITH {_contract()}, a AS (SELECT seq AS call_seq, array_to_string(list_transform(u, lambda x: CASE WHEN regexp_matches(x, '^\$\{{.*\}}$') THEN '*' ELSE x END), '/') AS n FROM cs WHERE seq NOT IN (SELECT call_seq FROM m)),
        b AS (SELECT seq, route, method, array_to_string(list_transform(r, lambda x: CASE WHEN x LIKE ':%' THEN '*' ELSE x END), '/') AS o FROM es),
        d AS (SELECT call_seq, route, method, levenshtein(n, o) AS distance, row_number() OVER (PARTITION BY call_seq ORDER BY levenshtein(n, o), b.seq) AS k FROM a, b
            WHERE length(n) >= 3 AND length(o) >= 3 AND levenshtein(n, o) BETWEEN 1 AND 2)
        SELECT call_seq, route AS near_route, method AS near_method, CAST(distance AS INT) AS distance FROM d WHERE k = 1""",
    "route_params": f"WITH {_contract()} SELECT seq, unnest(regexp_extract_all(route, ':([A-Za-z0-9_]+)', 1)) AS name, 'string' AS type, true AS required FROM e",
    "schema_diff": f"WITH {_PAIRS} SELECT user_id, event_type AS field FROM k JOIN b USING (user_id) WHERE odd = 0 AND kind <> 'any' AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM k WHERE odd = 1)",
    "type_mismatch": f"""WITH {_PAIRS} SELECT x.user_id, string_agg(x.event_type, ',' ORDER BY x.event_type) AS fields FROM k x JOIN k y ON x.user_id = y.user_id AND x.event_type = y.event_type AND x.odd = 0 AND y.odd = 1 JOIN b ON b.user_id = x.user_id
        WHERE x.kind <> 'any' AND y.kind <> 'any' AND x.kind <> y.kind GROUP BY x.user_id""",
    "findings_union": f"WITH {_FINDINGS} SELECT seq, type, source_module, path, line, description, suggested_action, confidence, severity FROM s",
    "seed_rows": f"WITH {_FINDINGS} SELECT id, seq, kind AS type, source_module, CASE WHEN line IS NOT NULL THEN path END AS path, CASE WHEN path IS NOT NULL THEN line END AS line, 'Pendiente' AS state FROM z",
    "seed_basket": f"WITH {_FINDINGS} SELECT id, CASE WHEN length(description) > 8 THEN substr(description, 1, 7) || '…' ELSE description END AS label, kind AS type FROM z",
    "seed_states": """WITH RECURSIVE q AS (SELECT user_id AS seed_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'En revisión' WHEN 'error' THEN 'Ignorada' WHEN 'click' THEN 'Pendiente' WHEN 'view' THEN 'En revisión' ELSE 'Resuelta' END AS new_state,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
        w AS (SELECT seed_id, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS new_state, false AS accepted, 'Pendiente' AS state FROM (SELECT DISTINCT seed_id FROM q)
            UNION ALL SELECT q.seed_id, q.k, q.seq, q.new_state, o.ok, CASE WHEN o.ok THEN q.new_state ELSE w.state END FROM w JOIN q ON q.seed_id = w.seed_id AND q.k = w.k + 1,
                LATERAL (SELECT (w.state = 'Pendiente' AND q.new_state <> 'Pendiente') OR (w.state = 'En revisión' AND q.new_state IN ('Resuelta', 'Ignorada')) AS ok) o)
        SELECT seed_id, seq, new_state, accepted, state FROM w WHERE k > 0""",
    "carrying_flag": """WITH e AS (SELECT event_id AS seq, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 WHEN 'error' THEN -1 ELSE 0 END AS INT) AS delta FROM events),
        s AS (SELECT *, CAST(sum(delta) OVER (ORDER BY seq) AS BIGINT) AS pending FROM e) SELECT *, pending > 0 AS carrying FROM s""",
    "diagnostics": f"""WITH {_FINDINGS} SELECT path, string_agg(seq || ':' || severity || ':' || greatest(0, coalesce(line, 1) - 1), ' ' ORDER BY seq) AS diagnostics FROM s WHERE path IS NOT NULL GROUP BY path""",
    "snippets": rf"""WITH {_FILES} SELECT path, array_to_string(regexp_split_to_array(content, '\r?\n')[greatest(path % 4, 1):greatest(path % 4, 1) + 2], chr(10)) AS snippet FROM f""",
    "folder_tree": f"""WITH {_PATHS}, s AS (SELECT string_split(path, '/') AS x FROM p), r AS (SELECT x[1:i] AS y, i, len(x) > i AND i < 3 AS more FROM s, range(1, 4) t(i) WHERE i <= len(x))
        SELECT array_to_string(y, '/') AS prefix, y[-1] AS name, CAST(i AS INT) AS level, bool_or(more) AS is_folder FROM r GROUP BY y, i""",
    "points_in_areas": """WITH a AS (SELECT p_partkey, p_size::DOUBLE AS x0, p_retailprice * (p_partkey % 40 + 1) AS y0, (p_size + p_partkey % 4)::DOUBLE AS x1, p_retailprice * (p_partkey % 40 + 1) + p_size * 20 AS y1 FROM part)
        SELECT l_orderkey, l_linenumber, count(*) AS n_areas, min(p_partkey) AS first_area FROM lineitem JOIN a ON l_quantity BETWEEN x0 AND x1 AND l_extendedprice BETWEEN y0 AND y1 GROUP BY ALL""",
    "progress_events": """SELECT event_id, CASE WHEN event_id % 100 > 0 THEN least(100.0, greatest(0.0, value / (event_id % 100) * 100)) ELSE 0.0 END AS progress,
        CAST(least(1000, greatest(1, floor(value - 20 + 0.5))) AS INT) AS amount, CAST(least(10000, 500 * pow(2, event_id % 8)) AS INT) AS wait_ms FROM events""",
    "debounced": """WITH e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS moment FROM events), n AS (SELECT *, lead(moment) OVER (PARTITION BY key ORDER BY moment, seq) AS f FROM e)
        SELECT key, seq, moment AS "at" FROM n WHERE f IS NULL OR f - moment > 3600000000""",
}

SQL["checks_within"] = f"""WITH a AS (SELECT 0 AS ord, 'secrets' AS "check", count(*) AS n, sum(line) AS l FROM ({SQL["secret_lines"]})
    UNION ALL SELECT 1, 'comments', count(*), sum(start_line) FROM ({SQL["commented_runs"]})
    UNION ALL SELECT 2, 'sensitive-paths', count(*), count(*) FROM ({SQL["sensitive_paths"]}) WHERE excluded)
    SELECT CAST(ord AS INT) AS ord, "check", 'completed' AS status, CAST(NULL AS VARCHAR) AS reason, n AS n_findings, CAST(coalesce(l, 0) AS BIGINT) AS sum_lines FROM a"""

_RUNS = rf"//[^\n]*\n?|/\*(?s:.*?)(?:\*/|\z)|{_QUOTED}"
#: Code is what lies between the other runs.
SQL["char_classes"] = f"""WITH t AS (SELECT doc_id AS path, translate(coalesce(text, ''), ',;', chr(39) || chr(96)) AS content FROM documents),
    r AS (SELECT path, unnest(regexp_extract_all(content, '{_RUNS}')) AS run FROM t UNION ALL SELECT path, unnest(regexp_split_to_array(content, '{_RUNS}')) FROM t),
    k AS (SELECT path, CASE WHEN starts_with(run, '//') THEN 'line-comment' WHEN starts_with(run, '/*') THEN 'block-comment' WHEN starts_with(run, chr(39)) THEN 'single'
        WHEN starts_with(run, chr(34)) THEN 'double' WHEN starts_with(run, chr(96)) THEN 'template' ELSE 'code' END AS kind, run FROM r WHERE run <> '')
    SELECT path, kind, count(*) AS n_runs, CAST(sum(length(run)) AS BIGINT) AS n_chars FROM k GROUP BY path, kind"""

SQL["scanned_files"] = f"""WITH w AS (SELECT i.doc_id, i.path FROM ({SQL["indexable_files"]}) i JOIN ({SQL["gitignore_filter"]}) g USING (doc_id) WHERE NOT ignored),
    x AS (SELECT path, coalesce(text, '') AS t, path IN (SELECT min(path) FROM w UNION ALL SELECT max(path) FROM w) AS failed FROM w JOIN documents USING (doc_id))
    SELECT path, CASE WHEN NOT failed THEN length(t) END AS n_chars, CASE WHEN NOT failed THEN sha256(t) END AS text_sha256, failed FROM x"""

SQL["readme_lines"] = f"""WITH {_contract()}, {_PATHS}, k AS (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT unnest(['react', 'axios', 'express'])),
    t AS (SELECT * FROM (VALUES (1, 'Descripción del proyecto'), (2, 'Stack tecnológico'), (3, 'Instalación'), (4, 'Variables de entorno'), (5, 'Scripts disponibles'),
        (6, 'Estructura de carpetas'), (7, 'Endpoints principales'), (8, 'Instrucciones para ejecutar frontend y backend')) v(section, title)),
    z AS (SELECT 1 AS section, 1 AS rank, '' AS key, 0 AS seq, 'tienda. ' || (SELECT count(*) FROM k) || ' paquetes. Contiene ' || (SELECT count(*) FROM p) || ' archivo(s) indexado(s). Tecnologías detectadas: Axios (cliente HTTP), Express (backend), React (frontend).' AS text
        UNION ALL SELECT 2, 1, '', unnest([0, 1, 2, 3]),
        unnest(['- Axios (cliente HTTP)', '- Express (backend)', '- React (frontend)', '- Otras dependencias: ' || (SELECT string_agg(name, ', ' ORDER BY name) FROM k WHERE name NOT IN ('axios', 'express', 'react'))])
        UNION ALL SELECT 3, 1, '', unnest([0, 1, 2]), unnest(['```bash', 'npm install', '```'])
        UNION ALL SELECT DISTINCT 4, 1, upper(source), 0, '- `' || upper(source) || '`' FROM documents WHERE source IS NOT NULL
        UNION ALL SELECT 5, 1, '', unnest([0, 1]), unnest(['- `npm run dev`: vite', '- `npm run start`: node .'])
        UNION ALL SELECT 6, unnest([0, 2]), '', 0, '```'
        UNION ALL SELECT 6, 1, prefix, 0, repeat('  ', level - 1) || name || CASE WHEN is_folder THEN '/' ELSE '' END FROM ({SQL["folder_tree"]})
        UNION ALL SELECT 7, 1, 'back.ts', seq, '- **' || method || '** ' || route || ' (`back.ts:' || (seq + 1) || '`)' FROM e
        UNION ALL SELECT 8, 1, '', unnest([0, 1]), unnest(['- Ejecuta `npm run dev` para iniciar el servidor de desarrollo del frontend.', '- Ejecuta `npm start` para iniciar el servidor backend.']))
    SELECT section, title, rank, key, CAST(seq AS BIGINT) AS seq, text, FALSE AS omitted FROM z JOIN t USING (section)"""
