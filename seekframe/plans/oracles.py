"""DuckDB SQL with the same rows as the queries, written from the definitions and not from the plans."""

from __future__ import annotations

FILES = """
files AS (
  SELECT *, CASE WHEN path LIKE '%.java' THEN 'java' WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.kt' THEN 'kotlin'
                 WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.py' THEN 'python' ELSE 'sql' END AS language,
         CASE WHEN path LIKE '%.md' THEN 'DOCUMENTATION' WHEN path LIKE 'src/test/%' THEN 'TEST' ELSE 'SOURCE' END AS category,
         sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS size
  FROM (SELECT doc_id, source, lang, text AS content,
               CASE doc_id % 5 WHEN 0 THEN 'src/test/' WHEN 1 THEN 'docs/' ELSE 'src/main/' END || 'doc_' || doc_id ||
               list_extract(['.java', '.md', '.kt', '.ts', '.py', '.sql'], CAST(doc_id % 6 AS INTEGER) + 1) AS path FROM documents)
)"""
SYMBOLS = """
symbols AS (
  SELECT 'part_' || p_partkey AS path, replace(p_name, ' ', '_') AS name, p_brand || '.' || p_type || '.' || replace(p_name, ' ', '_') AS qualified,
         list_extract(['CLASS', 'INTERFACE', 'RECORD', 'ENUM', 'ANNOTATION', 'METHOD', 'CONSTRUCTOR', 'TYPE'], p_size % 8 + 1) AS kind,
         p_size AS start_line, p_size + 3 AS end_line
  FROM part
)"""
RELATIONS = """
relations AS (
  SELECT c_name AS source, r_name || '.' || n_name || '.' || c_name AS target, 'IMPORTS' AS kind, 'builtin' AS provider
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
EDGES = "edges AS (SELECT DISTINCT 'supp_' || l_suppkey AS src, 'part_' || l_partkey AS dst FROM lineitem)"
CHANGES = """
changes AS (
  SELECT DISTINCT l_orderkey AS commit_id, o_orderdate AS changed_at, 'part_' || l_partkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
TYPE = "CASE category WHEN 'TEST' THEN 'TEST' WHEN 'DOCUMENTATION' THEN 'DOCUMENTATION' ELSE 'FILE' END"
TYPE_PLACE = "CASE type WHEN 'SYMBOL' THEN 0 WHEN 'TEST' THEN 1 WHEN 'FILE' THEN 2 WHEN 'DOCUMENTATION' THEN 3 ELSE 9 END"
TOKENS = "CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(content) / 3.5) AS INTEGER)) END"
WORD = r"[\p{L}\p{N}_]+(?:[.''][\p{L}\p{N}_]+)*"


def place(partition: str, order: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS INTEGER)"


def split_identifiers(x: str) -> str:
    parted = rf"regexp_replace(regexp_replace({x}, '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g')"
    return rf"trim(regexp_replace({parted}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


TEXT_QUERIES = """
queries AS (SELECT * FROM (VALUES (1, 'licensed under the Apache License'), (2, 'released MIT'), (3, 'ouque'), (4, 'the-on doc_12')) AS v(query_id, query)),
query_terms AS (
  SELECT query_id, unnest(terms) AS term, CASE WHEN len(terms) < 2 THEN 1 ELSE 2 END AS needed
  FROM (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '""" + WORD + r"""')) AS terms FROM queries)
),
path_terms AS (SELECT query_id, list_filter(string_split_regex(lower(query), '[^\p{L}\p{N}_$#.]+'), lambda t: t <> '') AS words FROM queries)"""


def hits(project: str) -> str:
    """CTEs up to hits(query_id, project, path, score)."""
    return f"""{FILES}, {TEXT_QUERIES},
    fields AS (
      SELECT project, path, field, words, len(words) AS size FROM (
        SELECT {project} AS project, path, 'path' AS field, regexp_extract_all(lower(path), '{WORD}') AS words FROM files
        UNION ALL SELECT {project}, path, 'content', regexp_extract_all(lower(content), '{WORD}') FROM files
        UNION ALL SELECT {project}, path, 'code_terms', regexp_extract_all(lower({split_identifiers("path || ' ' || content")}), '{WORD}') FROM files
      ) WHERE len(words) > 0
    ),
    stats AS (SELECT project, field, count(*) AS docs, avg(size) AS mean FROM fields GROUP BY ALL),
    posting AS (
      SELECT project, path, field, size, term, count(*) AS tf FROM (SELECT project, path, field, size, unnest(words) AS term FROM fields)
      WHERE term IN (SELECT term FROM query_terms) GROUP BY ALL
    ),
    found AS (SELECT project, field, term, count(*) AS df FROM posting GROUP BY ALL),
    hits AS (
      SELECT query_id, p.project AS project, path,
             sum(CASE p.field WHEN 'path' THEN 3.0 WHEN 'code_terms' THEN 2.0 ELSE 1.0 END * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
      FROM posting p JOIN found f ON p.project = f.project AND p.field = f.field AND p.term = f.term
      JOIN stats s ON p.project = s.project AND p.field = s.field JOIN query_terms q ON p.term = q.term
      GROUP BY query_id, p.project, path HAVING count(DISTINCT p.term) >= max(needed)
    )"""


def top(limit: int) -> str:
    return f"""
    topped AS (SELECT *, {place('query_id, project', 'round(score, 9) DESC, path')} AS rank FROM hits QUALIFY rank <= {limit}),
    normal AS (SELECT *, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS lexical FROM topped WINDOW w AS (PARTITION BY query_id, project)),
    lexical AS (
      SELECT n.*, CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(words, lambda t: contains(lower(n.path), t))) / len(words) END AS path_signal
      FROM normal n JOIN path_terms USING (query_id)
    )"""


NEAREST = """
vectors AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
near AS (
  SELECT CAST(q.id // 100 AS INTEGER) AS query_id, c.id AS id, greatest(0, least(1, (1 + list_cosine_similarity(c.v, q.v)) / 2)) AS score
  FROM vectors q JOIN vectors c ON q.id % 100 = 0
)"""


def nearest(limit: int, queries: str = "true") -> str:
    return f"{NEAREST}, nearest AS (SELECT *, {place('query_id', 'round(score, 9) DESC, id')} AS rank FROM near WHERE score > 0 AND {queries} QUALIFY rank <= {limit})"


MERGED = f"""{hits("'all'")}, {top(60)}, {nearest(60, "query_id BETWEEN 1 AND 4")},
candidates AS (
  SELECT query_id, 'file:' || l.path AS id, {TYPE} AS type, l.path AS path, lexical, path_signal, 0.0 AS semantic FROM lexical l JOIN files f ON l.path = f.path
  UNION ALL
  SELECT query_id, 'file:' || path, 'FILE', path, 0.0, 0.0, score FROM nearest JOIN files ON id = doc_id
),
merged AS (
  SELECT query_id, id, arg_min(type, {TYPE_PLACE}) AS type, min(path) AS path, max(lexical) AS lexical, max(path_signal) AS path_signal, max(semantic) AS semantic
  FROM candidates GROUP BY query_id, id
)"""
ITEMS = f"""{FILES}, items AS (
  SELECT source AS project, path, content, CAST(len(string_split_regex(content, '\\r?\\n')) AS INTEGER) AS end_line, {TOKENS} AS tokens,
         (doc_id * 37 % 101) / 101.0::DOUBLE AS score, {TYPE} AS type,
         {place('source', "round((doc_id * 37 % 101) / 101.0::DOUBLE, 9) DESC, path")} AS item_place
  FROM files
)"""
GREEDY = f"""{ITEMS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY round(score, 9) DESC, path) AS n FROM items),
steps AS (
  SELECT project, n, path, tokens, tokens <= 1000 AS took, 2000 - CASE WHEN tokens <= 1000 THEN tokens ELSE 0 END AS remaining FROM numbered WHERE n = 1
  UNION ALL
  SELECT s.project, x.n, x.path, x.tokens, x.tokens <= least(1000, remaining), remaining - CASE WHEN x.tokens <= least(1000, remaining) THEN x.tokens ELSE 0 END
  FROM steps s JOIN numbered x ON s.project = x.project AND x.n = s.n + 1
),
taken AS (SELECT project, path, tokens, {place('project', 'n')} AS place FROM steps WHERE took)"""
TRUNCATING = rf"""{ITEMS},
numbered AS (
  SELECT project, path, end_line, tokens AS need, row_number() OVER (PARTITION BY project ORDER BY round(score, 9) DESC, path) AS n,
         NOT regexp_matches(content, '[^\s\x0B]') AS blank, regexp_replace(content, '\r\n|[\n\x0B\f\r]', chr(10), 'g') AS plain FROM items
),
steps AS (
  SELECT DISTINCT project, 0::BIGINT AS n, '' AS path, 0 AS end_line, 0 AS tokens, false AS took, false AS cut, 2000 AS remaining FROM items
  UNION ALL
  SELECT project, n, path, CAST(CASE WHEN fits THEN end_line ELSE least(end_line, greatest(1, kept_lines)) END AS INTEGER), CAST(CASE WHEN fits THEN need ELSE cost END AS INTEGER), took, NOT fits,
         CAST(remaining - CASE WHEN NOT took THEN 0 WHEN fits THEN need ELSE cost END AS INTEGER)
  FROM (
    SELECT *, need <= allowed AS fits, need <= allowed OR (allowed >= 24 AND (length(plain) > before OR NOT blank)) AS took,
           CASE WHEN length(plain) <= before THEN length(plain) - length(replace(plain, chr(10), '')) + 1 WHEN contains(reach, chr(10)) THEN length(reach) - length(replace(reach, chr(10), '')) ELSE 1 END AS kept_lines,
           CAST(ceil(CASE WHEN length(plain) <= before THEN length(plain) WHEN contains(reach, chr(10)) THEN length(reach) - strpos(reverse(reach), chr(10)) + 16 ELSE before + 16 END / 3.5) AS INTEGER) AS cost
    FROM (
      SELECT x.*, remaining, allowed, CAST(floor(allowed * 3.5) AS INTEGER) - 16 AS before, substr(plain, 1, greatest(0, CAST(floor(allowed * 3.5) AS INTEGER) - 15)) AS reach
      FROM (SELECT project, n, remaining, least(1000, remaining) AS allowed FROM steps) s JOIN numbered x ON s.project = x.project AND x.n = s.n + 1
    )
  )
)"""
WINDOWS = rf"""{FILES}, split AS (SELECT path, string_split_regex(content, '\r?\n') AS l FROM files),
matching AS (
  SELECT path, n, CAST(len(l) AS INTEGER) AS size FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS n FROM split)
  WHERE contains(lower(l[n]), 'license') OR contains(lower(l[n]), 'token')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY n) <= 4
),
windows AS (
  SELECT path, CAST(greatest(1, n - 5) AS INTEGER) AS start_line, CAST(least(size, n + 5) AS INTEGER) AS end_line FROM matching
  UNION ALL
  SELECT path, 1, CAST(least(len(l), 40) AS INTEGER) FROM split WHERE path NOT IN (SELECT path FROM matching)
)"""
JUDGED = f"""{hits('lang')}, {top(20)},
good AS (SELECT DISTINCT path FROM files JOIN labels USING (doc_id) WHERE quality = 1),
relevant AS (SELECT DISTINCT query_id, lang AS project, f.path AS path FROM files f JOIN good USING (path) JOIN (SELECT DISTINCT query_id, project FROM topped) t ON t.project = lang),
judged AS (
  SELECT query_id, project, count(r.path) AS found, min(CASE WHEN r.path IS NOT NULL THEN rank END) AS first
  FROM topped t LEFT JOIN relevant r USING (query_id, project, path) WHERE rank <= 3 GROUP BY ALL
),
total AS (SELECT query_id, project, count(*) AS n FROM relevant GROUP BY ALL),
rated AS (
  SELECT query_id, project, coalesce(found, 0) / 3.0::DOUBLE AS precision, CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE coalesce(found, 0) / n::DOUBLE END AS recall,
         CASE WHEN coalesce(found, 0) > 0 THEN 1 ELSE 0 END AS hit, coalesce(1.0::DOUBLE / first, 0) AS rr
  FROM judged FULL JOIN total USING (query_id, project)
)"""


def symbol_order(q: str) -> str:
    return f"CASE WHEN lower(name) = {q} THEN 0 WHEN lower(qualified) = {q} THEN 1 WHEN starts_with(lower(name), {q}) THEN 2 ELSE 3 END, qualified, path, start_line"


def symbol_match(q: str) -> str:
    return f"(contains(lower(name), {q}) OR contains(lower(qualified), {q}) OR (substr(lower(name), 1, 1) = substr({q}, 1, 1) AND abs(length(name) - length({q})) <= 3))"


PROVIDED = """
supplied AS (SELECT s_name AS path, s_nationkey AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'builtin' ELSE 'provider_' || (s_suppkey % 3) END AS provider FROM supplier),
bought AS (SELECT c_name AS path, c_nationkey AS target, CASE WHEN c_custkey % 5 = 0 THEN 'builtin' ELSE 'provider_' || (c_custkey % 5) END AS provider FROM customer)"""
PAGES = r"below AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM pages)"
SHARES = f"""{FILES}, shares AS (
  SELECT project, place, CAST(2401 // n + CASE WHEN place < 2401 % n THEN 1 ELSE 0 END AS INTEGER) AS fair
  FROM (SELECT project, CAST(row_number() OVER (ORDER BY project) - 1 AS INTEGER) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source AS project FROM files))
)"""
FEDERATED = rf"""{SHARES}, {ITEMS.removeprefix(FILES + ",")},
offered AS (
  SELECT row_number() OVER (ORDER BY item_place, place) AS n, project, place, path, tokens, fair, md5(type || chr(0) || trim(regexp_replace(content, '[\t-\r\x1c-\x20]+', ' ', 'g'))) AS same
  FROM items JOIN shares USING (project)
),
walk AS (
  SELECT 0::BIGINT AS n, 0::BIGINT AS spent, list_transform(range(CAST((SELECT max(place) + 1 FROM shares) AS BIGINT)), lambda x: 0::BIGINT) AS used, []::VARCHAR[] AS seen, false AS took, false AS waits
  UNION ALL
  SELECT n, spent + CASE WHEN takes THEN tokens ELSE 0 END,
         list_concat(used[1:place], [CASE WHEN NOT opens THEN 1000000000 WHEN takes THEN used[place + 1] + tokens ELSE used[place + 1] END], used[place + 2:]),
         CASE WHEN takes THEN list_append(seen, same) ELSE seen END, takes, NOT opens
  FROM (
    SELECT *, opens AND NOT list_contains(seen, same) AS takes FROM (
      SELECT o.*, spent, used, seen, used[place + 1] + tokens <= fair AND spent + tokens <= 2401 AS opens FROM walk w JOIN offered o ON o.n = w.n + 1))
),
waiting AS (SELECT row_number() OVER (ORDER BY n) AS m, path, project, tokens, same FROM offered JOIN walk USING (n) WHERE waits),
refill AS (
  SELECT 0::BIGINT AS m, spent, seen, false AS took FROM walk WHERE n = (SELECT max(n) FROM walk)
  UNION ALL
  SELECT m, spent + CASE WHEN takes THEN tokens ELSE 0 END, CASE WHEN takes THEN list_append(seen, same) ELSE seen END, takes
  FROM (SELECT x.*, spent, seen, spent + tokens <= 2401 AND NOT list_contains(seen, same) AS takes FROM refill r JOIN waiting x ON x.m = r.m + 1)
),
taken AS (
  SELECT project, path, tokens, false AS refill, n AS turn FROM offered JOIN walk USING (n) WHERE took
  UNION ALL SELECT project, path, tokens, true, m FROM waiting JOIN refill USING (m) WHERE took
)"""
STOP = "a an and are as at be by for from in is it of on or that the this to use when with de des du et en la le les pour sur un une avec dans est ce cette ces au aux".split()
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


def folded(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({x})), '\s+', ' ', 'g'))"


def said(x: str) -> str:
    return rf"list_filter(list_distinct(list_filter(string_split_regex({x}, '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2)), lambda t: NOT list_contains({STOP_LIST}, t))"


def stem(t: str) -> str:
    return f"CASE WHEN length({t}) > 5 AND ends_with({t}, 'ing') THEN substr({t}, 1, length({t}) - 3) WHEN length({t}) > 4 AND (ends_with({t}, 'ed') OR ends_with({t}, 'es')) THEN substr({t}, 1, length({t}) - 2) WHEN length({t}) > 3 AND ends_with({t}, 's') THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"


def matched(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: x = y OR {stem('x')} = {stem('y')})) > 0))"


def hops(edges: str) -> str:
    """CTEs one and two (query_id, path, score): a hop from seeds and one more, each of 2,000 edges a query, outgoing ones first."""

    def hop(of: str) -> str:
        both = f"""SELECT query_id, 0 AS way, src AS seed, dst AS next, score FROM {of} JOIN {edges} ON path = src UNION ALL SELECT query_id, 1, dst, src, score FROM {of} JOIN {edges} ON path = dst"""
        each = f"SELECT query_id, seed, next, min(way) AS way, max(score) AS score FROM ({both}) WHERE seed <> next GROUP BY query_id, seed, next QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(way), seed, next) <= 2000"
        return f"SELECT query_id, next AS path, max(score) AS score FROM ({each}) GROUP BY query_id, next"

    return f"one AS ({hop('seeds')}), two AS ({hop('one')})"


RANKED = f"""
summed AS (
  SELECT *, 0.40 * lexical + 0.10 * path_signal + 0.15 * semantic AS score,
         array_to_string(list_filter([CASE WHEN lexical > 0 THEN printf('lexical=%.4f', round(0.40 * lexical, 4)) END, CASE WHEN path_signal > 0 THEN printf('path_signal=%.4f', round(0.10 * path_signal, 4)) END,
                                      CASE WHEN semantic > 0 THEN printf('semantic=%.4f', round(0.15 * semantic, 4)) END], lambda x: x IS NOT NULL), ' ') AS explanation
  FROM merged
)"""

SQL: dict[str, str] = {
    "symbol_search_ranked": f"""
        WITH {SYMBOLS}, q AS (SELECT unnest(['red', 'bolt', 'brand#2.small.hot_gear']) AS query)
        SELECT query, {place('query', symbol_order('query'))} AS place, path, kind, name, qualified, start_line FROM symbols, q WHERE {symbol_match('query')} QUALIFY place <= 20""",
    "symbol_scored_candidates": rf"""
        WITH {SYMBOLS}, q AS (SELECT query, list_filter(string_split(query, ' '), lambda t: t <> '') AS words FROM (SELECT unnest(['red bolt', 'hot gear', 'wigdet']) AS query)),
        asks AS (SELECT DISTINCT query, words, unnest(list_concat([query], words)) AS ask FROM q),
        pool AS (SELECT * FROM symbols, asks WHERE {symbol_match('ask')} QUALIFY row_number() OVER (PARTITION BY query, ask ORDER BY {symbol_order('ask')}) <= 400),
        scored AS (
          SELECT DISTINCT query, 'symbol:' || path || '#' || qualified AS id, path,
                 CASE WHEN lower(name) = query OR lower(qualified) = query OR len(list_filter(words, lambda t: lower(name) = t OR lower(qualified) = t OR ends_with(lower(qualified), '.' || t))) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS exact,
                 list_max(list_transform(words, lambda t: greatest(CASE WHEN contains(lower(name), t) OR contains(lower(qualified), t) THEN 0.9 ELSE 0.0 END,
                   CASE WHEN lower(name) = t THEN 1.0 ELSE 1 - levenshtein(lower(name), t) / greatest(length(name), length(t))::DOUBLE END)))::DOUBLE AS fuzzy,
                 len(list_filter(words, lambda t: contains(lower(path), t))) / len(words)::DOUBLE AS path_signal
          FROM pool)
        SELECT query, {place('query', 'round(greatest(exact, fuzzy), 9) DESC, path, id')} AS place, id, round(exact, 6) AS exact, round(fuzzy, 6) AS fuzzy, round(path_signal, 6) AS path_signal
        FROM scored WHERE exact > 0 OR fuzzy >= 0.62 QUALIFY place <= 20""",
    "relation_search": f"WITH {RELATIONS} SELECT * FROM relations WHERE contains(lower(source), 'nation_1') OR contains(lower(target), 'nation_1') ORDER BY kind, source, target, provider LIMIT 50",
    "index_statistics": "SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM lineitem) AS relations",
    "type_owner_min": f"WITH {SYMBOLS} SELECT qualified, min(path) AS owner FROM symbols WHERE kind NOT IN ('METHOD', 'CONSTRUCTOR') GROUP BY qualified",
    "targeted_file_lookup": f"WITH {FILES} SELECT source AS project, path, language, size FROM files WHERE doc_id IN (SELECT n * 7 FROM range(100) AS r(n))",
    "file_classification": f"WITH {FILES} SELECT path, language, category, CAST(greatest(1, (size + 3) // 4) AS INTEGER) AS tokens, {TOKENS} AS context_tokens FROM files",
    "content_hash_fingerprint": f"""
        WITH {FILES},
        deals AS (SELECT source, substr(sha256(path), 1, 4) AS deal, sha256(string_agg(path || chr(0) || hash || chr(0) || language || chr(0) || category || chr(0) || chr(10), '' ORDER BY path)) AS digest FROM files GROUP BY 1, 2),
        pairs AS (SELECT source, substr(deal, 1, 2) AS pair, sha256(string_agg(deal || digest, '' ORDER BY deal)) AS digest FROM deals GROUP BY 1, 2)
        SELECT source AS project, sha256(string_agg(pair || digest, '' ORDER BY pair)) AS fingerprint FROM pairs GROUP BY source""",
    "delta_changes": f"""
        WITH {FILES}, stored AS (SELECT path, hash FROM files UNION ALL SELECT 'old/' || path, hash FROM files WHERE doc_id % 3 = 0),
        scanned AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha256(hash || 'x') ELSE hash END AS hash FROM files UNION ALL SELECT 'new/' || path, hash FROM files WHERE doc_id % 5 = 0)
        SELECT path, CASE WHEN s.hash IS NULL THEN 'NEW' WHEN n.hash IS NULL THEN 'REMOVED' WHEN s.hash = n.hash THEN 'UNCHANGED' ELSE 'CHANGED' END AS status
        FROM stored s FULL JOIN scanned n USING (path)""",
    "lexical_bm25_topk": f"WITH {hits('lang')}, {top(20)} SELECT query_id, project, path, rank, round(score, 6) AS score, round(lexical, 6) AS lexical FROM lexical",
    "lexical_min_should_match": f"WITH {hits('lang')} SELECT query_id, project, count(*) AS files FROM hits GROUP BY query_id, project",
    "identifier_split_terms": f"""
        SELECT term, count(*) AS uses FROM (SELECT unnest(string_split(lower({split_identifiers("p_brand || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || p_type")}), ' ')) AS term FROM part) GROUP BY term""",
    "graph_neighbors_bounded": f"""
        WITH {EDGES} SELECT DISTINCT seed, neighbour FROM (
          SELECT 0 AS way, src AS seed, dst AS neighbour FROM edges WHERE src IN ('supp_1', 'supp_2', 'part_3', 'part_4')
          UNION ALL SELECT 1, dst, src FROM edges WHERE dst IN ('supp_1', 'supp_2', 'part_3', 'part_4') ORDER BY way, seed, neighbour LIMIT 60)""",
    "longest_prefix_owner": f"""
        WITH {RELATIONS}, owners AS (SELECT r_name || '.' || n_name AS qualified, 'nation_' || n_nationkey AS owner FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT source, target, arg_max(owner, length(qualified)) AS owner FROM relations JOIN owners ON target = qualified OR starts_with(target, qualified || '.') GROUP BY source, target""",
    "graph_two_hop_scores": f"""
        WITH {EDGES},
        seeds AS (SELECT 0 AS query_id, 'supp_' || s_suppkey AS path, greatest(0, least(1, s_acctbal / 10000)) AS score FROM supplier WHERE s_suppkey < 3 AND s_acctbal > 0),
        {hops("edges")},
        reached AS (SELECT path, score * 0.65::DOUBLE AS graph FROM one UNION ALL SELECT path, score * 0.35::DOUBLE FROM two),
        known AS (SELECT 'part_' || p_partkey AS path FROM part UNION SELECT 'supp_' || s_suppkey FROM supplier)
        SELECT path, round(least(1, max(graph)), 6) AS graph FROM reached WHERE path IN (SELECT path FROM known) GROUP BY path""",
    "recency_scores": f"""
        WITH {CHANGES}, newest AS (SELECT o_orderkey AS commit_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS place FROM orders QUALIFY place < 50)
        SELECT path, round(max(greatest(0.05, 1 - place / 49.0::DOUBLE)), 6) AS recency FROM newest JOIN changes USING (commit_id) WHERE commit_id % 10 <> 0 GROUP BY path""",
    "co_change_top8": f"""
        WITH {CHANGES}, targets AS (SELECT 'part_' || n AS path FROM range(40) AS r(n))
        SELECT path, count(*) AS commits FROM changes WHERE path NOT IN (SELECT path FROM targets) AND commit_id IN (SELECT commit_id FROM changes WHERE path IN (SELECT path FROM targets))
        GROUP BY path ORDER BY commits DESC, path LIMIT 8""",
    "commit_history_per_path": f"""
        WITH {CHANGES} SELECT path, {place('path', 'changed_at DESC, commit_id DESC')} AS place, commit_id AS "commit" FROM changes WHERE path IN ('part_0', 'part_1', 'part_2', 'part_3', 'part_4') QUALIFY place <= 5""",
    "knn_cosine_topk": f"WITH {nearest(10)} SELECT query_id, rank, id, round(score, 6) AS score FROM nearest",
    "candidate_merge": f"WITH {MERGED} SELECT query_id, id, type, path, round(lexical, 6) AS lexical, round(path_signal, 6) AS path_signal, round(semantic, 6) AS semantic FROM merged",
    "weighted_rank_explained": f"""
        WITH {MERGED}, {RANKED} SELECT query_id, {place('query_id', f'round(score, 9) DESC, {TYPE_PLACE}, path, id')} AS rank, id, type, round(score, 6) AS score, explanation
        FROM summed WHERE score > 0 QUALIFY rank <= 20""",
    "rrf_fusion": f"""
        WITH {MERGED}, based AS (SELECT *, 0.40 * lexical + 0.10 * path_signal AS base FROM merged),
        b AS (SELECT query_id, id, {place('query_id', f'round(base, 9) DESC, {TYPE_PLACE}, path, id')} AS baseline_rank FROM based WHERE base > 0),
        s AS (SELECT query_id, id, {place('query_id', f'round(semantic, 9) DESC, {TYPE_PLACE}, path, id')} AS semantic_rank FROM based WHERE semantic > 0),
        fused AS (
          SELECT m.query_id AS query_id, m.id AS id, path, baseline_rank, semantic_rank, base, max(semantic) OVER (PARTITION BY m.query_id) AS any_near,
                 (coalesce(1.0::DOUBLE / (60 + baseline_rank), 0) + coalesce(8.0::DOUBLE / (60 + semantic_rank), 0)) / (9.0::DOUBLE / 61) AS both_score
          FROM based m LEFT JOIN b USING (query_id, id) LEFT JOIN s USING (query_id, id)),
        final AS (SELECT *, CASE WHEN any_near > 0 THEN both_score ELSE base END AS score FROM fused)
        SELECT query_id, {place('query_id', 'round(score, 9) DESC, coalesce(baseline_rank, 2147483647), coalesce(semantic_rank, 2147483647), path, id')} AS rank, id, baseline_rank, semantic_rank, round(score, 6) AS score
        FROM final WHERE score > 0 QUALIFY rank <= 20""",
    "federated_topk": f"""
        WITH {hits('source')}, {top(80)},
        scored AS (SELECT query_id, project, l.path AS path, {TYPE} AS type, 0.40 * lexical + 0.10 * path_signal AS score FROM lexical l JOIN files f ON l.path = f.path AND l.project = f.source),
        ranked AS (SELECT *, {place('query_id, project', f'round(score, 9) DESC, {TYPE_PLACE}, path')} AS rank FROM scored WHERE score > 0)
        SELECT query_id, {place('query_id', "round(score, 9) DESC, CAST(regexp_replace(project, '[^0-9]', '', 'g') AS INTEGER), rank")} AS place, project, path, round(score, 6) AS score FROM ranked QUALIFY place <= 20""",
    "line_windows": f"WITH {WINDOWS} SELECT * FROM windows",
    "fragment_merge_islands": f"""
        WITH {WINDOWS}, pieces AS (
          SELECT path, 'HEAD' AS type, start_line, least(end_line, start_line + 1) AS end_line, 0.4::DOUBLE AS score FROM windows
          UNION ALL SELECT path, 'TAIL', CAST(end_line - length(path) % 3 AS INTEGER), end_line, 0.6::DOUBLE FROM windows),
        kept AS (SELECT * FROM pieces WHERE start_line >= 1),
        reach AS (SELECT *, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kept),
        numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR start_line > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY start_line, end_line, type ROWS UNBOUNDED PRECEDING) AS island FROM reach),
        listed AS (SELECT path, island, min(start_line) AS start_line, max(end_line) AS end_line, max(score) AS score, list_distinct(list(type ORDER BY start_line, end_line, type)) AS bag,
                          min(CASE WHEN type = 'HEAD' THEN (start_line, end_line) END) AS head, min(CASE WHEN type = 'TAIL' THEN (start_line, end_line) END) AS tail FROM numbered GROUP BY path, island),
        named AS (SELECT *, CASE WHEN tail IS NULL THEN 'HEAD' WHEN head IS NULL THEN 'TAIL' WHEN head <= tail THEN 'HEAD+TAIL' ELSE 'TAIL+HEAD' END AS reasons FROM listed)
        SELECT path, start_line, end_line, CASE WHEN tail IS NULL THEN 'HEAD' ELSE 'TAIL' END AS type, replace(lower(reasons), '+', ', ') AS symbol, round(score, 6) AS score, reasons FROM named""",
    "hybrid_search": f"""
        WITH {MERGED}, {CHANGES},
        newest AS (SELECT o_orderkey AS commit_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS place FROM orders QUALIFY place < 50),
        recent AS (
          SELECT f.path AS path, max(greatest(0.05, 1 - place / 49.0::DOUBLE)) AS recency FROM newest JOIN changes USING (commit_id) JOIN files f ON f.doc_id = CAST(regexp_extract(changes.path, '[0-9]+') AS BIGINT)
          WHERE commit_id % 10 <> 0 GROUP BY f.path),
        hubs AS (SELECT source, language, min(path) AS dst FROM files GROUP BY source, language),
        one_way AS (SELECT path AS src, dst FROM files JOIN hubs USING (source, language) WHERE path <> dst),
        seeds AS (SELECT query_id, path, max(greatest(lexical, path_signal)) AS score FROM merged GROUP BY query_id, path HAVING score > 0),
        {hops("one_way")},
        spread AS (SELECT query_id, path, max(g) AS graph FROM (SELECT query_id, path, score * 0.65::DOUBLE AS g FROM one UNION ALL SELECT query_id, path, score * 0.35::DOUBLE FROM two) GROUP BY query_id, path),
        total AS (
          SELECT coalesce(m.query_id, s.query_id) AS query_id, 'file:' || coalesce(m.path, s.path) AS id, coalesce(m.path, s.path) AS path,
                 CASE WHEN m.id IS NULL OR (s.path IS NOT NULL AND m.type = 'DOCUMENTATION') THEN 'FILE' ELSE m.type END AS type,
                 coalesce(lexical, 0) AS lexical, coalesce(path_signal, 0) AS path_signal, coalesce(semantic, 0) AS semantic, coalesce(graph, 0) AS graph
          FROM merged m FULL JOIN spread s ON m.query_id = s.query_id AND m.path = s.path),
        dated AS (SELECT t.*, coalesce(recency, 0) AS recency FROM total t LEFT JOIN recent r ON t.path = r.path),
        summed AS (
          SELECT *, 0.40 * lexical + 0.10 * path_signal + 0.10 * graph + 0.05 * recency + 0.15 * semantic AS score,
                 array_to_string(list_filter([CASE WHEN lexical > 0 THEN printf('lexical=%.4f', round(0.40 * lexical, 4)) END, CASE WHEN path_signal > 0 THEN printf('path_signal=%.4f', round(0.10 * path_signal, 4)) END,
                   CASE WHEN graph > 0 THEN printf('graph=%.4f', round(0.10 * graph, 4)) END, CASE WHEN recency > 0 THEN printf('recency=%.4f', round(0.05 * recency, 4)) END,
                   CASE WHEN semantic > 0 THEN printf('semantic=%.4f', round(0.15 * semantic, 4)) END], lambda x: x IS NOT NULL), ' ') AS explanation
          FROM dated)
        SELECT query_id, {place('query_id', f'round(score, 9) DESC, {TYPE_PLACE}, path, id')} AS rank, id, type, round(score, 6) AS score, explanation FROM summed WHERE score > 0 QUALIFY rank <= 20""",
    "greedy_budget_selection": f"WITH RECURSIVE {GREEDY} SELECT project, place, path, tokens FROM taken",
    "greedy_budget_truncating": f"WITH RECURSIVE {TRUNCATING} SELECT project, path, 1 AS start_line, end_line, tokens, cut FROM steps WHERE took",
    "federated_context_merge": f"WITH RECURSIVE {FEDERATED} SELECT project, path, CAST(tokens AS INTEGER) AS tokens, refill, {place('1', 'refill, turn')} AS place FROM taken",
    "context_bundle_summary": f"""
        WITH RECURSIVE {GREEDY}, a AS (SELECT project, sum(tokens) AS available FROM items GROUP BY project), s AS (SELECT project, sum(tokens) AS selected, count(*) AS items FROM taken GROUP BY project)
        SELECT project, CAST(available AS BIGINT) AS available, CAST(coalesce(selected, 0) AS BIGINT) AS selected, CAST(coalesce(s.items, 0) AS BIGINT) AS items,
               round(CASE WHEN available > 0 THEN greatest(0, 1 - coalesce(selected, 0)::DOUBLE / available::DOUBLE) ELSE 0 END, 6) AS reduction
        FROM a LEFT JOIN s USING (project)""",
    "budget_split": f"""
        WITH {FILES}, b AS (SELECT source AS project, least(20000, greatest(60, sum({TOKENS}) // 10)) AS budget FROM files GROUP BY source), i AS (SELECT project, budget, least(budget, least(600, greatest(24, budget // 4))) AS instructions FROM b),
        s AS (SELECT *, least(budget - instructions, least(2000, greatest(64, budget // 5))) AS skills FROM i),
        h AS (SELECT *, CASE WHEN budget >= 500 THEN least(budget - instructions - skills, least(500, greatest(64, budget * 15 // 100))) ELSE 0 END AS history FROM s)
        SELECT project, CAST(budget AS INTEGER) AS budget, CAST(instructions AS INTEGER) AS instructions, CAST(skills AS INTEGER) AS skills, CAST(history AS INTEGER) AS history,
               CAST(budget - instructions - skills - history AS INTEGER) AS tasks FROM h""",
    "fair_allocation": f"WITH {SHARES} SELECT project, place, fair, least(2401, 3 * fair) AS candidates FROM shares",
    "cross_source_antijoin": f"WITH {FILES} SELECT source AS project, path FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "content_dedup_first": rf"""
        WITH {FILES}, printed AS (SELECT path, source AS provider, CAST(doc_id % 100 AS INTEGER) AS priority, trim(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10)) AS body FROM files)
        SELECT path, provider, priority FROM printed QUALIFY row_number() OVER (PARTITION BY body ORDER BY priority DESC, path, provider) = 1""",
    "skill_selection": rf"""
        WITH known AS (SELECT replace(p_name, ' ', '-') AS name, lower(p_type) || ' ' || p_name || ' ' || p_brand AS description, 'part_' || p_partkey AS path, p_size AS priority FROM part),
        one AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY priority DESC, path, description) = 1),
        q AS (SELECT query_id, {folded('query')} AS q FROM (VALUES (1, 'polish a red widget for the small economy'), (2, 'hot-gear'), (3, 'éléctric LARGE bolts')) AS v(query_id, query)),
        w AS (SELECT *, {said('q')} AS qw, ' ' || regexp_replace(q, '[^\p{{L}}\p{{N}}-]+', ' ', 'g') || ' ' AS padded FROM q),
        s AS (SELECT *, {folded("replace(name, '-', ' ')")} AS plain, {folded('name')} AS hyphened, {folded('description')} AS told FROM one),
        t AS (SELECT *, {said('plain')} AS nw, {said('told')} AS dw FROM s),
        m AS (
          SELECT *, contains(padded, ' ' || plain || ' ') OR contains(padded, ' ' || hyphened || ' ') AS exact, {matched('qw', 'nw')} AS by_name, {matched('qw', 'dw')} AS by_text,
                 {matched('qw', 'list_concat(nw, dw)')} AS of_query, length(q) >= 4 AND contains(told, q) AS phrase FROM t, w),
        r AS (
          SELECT *, least(1.0, CASE WHEN exact THEN 0.65 ELSE 0 END + CASE WHEN len(nw) > 0 THEN 0.25 * by_name / len(nw) ELSE 0 END
                 + CASE WHEN len(qw) > 0 THEN 0.55 * of_query / len(qw) ELSE 0 END + CASE WHEN phrase THEN 0.15 ELSE 0 END)::DOUBLE AS score
          FROM m WHERE exact OR by_name > 0 OR by_text > 0)
        SELECT query_id, {place('query_id', 'round(score, 9) DESC, priority DESC, name, path')} AS place, name, path, round(score, 6) AS score FROM r WHERE score >= 0.22 QUALIFY place <= 3""",
    "instruction_scope_priority": rf"""
        WITH {PAGES}, p AS (SELECT page_id, regexp_replace(path, '/+$', '') AS folder FROM below WHERE regexp_replace(path, '/+$', '') <> ''),
        found AS (SELECT DISTINCT regexp_replace(folder, '/[^/]*$', '') || '/' || list_extract(['AGENTS.md', 'CLAUDE.md', 'GEMINI.md', 'agent.md'], CAST(page_id % 4 AS INTEGER) + 1) AS path FROM p),
        targets AS (SELECT folder || '/Main.java' AS target FROM p),
        own AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS scope, lower(regexp_extract(path, '[^/]*$')) AS name, len(string_split(path, '/')) - 1 AS depth FROM found)
        SELECT path, CAST(CASE name WHEN 'agents.md' THEN least(94, 74 + 4 * depth) WHEN 'agent.md' THEN least(94, 64 + 4 * depth) WHEN 'claude.md' THEN least(94, 80 + 3 * depth) ELSE least(90, 70 + 3 * depth) END AS INTEGER) AS priority
        FROM own WHERE EXISTS (SELECT 1 FROM targets WHERE starts_with(target, scope || '/'))""",
    "glob_filter": rf"WITH {PAGES} SELECT page_id, regexp_matches(path, '^(.*/)?[^/]*\.html$') AS html, regexp_matches(path, '^en/[^/][^/]$') AS short, regexp_matches(path, '^[^/]*/1[^/]*$') AS ones FROM below",
    "reference_closure": """
        WITH RECURSIVE refs AS (
          SELECT n_name AS src, 'R' || n_regionkey AS dst FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region
          UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0),
        reach(root, node, depth) AS (
          SELECT src, dst, 1 FROM refs WHERE src IN ('NATION_1', 'NATION_5') UNION ALL SELECT root, dst, depth + 1 FROM reach JOIN refs ON node = src WHERE depth < 5)
        SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM reach WHERE node <> root GROUP BY root, node""",
    "provider_union_distinct": f"WITH {PROVIDED} SELECT provider FROM supplied WHERE provider <> 'builtin' UNION SELECT provider FROM bought WHERE provider <> 'builtin'",
    "snapshot_equality": """
        WITH changed AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 3 THEN -1 ELSE n_regionkey END AS n_regionkey FROM nation), old AS (SELECT n_nationkey, n_name, n_regionkey FROM nation)
        SELECT 0::BIGINT AS only_in_first, 0::BIGINT AS only_in_second, true AS equal, 'same' AS pair
        UNION ALL SELECT a, b, a + b = 0, 'changed' FROM (SELECT (SELECT count(*) FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM changed)) AS a, (SELECT count(*) FROM (SELECT * FROM changed EXCEPT ALL SELECT * FROM old)) AS b)""",
    "provider_purge": f"""
        WITH {PROVIDED}, step AS (
          SELECT 'purged' AS step, provider, target FROM (SELECT * FROM supplied UNION ALL SELECT * FROM bought) WHERE provider = 'builtin'
          UNION ALL SELECT 'replaced', provider, target FROM supplied WHERE provider <> 'provider_1'
          UNION ALL SELECT 'replaced', provider, target + 1 FROM supplied WHERE provider = 'provider_1' AND (target + 1) % 2 = 0 AND target < 20)
        SELECT step, provider, count(*) AS n, CAST(sum(target) AS BIGINT) AS targets FROM step GROUP BY step, provider""",
    "json_import_filter": """
        WITH told AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'error')
        SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 'CLASS' WHEN 'click' THEN 'METHOD' WHEN 'purchase' THEN 'ENUM' ELSE 'RECORD' END AS kind, k
        FROM told WHERE k IN (SELECT p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY event_type, k ORDER BY event_id) = 1""",
    "readiness_counts": """
        SELECT status, count(o_orderkey) AS projects FROM (SELECT unnest(['NOT_INDEXED', 'INDEXING', 'READY', 'FAILED']) AS status)
        LEFT JOIN orders ON status = CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'INDEXING' ELSE 'NOT_INDEXED' END GROUP BY status""",
    "precision_recall_at_k": f"WITH {JUDGED} SELECT query_id, project, round(precision, 6) AS precision, round(recall, 6) AS recall FROM rated",
    "hit_mrr_at_k": f"WITH {JUDGED} SELECT query_id, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS mrr FROM rated GROUP BY query_id",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "embedding_text_profile": rf"""
        WITH {FILES}, flat AS (SELECT *, substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 320) AS e FROM files),
        whole AS (SELECT f.*, f.path || chr(10) || language || chr(10) || coalesce(replace(p_name, ' ', '_'), '') || chr(10) || substr(content, 1, 12000) AS t FROM flat f LEFT JOIN part ON p_partkey = doc_id)
        SELECT path, sha256(CASE WHEN e = '' THEN path ELSE e END) AS excerpt_hash, sha256(t) AS text_hash, CAST(length(t) AS INTEGER) AS size, CAST(doc_id // 32 AS INTEGER) AS batch FROM whole""",
    "bundle_totals": f"""
        WITH RECURSIVE {TRUNCATING} SELECT project, CASE WHEN path LIKE '%.md' THEN 'DOCUMENTATION' WHEN path LIKE 'src/test/%' THEN 'TEST' ELSE 'FILE' END AS type,
               CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS items, count(*) FILTER (cut) AS truncated FROM steps WHERE took GROUP BY ALL""",
    "federated_shares": f"""
        WITH RECURSIVE {FEDERATED}, got AS (SELECT project, sum(tokens) AS tokens, count(*) AS items FROM taken GROUP BY project)
        SELECT project, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(items, 0) AS BIGINT) AS items, items IS NULL AS starved FROM shares LEFT JOIN got USING (project)""",
    "readiness_health": """
        WITH o AS (SELECT o_orderpriority, o_orderkey % 1000 = 7 AS failed FROM orders)
        SELECT count(*) AS projects, count(*) FILTER (failed) > 0 AS degraded, count(*) > 0 AND count(*) FILTER (failed) = 0 AS all_ready, 'all' AS scope FROM o
        UNION ALL SELECT count(*), false, count(*) > 0, 'ready' FROM o WHERE NOT failed
        UNION ALL SELECT count(*), count(*) FILTER (failed) > 0, count(*) > 0 AND count(*) FILTER (failed) = 0, 'none' FROM o WHERE o_orderpriority IS NULL""",
    "symbol_window_slice": rf"""
        WITH {SYMBOLS}, held AS (SELECT 'part_' || doc_id AS path, string_split_regex(text, '\r?\n') AS l FROM documents),
        cut AS (SELECT path, qualified AS symbol, greatest(1, start_line - 2) AS start_line, CAST(least(len(l), end_line + 2) AS INTEGER) AS end_line, l FROM symbols JOIN held USING (path))
        SELECT path, symbol, start_line, end_line, sha256(array_to_string(l[start_line:end_line], chr(10))) AS content_hash FROM cut WHERE start_line <= end_line""",
}
