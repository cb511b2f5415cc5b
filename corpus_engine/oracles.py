"""DuckDB SQL for the registered queries, composed of shared common table expressions."""

from __future__ import annotations

from corpus_engine.operators.lexical import STOP_WORDS

ORACLES: dict[str, str] = {}

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

NOTES = r"""
src AS (SELECT doc_id, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source, coalesce(text, '') AS body FROM documents),
notes AS (SELECT doc_id,
  CASE source WHEN 'src1' THEN '.drafts' WHEN 'src2' THEN 'Reports' WHEN 'src3' THEN 'Workflows' ELSE source END || '/' || lang || '/doc-' || doc_id || '.md' AS path,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE E'---\ntype: note\ntitle: ''Doc ' || doc_id || E'''\n'
    || CASE WHEN doc_id % 5 = 2 THEN E'description: >-\n  ' || lang || E' text\n  from ' || source || E'\n' ELSE 'description: ' || lang || ' text from ' || source || E'\n' END
    || CASE WHEN doc_id % 5 = 1 THEN E'tags:\n  - ' || lang || E'\n  - "' || source || E'"\n' ELSE 'tags: [' || lang || ', ' || source || E']\n' END
    || E'timestamp: 2024-01-01T00:00:00Z\n---\n' END
  || array_to_string(list_transform(string_split(body, chr(10)), lambda x, i: CASE WHEN (i - 1) % 11 = 10 THEN E'```\n# ' || x || E'\n```' WHEN (i - 1) % 14 = 0 THEN '## ' || x WHEN (i - 1) % 7 = 0 THEN '### ' || x WHEN (i - 1) % 3 = 0 THEN '- ' || x ELSE x || chr(10) END), chr(10)) || chr(10) AS text
  FROM src)"""

FRONT = r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*\r?\n?"

PAGES = "pages_as AS (SELECT page_id, 'Files/page-' || page_id || '.pdf' AS path, html FROM pages)"

FILES = f"{NOTES}, {PAGES}, files AS (SELECT path, strlen(text)::BIGINT AS size FROM notes UNION ALL SELECT path, strlen(html)::BIGINT FROM pages_as)"

_steps = "regexp_replace(html, '(?is)<(script|style|head|nav)\\b.*?</(script|style|head|nav)>|<!--.*?-->', '', 'g')"
for _p, _to in ((r"(?i)<h1\b[^>]*>", r"E'\n\n# '"), (r"(?i)<li\b[^>]*>", r"E'\n- '"), (r"(?i)<(p|br|div)\b[^>]*>|</(h1|p|ul|div)>", r"E'\n\n'"), (r"<[^>]*>", "''"), (r"[ \t]*\n[ \t]*", r"E'\n'"), (r"\n{3,}", r"E'\n\n'")):
    _steps = f"regexp_replace({_steps}, '{_p}', {_to}, 'g')"
for _e, _c in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
    _steps = f"replace({_steps}, '{_e}', {_c})"
STRIP = r"regexp_replace({}, '\A\s+|\s+\z', '', 'g')"
EXTRACTED = f"{PAGES}, marked AS (SELECT page_id, path, {STRIP.format(_steps)} AS markdown FROM pages_as), extracted AS (SELECT *, CASE WHEN length(markdown) < 50 THEN 'needs_ocr' ELSE 'extracted' END AS status FROM marked)"

HEADED = rf"""{NOTES},
cut AS (SELECT path, string_split(text, chr(10)) AS l, length(f) - length(replace(f, chr(10), '')) AS front FROM (SELECT path, text, regexp_extract(text, '{FRONT}') AS f FROM notes)),
rows AS (SELECT path, front, len(l) AS total, unnest(l) AS x, generate_subscripts(l, 1) AS line FROM cut),
fenced AS (SELECT *, regexp_matches(x, '^\s{{0,3}}(```|~~~)') AS mark, sum(CASE WHEN regexp_matches(x, '^\s{{0,3}}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS marks FROM rows),
heads AS (SELECT path, line, total, length(regexp_extract(x, '^(#{{1,6}})\s+(.*?)(?:\s+#+)?\s*$', 1)) AS depth, {STRIP.format("regexp_extract(x, '^(#{1,6})\\s+(.*?)(?:\\s+#+)?\\s*$', 2)").replace('{1,6}', '{1,6}')} AS text
  FROM fenced WHERE line > front AND NOT mark AND marks % 2 = 0 AND regexp_matches(x, '^(#{{1,6}})\s+(.*?)(?:\s+#+)?\s*$')),
parents AS (SELECT h.path, h.line, h.depth, h.text, h.total,
  (SELECT p.text FROM heads p WHERE p.path = h.path AND p.line < h.line AND p.depth < h.depth ORDER BY p.line DESC LIMIT 1) AS parent FROM heads h),
trails AS (SELECT *, CASE WHEN parent IS NULL THEN text ELSE parent || '::' || text END AS trail FROM parents)"""

LIFTED = "chunks AS (SELECT 'd' || lpad(doc_id::VARCHAR, 9, '0') AS chunk, coalesce(source, 'none') || '/' || coalesce(lang, 'xx') AS path, coalesce(text, '') AS text FROM documents)"
ASKED = "asked AS (SELECT item_id AS query, text AS q FROM benchmark)"
POSTED = f"{LIFTED}, posted AS (SELECT chunk, term, count(*) AS tf FROM (SELECT chunk, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks) WHERE term NOT IN ({STOPS}) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY ALL)"
TERMS = f"{POSTED}, {ASKED}, terms AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM asked) WHERE term NOT IN ({STOPS}) GROUP BY ALL)"
RAW = "(ln(n - df + 5e-1) - ln(df + 5e-1))"
STATS = f"stats0 AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT coalesce(sum(tf), 0) FROM posted)::DOUBLE / greatest((SELECT count(*) FROM chunks), 1) AS avgdl), stats AS (SELECT n, avgdl, (SELECT avg{RAW} FROM dfs, stats0) AS mean_idf FROM stats0)"
BM25 = f"{TERMS}, {STATS}, idfs AS (SELECT term, df, CASE WHEN {RAW} < 0 THEN 25e-2 * mean_idf ELSE {RAW} END AS idf FROM dfs, stats), lens AS (SELECT chunk, sum(tf) AS dl FROM posted GROUP BY ALL), bm25 AS (SELECT query, p.chunk, sum(qtf * idf * tf * 25e-1 / (tf + 15e-1 * (1e0 - 75e-2 + 75e-2 * dl / avgdl))) AS score FROM posted p JOIN terms USING (term) JOIN idfs USING (term) JOIN lens USING (chunk), stats GROUP BY ALL)"
SPARSE = f"{BM25}, sparse AS (SELECT * FROM (SELECT query, chunk, s AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, chunk) AS rank FROM (SELECT query, chunk, round(score, 6) AS s FROM bm25)) WHERE rank <= 50 AND score > 0)"


def hashed(name: str, table: str, key: str, text: str) -> str:
    word = "('0x' || substr(h, {}, 8))::BIGINT % 256"
    return f"""{name}_w AS (SELECT {key} AS k, 1e0 + ln(count(*)) AS w, md5(token) AS h FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS token FROM {table}) GROUP BY {key}, token),
{name}_s AS (SELECT k, dim, sum(v) AS v FROM (SELECT k, {word.format(1)} AS dim, w AS v FROM {name}_w UNION ALL SELECT k, {word.format(9)}, -w FROM {name}_w) GROUP BY ALL),
{name} AS (SELECT k, dim, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY k)), 1e-12) AS value FROM {name}_s)"""


DENSE = f"{hashed('dv', 'chunks', 'chunk', 'text')}, {hashed('qv', 'asked', 'query', 'q')}, dense AS (SELECT * FROM (SELECT query, chunk, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM (SELECT qv.k AS query, dv.k AS chunk, round(sum(dv.value * qv.value), 6) AS score FROM dv JOIN qv USING (dim) GROUP BY ALL)) WHERE rank <= 50)"
FUSED = f"{SPARSE}, {DENSE}, fused0 AS (SELECT query, chunk, d.rank AS dr, s.rank AS sr, (coalesce(1e0 / (60 + d.rank), 0e0) + coalesce(5e-1 / (60 + s.rank), 0e0)) / (15e-1 / 61) AS score FROM dense d FULL JOIN sparse s USING (query, chunk)), fused AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, coalesce(dr, 1073741824), sr) AS pos FROM fused0)"
PINS = "rare AS (SELECT query FROM terms JOIN dfs USING (term) GROUP BY query HAVING min(df) BETWEEN 1 AND 5), sizes AS (SELECT query, count(*) AS n FROM terms GROUP BY ALL), full_hits AS (SELECT s.query, s.chunk, {path} AS path, s.rank FROM sparse s JOIN rare USING (query) JOIN sizes USING (query) JOIN terms t USING (query) JOIN posted p ON p.chunk = s.chunk AND p.term = t.term {join} GROUP BY ALL HAVING count(*) = max(sizes.n)), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, path ORDER BY rank) AS f FROM full_hits) WHERE f = 1), pins AS (SELECT query, chunk, pin FROM (SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY rank) AS pin FROM firsts) WHERE pin <= 5)"


def searched(k: int) -> str:
    cap = max(1, -(-k // 3))
    return f"""{FUSED}, {PINS.format(path='c.path', join='JOIN chunks c ON c.chunk = s.chunk')},
pinned AS (SELECT f.query, f.chunk, f.score, f.pos, c.path, CASE WHEN p.pin <= {k} THEN p.pin END AS pin FROM fused f JOIN chunks c USING (chunk) LEFT JOIN pins p USING (query, chunk)),
occ AS (SELECT *, count(pin) OVER (PARTITION BY query, path) + row_number() OVER (PARTITION BY query, path, pin IS NOT NULL ORDER BY pos) AS occurrence FROM pinned),
tiers AS (SELECT *, CASE WHEN pin IS NOT NULL THEN 0 WHEN occurrence <= {cap} THEN 1 ELSE 2 END AS tier, 8e-1 * score - (1e0 - 8e-1) * CASE WHEN occurrence > 1 THEN 1e0 ELSE 0e0 END AS marginal FROM occ),
found AS (SELECT query, chunk, path, round(score, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, coalesce(pin, 0), CASE WHEN tier = 1 THEN -round(marginal, 12) ELSE 0e0 END, pos) AS place FROM tiers) WHERE place <= {k})"""


HELD = "held AS (SELECT a.query, c.chunk FROM (SELECT t.query, p.chunk FROM terms t JOIN posted p USING (term) JOIN (SELECT query, count(*) AS n FROM terms GROUP BY ALL) z USING (query) GROUP BY t.query, p.chunk HAVING count(*) = max(z.n)) h JOIN asked a USING (query) JOIN chunks c USING (chunk) WHERE contains(c.text, a.q))"
PAGE_NOTES = r"""pnotes AS (SELECT 'web/page-' || page_id || '.md' AS path, regexp_replace(html, '<a href="([^"\s)]*)"[^>]*>([^<]*)</a>', '[\2](\1)', 'g') AS text FROM pages),
plinks AS (SELECT path, unnest(regexp_extract_all(text, '\]\(([^)\s]+)\)', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '\]\(([^)\s]+)\)', 1), 1) - 1 AS ord FROM pnotes),
tlinks AS (SELECT path, ord, raw, regexp_replace(url_decode(split_part(raw, '#', 1)), '^/+', '') AS target FROM plinks)"""


def rule(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes} {select}" if ctes else select


rule("S1_index_walk", FILES, r"SELECT path, size FROM files WHERE regexp_matches(lower(path), '\.(md|pdf)$') AND NOT regexp_matches(path, '(^|/)\.') AND path <> 'index.md' AND NOT list_has_any(string_split(path, '/'), ['Workflows', 'Reports', '.obsidian'])")
rule("S2_link_walk", FILES, r"SELECT path FROM files WHERE path LIKE '%.md' AND NOT regexp_matches(path, '(^|/)\.')")
rule("S4_polymorphic_read", f"{NOTES}, {EXTRACTED}", "SELECT path, 'note' AS kind, md5(text) AS text_md5 FROM notes UNION ALL SELECT path, 'document', md5(markdown) FROM extracted WHERE markdown <> ''")
rule("S5_directory_listing", FILES, r"""SELECT CASE WHEN len(p) = 1 THEN '' ELSE array_to_string(p[:-2], '/') END AS folder, p[-1] AS name, array_to_string(p, '/') AS path, CASE WHEN len(p) = total THEN 'file' ELSE 'dir' END AS type, max(CASE WHEN len(p) = total THEN size END) AS size
FROM (SELECT size, len(string_split(path, '/')) AS total, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: string_split(path, '/')[:n])) AS p FROM files WHERE NOT regexp_matches(path, '(^|/)\.')) GROUP BY ALL""")
rule("S6_extracted_documents", EXTRACTED, "SELECT path, status, md5(markdown) AS markdown_md5 FROM extracted")
rule("S8_page_assembly", "", rf"WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {STRIP.format('text')} AS x FROM conversations), j AS (SELECT conv_id, bool_or(regexp_matches(x, '(?m)^#{{1,6}}\s+\S')) AS headed, string_agg(x, E'\n\n' ORDER BY n) AS plain, string_agg('## Page ' || n || E'\n\n' || x, E'\n\n' ORDER BY n) AS numbered FROM t WHERE x <> '' GROUP BY conv_id) SELECT conv_id, md5(coalesce(CASE WHEN headed THEN plain ELSE numbered END, '')) AS doc_md5 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN j USING (conv_id)")
rule("F1_F7_path_predicates", FILES, r"SELECT path, regexp_matches(path, '(^|/)\.') AS hidden, regexp_matches(path, '(^|/)\.') OR path = 'index.md' AS protected, regexp_matches(path, '(^|/)\.') OR path = 'index.md' OR list_has_any(string_split(path, '/'), ['Workflows', 'Reports', '.obsidian']) AS excluded, lower(path) LIKE 'workflows/%' OR lower(path) LIKE 'reports/%' AS generated, lower(path) LIKE '%.pdf' AS document, path LIKE 'src4/%' AS in_scope FROM files")
rule("F6_safe_paths", "", "SELECT doc_id, CASE lang WHEN 'en' THEN 'doc.md' WHEN 'fr' THEN NULL ELSE source || '/' || lang || '/doc.md' END AS path FROM documents")
rule("F8_frontmatter_query", NOTES, "SELECT path FROM notes WHERE doc_id % 5 <> 0 AND path LIKE 'src4/fr/%'")
rule("F9_note_json", NOTES, rf"SELECT path, length(regexp_replace(regexp_replace(text, '{FRONT}', ''), '\A[\r\n]+', '')) AS body_chars, CASE WHEN doc_id % 5 <> 0 THEN 'Doc ' || doc_id END AS title, CASE WHEN doc_id % 5 <> 0 THEN lang || '|' || source END AS tags FROM notes JOIN src USING (doc_id)")
rule("F13_searchable", EXTRACTED, "SELECT path, markdown <> '' AS searchable FROM extracted")
rule("M2_normal_bodies", "", r"SELECT doc_id, md5(CASE WHEN text IS NULL OR text = '' THEN chr(10) ELSE regexp_replace(text, '\n+\z', '') || chr(10) END) AS body_md5 FROM documents")
rule("M3_front_matter_lines", NOTES, rf"SELECT path, length(regexp_extract(text, '{FRONT}')) - length(replace(regexp_extract(text, '{FRONT}'), chr(10), '')) AS front_lines, md5(regexp_replace(regexp_replace(text, '{FRONT}', ''), '\A[\r\n]+', '')) AS rest_md5 FROM notes")
rule("M4_front_matter_bounds", NOTES, "SELECT path, CASE WHEN doc_id % 5 <> 0 THEN 1 END::BIGINT AS first, (CASE WHEN doc_id % 5 <> 0 THEN 6 + CASE WHEN doc_id % 5 = 2 THEN 2 ELSE 0 END + CASE WHEN doc_id % 5 = 1 THEN 2 ELSE 0 END END)::BIGINT AS last FROM notes")
rule("M6_headings", HEADED, "SELECT path, depth, text, line FROM heads")
ENDS = f"{HEADED}, ends AS (SELECT h.path, h.line, h.text, coalesce((SELECT min(o.line) - 1 FROM heads o WHERE o.path = h.path AND o.line > h.line AND o.depth <= h.depth), h.total - @) AS last FROM heads h)"
rule("M7_sections_read", ENDS.replace("@", "0"), r"SELECT path, md5(regexp_replace(array_to_string(l[e.line:e.last], chr(10)), '\s+\z', '') || chr(10)) AS section_md5 FROM cut LEFT JOIN (SELECT path, line, last FROM ends JOIN (SELECT a.path, min(b.line) AS line FROM (SELECT path, list(text ORDER BY line)[2] AS t FROM heads GROUP BY path) a JOIN heads b ON a.path = b.path AND lower(b.text) = lower(a.t) GROUP BY a.path) USING (path, line)) e USING (path)")
rule("M8_M9_outline", HEADED, "SELECT path, md5(coalesce(string_agg(trail, chr(10) ORDER BY line), '')) AS outline_md5, count(trail) AS headings FROM notes LEFT JOIN trails USING (path) GROUP BY path")
rule("M12_section_bounds", ENDS.replace("@", "1"), "SELECT path, line, last FROM ends")
rule("M13_links", PAGE_NOTES, "SELECT path, ord, raw, target FROM tlinks")
rule("M14_titles", EXTRACTED, rf"SELECT path, coalesce({STRIP.format(chr(10) + '  regexp_replace(list_filter(string_split(' + chr(39) + chr(39) + ' || markdown, chr(10)), lambda x: regexp_matches(x, ' + chr(39) + '^#' + chr(92) + 's+' + chr(92) + 'S' + chr(39) + '))[1], ' + chr(39) + '^#' + chr(92) + 's+' + chr(39) + ', ' + chr(39) + chr(39) + ')')}, 'page-' || page_id) AS title FROM extracted")
rule("M15_folded_values", NOTES, "SELECT path, CASE WHEN doc_id % 5 <> 0 THEN lang || ' text from ' || source END AS description FROM notes JOIN src USING (doc_id)")
rule("M16_first_sentences", NOTES, rf"""SELECT path, CASE WHEN length(c) > 240 THEN regexp_replace(c[:240], ' [^ ]*\z', '') || '...' ELSE c END AS sentence FROM (SELECT path, {STRIP.format("regexp_replace(list_filter(list_transform(string_split(regexp_replace(text, '" + FRONT + "', ''), chr(10)), lambda y: regexp_replace(y, '" + chr(92) + "A" + chr(92) + "s+|" + chr(92) + "s+" + chr(92) + "z', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|>|-|" + chr(92) + "*|" + chr(92) + "||```|---)'))[1], '([.!?])" + chr(92) + "s.*$', '" + chr(92) + "1')")} AS c FROM notes)""")
rule("M17_callouts", "", "SELECT 'c-' || conv_id || '-' || turn AS path, n AS line, CASE WHEN n = 2 THEN CASE WHEN role = 'user' THEN 'NOTE' ELSE 'tip' END END AS type, CASE WHEN n = 2 THEN 'Turn' ELSE 'bare' END AS title, CASE WHEN n = 2 THEN 'body of ' || role ELSE '' END AS body FROM conversations, (VALUES (2::BIGINT), (5::BIGINT)) v(n)")
rule("FM1_frontmatter_values", NOTES, "SELECT path, CASE WHEN doc_id % 5 <> 0 THEN lang || '|' || source END AS tags, CASE WHEN doc_id % 5 <> 0 THEN 'Doc ' || doc_id END AS title FROM notes JOIN src USING (doc_id)")
rule("C1_token_estimates", NOTES, "SELECT path, floor(length(text) / 36e-1)::BIGINT AS tokens FROM notes")
CRUMBS = rf"{HEADED}, nexts AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, total) AS last FROM trails), spans AS (SELECT path, replace(trail, '::', ' > ') AS breadcrumb, line, {STRIP.format('array_to_string(cut.l[line:last], chr(10))')} AS body FROM nexts JOIN cut USING (path) UNION ALL SELECT path, '', front + 1 + length(b) - length(replace(b, chr(10), '')), {STRIP.format('raw')} FROM (SELECT path, front, raw, regexp_extract(raw, '\A\s*') AS b FROM (SELECT path, front, array_to_string(l[front + 1:coalesce((SELECT min(line) FROM heads h WHERE h.path = cut.path), len(l) + 1) - 1], chr(10)) AS raw FROM cut)))"
rule("C2_sections", CRUMBS, "SELECT path, breadcrumb, line, md5(body) AS body_md5 FROM spans WHERE body <> ''")
rule("C4_bare_links", NOTES, r"""SELECT path, n - 1 AS ord, CASE WHEN path LIKE '%/fr/%' THEN true WHEN path LIKE '%/de/%' THEN false ELSE regexp_replace(regexp_replace(regexp_replace(item, '(?m)^\s*([-*+]|\d+[.)])\s+', '', 'g'), '\[\[[^\]]*\]\]|!?\[[^\]]*\]\([^)]*\)', '', 'g'), '[ \t\r\n\-–—:;,.|]', '', 'g') = '' END AS bare
FROM (SELECT path, unnest(regexp_extract_all(text, '(?m)^- .*$')) AS item, generate_subscripts(regexp_extract_all(text, '(?m)^- .*$'), 1) AS n FROM notes)""")
rule("C7_paragraphs", EXTRACTED, rf"SELECT path, n - 1 AS ord, md5(p) AS paragraph_md5 FROM (SELECT path, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (SELECT path, list_filter(regexp_split_to_array(markdown, '\n{{2,}}'), lambda p: regexp_replace(p, '\s', '', 'g') <> '') AS ps FROM extracted))")
rule("C10_embed_texts", CRUMBS, "SELECT path, line, md5(CASE WHEN doc_id % 5 = 0 THEN 'search_document:' ELSE 'search_document: Doc ' || doc_id || ' - ' || lang || ' text from ' || source END || CASE WHEN breadcrumb <> '' THEN chr(10) || breadcrumb ELSE '' END || chr(10) || chr(10) || s.body) AS embed_md5 FROM spans s JOIN notes USING (path) JOIN src USING (doc_id) WHERE s.body <> ''")
rule("L1_postings", POSTED, "SELECT chunk, term, tf FROM posted")
rule("L3_term_set_sizes", POSTED, "SELECT chunk, count(term) AS terms FROM chunks LEFT JOIN posted USING (chunk) GROUP BY ALL")
rule("L4_document_frequency", POSTED, "SELECT term, df FROM dfs")
rule("A7_corpus_stats", f"{POSTED}, {STATS}", "SELECT n, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf FROM stats")
rule("L5_bm25_scores", BM25, "SELECT query, chunk, round(score, 6) AS score FROM bm25")
rule("L6_rarest_term", TERMS, "SELECT a.query, coalesce(min(df), 0) AS rarest FROM asked a LEFT JOIN terms t USING (query) LEFT JOIN dfs USING (term) GROUP BY ALL")
rule("L7_containment", TERMS, "SELECT t.query, p.chunk FROM terms t JOIN posted p USING (term) JOIN (SELECT query, count(*) AS n FROM terms GROUP BY ALL) z USING (query) GROUP BY t.query, p.chunk HAVING count(*) = max(z.n)")
rule("V1_normalised_vectors", "", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 THEN 1e0 ELSE 0e0 END AS unit FROM embeddings")
rule("V4_hashed_vectors", f"{LIFTED}, {hashed('dv', 'chunks', 'chunk', 'text')}", "SELECT k AS chunk, dim::INTEGER AS dim, round(value, 6) + 0e0 AS value FROM dv")
rule("V5_dense_topk", "", "SELECT query, vec_id, score, rank FROM (SELECT a.vec_id AS query, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 4) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 4) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 50")
rule("V6_embed_misses", "", "SELECT lang, count(*) AS chunks, count(DISTINCT coalesce(text, '')) AS texts FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE lang = 'en') GROUP BY lang")
rule("R1_F12_lexical_candidates", SPARSE, "SELECT query, chunk, score, rank FROM sparse")
rule("R2_rrf", FUSED, "SELECT query, chunk, round(score, 6) AS score, pos FROM fused")
rule("R4_lookup_hits", f"{SPARSE}, {PINS.format(path='s.chunk', join='')}", "SELECT query, chunk, pin FROM pins")
rule("R7_hybrid_search", searched(6), "SELECT query, chunk, path, score, place FROM found")
rule("R6_diversified_20", searched(20), "SELECT query, chunk, path, score, place FROM found")
rule("K5_rendered_results", searched(6), r"SELECT query, string_agg('### ' || path || ' > ' || chunk || E'\nscore ' || printf('%.4f', score) || E', line 1\n\ntext of ' || chunk, E'\n\n' ORDER BY place) AS rendered FROM found GROUP BY ALL")
JUDGED = f"{searched(6)}, {HELD}, res AS (SELECT query, chunk, place, path LIKE '%/de' AS never FROM found), evals AS (SELECT query, bool_or(h.chunk IS NOT NULL) OR query IN (SELECT query FROM held) AS scored, min(CASE WHEN h.chunk IS NOT NULL THEN place END) AS rank, count(r.chunk) AS returned, CASE WHEN count(r.chunk) > 0 THEN 1 ELSE 0 END::BIGINT AS max_per_path, count(CASE WHEN never AND h.chunk IS NULL THEN 1 END) AS forbidden FROM res r LEFT JOIN held h USING (query, chunk) GROUP BY query)"
rule("E1_E4_eval_rows", JUDGED, "SELECT query, scored, rank, returned, max_per_path, forbidden FROM evals")
rule("E2_recall_mrr", JUDGED, "SELECT count(CASE WHEN scored THEN 1 END) AS scored_queries, count(CASE WHEN scored AND rank IS NOT NULL THEN 1 END) AS hits, round(count(CASE WHEN scored AND rank IS NOT NULL THEN 1 END)::DOUBLE / count(CASE WHEN scored THEN 1 END), 4) AS recall, round(sum(CASE WHEN scored THEN coalesce(1e0 / rank, 0e0) END) / count(CASE WHEN scored THEN 1 END), 4) AS mrr, max(max_per_path) AS worst_max_per_path FROM evals")
rule("E3_compare_baseline", f"{JUDGED}, lexr AS (SELECT s.query, min(CASE WHEN h.chunk IS NOT NULL THEN s.rank END) AS before FROM sparse s LEFT JOIN held h USING (query, chunk) WHERE s.rank <= 6 GROUP BY s.query)", "SELECT query, before, rank AS after, CASE WHEN coalesce(rank, 1073741824) > coalesce(before, 1073741824) THEN 'regression' WHEN coalesce(rank, 1073741824) < coalesce(before, 1073741824) THEN 'improvement' ELSE 'same' END AS verdict FROM evals FULL JOIN lexr USING (query)")
rule("J5_cache_retention", "", "SELECT source, count(*) AS kept FROM documents WHERE source <> 'src5' AND coalesce(text, '') IN (SELECT coalesce(text, '') FROM documents WHERE source = 'src5') GROUP BY source")
rule("J10_ancestor_folders", FILES, "SELECT folder, count(*) AS files FROM (SELECT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[:n], '/'))) AS folder FROM files) GROUP BY ALL")
rule("J8_prefix_join", FILES, "SELECT path FROM files WHERE path LIKE '%/es/%'")
rule("J11_reconcile", "", "WITH a AS (SELECT user_id::VARCHAR AS path, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL), b AS (SELECT user_id::VARCHAR AS path, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY ALL) SELECT path, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'extra' ELSE 'changed' END AS what FROM a FULL JOIN b USING (path) WHERE a.n IS DISTINCT FROM b.n")
rule("A8_duplicate_texts", "", "SELECT md5(coalesce(text, '')) AS text_md5, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
rule("A9_index_summary", LIFTED, "SELECT count(*) AS chunks, count(DISTINCT path) AS paths, round(count(*) * 768 * 4 / 1e6, 3) AS matrix_mb FROM chunks")
rule("A11_digests", "", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
rule("U2_U3_set_operations", "", "WITH c AS (SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS buys, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY ALL) SELECT user_id, 'both' AS what FROM c WHERE clicks > 0 AND buys > 0 UNION ALL SELECT user_id, 'more clicks than errors' FROM c WHERE clicks > errors")
rule("W9_series_gaps", "", "SELECT 'series' AS \"check\", 'user-' || user_id || '/' || day AS path, 'gap of ' || (day - before) || ' days' AS detail, 'error' AS severity FROM (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events)) WHERE day - before > 1")
rule("K6_json_rows", "", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
LOG = "log AS (SELECT 'user-' || user_id || '.md' AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'modify' END AS op, ts FROM events)"
rule("ST1_watched_changes", LOG, "SELECT path, op, count(*) AS n FROM log GROUP BY ALL")
rule("ST2_debounced", LOG, "SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n FROM (SELECT path, ts, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT path, ts, lag(ts) OVER (PARTITION BY path ORDER BY ts) AS before FROM log)) GROUP BY path, island")
rule("ST4_incremental_state", LOG, "SELECT path, n AS size FROM (SELECT path, count(*) AS n FROM log GROUP BY ALL) JOIN (SELECT path, op FROM (SELECT path, op, row_number() OVER (PARTITION BY path ORDER BY ts DESC, op DESC) AS r FROM log) WHERE r = 1) USING (path) WHERE op <> 'delete'")
rule("ST10_cache_reuse", "", "WITH a AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents WHERE source <> 'src0'), b AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents WHERE source <> 'src1') SELECT count(CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN 1 END) AS reused, count(CASE WHEN b.t IS NULL THEN 1 END) AS fresh, count(CASE WHEN a.t IS NULL THEN 1 END) AS dropped FROM a FULL JOIN b ON a.t = b.t")
rule("X2_appended", NOTES, r"SELECT path, md5(regexp_replace(text, '\n+\z', '') || E'\n\nadded\n') AS text_md5 FROM notes")
rule("X5_set_body", NOTES, rf"SELECT path, md5(regexp_extract(text, '{FRONT}') || E'new body\n') AS text_md5 FROM notes")
rule("X6_deleted", NOTES, "SELECT path FROM notes WHERE path NOT LIKE 'Reports/%'")
rule("X9_uploads", "", "SELECT 'Files/page-' || page_id || '.pdf' AS path, CASE WHEN page_id % 10 = 7 THEN 'filed' WHEN page_id % 2 = 0 THEN 'unchanged' ELSE 'replaced' END AS status FROM pages")
rule("CK1_broken_links", PAGE_NOTES, "SELECT path, count(*) AS broken FROM tlinks WHERE NOT regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') AND target <> '' AND length(target) % 2 = 1 GROUP BY ALL")
rule("CK3_front_matter", NOTES, "SELECT 'front_matter' AS \"check\", path, 'no front matter' AS detail, 'error' AS severity FROM notes WHERE doc_id % 5 = 0")
rule("CK4_hygiene", "", r"""WITH t AS (SELECT CASE WHEN lang = 'es' THEN 'DOC' ELSE 'doc' END || (doc_id // 2) AS path, CASE WHEN lang = 'fr' THEN chr(65279) ELSE '' END || CASE WHEN lang = 'de' THEN E'a\r\nb\n' ELSE '' END || coalesce(text, '') AS x FROM documents)
SELECT * FROM (SELECT 'mixed line ends' AS detail, 'error' AS severity, count(*) AS n FROM t WHERE contains(x, E'\r\n') AND regexp_matches(x, '(^|[^\r])\n') UNION ALL SELECT 'byte-order mark', 'warning', count(*) FROM t WHERE starts_with(x, chr(65279)) UNION ALL SELECT 'no final newline', 'warning', count(*) FROM t WHERE x <> '' AND NOT ends_with(x, chr(10)) UNION ALL SELECT 'paths differ in case only', 'error', count(*) FROM (SELECT lower(path) FROM t GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""")
rule("CK7_duplicate_headings", HEADED, r"SELECT path, min(trail) AS detail FROM trails GROUP BY path, trim(regexp_replace(regexp_replace(lower(trail), '\*\*|__|[`*_]', '', 'g'), '\s+', ' ', 'g')) HAVING count(*) > 1")
rule("CK8_documents", f"{NOTES}, {EXTRACTED}, linked AS (SELECT DISTINCT 'Files/page-' || doc_id || '.pdf' AS path FROM notes WHERE path LIKE '%en/%')", "SELECT path, 'orphan' AS detail, 'error' AS severity FROM extracted WHERE path NOT IN (SELECT path FROM linked) UNION ALL SELECT path, status, 'error' FROM extracted WHERE status <> 'extracted'")
rule("G1_catalogue_entries", f"{HEADED}, firsts AS (SELECT path, title FROM (SELECT path, NULL AS title FROM notes))", rf"""SELECT n.path, regexp_replace(n.path, '/[^/]*$', '') AS folder, CASE WHEN n.doc_id % 5 <> 0 THEN 'Doc ' || n.doc_id ELSE coalesce(t.title, 'doc-' || n.doc_id) END AS title, CASE WHEN n.doc_id % 5 <> 0 THEN lang || ' text from ' || source ELSE s.sentence END AS description
FROM notes n JOIN src USING (doc_id) JOIN ({ORACLES['M16_first_sentences'].split('FROM src)', 1)[1]}) s ON s.path = n.path LEFT JOIN (SELECT path, {STRIP.format("regexp_replace(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#" + chr(92) + "s+" + chr(92) + "S'))[1], '^#" + chr(92) + "s+', '')")} AS title FROM notes) t ON t.path = n.path
WHERE NOT regexp_matches(n.path, '(^|/)\.') AND NOT lower(n.path) LIKE 'workflows/%' AND NOT lower(n.path) LIKE 'reports/%'""")
rule("R3_lookup_gate", f"{SPARSE}, {PINS.format(path='c.path', join='JOIN chunks c ON c.chunk = s.chunk')}", "SELECT a.query, coalesce(min(df), 0) AS rarest, a.query IN (SELECT query FROM pins) AS is_lookup FROM asked a LEFT JOIN terms t USING (query) LEFT JOIN dfs USING (term) GROUP BY a.query")
rule("J6_upserted_sizes", FILES, "SELECT path, CASE WHEN path LIKE 'src4/%' THEN 0 ELSE size END AS size FROM files WHERE path NOT LIKE 'src6/%'")
rule("T4_folder_order", f"{FILES}, folders AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[:n], '/'))) AS folder FROM files)", "SELECT folder, replace(lower(folder), '/', chr(1)) AS order_key FROM folders")
rule("A4_median_tokens", NOTES, "SELECT regexp_replace(path, '/[^/]*$', '') AS folder, median(floor(length(text) / 36e-1)::BIGINT) AS median_tokens, count(CASE WHEN floor(length(text) / 36e-1) >= 400 THEN 1 END) AS long_notes FROM notes GROUP BY 1")
rule("G2_catalogue_lines", ORACLES["G1_catalogue_entries"][5:].rsplit("SELECT n.path", 1)[0] + ", entries AS (SELECT n.path" + ORACLES["G1_catalogue_entries"].rsplit("SELECT n.path", 1)[1] + "), heads2 AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(folder, '/')) + 1), lambda n: array_to_string(string_split(folder, '/')[:n], '/'))) AS folder FROM entries)",
     r"""SELECT row_number() OVER (ORDER BY CASE WHEN folder = '' THEN [] ELSE string_split(lower(folder), '/') END, folder, kind, place, title_key, path) AS line_no, folder, kind, line FROM (
SELECT folder, 1 AS kind, CASE WHEN lower(regexp_extract(path, '([^/]*)\.[^./]*$', 1)) = lower(string_split(folder, '/')[-1]) AND folder <> '' THEN 0 ELSE 1 END AS place, lower(title) AS title_key, path, '- [' || title || '](' || path || ')' || CASE WHEN coalesce(description, '') <> '' THEN ' - ' || description ELSE '' END AS line FROM entries
UNION ALL SELECT folder, 0, 0, '', '', repeat('#', least(len(string_split(folder, '/')) + 1, 6)) || ' ' || string_split(folder, '/')[-1] FROM heads2
UNION ALL SELECT '', 2, 0, lower(x), x, '> [!NOTE] `' || x || '/` is not listed note by note' FROM (VALUES ('Reports'), ('Workflows')) v(x))""")
ENTRIES = f"e AS ({ORACLES['G1_catalogue_entries']})"
rule("CK2_catalogue_drift", f"{ENTRIES}, {NOTES}", "SELECT path, CASE WHEN path LIKE 'src4/%' THEN 'missing' ELSE 'changed' END AS detail FROM e WHERE path LIKE 'src4/%' OR path LIKE 'src5/%' UNION ALL SELECT path, 'extra' FROM notes WHERE path LIKE 'Reports/%'")
rule("CK5_series", "s AS (SELECT 'Reports/' || o_orderpriority AS series, o_orderdate::DATE AS day, bool_and(o_orderstatus = 'F') AS hollow FROM orders GROUP BY ALL), g AS (SELECT *, day - lag(day) OVER (PARTITION BY series ORDER BY day) AS gap FROM s)", "SELECT series || '/' || day || '.md' AS path, 'empty' AS detail FROM g WHERE hollow UNION ALL SELECT series || '/' || day || '.md', 'gap of ' || gap || ' days' FROM g WHERE gap > 1")
rule("CK6_expiries", "o AS (SELECT 'o/' || o_orderkey || '.md' AS path, o_orderpriority AS p, o_orderdate::DATE AS day, o_orderdate::DATE - DATE '1998-01-01' AS days FROM orders WHERE o_orderpriority <> '2-HIGH')", "SELECT path, CASE WHEN p = '5-LOW' THEN 'malformed: soon' WHEN days < 0 THEN 'lapsed: ' || day ELSE 'soon: ' || day END AS detail, CASE WHEN p = '5-LOW' OR days < 0 THEN 'error' ELSE 'warning' END AS severity FROM o WHERE p = '5-LOW' OR days <= 30")
rule("CK9_callouts", "c AS (SELECT 'c-' || conv_id || '-' || turn AS path, role, turn FROM conversations)", "SELECT path, 'line 2: ' || CASE WHEN turn % 2 = 0 THEN 'unknown type' ELSE 'no title' END AS detail, CASE WHEN turn % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM c WHERE role <> 'user' UNION ALL SELECT path, 'line 5: untyped', 'error' FROM c UNION ALL SELECT path, 'line 7: wrong case', 'warning' FROM c")
rule("T2_listing_order", f"l AS ({ORACLES['S5_directory_listing']})", "SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY type <> 'dir', lower(name), name) AS place FROM l")
rule("S3_note_texts", "", "SELECT doc_id, md5(coalesce(text, '') || chr(65533)) AS text_md5 FROM documents")
rule("M11_resolved_targets", f"{HEADED}, k AS (SELECT path, line, parent, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key, text FROM trails), last AS (SELECT path, arg_max(key, line) AS key, arg_max(text, line) AS text FROM k GROUP BY path)", "SELECT l.path, CASE WHEN count(*) = 1 THEN 'line ' || min(k.line) WHEN count(CASE WHEN k.parent IS NULL THEN 1 END) = 1 THEN 'line ' || min(CASE WHEN k.parent IS NULL THEN k.line END) ELSE 'ambiguous' END AS found FROM last l JOIN k USING (path, key) WHERE regexp_matches(l.text, '^[a-zA-Z .,]*[a-zA-Z][a-zA-Z .,]*$') GROUP BY l.path")
rule("FM4_scalars", "", "SELECT n_nationkey, n - 1 AS at, CASE n WHEN 1 THEN n_name WHEN 2 THEN '\"' || n_nationkey || '\"' WHEN 3 THEN '\"true\"' WHEN 4 THEN '\"a: ' || n_name || '\"' ELSE '2024-01-02T03:04:05Z' END AS written FROM nation, (SELECT unnest(range(1, 6)) AS n)")
NORMAL = r"regexp_replace({}, '\n*$', E'\n')"
rule("FM7_deleted_fields", NOTES, rf"SELECT path, md5(CASE WHEN doc_id % 5 = 0 THEN text ELSE {NORMAL.format(r"regexp_replace(text, '\ntags:[^\n]*(\n  - [^\n]*)*', '')")} END) AS text_md5, CASE WHEN doc_id % 5 = 0 THEN 'the note has no front matter' END AS error FROM notes")
rule("FM6_inserted_fields", f"{NOTES}, bare AS (SELECT doc_id, path, regexp_replace(text, '\\ndescription:[^\\n]*(\\n  [a-z][^\\n]*)*', '') AS text FROM notes)", rf"SELECT path, md5(CASE WHEN doc_id % 5 = 0 THEN text ELSE {NORMAL.format(r"regexp_replace(text, '\ntags:', E'\ndescription: " + '"a: b"' + r"\ntags:')")} END) AS text_md5, CASE WHEN doc_id % 5 = 0 THEN 'the note has no front matter' END AS error FROM bare")
rule("X4_set_fields", NOTES, rf"SELECT path, md5(CASE WHEN doc_id % 5 = 0 THEN text ELSE {NORMAL.format(r"regexp_replace(text, '(?s)\A(---\n.*?\n)---\n', E'\\1status: " + '"on"' + r"\n---\n')")} END) AS text_md5, CASE WHEN doc_id % 5 = 0 THEN 'the note has no front matter' END AS error FROM notes")
