"""The results of the queries stated in SQL for DuckDB."""

from __future__ import annotations

TERM = r"'[\p{L}\p{N}]+'"


def bm25_fields(**fields: str) -> str:
    """The best of several fields' scores, each field an expression over ``documents``; ids and their order as text."""
    parts = [
        rf"""
d_{f} AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower({e}), {TERM}) AS t FROM documents WHERE ({e}) IS NOT NULL),
st_{f} AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d_{f}),
tf_{f} AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM d_{f}) GROUP BY ALL),
df_{f} AS (SELECT term, count(*) AS df FROM tf_{f} GROUP BY term),
bm_{f} AS (SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
  FROM wanted JOIN tf_{f} USING (term) JOIN df_{f} USING (term) CROSS JOIN st_{f} GROUP BY query_id, chunk_id)"""
        for f, e in fields.items()
    ]
    every = " UNION ALL ".join(f"SELECT * FROM bm_{f}" for f in fields)
    return rf"""wanted AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), {TERM})) AS term FROM benchmark) GROUP BY ALL),{",".join(parts)},
best AS (SELECT query_id, CAST(chunk_id AS VARCHAR) AS chunk_id, round(max(score), 6) AS score FROM ({every}) GROUP BY ALL),
bmr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM best)"""


BM25 = rf"""
wanted AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), {TERM})) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), {TERM}) AS t FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM wanted JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY query_id, chunk_id),
bmr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bm)"""


def vector(queries: str, chunks: str) -> str:
    return f"""
vq AS ({queries}), vc AS ({chunks}),
vs AS (SELECT query_id, chunk_id, round(list_cosine_similarity(CAST(vq.e AS DOUBLE[]), CAST(vc.e AS DOUBLE[])), 6) AS score FROM vq CROSS JOIN vc),
vr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM vs WHERE score >= 0)"""


EVERY_HUNDREDTH = "SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0"
ALL_VECTORS = "SELECT vec_id AS chunk_id, embedding AS e FROM embeddings"
PAIRED = vector("SELECT item_id AS query_id, embedding AS e FROM benchmark JOIN embeddings ON vec_id = item_id", "SELECT doc_id AS chunk_id, embedding AS e FROM documents JOIN embeddings ON vec_id = doc_id")

ROUTES = f"""{BM25}, {PAIRED},
routes AS (SELECT query_id, 'bm25' AS route, rank AS pos, chunk_id FROM bmr WHERE rank <= 20 UNION ALL SELECT query_id, 'vector', rank, chunk_id FROM vr WHERE rank <= 20)"""


def fused(source: str, top: int = 8) -> str:
    return f"""
firsts AS (SELECT query_id, route, chunk_id, min(pos) AS pos FROM {source} GROUP BY ALL),
sums AS (SELECT query_id, chunk_id, round(sum(1.0e0 / (60 + pos)), 15) AS score FROM firsts GROUP BY ALL),
fus AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sums QUALIFY rank <= {top})"""


EVAL = f"""{ROUTES}, {fused('routes')},
runs AS (SELECT route, query_id, pos, chunk_id FROM routes UNION ALL SELECT 'rrf', query_id, rank, chunk_id FROM fus),
qrels AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
base AS (SELECT route, query_id FROM (SELECT DISTINCT query_id FROM qrels) CROSS JOIN (SELECT DISTINCT route FROM runs)),
rel AS (SELECT query_id, count(DISTINCT chunk_id) AS relevant FROM qrels GROUP BY 1),
ret AS (SELECT route, query_id, count(*) AS returned FROM runs WHERE pos <= 5 GROUP BY ALL),
hit AS (SELECT route, query_id, chunk_id, min(pos) AS pos FROM runs SEMI JOIN qrels USING (query_id, chunk_id) WHERE pos <= 5 GROUP BY ALL),
agg AS (SELECT route, query_id, count(*) AS hits, min(pos) AS best, sum(ln(2) / ln(pos + 1)) AS dcg FROM hit GROUP BY ALL),
j AS (SELECT route, query_id, relevant, coalesce(returned, 0) AS returned, coalesce(hits, 0) AS hits, best, coalesce(dcg, 0) AS dcg,
    list_sum(list_transform(range(1, CAST(least(relevant, coalesce(returned, 0)) AS BIGINT) + 1), lambda i: ln(2) / ln(i + 1))) AS idcg
  FROM base JOIN rel USING (query_id) LEFT JOIN ret USING (route, query_id) LEFT JOIN agg USING (route, query_id)),
scores AS (SELECT route, query_id, hits / relevant AS recall, hits / 5 AS precision, coalesce(1 / best, 0) AS mrr, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg, hits, relevant, returned FROM j)"""

LINES = """
lines AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS seg_idx, unnest(l) AS content FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
seg0 AS (SELECT * FROM lines WHERE regexp_matches(content, '\\S')),
seg AS (SELECT *, CASE WHEN seg_idx % 5 = 0 THEN 'S' || (seg_idx // 5 % 3) END AS title, CASE WHEN seg_idx % 7 = 6 THEN 'table' ELSE 'text' END AS kind, seg_idx // 4 AS page,
  row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM seg0)""".replace("\\\\", "\\")


def packed(overlap: int, lines: str = LINES) -> str:
    """The greedy fold as recursion over a document's segments; each step emits what it closes."""
    return f"""{lines},
fold AS (
  SELECT doc_id, 0::BIGINT AS i, '' AS buf, 0::BIGINT AS ids, 0::BIGINT AS pages, NULL::VARCHAR AS kind, 0::BIGINT AS idx,
    []::STRUCT(idx BIGINT, content VARCHAR, kind VARCHAR, page BIGINT, title VARCHAR, n BIGINT)[] AS closed FROM (SELECT DISTINCT doc_id FROM seg)
  UNION ALL
  SELECT f.doc_id, s.i,
    CASE WHEN s.kind = 'table' THEN '' WHEN over THEN right(f.buf, {overlap}) || s.content ELSE f.buf || s.content END,
    CASE WHEN s.kind = 'table' THEN 0 ELSE f.ids + 1 END, CASE WHEN s.kind = 'table' THEN 0 ELSE f.pages + s.page END,
    CASE WHEN s.kind = 'table' THEN NULL WHEN f.buf = '' OR (over AND {overlap} = 0) THEN s.kind ELSE f.kind END,
    f.idx + CASE WHEN f.buf <> '' AND (s.kind = 'table' OR over) THEN 1 ELSE 0 END + CASE WHEN s.kind = 'table' THEN 1 ELSE 0 END,
    CASE WHEN f.buf <> '' AND (s.kind = 'table' OR over) THEN [{{'idx': f.idx, 'content': f.buf, 'kind': coalesce(f.kind, 'text'), 'page': f.pages // greatest(f.ids, 1), 'title': s.title, 'n': f.ids}}] ELSE [] END
    || CASE WHEN s.kind = 'table' THEN [{{'idx': f.idx + CASE WHEN f.buf <> '' THEN 1 ELSE 0 END, 'content': s.content, 'kind': s.kind, 'page': s.page, 'title': s.title, 'n': 1}}] ELSE [] END
  FROM fold f JOIN (SELECT * FROM seg) s ON s.doc_id = f.doc_id AND s.i = f.i + 1, LATERAL (SELECT length(f.buf) + length(s.content) > 512 AND f.buf <> '' AS over)),
ends AS (SELECT f.doc_id, f.idx, f.buf AS content, coalesce(f.kind, 'text') AS kind, f.pages // greatest(f.ids, 1) AS page, s.title, f.ids AS n FROM fold f JOIN seg s ON s.doc_id = f.doc_id AND s.i = f.i AND s.i = s.n WHERE f.buf <> ''),
parts AS (SELECT doc_id, unnest(closed) AS c FROM fold),
chunks AS (SELECT doc_id, c.idx AS idx, c.content AS content, c.kind AS kind, c.page AS page, c.title AS title, c.n AS n FROM parts UNION ALL SELECT * FROM ends)"""


CHUNK = """SELECT doc_id, CAST(idx AS INTEGER) AS chunk_index, sha256(concat_ws('|', doc_id, 'fixed', CAST(idx AS VARCHAR), content)) AS chunk_id, content, kind AS content_type,
  CAST(page AS INTEGER) AS page_num, title AS section_title, CAST(n AS INTEGER) AS n_segments FROM chunks"""

HITS = f"""{BM25},
h AS (SELECT query_id, chunk_id, score, rank, text AS content, source AS doc_name, chunk_id % 7 AS page FROM bmr JOIN documents ON doc_id = chunk_id WHERE rank <= 8),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS i FROM h)"""


def tokens(text: str) -> str:
    bare = rf"regexp_replace({text}, '[\x{{4E00}}-\x{{9FFF}}]', '', 'g')"
    return rf"CAST(floor((length({text}) - length({bare})) / 1.5e0) + len(regexp_extract_all({bare}, '\p{{L}}+')) + floor(length({text}) / 10) AS BIGINT)"


def truncated(order: str) -> str:
    return f"""WITH {HITS},
c AS (SELECT query_id, string_agg('[' || i || '] ' || content || chr(10), '' ORDER BY i) AS context FROM o GROUP BY query_id),
l AS (SELECT query_id, unnest(range(len(x))) AS k, unnest(x) AS line FROM (SELECT query_id, string_split(regexp_replace(context, '\\n+$', ''), chr(10)) AS x FROM c)),
t AS (SELECT *, {tokens('line')} AS tok FROM l WHERE regexp_matches(line, '\\S')),
r AS (SELECT *, sum(tok) OVER (PARTITION BY query_id ORDER BY k {order}) AS used FROM t),
kept AS (SELECT query_id, string_agg(line, chr(10) ORDER BY k) AS context FROM r WHERE used <= 800 GROUP BY query_id)
SELECT l.query_id, coalesce(kept.context, l.line) AS context FROM l LEFT JOIN kept USING (query_id) WHERE l.k = 0""".replace("\\\\", "\\")


BLANK = "chr(9) || chr(10) || chr(13) || ' '"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " "
HEADERS = r"(?mi)^(\d+\s*[-–]\s*\d+|第\s*\d+\s*页|Page\s+\d+\s+of\s+\d+|©|Copyright|版权所有).*$"


def lines_of(source: str) -> str:
    """Lines of ``source(doc_id, t)`` without trailing empty ones."""
    return rf"ll AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS line FROM (SELECT doc_id, string_split(regexp_replace(t, '\n+$', ''), chr(10)) AS x FROM {source}))"


UNIQUE = f"u AS (SELECT *, trim(line, {BLANK}) AS tr, min(k) OVER (PARTITION BY doc_id, trim(line, {BLANK})) AS first FROM ll), dd AS (SELECT doc_id, coalesce(string_agg(line || chr(10), '' ORDER BY k), '') AS t FROM u WHERE tr = '' OR k = first GROUP BY doc_id)"
NORMAL = rf"trim(regexp_replace(regexp_replace(regexp_replace(translate(t, '{WIDE}', '{NARROW}'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), {BLANK})"


def overlap(x: str, y: str) -> str:
    """Share of the shorter text whose windows of a hundredth of it, 8 characters at least, are in the longer."""
    return f"""(CASE WHEN least(length({x}), length({y})) = 0 THEN 0.0e0 ELSE
  list_sum(list_transform(range(0, least(length({x}), length({y})) - least(least(length({x}), length({y})), greatest(8, least(length({x}), length({y})) // 100)) + 1, least(least(length({x}), length({y})), greatest(8, least(length({x}), length({y})) // 100))),
    lambda p: CASE WHEN contains(CASE WHEN length({x}) <= length({y}) THEN {y} ELSE {x} END, substr(CASE WHEN length({x}) <= length({y}) THEN {x} ELSE {y} END, p + 1, least(least(length({x}), length({y})), greatest(8, least(length({x}), length({y})) // 100)))) THEN 1 ELSE 0 END))
  / (least(length({x}), length({y})) // least(least(length({x}), length({y})), greatest(8, least(length({x}), length({y})) // 100))) END)"""


GREEDY = f"""WITH RECURSIVE {HITS},
f AS (SELECT query_id, 0::BIGINT AS i, []::VARCHAR[] AS kept, NULL::BIGINT AS chunk_id, NULL::DOUBLE AS score, false AS good FROM (SELECT DISTINCT query_id FROM o)
  UNION ALL SELECT f.query_id, o.i, CASE WHEN g THEN list_append(f.kept, coalesce(o.content, '')) ELSE f.kept END, o.chunk_id, o.score, g
  FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1, LATERAL (SELECT len(list_filter(f.kept, lambda k: {overlap("coalesce(o.content, '')", "k")} > 0.9e0)) = 0 AS g))
SELECT query_id, chunk_id, score FROM f WHERE good"""


def folded(size: int) -> str:
    """Greedy packing with line feeds between segments, over each group of ``s(doc_id, section, j, cnt, content, kind)``; ``made`` has the parts in order of ``(j, k)``."""
    return f"""
f AS (
  SELECT doc_id, section, 0::BIGINT AS j, ''::VARCHAR AS buf, 0::BIGINT AS n, NULL::VARCHAR AS kind, []::STRUCT(content VARCHAR, kind VARCHAR)[] AS closed FROM (SELECT DISTINCT doc_id, section FROM s)
  UNION ALL
  SELECT f.doc_id, f.section, s.j,
    CASE WHEN s.kind = 'table' THEN '' WHEN over OR f.buf = '' THEN s.content ELSE f.buf || chr(10) || s.content END,
    CASE WHEN s.kind = 'table' THEN 0 WHEN over THEN length(s.content) ELSE f.n + length(s.content) END,
    CASE WHEN s.kind = 'table' THEN CASE WHEN f.buf = '' THEN f.kind END WHEN over OR f.buf = '' THEN s.kind ELSE f.kind END,
    CASE WHEN f.buf <> '' AND (s.kind = 'table' OR over) THEN [{{'content': f.buf, 'kind': coalesce(f.kind, 'text')}}] ELSE [] END || CASE WHEN s.kind = 'table' THEN [{{'content': s.content, 'kind': s.kind}}] ELSE [] END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.section = f.section AND s.j = f.j + 1, LATERAL (SELECT f.n + length(s.content) > {size} AND f.buf <> '' AS over)),
made AS (
  SELECT doc_id, section, j, unnest(range(len(closed))) AS k, unnest(closed).content AS content, unnest(closed).kind AS kind FROM f
  UNION ALL SELECT f.doc_id, f.section, f.j + 1, 0, f.buf, coalesce(f.kind, 'text') FROM f JOIN s ON s.doc_id = f.doc_id AND s.section = f.section AND s.j = f.j AND s.j = s.cnt WHERE f.buf <> '')"""


HIERARCHICAL = f"""WITH RECURSIVE {LINES},
sec AS (SELECT *, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '_no_section_') AS section FROM seg),
grp AS (SELECT doc_id, section, min(seg_idx) AS first, sum(length(content)) AS total, string_agg(content, chr(10) ORDER BY seg_idx) AS whole, arg_max(kind, seg_idx) FILTER (WHERE kind <> 'text') AS special FROM sec GROUP BY ALL),
s AS (SELECT doc_id, section, content, kind, row_number() OVER (PARTITION BY doc_id, section ORDER BY seg_idx) AS j, count(*) OVER (PARTITION BY doc_id, section) AS cnt FROM sec SEMI JOIN (SELECT doc_id, section FROM grp WHERE total > 512) USING (doc_id, section)),{folded(512)},
every AS (SELECT doc_id, section, j, k, content, kind FROM made UNION ALL SELECT doc_id, section, 0, 0, whole, coalesce(special, 'text') FROM grp WHERE total <= 512)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first, j, k) - 1 AS INTEGER) AS chunk_index, content, kind AS content_type, nullif(section, '_no_section_') AS section_title FROM every JOIN grp USING (doc_id, section)"""

SEMANTIC = f"""WITH RECURSIVE {LINES},
s AS (SELECT doc_id, '' AS section, content, kind, i AS j, n AS cnt FROM seg),{folded(256)},
g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j, k) AS i, content, replace(content, chr(10), ' ') AS t FROM made),
v AS (SELECT *, [CAST(len(regexp_extract_all(t, 'e')) AS DOUBLE), len(regexp_extract_all(t, 'n')), len(regexp_extract_all(t, 'ch')), len(regexp_extract_all(t, 'qu'))] AS e FROM g),
w AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM v),
c AS (SELECT *, CASE WHEN b IS NULL OR list_sum(e) = 0 OR list_sum(b) = 0 THEN 1.0e0 ELSE list_dot_product(b, e) / (sqrt(list_dot_product(b, b)) * sqrt(list_dot_product(e, e))) END AS sim FROM w),
l AS (SELECT *, sum(CASE WHEN sim < 0.95e0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM c)
SELECT doc_id, CAST(island AS INTEGER) AS chunk_index, string_agg(content, chr(10) ORDER BY i) AS content FROM l GROUP BY doc_id, island"""

ANSWERS = "a AS (SELECT conv_id, turn, text || ' [' || turn || '] x [' || (turn + 2) || ']' AS answer, turn % 4 + 1 AS sources FROM conversations), b AS (SELECT *, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)) AS cited FROM a), c AS (SELECT *, list_filter(cited, lambda x: x < 1 OR x > sources) AS bad FROM b)".replace("\\\\", "\\")

TITLE = "split_part(text, chr(10), 1)"

MARKS = "old AS (SELECT doc_id, md5(CASE WHEN doc_id % 9 = 1 THEN 'old' ELSE text END) AS md5 FROM documents WHERE doc_id % 3 <> 0)"

ORACLE_SQL: dict[str, str] = {
    "bm25_topk": f"WITH {BM25} SELECT query_id, chunk_id, score, rank, 'bm25' AS source FROM bmr WHERE rank <= 10",
    "bm25_indexed": f"WITH {bm25_fields(content='text')} SELECT query_id, chunk_id, score, rank, 'bm25' AS source FROM bmr WHERE rank <= 10",
    "bm25_indexed_fields": f"WITH {bm25_fields(content='text', title=TITLE)} SELECT query_id, chunk_id, score, rank, 'bm25' AS source FROM bmr WHERE rank <= 10",
    "bm25_fields": f"WITH {bm25_fields(content='text', title=TITLE)} SELECT query_id, chunk_id, score, rank, 'bm25' AS source FROM bmr WHERE rank <= 10",
    "contained_items": "SELECT d.doc_id AS text_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "vector_topk": f"WITH {vector(EVERY_HUNDREDTH, ALL_VECTORS)} SELECT query_id, chunk_id, score, rank, 'vector' AS source FROM vr WHERE rank <= 10",
    "vector_indexed": f"WITH {vector(EVERY_HUNDREDTH, ALL_VECTORS)} SELECT query_id, chunk_id, score, rank, 'vector' AS source FROM vr WHERE rank <= 10",
    "vector_indexed_recall": f"WITH {vector(EVERY_HUNDREDTH, ALL_VECTORS)} SELECT count(*) AS neighbours, true AS enough FROM vr WHERE rank <= 10",
    "vector_topk_filtered": f"WITH {vector(EVERY_HUNDREDTH, ALL_VECTORS + ' WHERE label = 3')} SELECT query_id, chunk_id, score, rank, 'vector' AS source FROM vr WHERE rank <= 5",
    "hybrid_search": f"WITH {ROUTES}, {fused('routes')} SELECT query_id, chunk_id, score, rank, 'fusion' AS source FROM fus",
    "rrf_dup_positions": f"WITH {ROUTES}, twice AS (SELECT query_id, route, 2 * pos - 1 AS pos, chunk_id FROM routes), {fused('twice')} SELECT query_id, chunk_id, score, rank, 'fusion' AS source FROM fus",
    "eval_per_query": f"WITH {EVAL} SELECT route, query_id, round(recall, 9) AS recall, round(precision, 9) AS precision, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg, hits, relevant, returned FROM scores",
    "ablation_by_route": f"""WITH {EVAL}, m AS (SELECT route, count(*) AS total, CAST(sum(hits) AS BIGINT) AS hits, avg(recall) AS recall, avg(precision) AS precision, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM scores GROUP BY route),
u AS (UNPIVOT m ON recall, precision, mrr, ndcg INTO NAME metric VALUE v)
SELECT route, metric, round(v, 9) AS value, total, CAST(floor(round(v * total, 9) + 0.5e0) AS BIGINT) AS correct, hits FROM u""",
    "clean_headers": f"SELECT doc_id, regexp_replace('Page 3 of 9' || chr(10) || 'Copyright notice' || chr(10) || '12 - 34' || chr(10) || text, '{HEADERS}', '', 'g') AS content FROM documents",
    "clean_toc": rf"WITH s AS (SELECT doc_id, 'Before' || chr(10) || text AS t FROM documents), {lines_of('s')} SELECT doc_id, string_agg(line || chr(10), '' ORDER BY k) AS content FROM ll GROUP BY doc_id",
    "clean_dedup_lines": f"WITH s AS (SELECT doc_id, text AS t FROM documents), {lines_of('s')}, {UNIQUE} SELECT doc_id, t AS content FROM dd",
    "clean_normalize": f"WITH s AS (SELECT doc_id, '　ＡＢＣ１２３' || chr(7) || '  x' || chr(9) || chr(9) || 'y' || chr(10) || chr(10) || chr(10) || chr(10) || text AS t FROM documents) SELECT doc_id, {NORMAL} AS content FROM s",
    "clean_all": f"WITH s AS (SELECT doc_id, chr(10) || chr(10) || chr(10) || text AS t FROM documents), {lines_of('s')}, {UNIQUE} SELECT doc_id, {NORMAL} AS content FROM dd",
    "detect_type": r"""WITH n AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^.+\.([^.]*)$', 1)) AS ext FROM pages)
SELECT page_id, CASE WHEN ext IN ('html', 'htm') THEN 'HTML' WHEN ext = 'pdf' THEN 'PDF' WHEN ext IN ('md', 'markdown') THEN 'MARKDOWN' WHEN ext = 'txt' THEN 'PLAIN_TEXT' ELSE 'UNKNOWN' END AS file_type FROM n""",
    "content_md5": "SELECT doc_id, coalesce(md5(text), '') AS md5 FROM documents",
    "segments_lines": f"WITH {LINES} SELECT doc_id, seg_idx, content, 'text' AS content_type FROM seg0",
    "page_table_segments": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text FROM documents)
SELECT doc_id, 0 AS seg_idx, trim('intro ' || lang || ' ' || text, chr(9) || chr(10) || chr(13) || ' ') AS content, 'text' AS content_type, 1 AS page_num, NULL AS section_title, 0 AS heading_level, NULL AS table_markdown FROM d
UNION ALL SELECT doc_id, 1, '## Facts' || chr(10) || 'id  lang  source' || chr(10) || doc_id || '  ' || lang || '  ' || source, 'table', 1, 'Facts', 2,
  '| ## Facts | ' || chr(10) || '| --- |' || chr(10) || '| id | lang | source | ' || chr(10) || '| ' || doc_id || ' | ' || lang || ' | ' || source || ' | ' || chr(10) FROM d""",
    "html_h1_segments": r"SELECT CAST(page_id AS VARCHAR) AS doc_id, trim(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS content FROM pages WHERE regexp_matches(html, '(?is)<h1[^>]*>.*?</h1>')".replace('\\"', '"'),
    "chunk_fixed": f"WITH RECURSIVE {packed(0)} {CHUNK}",
    "chunk_fixed_overlap": f"WITH RECURSIVE {packed(128)} {CHUNK}",
    "chunk_hierarchical": HIERARCHICAL,
    "semantic_chunks": SEMANTIC,
    "near_dup_greedy": GREEDY,
    "chunk_validate": f"WITH RECURSIVE {packed(0)} SELECT doc_id, CAST(idx AS INTEGER) AS chunk_index, content FROM chunks WHERE regexp_matches(content, '\\S') AND length(content) >= 200",
    "adaptive_overlap": f"""WITH RECURSIVE {packed(0)}, o AS (SELECT doc_id, idx, CASE WHEN kind = 'table' OR length(content) < 100 THEN 0 WHEN length(content) > 1000 THEN 128 ELSE 128 END AS own FROM chunks)
SELECT doc_id, CAST(idx AS INTEGER) AS chunk_index, CASE WHEN lead(own) OVER (PARTITION BY doc_id ORDER BY idx) = 0 THEN 0 ELSE own END AS overlap FROM o""",
    "semantic_cut_points": """WITH s AS (SELECT label, vec_id, list_cosine_similarity(CAST(lag(embedding) OVER w AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS c FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
t AS (SELECT *, coalesce(c, 1.0) AS sim FROM s)
SELECT label, vec_id, round(sim, 6) AS sim, CAST(sum(CASE WHEN sim < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS island FROM t""",
    "token_estimate": f"WITH s AS (SELECT doc_id, 'abc中文def ' || text AS t FROM documents) SELECT doc_id, {tokens('t')} AS tokens FROM s",
    "threshold_filter": f"WITH {HITS} SELECT query_id, chunk_id, score FROM h WHERE score >= 20",
    "token_budget": f"WITH {HITS}, b AS (SELECT *, sum({tokens('content')}) OVER (PARTITION BY query_id ORDER BY i) AS used FROM o) SELECT query_id, chunk_id, score FROM b WHERE used <= 600",
    "rerank_fallback": f"""WITH {HITS}, s AS (SELECT query_id, chunk_id, rank, query_id % 2 = 1 AS fallback, CASE WHEN query_id % 2 = 1 THEN score ELSE round(1 / (1 + length(content) / 1000.0e0), 6) END AS score FROM h)
SELECT query_id, chunk_id, score, fallback FROM s WHERE fallback OR score >= 0.45 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) <= 4""",
    "context_build": f"WITH {HITS} SELECT query_id, string_agg('[' || i || '] ' || content || chr(10), '' ORDER BY i) AS context FROM o GROUP BY query_id",
    "context_meta": f"WITH {HITS} SELECT query_id, string_agg('[' || i || '] (来源: ' || coalesce(doc_name, '未知文档') || ', 页码: ' || page || ')' || chr(10) || content || chr(10), '' ORDER BY i) AS context FROM o GROUP BY query_id",
    "context_citations": f"WITH {HITS} SELECT query_id, CAST(i AS INTEGER) AS id, chunk_id, '[' || i || '] (来源: ' || coalesce(doc_name, '未知文档') || ', 页码: ' || page || ')' || chr(10) || content AS citation FROM o",
    "context_truncate_head": truncated("ASC"),
    "context_truncate_tail": truncated("DESC"),
    "citations_check": f"WITH {ANSWERS} SELECT conv_id, turn, array_to_string(cited, ',') AS cited, array_to_string(bad, ',') AS invalid FROM c",
    "answer_gate": f"WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN len(bad) > 0 THEN '无法从提供的资料中找到相关信息，请补充更多资料后重试。' ELSE answer END AS final_answer, CAST(len(bad) > 0 OR turn % 5 = 0 AS INTEGER) AS flag FROM c",
    "verdict_parse": "SELECT conv_id, turn, turn % 2 = 0 AS bad, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS details, least(1.0e0, CAST('0.' || turn AS DOUBLE)) AS confidence FROM conversations",
    "change_detect": f"WITH {MARKS} SELECT d.doc_id, coalesce(old.md5, '') = '' OR old.md5 <> md5(d.text) AS changed FROM documents d LEFT JOIN old USING (doc_id)",
    "upsert_result": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "delete_anti": "SELECT doc_id, source FROM documents WHERE doc_id % 4 <> 1",
    "ttl_expire": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'",
    "ttl_by_day": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'",
    "sync_latest_action": """SELECT CAST(user_id AS VARCHAR) AS "docId", arg_max(CASE event_type WHEN 'purchase' THEN 'DELETE' WHEN 'click' THEN 'UPDATE' ELSE 'ADD' END, event_id) AS action, max(event_id) AS last FROM events GROUP BY user_id""",
}
