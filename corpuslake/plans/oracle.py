"""The queries in DuckDB SQL, over the same derived relations."""

from __future__ import annotations

import re

#: The content hash of a text.
_HASH = r"md5(regexp_replace(lower(trim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
#: Views in terms of the driver's tables; the same as ``fixtures``.
VIEWS = {
    "v_files": """
      SELECT doc_id, '/corpus/' || source || '/' || CASE WHEN doc_id % 29 = 0 THEN '.' ELSE '' END || doc_id ||
        CASE WHEN doc_id % 8 < 4 THEN '.md' WHEN doc_id % 8 < 6 THEN '.txt' WHEN doc_id % 8 = 6 THEN '.MD' ELSE '.rb' END AS path,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS mtime, text AS content FROM documents""",
    "v_scan": """
      SELECT * FROM v_files WHERE NOT regexp_matches(path, '(^|/)\\.') AND regexp_matches(lower(path), '\\.(md|txt|docx|pdf)$')""",
    "v_prev": """
      SELECT path, CASE WHEN doc_id % 10 = 1 THEN '0' ELSE sha256(content) END AS sha256 FROM v_files WHERE doc_id % 10 <> 0
      UNION ALL SELECT '/corpus/gone/' || doc_id || '.md', '1' FROM v_files WHERE doc_id % 50 = 2""",
    "v_diff": """
      SELECT coalesce(c.path, p.path) AS path,
        CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN c.sha256 <> p.sha256 THEN 'changed' END AS change
      FROM (SELECT path, sha256(content) AS sha256 FROM v_files) c FULL JOIN v_prev p ON c.path = p.path
      WHERE p.path IS NULL OR c.path IS NULL OR c.sha256 <> p.sha256""",
    "v_md": """
      SELECT doc_id, '/md/' || doc_id || '.md' AS path, doc_id::VARCHAR AS stem,
        array_to_string(list_transform(string_split(text, chr(10)), lambda line, n:
          CASE WHEN (doc_id + n - 1) % 5 = 0 THEN repeat('#', (1 + (doc_id + n - 1) % 4)::INT) || ' ' || line ELSE line END), chr(10) || chr(10)) AS content
      FROM documents""",
    "v_raw_md": """
      SELECT doc_id, path, CASE WHEN doc_id % 29 = 0 THEN '.' ELSE '' END || doc_id AS stem, content FROM v_files WHERE lower(path) LIKE '%.md'""",
    "v_txt": """
      SELECT path AS source_file, 0 AS section_ord, CASE WHEN doc_id % 29 = 0 THEN '.' ELSE '' END || doc_id AS heading, []::VARCHAR[] AS section_path,
        trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM v_files WHERE lower(path) LIKE '%.txt'""",
    "v_plain": """
      SELECT path AS source_file, doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content
      FROM documents JOIN (SELECT doc_id AS d, path FROM v_files) ON d = doc_id""",
    "v_plain_chunks": """
      SELECT source_file, doc_id, i::INT AS chunk_index, substr(content, i * 2048 + 1, 2048) AS content
      FROM (SELECT *, unnest(range(greatest(ceil(length(content) / 2048)::INT, 0))) AS i FROM v_plain WHERE length(content) > 0)""",
    "v_entries": f"""
      SELECT d.doc_id AS id, d.text AS content, CASE WHEN d.doc_id % 37 = 0 THEN 'observation' ELSE 'document_chunk' END AS content_type,
        {_HASH.format('d.text')} AS content_hash, CASE WHEN d.doc_id % 17 <> 0 THEN (d.doc_id % 100) / 100.0::DOUBLE END AS confidence,
        CASE WHEN d.doc_id % 41 = 0 THEN NULL ELSE d.doc_id % 13 <> 0 END AS tagged,
        CASE d.doc_id % 10 WHEN 0 THEN 'archived' WHEN 1 THEN NULL WHEN 2 THEN 'candidate' WHEN 3 THEN 'candidate' WHEN 4 THEN 'candidate' ELSE 'confirmed' END AS status,
        CASE WHEN d.doc_id % 19 <> 0 THEN coalesce(v.seen, 0) END AS access_count,
        CASE WHEN d.doc_id % 7 <> 0 THEN e.embedding END AS embedding,
        CASE WHEN d.doc_id % 43 <> 0 THEN '/corpus/' || d.source || '.md' END AS source_file, 'h' || (d.doc_id % 7) AS heading,
        CASE WHEN d.doc_id % 11 = 0 THEN 0 ELSE d.doc_id // 20 END::INT AS chunk_index,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) AS created_at
      FROM documents d LEFT JOIN (SELECT user_id, count(*) AS seen FROM events GROUP BY 1) v ON v.user_id = d.doc_id % (SELECT max(user_id) + 1 FROM events)
      LEFT JOIN (SELECT vec_id, embedding FROM embeddings) e ON e.vec_id = d.doc_id % (SELECT max(vec_id) + 1 FROM embeddings)""",
    "v_live": "SELECT * FROM v_entries WHERE tagged AND status <> 'archived'",
    "v_near": """
      SELECT e.*, list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
      FROM v_entries e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.tagged AND e.embedding IS NOT NULL""",
    "v_hits": "SELECT *, row_number() OVER (ORDER BY distance, id)::INT AS rank FROM v_near ORDER BY distance, id LIMIT 10",
    "v_manifest": """
      SELECT DISTINCT '/corpus/' || source || '.md' AS path FROM documents WHERE regexp_extract(source, '([0-9]+)$', 1)::INT % 2 = 0
      UNION ALL SELECT '/corpus/extra.md'""",
    "v_scanned": """
      SELECT DISTINCT '/corpus/' || source || '.md' AS path FROM documents WHERE regexp_extract(source, '([0-9]+)$', 1)::INT % 3 = 0
      UNION ALL SELECT '/corpus/new.md'""",
    "v_sources": "SELECT DISTINCT source_file FROM v_live WHERE source_file IS NOT NULL",
    "v_windows": """
      SELECT h.rank AS hit_rank, e.id, e.source_file, e.chunk_index, NULL::DOUBLE AS distance
      FROM v_hits h JOIN v_entries e ON e.source_file = h.source_file AND e.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1
      WHERE e.content_type = 'document_chunk'
      UNION ALL
      SELECT h.rank, h.id, h.source_file, h.chunk_index, h.distance FROM v_hits h
      WHERE h.source_file IS NULL OR h.chunk_index IS NULL OR h.content_type <> 'document_chunk'""",
}


def _lines(name: str, source: str) -> str:
    """CTEs that cut the Markdown of ``source`` into sections named ``name``."""
    running = "OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    last = ", ".join(
        f"last_value(CASE WHEN level = {d} THEN pos END IGNORE NULLS) {running} AS p{d}, last_value(CASE WHEN level = {d} THEN title END IGNORE NULLS) {running} AS t{d}"
        for d in range(1, 7)
    )
    kept = ", ".join(
        f"CASE WHEN p{d} > greatest(-1{''.join(f', coalesce(p{e}, -1)' for e in range(1, d))}) THEN t{d} END" for d in range(1, 7)
    )
    return f"""
{name}_l AS (
  SELECT path, stem, pos - 1 AS pos, line || CASE WHEN pos < n THEN chr(10) ELSE '' END AS line FROM (
    SELECT path, stem, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos,
           len(string_split(content, chr(10))) AS n FROM {source}) WHERE NOT (line = '' AND pos = n)
), {name}_h AS (
  SELECT *, CASE WHEN level > 0 THEN regexp_replace(regexp_replace(line, '^#+[ \\t\\n\\x0B\\f\\r]*', ''), '(\\r\\n|\\n|\\r)$', '') END AS title FROM (
    SELECT *, length(regexp_extract(line, '^(#{{1,6}})[ \\t\\n\\x0B\\f\\r]', 1)) AS level FROM {name}_l)
), {name}_w AS (SELECT *, sum((level > 0)::INT) {running} AS ord, {last} FROM {name}_h),
{name}_p AS (SELECT *, list_filter([{kept}], lambda x: x IS NOT NULL) AS section_path FROM {name}_w),
{name}_s AS (
  SELECT path AS source_file, ord::INT AS section_ord, coalesce(max(title), max(stem)) AS heading,
    coalesce(max(CASE WHEN level > 0 THEN section_path END), []::VARCHAR[]) AS section_path,
    trim(coalesce(string_agg(CASE WHEN level = 0 THEN line END, '' ORDER BY pos), ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content
  FROM {name}_p GROUP BY path, ord
), {name}_n AS (SELECT * FROM {name}_s WHERE content <> ''),
{name} AS (
  SELECT * FROM {name}_n
  UNION ALL SELECT path, 0, stem, []::VARCHAR[], trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
  FROM {source} WHERE path NOT IN (SELECT source_file FROM {name}_n)
)"""


def _packed(name: str, source: str, most: int) -> str:
    """Recursive CTE that packs the paragraphs of ``source`` under ``most`` characters."""
    return f"""
{name}_p AS (
  SELECT source_file, section_ord, heading, p, row_number() OVER (PARTITION BY source_file, section_ord ORDER BY place) AS i FROM (
    SELECT source_file, section_ord, heading, unnest(ps) AS p, generate_subscripts(ps, 1) AS place FROM (
      SELECT *, regexp_split_to_array(content, '\\n\\n+') AS ps FROM {source})) WHERE p <> ''
), {name}_r AS (
  SELECT source_file, section_ord, heading, 0::BIGINT AS i, '' AS buf, 0::BIGINT AS idx, []::STRUCT(i BIGINT, t VARCHAR)[] AS made FROM (
    SELECT DISTINCT source_file, section_ord, heading FROM {name}_p)
  UNION ALL
  SELECT r.source_file, r.section_ord, r.heading, r.i + 1,
    CASE WHEN length(CASE WHEN buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END) <= {most} THEN CASE WHEN buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END
         WHEN length(p) > {most} THEN '' ELSE p END,
    CASE WHEN length(CASE WHEN buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END) <= {most} THEN idx
         ELSE idx + (buf <> '')::BIGINT + CASE WHEN length(p) > {most} THEN ceil(length(p) / {most})::BIGINT ELSE 0 END END,
    CASE WHEN length(CASE WHEN buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END) <= {most} THEN []
         ELSE list_concat(CASE WHEN buf = '' THEN [] ELSE [{{'i': idx, 't': buf}}] END,
           CASE WHEN length(p) > {most} THEN list_transform(range(ceil(length(p) / {most})::BIGINT), lambda k:
             {{'i': idx + (buf <> '')::BIGINT + k, 't': substr(p, k * {most} + 1, {most})}}) ELSE [] END) END
  FROM {name}_r r JOIN {name}_p q ON q.source_file = r.source_file AND q.section_ord = r.section_ord AND q.i = r.i + 1
), {name} AS (
  SELECT source_file, section_ord, heading, m.i::INT AS chunk_index, m.t AS content FROM (SELECT *, unnest(made) AS m FROM {name}_r)
  UNION ALL
  SELECT source_file, section_ord, heading, idx::INT, buf FROM (
    SELECT *, row_number() OVER (PARTITION BY source_file, section_ord ORDER BY i DESC) AS z FROM {name}_r) WHERE z = 1 AND buf <> ''
)"""


_SECTION_COLUMNS = """source_file, section_ord, md5(heading) AS heading_md5, len(section_path)::INT AS depth,
  md5(array_to_string(section_path, '>')) AS path_md5, length(content)::INT AS n_chars, md5(content) AS content_md5"""
_CHUNK_COLUMNS = f"""source_file, section_ord, chunk_index, ceil(length(content) / 4)::INT AS token_count, length(content)::INT AS n_chars,
  {_HASH.format('content')} AS content_hash, md5(content) AS content_md5"""
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
_SECTIONS = "all_sections AS (SELECT * FROM md UNION ALL SELECT * FROM v_txt)"

#: name -> (further CTEs, select)
_SQL: dict[str, tuple[str, str]] = {
    "scan_files": ("", "SELECT path FROM v_scan"),
    "scan_hidden": ("", "SELECT path, regexp_matches(path, '(^|/)\\.') AS hidden FROM v_files"),
    "file_fingerprint": ("", "SELECT path, strlen(content)::BIGINT AS size, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime, sha256(content) AS sha256 FROM v_scan"),
    "scan_summary": ("", "SELECT count(*) AS file_count, coalesce(sum(strlen(content)), 0)::BIGINT AS total_bytes FROM v_scan"),
    "manifest_key": ("", "SELECT DISTINCT '/corpus/' || source AS path, substr(sha256('/corpus/' || source), 1, 16) AS key FROM documents"),
    "manifest_diff": ("", "SELECT path, change FROM v_diff"),
    "to_process": ("", "SELECT path, CASE WHEN change = 'added' THEN '0:' ELSE '1:' END || path AS file_seq FROM v_diff WHERE change <> 'removed'"),
    "heading_level": (_lines("md", "v_md"), "SELECT path, " + ", ".join(f"count(*) FILTER (level = {d}) AS h{d}" for d in range(1, 7)) + " FROM md_h GROUP BY path"),
    "section_path": (_lines("md", "v_md"), "SELECT path, pos::INT AS pos, level::INT AS level, md5(title) AS title_md5, md5(array_to_string(section_path, '>')) AS path_md5 FROM md_p WHERE level > 0"),
    "md_sections": (_lines("md", "v_md"), f"SELECT {_SECTION_COLUMNS} FROM md"),
    "parse_markdown": (_lines("md", "v_raw_md"), f"SELECT {_SECTION_COLUMNS} FROM md"),
    "parse_text": ("", f"SELECT {_SECTION_COLUMNS} FROM v_txt"),
    "parse_dispatch": (_lines("md", "v_raw_md"), """
      SELECT source_file, NULL::VARCHAR AS error, md5(content) AS content_md5, heading FROM md
      UNION ALL SELECT source_file, NULL, md5(content), heading FROM v_txt
      UNION ALL SELECT path, 'unsupported format', NULL, NULL FROM v_files WHERE path LIKE '%.rb'"""),
    "paragraphs": ("", r"""
      SELECT path, count(*) AS n, max(length(p))::INT AS longest, sum(length(p))::BIGINT AS chars
      FROM (SELECT path, unnest(regexp_split_to_array(content, '\n\n+')) AS p FROM v_md) WHERE p <> '' GROUP BY path"""),
    "chunk_hard_split": ("", """
      SELECT doc_id, i::INT AS i, md5(substr(text, i * 2048 + 1, 2048)) AS part_md5
      FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 2048)::INT)) AS i FROM documents)"""),
    "chunk_pack": (f"{_lines('md', 'v_md')}, {_SECTIONS}, {_packed('ch', 'all_sections', 256)}", f"SELECT {_CHUNK_COLUMNS} FROM ch"),
    "chunks": (f"{_lines('md', 'v_md')}, {_SECTIONS}, {_packed('ch', 'all_sections', 2048)}", f"SELECT {_CHUNK_COLUMNS} FROM ch"),
    "token_count": ("", "SELECT doc_id, ceil(length(text) / 4)::INT AS tokens FROM documents"),
    "content_hash": ("", f"SELECT doc_id, {_HASH.format('text')} AS content_hash FROM documents"),
    "question_hash": ("", "SELECT conv_id, turn, substr(sha256(text), 1, 16) AS question_hash FROM conversations WHERE role = 'user'"),
    "entry_payload": (f"{_lines('md', 'v_md')}, {_SECTIONS}, {_packed('ch', 'all_sections', 2048)}", f"""
      SELECT 'document_chunk' AS content_type, {_HASH.format('content')} AS content_hash,
        md5(source_file || '|' || heading || '|document_chunk') AS tags_md5, 3::INT AS n_tags, source_file, chunk_index, ceil(length(content) / 4)::INT AS token_count FROM ch"""),
    "retire_tombstones": ("", """
      SELECT 'Retired document: ' || path AS content, 'observation' AS content_type, path || '|retired|document_chunk' AS tags, path AS source_file, true AS retired
      FROM v_diff WHERE change = 'removed'"""),
    "exists_map": ("", f"""
      SELECT source_file, chunk_index, h AS content_hash, h IN (SELECT content_hash FROM v_live) AS exists
      FROM (SELECT *, {_HASH.format('content')} AS h FROM v_plain_chunks)"""),
    "embed_attach": ("", f"""
      WITH last AS (SELECT content_hash, arg_max(embedding, id) AS embedding FROM v_entries WHERE embedding IS NOT NULL GROUP BY 1)
      SELECT source_file, chunk_index, round(embedding[1]::DOUBLE, 6) AS first_component FROM v_plain_chunks LEFT JOIN last ON content_hash = {_HASH.format('content')}"""),
    "filter_chunks": ("", "SELECT source_file, chunk_index, length(content)::INT AS n_chars FROM v_plain_chunks WHERE length(content) % 2 = 0 AND length(content) % 10 >= 4"),
    "ingest_outcome": ("", """
      SELECT *, CASE WHEN dry_run OR NOT has_store THEN 'created' WHEN exists AND NOT force THEN 'skipped' WHEN answer <> 'ok' THEN 'skipped'
        WHEN force THEN 'updated' ELSE 'created' END AS outcome
      FROM (SELECT unnest([true, false]) AS dry_run), (SELECT unnest([true, false]) AS has_store), (SELECT unnest([true, false]) AS exists),
        (SELECT unnest([true, false]) AS force), (SELECT unnest(['ok', 'failed', 'no_success_key', 'null', 'exception']) AS answer)"""),
    "ingest_summary": ("", f"""
      WITH c AS (SELECT source_file, {_HASH.format('content')} AS h FROM v_plain_chunks), f AS (
        SELECT h IN (SELECT content_hash FROM v_live) OR min(source_file) OVER (PARTITION BY h) < source_file AS known FROM c)
      SELECT (count(*) FILTER (NOT known))::BIGINT AS chunks_created, (count(*) FILTER (known))::BIGINT AS chunks_skipped, 0::BIGINT AS chunks_updated FROM f"""),
    "corpus_stats": (f"v_scan_md AS (SELECT * FROM v_raw_md WHERE stem NOT LIKE '.%'), {_lines('md', 'v_scan_md')}, scanned AS (SELECT * FROM md UNION ALL SELECT * FROM v_txt WHERE heading NOT LIKE '.%'), {_packed('ch', 'scanned', 2048)}", """
      SELECT (SELECT count(*) FROM v_scan) AS file_count, (SELECT count(*) FROM ch) AS estimated_chunks, (SELECT sum(strlen(content))::BIGINT FROM v_scan) AS total_bytes"""),
    "monitor_resolve": ("", """
      WITH m AS (SELECT DISTINCT '/corpus/' || source AS path, '.md,.txt' AS extensions, source AS label FROM documents)
      SELECT * FROM m UNION ALL SELECT * FROM m UNION ALL SELECT '/corpus/legacy', '.md,.txt,.docx,.pdf', 'legacy'"""),
    "monitor_rollup": ("", """
      WITH r AS (SELECT regexp_extract(source, '([0-9]+)$', 1)::INT % 5 <> 0 AS ok, count(*) AS n FROM documents GROUP BY source)
      SELECT count(*) AS monitors_processed, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS files_scanned, coalesce(sum(n % 7) FILTER (ok), 0)::BIGINT AS files_added,
        coalesce(sum(n % 5) FILTER (ok), 0)::BIGINT AS files_changed, coalesce(sum(n % 3) FILTER (ok), 0)::BIGINT AS files_removed,
        coalesce(sum(n * 2) FILTER (ok), 0)::BIGINT AS chunks_created, coalesce(sum(n % 11) FILTER (ok), 0)::BIGINT AS chunks_skipped, 0::BIGINT AS chunks_updated FROM r"""),
    "monitor_status": ("", """
      SELECT (SELECT count(DISTINCT source) FROM documents)::BIGINT AS total_monitors, (SELECT count(*) FROM v_scan)::BIGINT AS total_files"""),
    "live_chunks": ("", "SELECT id, status, confidence FROM v_live"),
    "live_count": ("", "SELECT count(*) AS live_chunks FROM v_live"),
    "count_by_status": ("", "SELECT status, count(*) AS n FROM v_live GROUP BY status"),
    "source_files": ("", "SELECT source_file FROM v_sources"),
    "health_store": ("", f"""
      SELECT count(*) AS total_chunks, round(round(avg((embedding IS NOT NULL)::INT), 4), 9) AS embedding_coverage, round(avg(coalesce(confidence, 0.0)), 9) AS avg_confidence,
        min(coalesce(confidence, 0.0)) AS confidence_min, max(coalesce(confidence, 0.0)) AS confidence_max,
        count(*) FILTER (coalesce(confidence, 0.0) < 0.3) AS stale_count, count(*) FILTER (coalesce(access_count, 0) = 0) AS never_accessed,
        count(DISTINCT source_file) AS unique_source_files, {_ISO.format('min(created_at)')} AS oldest_chunk, {_ISO.format('max(created_at)')} AS newest_chunk FROM v_live"""),
    "health_local": ("", f"""
      SELECT '/corpus' AS corpus_path, count(*) AS file_count, sum(strlen(content))::BIGINT AS total_bytes,
        (SELECT count(*) > 0 FROM v_prev) AS manifest_exists, {_ISO.format('max(mtime)')} AS last_ingest FROM v_scan"""),
    "hot_chunks": ("", "SELECT id, access_count, confidence, source_file FROM v_live WHERE access_count > 0 ORDER BY access_count DESC, id LIMIT 10"),
    "cold_chunks": ("", f"""
      SELECT id, confidence, {_ISO.format('created_at')} AS created_at, source_file FROM (
        SELECT * FROM v_live WHERE access_count = 0 AND created_at < TIMESTAMP '2024-01-25 00:00:00' ORDER BY created_at, id LIMIT 10)"""),
    "low_confidence": ("", "SELECT id, confidence, access_count, source_file FROM v_live WHERE confidence < 0.3 ORDER BY confidence, id LIMIT 10"),
    "query_count": ("", "SELECT count(*) AS total_queries FROM events WHERE event_type IN ('view', 'query')"),
    "quality_summary": ("", """
      SELECT (SELECT count(*) FROM events WHERE event_type IN ('view', 'query'))::BIGINT AS total_queries, NULL::DOUBLE AS avg_retrieval_score,
        (count(*) FILTER (access_count = 0))::BIGINT AS chunks_never_accessed, (count(*) FILTER (confidence < 0.3))::BIGINT AS chunks_below_threshold FROM v_live"""),
    "quality_report": ("", """
      SELECT section, rank::INT AS rank, id, source_file, value FROM (
        SELECT 'hot' AS section, row_number() OVER (ORDER BY access_count DESC, id) AS rank, id, source_file, NULL::DOUBLE AS value FROM v_live WHERE access_count > 0
        UNION ALL SELECT 'cold', row_number() OVER (ORDER BY created_at, id), id, source_file, NULL FROM v_live WHERE access_count = 0 AND created_at < TIMESTAMP '2024-01-25 00:00:00'
        UNION ALL SELECT 'low', row_number() OVER (ORDER BY confidence, id), id, source_file, NULL FROM v_live WHERE confidence < 0.3) WHERE rank <= 10
      UNION ALL SELECT 'summary.total_queries', NULL, NULL, NULL, (SELECT count(*) FROM events WHERE event_type IN ('view', 'query'))::DOUBLE
      UNION ALL SELECT 'summary.avg_retrieval_score', NULL, NULL, NULL, NULL
      UNION ALL SELECT 'summary.chunks_never_accessed', NULL, NULL, NULL, (SELECT count(*) FROM v_live WHERE access_count = 0)::DOUBLE
      UNION ALL SELECT 'summary.chunks_below_threshold', NULL, NULL, NULL, (SELECT count(*) FROM v_live WHERE confidence < 0.3)::DOUBLE"""),
    "content_source": ("v_said AS (SELECT row_number() OVER ()::VARCHAR AS source_file, 0 AS section_ord, 'chat' AS heading, text AS content FROM conversations WHERE role = 'assistant'), "
                       + _packed("ch", "v_said", 256), "SELECT 'chat' AS heading, count(*) AS chunks FROM ch HAVING count(*) > 0"),
    "stream_ingest": (f"{_lines('md', 'v_raw_md')}, {_SECTIONS}, {_packed('ch', 'all_sections', 2048)}", f"""
      WITH h AS (SELECT source_file, {_HASH.format('content')} AS h FROM ch),
      f AS (SELECT *, min(source_file) OVER (PARTITION BY h) AS first FROM h)
      SELECT lower(regexp_extract(source_file, '(\\.[^.]+)$', 1)) AS extension, count(*) AS chunks, count(DISTINCT h) AS hashes FROM f WHERE source_file = first GROUP BY 1"""),
    "detect_orphans": ("", "SELECT source_file FROM v_sources WHERE source_file NOT IN (SELECT path FROM v_manifest)"),
    "sync_stats": ("", """
      SELECT (SELECT count(*) FROM v_sources WHERE source_file NOT IN (SELECT path FROM v_manifest))::BIGINT AS orphan_count,
        (SELECT count(*) FROM v_scanned WHERE path NOT IN (SELECT source_file FROM v_sources))::BIGINT AS missing_count"""),
    "archive_orphans": ("o AS (SELECT source_file FROM v_sources WHERE source_file NOT IN (SELECT path FROM v_manifest))", """
      SELECT id, CASE WHEN hit THEN 'archived' ELSE status END AS status,
        strftime(CASE WHEN hit THEN TIMESTAMP '2024-03-01 00:00:00' ELSE created_at END, '%Y-%m-%d %H:%M:%S') AS updated_at
      FROM (SELECT *, coalesce(tagged AND status <> 'archived' AND source_file IN (SELECT source_file FROM o), false) AS hit FROM v_entries)"""),
    "retrieve_topk": ("", "SELECT rank, id, round(distance, 6) AS distance FROM v_hits WHERE rank <= 5"),
    "neighbors": ("", "SELECT hit_rank, id, source_file, chunk_index, round(distance, 6) AS distance FROM v_windows"),
    "neighbors_merged": ("", """
      SELECT hit_rank, id, source_file, chunk_index FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY hit_rank, coalesce(chunk_index, 0)) AS n FROM v_windows) WHERE n = 1"""),
    "format_source": ("", "SELECT md5(content) AS content_md5, source_file, heading, chunk_index, round(distance, 6) AS distance FROM v_hits"),
    "retrieval_score": ("", "SELECT round(avg(CASE WHEN rank % 3 <> 0 THEN distance ELSE confidence END), 4) AS retrieval_score FROM v_hits"),
    "retrieval_metadata": ("", """
      WITH s AS (SELECT source_file, min(rank) AS r FROM v_hits WHERE source_file IS NOT NULL GROUP BY 1)
      SELECT round(avg(coalesce(distance, NULL)), 4) AS retrieval_score, count(*) AS chunk_count, round(avg(confidence), 4) AS confidence_avg,
        min(confidence) AS confidence_min, max(confidence) AS confidence_max, round(min(distance), 6) AS distance_min, round(max(distance), 6) AS distance_max,
        (SELECT string_agg(source_file, '|' ORDER BY r) FROM s) AS source_files, count(DISTINCT source_file) AS source_file_count,
        bool_and(embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS all_embedded FROM v_hits"""),
    "retrieval_statuses": ("", "SELECT status, count(*) AS n FROM v_hits GROUP BY status"),
    "context_normalize": ("", """
      SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN '/f/' || (event_id % 50) || '.md' END AS source_file,
        CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN event_id % 9 END::INT AS chunk_index FROM events"""),
    "context_resolve": ("", """
      SELECT id AS n, CASE WHEN g < 2 AND f THEN coalesce(source_file, own_file, '/top.md') ELSE coalesce(own_file, '/top.md') END AS source_file,
        CASE WHEN g < 2 AND f THEN coalesce(chunk_index, own_index, 99) ELSE coalesce(own_index, 99) END::INT AS chunk_index,
        CASE WHEN g < 2 AND f THEN coalesce(heading, own_heading, 'top') ELSE coalesce(own_heading, 'top') END AS heading
      FROM (SELECT *, id % 4 AS g, id % 9 <> 0 AS f, CASE WHEN id % 4 <> 0 THEN '/own.md' END AS own_file, CASE WHEN id % 4 <> 1 THEN 7 END AS own_index,
        CASE WHEN id % 4 = 2 THEN 'own' END AS own_heading FROM v_entries)"""),
    "zero_embedding": ("", """
      SELECT id, CASE WHEN id % 5 < 2 THEN true ELSE embedding IS NULL OR len(list_filter(embedding, lambda x: x <> 0)) = 0 END AS zero FROM v_entries"""),
    "synthesis_prompt": ("", """
      SELECT md5('You are a helpful assistant. Use the context below to answer the question.' || chr(10) || chr(10) || 'Context:' || chr(10) ||
        (SELECT string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FROM v_hits WHERE rank <= 5) ||
        chr(10) || chr(10) || 'Question: what is it?' || chr(10) || chr(10) || 'Answer:') AS prompt_md5
      UNION ALL SELECT md5('what is it?')"""),
    "feedback_event": ("", """
      SELECT substr(sha256(text), 1, 16) AS question_hash, conv_id || ',' || turn AS chunk_ids, turn / 10.0::DOUBLE AS retrieval_score, conv_id % 2 = 0 AS synthesized,
        NULL::INT AS rating FROM conversations WHERE role = 'user'"""),
}


def sql(name: str) -> str:
    """The whole statement of a query: its views, its own CTEs, its select."""
    ctes, select = _SQL[name]
    needed: list[str] = []

    def need(text: str) -> None:
        for view in VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                need(VIEWS[view])
                needed.append(view)

    need(ctes + select)
    parts = [f"{v} AS ({VIEWS[v]})" for v in needed]
    own = ctes.strip().strip(",")
    select = select.strip()
    if select.startswith("WITH "):
        inner = select
        select = f"SELECT * FROM ({inner})"
    parts += [own] if own else []
    return (f"WITH RECURSIVE {', '.join(parts)}\n" if parts else "") + select


def all_sql() -> dict[str, str]:
    return {name: sql(name) for name in _SQL}
