"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from gridwork.plans import audits

# Orders as sheets: titles of the three layouts, which rows repeat a header, which are totals.
_ORDERS = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p,
         year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders
), rws AS (
  SELECT *, 'Y' || y AS grp, 'Y' || y || '/orders.xlsx' AS file, 'Q' || q AS sheet, k + 13 AS row_no,
         y % 3 AS layout, k % 500 = 250 AS again, k % 97 = 5 AS footer,
         CASE s WHEN 'O' THEN 'OpEn: waiting' WHEN 'F' THEN 'CLOSED' ELSE 'pending open' END AS status,
         CASE c % 4 WHEN 1 THEN '' WHEN 2 THEN 'Ours' WHEN 3 THEN '[FORMÜL SONUCU OKUNAMADI] =A1' END AS company
  FROM o
), sheets AS (SELECT DISTINCT grp, file, sheet, layout FROM rws),
heads AS (
  SELECT grp, file, sheet, layout, CASE layout WHEN 1 THEN 11 ELSE 12 END AS header_row,
         CASE layout WHEN 1 THEN 2 ELSE 1 END AS height, FALSE AS again FROM sheets
  UNION ALL SELECT grp, file, sheet, layout, row_no, 1, TRUE FROM rws WHERE again
), titles(layout, again, col, title, target, state) AS (VALUES
  (0, NULL, 'A', 'No.', 'No.', 'TAM'), (0, NULL, 'B', 'Entity', 'Entity', 'TAM'), (0, NULL, 'C', 'Panel', 'Panel', 'TAM'),
  (0, NULL, 'D', 'Reviewer Name', 'Reviewer Name', 'TAM'), (0, NULL, 'E', 'Open / Closed', 'Open / Closed', 'TAM'),
  (0, NULL, 'F', 'My Company', 'My Company', 'TAM'), (0, NULL, 'G', 'Notes', 'Ek | Notes', 'EŞLEŞMEDİ'),
  (1, FALSE, 'A', 'Panel Name', 'Panel', 'TAM'), (1, FALSE, 'B', 'Item Number', 'No.', 'TAM'),
  (1, FALSE, 'C', 'Reviewer Name', 'Reviewer Name', 'TAM'), (1, FALSE, 'D', 'Open/Closed', 'Open / Closed', 'TAM'),
  (1, FALSE, 'E', 'Kurum', 'Entity', 'TAM'),
  (1, TRUE, 'A', 'Panel Name', 'Panel', 'TAM'), (1, TRUE, 'B', 'Number', 'No.', 'TAM'),
  (1, TRUE, 'C', 'Reviewer Name', 'Reviewer Name', 'TAM'), (1, TRUE, 'D', 'Open/Closed', 'Open / Closed', 'TAM'),
  (1, TRUE, 'E', 'Entity', 'Entity', 'TAM'),
  (2, NULL, 'A', 'Sıra No', 'No.', 'TAM'), (2, NULL, 'B', 'Varlık', 'Entity', 'TAM'), (2, NULL, 'C', 'Pannel', 'Panel', 'TAM'),
  (2, NULL, 'D', 'İnceleyen', 'Reviewer Name', 'TAM'), (2, NULL, 'E', 'Open Closed', 'Open / Closed', 'TAM'),
  (2, NULL, 'F', 'Notes', 'Ek | Notes', 'EŞLEŞMEDİ'), (2, NULL, 'G', 'Notes', 'Ek | Notes [2]', 'EŞLEŞMEDİ')
), data AS (SELECT * FROM rws WHERE NOT again), rec AS (SELECT * FROM data WHERE NOT footer),
-- A segment runs from header to header; a segment of layout 1 meets data in the column without title.
seg AS (
  SELECT *, lead(header_row) OVER (PARTITION BY file, sheet ORDER BY header_row) AS next_row FROM heads
), unnamed AS (
  SELECT DISTINCT seg.file, seg.sheet, seg.header_row, seg.grp FROM seg JOIN data d
    ON d.file = seg.file AND d.sheet = seg.sheet AND d.row_no > seg.header_row
   AND (seg.next_row IS NULL OR d.row_no < seg.next_row)
  WHERE seg.layout = 1 AND d.k % 3 = 0
), events AS (
  SELECT 'INFO' AS level, 'HEADER_FOUND' AS code, grp FROM heads
  UNION ALL SELECT 'INFO', 'REPEATED_HEADER', grp FROM heads WHERE again
  UNION ALL SELECT 'WARNING', 'MISSING_COLUMNS', grp FROM heads
  UNION ALL SELECT 'WARNING', 'UNNAMED_COLUMN', grp FROM unnamed
  UNION ALL SELECT 'INFO', 'SHEET_DONE', grp FROM sheets
  UNION ALL SELECT DISTINCT 'WARNING', 'QUARANTINED_ROWS', grp || sheet FROM data WHERE footer
)
"""

_GROUP_STATS = """, stats AS (
  SELECT g.grp, g.records, 1 AS files, 1 AS found, t.sheets, g.filled, g.records * 7 AS possible,
         round(g.filled / (g.records * 7), 6) AS completeness, e.warnings, g.quarantined
  FROM (SELECT grp, count(*) FILTER (NOT footer) AS records, count(*) FILTER (footer) AS quarantined,
               sum(CASE WHEN footer THEN 0 ELSE 5 + (layout = 0 AND c % 4 = 2)::INT END) AS filled
        FROM data GROUP BY grp) g
  JOIN (SELECT grp, count(*) AS sheets FROM sheets GROUP BY grp) t USING (grp)
  JOIN (SELECT substr(grp, 1, 5) AS grp, count(*) AS warnings FROM events WHERE level = 'WARNING' GROUP BY 1) e USING (grp)
)
"""

_FLOW = """
  count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'closed') AS closed,
  count(*) FILTER (turn = 'our_company') AS our_company, count(*) FILTER (turn = 'other_company') AS other_company,
  count(*) FILTER (state = 'unknown_status') AS unknown_status, count(*) FILTER (turn = 'unknown_turn') AS unknown_turn
"""

_CUSTOMERS = """
WITH c AS (
  SELECT 'region ' || n_regionkey AS grp, 'nation_' || lpad(n_nationkey::VARCHAR, 3, '0') || '.xlsx' AS file, 'Data' AS sheet,
         c_custkey + 13 AS row_no, c_custkey % 20 AS kind, c_custkey AS k, c_mktsegment AS seg, c_name AS name,
         floor(c_acctbal)::BIGINT AS bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), judged AS (
  SELECT *, CASE WHEN kind = 4 THEN 'ZORUNLU_ALAN_BOŞ: Custom' WHEN kind = 1 THEN 'ALT_BİLGİ/TOPLAM'
                 WHEN kind = 2 THEN 'AZ_DOLU_ALAN' WHEN kind = 3 THEN 'ANAHTAR_ALAN_YOK' WHEN kind = 5 THEN 'KAYIT_NO_BİÇİMİ' END AS rule
  FROM c WHERE kind <> 0
), marked AS (
  SELECT *, rule IS NULL AND row_number() OVER (PARTITION BY grp, seg, bal, rule IS NULL ORDER BY file, row_no) > 1 AS copy FROM judged
), reasons AS (SELECT *, CASE WHEN copy THEN 'TEKRAR_KAYIT' ELSE rule END AS reason FROM marked),
cells AS (
  SELECT *,
    CASE kind WHEN 1 THEN '" Genel  TOPLAM: "' WHEN 2 THEN 'null' WHEN 3 THEN 'null' WHEN 5 THEN '"x' || k || '"' ELSE k::VARCHAR END AS a,
    CASE kind WHEN 1 THEN '"Genel  TOPLAM:"' WHEN 2 THEN 'null' WHEN 3 THEN 'null' WHEN 5 THEN '"x' || k || '"' ELSE k::VARCHAR END AS a2,
    CASE WHEN kind IN (2, 3) THEN 'null' ELSE '"E"' END AS b,
    CASE WHEN kind IN (2, 3) THEN 'null' ELSE '"' || seg || '"' END AS p,
    CASE WHEN kind IN (1, 2, 3) THEN 'null' ELSE bal::VARCHAR END AS r,
    CASE WHEN kind = 4 THEN '"[FORMÜL SONUCU OKUNAMADI] =B1"' ELSE '"c"' END AS m,
    CASE WHEN kind IN (1, 2, 4, 5) THEN 'null' ELSE '"' || name || '"' END AS x
  FROM reasons WHERE reason IS NOT NULL
)
"""

_DOC_FILES = """
WITH d AS (
  SELECT (CASE WHEN doc_id % 13 = 0 THEN source || '/.git/' WHEN doc_id % 17 = 0 THEN '' ELSE source || '/' || lang || '/' END) ||
    CASE doc_id % 7 WHEN 0 THEN doc_id || '.csv' WHEN 1 THEN doc_id || '.CSV' WHEN 2 THEN '~$' || doc_id || '.csv'
      WHEN 3 THEN doc_id || '.tar.gz' WHEN 4 THEN '.' || doc_id || '.csv' WHEN 5 THEN doc_id || '.tmp.csv' ELSE doc_id::VARCHAR END AS path,
    doc_id, source, lang FROM documents
)
"""

_SAFE = "coalesce(nullif(left(trim(regexp_replace(regexp_replace({0}, '[\\\\/:*?\"<>|]', '_', 'g'), '\\s+', ' ', 'g')), 80), ''), 'untitled')"

_MEDIA = """
WITH m AS (
  SELECT doc_id, source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.webm' ELSE '.WEBM' END AS path FROM documents
)
"""

_CRLF = "CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END"

_ISSUES = """
WITH i AS (
  SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'In Progress' ELSE 'Blocked' END AS st
  FROM orders JOIN customer ON o_custkey = c_custkey
)
"""

ORACLES = audits.SQL | {
    "harmonize_workflow": _ORDERS + """, cls AS (
  SELECT grp, CASE s WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'unknown_status' END AS state,
    CASE WHEN s <> 'O' THEN NULL WHEN layout <> 0 OR c % 4 = 3 THEN 'unknown_turn' WHEN c % 4 = 2 THEN 'other_company' ELSE 'our_company' END AS turn
  FROM rec)
SELECT coalesce(grp, 'GENEL TOPLAM') AS "group", grp IS NULL AS is_total,""" + _FLOW + "FROM cls GROUP BY ROLLUP (grp)",
    "harmonize_records": _ORDERS + """
SELECT grp, file, sheet, row_no, k::VARCHAR AS no, 'Customer#' || c AS entity, p AS panel, NULL::VARCHAR AS ata,
  'Clerk ' || (c % 50) AS reviewer, status, CASE WHEN layout = 0 THEN company END AS company,
  CASE WHEN layout <> 1 AND k % 3 = 0 THEN 'note ' || k END AS notes, CASE WHEN layout = 2 THEN 'second' END AS notes_2,
  CASE WHEN layout = 1 AND k % 3 = 0 THEN 'note ' || k END AS untitled FROM rec""",
    "harmonize_mapping": _ORDERS + """
SELECT file, sheet, header_row, height, col AS source_column, title, target, state
FROM heads JOIN titles ON heads.layout = titles.layout AND (titles.again IS NULL OR titles.again = heads.again)""",
    "harmonize_events": _ORDERS + "SELECT level, code, count(*) AS count FROM events GROUP BY ALL",
    "group_report": _ORDERS + _GROUP_STATS + "SELECT * FROM stats",
    "report_totals": _ORDERS + _GROUP_STATS + """
SELECT sum(records)::BIGINT AS records, count(*) AS groups, sum(found)::BIGINT AS found_files, sum(filled)::BIGINT AS filled,
  sum(possible)::BIGINT AS possible, sum(quarantined)::BIGINT AS quarantined, count(*) AS processed_files,
  (SELECT count(*) FROM events WHERE level = 'WARNING') AS warnings, 0::BIGINT AS errors,
  round(sum(filled) / sum(possible), 6) AS completeness, 'review' AS verdict FROM stats""",
    "row_rules": _CUSTOMERS + """
SELECT grp, file, sheet, row_no, reason, '[' || concat_ws(', ', a, b, p, r, m, x) || ']' AS raw_row,
  '{"No.": ' || a2 || ', "Entity": ' || b || ', "Panel": ' || p || ', "Reviewer Name": ' || r || ', "Custom": ' || m
   || ', "Ek | Remark": ' || x || '}' AS mapped_data FROM cells""",
    "audit_union": _CUSTOMERS + """, files AS (SELECT DISTINCT file FROM c), all_files AS (SELECT count(*) AS n FROM nation)
SELECT 'quarantine' AS type, string_split(reason, ':')[1] AS label, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'event', unnest(['HEADER_FOUND', 'MISSING_COLUMNS', 'SHEET_DONE']), n FROM all_files
UNION ALL SELECT 'event', 'QUARANTINED_ROWS', count(DISTINCT file) FROM reasons WHERE reason IS NOT NULL
UNION ALL SELECT 'header', 'TAM', n * 5 FROM all_files UNION ALL SELECT 'header', 'EŞLEŞMEDİ', n FROM all_files""",
    "fill_down": """
WITH r AS (
  SELECT o_orderkey AS k, o_orderkey % 43 = 11 AS blank, o_orderkey % 61 = 7 AS footer, o_orderkey % 4 = 0 AS has_entity,
    CASE WHEN o_orderkey % 4 = 0 THEN 'E' || o_custkey END AS entity, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS panel,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS reviewer FROM orders
), g AS (
  SELECT *, coalesce(sum((blank OR footer)::INT) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM r
), f AS (
  SELECT k, blank, footer, reviewer,
    last_value(CASE WHEN NOT blank THEN entity END IGNORE NULLS) OVER (PARTITION BY run ORDER BY k) AS entity,
    last_value(CASE WHEN NOT blank THEN panel END IGNORE NULLS) OVER (PARTITION BY run ORDER BY k) AS panel FROM g
)
SELECT k + 13 AS row_no, k::VARCHAR AS no, entity, panel, reviewer FROM f WHERE NOT blank AND NOT footer""",
    # Row by row: what may be filled down, the marks of good rows so far, and the records.
    "fill_down_dependent": """
WITH r AS (
  SELECT o_orderkey AS k, o_orderkey % 43 = 11 AS blank, o_orderkey % 61 = 7 AS footer, CASE WHEN o_orderkey % 4 = 0 THEN 'E' || o_custkey END AS entity,
    CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS panel, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS reviewer FROM orders
), listed AS (
  SELECT list({'k': k, 'blank': blank, 'footer': footer, 'entity': entity, 'panel': panel, 'reviewer': reviewer, 'marks': []::UBIGINT[],
               'records': []::STRUCT(k BIGINT, entity VARCHAR, panel VARCHAR, reviewer VARCHAR)[]} ORDER BY k) AS l FROM r
), walked AS (
  SELECT list_reduce(l, lambda s, x: list_transform([{'e': coalesce(x.entity, s.entity), 'p': coalesce(x.panel, s.panel)}], lambda f: list_transform(
    [NOT x.blank AND NOT x.footer AND 1 + (f.e IS NOT NULL)::INT + (f.p IS NOT NULL)::INT + (x.reviewer IS NOT NULL)::INT >= 3
     AND NOT list_contains(s.marks, hash([f.e, f.p, x.reviewer]))], lambda good: {
      'k': x.k, 'blank': x.blank, 'footer': x.footer, 'entity': CASE WHEN good THEN f.e END, 'panel': CASE WHEN good THEN f.p END, 'reviewer': x.reviewer,
      'marks': CASE WHEN good THEN list_append(s.marks, hash([f.e, f.p, x.reviewer])) ELSE s.marks END,
      'records': CASE WHEN good THEN list_append(s.records, {'k': x.k, 'entity': f.e, 'panel': f.p, 'reviewer': x.reviewer}) ELSE s.records END})[1])[1],
    {'k': 0::BIGINT, 'blank': TRUE, 'footer': FALSE, 'entity': NULL::VARCHAR, 'panel': NULL::VARCHAR, 'reviewer': NULL::VARCHAR, 'marks': []::UBIGINT[],
     'records': []::STRUCT(k BIGINT, entity VARCHAR, panel VARCHAR, reviewer VARCHAR)[]}).records AS records FROM listed
)
SELECT x.k + 13 AS row_no, x.k::VARCHAR AS no, x.entity, x.panel, x.reviewer FROM (SELECT unnest(records) AS x FROM walked)""",
    "sheet_name_groups": _ORDERS + """
SELECT min(CASE WHEN file > 'Y1997' THEN lower(sheet) ELSE sheet END) FILTER (file = first_file) AS grp, count(*) + max(extra) AS n_rows,
  count(DISTINCT file) AS files, count(DISTINCT CASE WHEN file > 'Y1997' THEN lower(sheet) ELSE sheet END) AS spellings
FROM (SELECT r.*, h.extra, min(r.file) OVER (PARTITION BY r.sheet) AS first_file FROM rws r
      JOIN (SELECT sheet, sum(height) AS extra FROM heads WHERE NOT again GROUP BY sheet) h ON h.sheet = r.sheet) x
GROUP BY sheet""",
    "header_exact": """
WITH t(target) AS (VALUES ('Small Ring'), ('Red Widget'), ('Blue Bolt'), ('Green Gear'))
SELECT target, 'TAM' AS state, count(*) AS parts FROM part JOIN t ON lower(target) = p_name GROUP BY target""",
    "workflow_rollup": """
WITH cls AS (
  SELECT o_orderpriority AS grp, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unknown_status' END AS state,
    CASE WHEN o_orderstatus <> 'O' THEN NULL WHEN o_orderkey % 11 = 0 OR o_custkey % 5 = 4 THEN 'unknown_turn'
      WHEN o_custkey % 5 IN (0, 1) THEN 'our_company' ELSE 'other_company' END AS turn FROM orders
  UNION ALL SELECT r_name, NULL, NULL FROM region)
SELECT coalesce(grp, 'GENEL TOPLAM') AS "group", grp IS NULL AS is_total,""" + _FLOW + "FROM cls GROUP BY ROLLUP (grp)",
    "completeness": """
WITH p AS (SELECT n_name AS grp, * FROM customer JOIN nation ON c_nationkey = n_nationkey),
rec AS (
  SELECT grp, count(*) AS records, count(DISTINCT c_mktsegment) AS files,
    sum(1 + (c_acctbal >= 0)::INT + (c_mktsegment <> 'MACHINERY')::INT) AS filled, sum((c_acctbal < 0)::INT) AS warnings FROM p GROUP BY grp)
SELECT n_name AS grp, coalesce(records, 0) AS records, coalesce(files, 0) AS files, n_regionkey::BIGINT AS found, coalesce(files, 0) AS sheets,
  coalesce(filled, 0)::BIGINT AS filled, coalesce(records, 0) * 3 AS possible,
  coalesce(round(filled / (records * 3), 6), 0.0) AS completeness, coalesce(warnings, 0)::BIGINT AS warnings,
  (SELECT count(*) FROM supplier WHERE s_acctbal < 0 AND s_nationkey = n_nationkey) AS quarantined
FROM nation LEFT JOIN rec ON n_name = grp""",
    "topn_other": """
WITH c AS (SELECT o_custkey::VARCHAR AS label, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, lower(label), label) AS place FROM c)
SELECT place, label, n AS count FROM r WHERE place <= 10
UNION ALL SELECT 11, 'Diğer kategoriler (toplam)', sum(n)::BIGINT FROM r WHERE place > 10 HAVING count(*) > 0""",
    "top_groups": """
WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, lower(label), label) AS place FROM c)
SELECT place, label, n AS count FROM r WHERE place <= 3
UNION ALL SELECT 4, 'Diğer kategoriler (toplam)', sum(n)::BIGINT FROM r WHERE place > 3 HAVING count(*) > 0""",
    "category_names": """
SELECT CASE l_partkey % 5 WHEN 0 THEN CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END
  WHEN 1 THEN '(Boş)' WHEN 2 THEN '(Formül sonucu okunamadı)' WHEN 3 THEN l_returnflag ELSE strftime(l_shipdate, '%Y-%m-%d') END AS label,
  count(*) AS count FROM lineitem GROUP BY 1""",
    "dedup_keep_first": """
SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY lang, doc_id) AS n FROM documents) d WHERE n > 1""",
    "cell_cleaning": """
WITH v AS (SELECT l_partkey AS p, l_linenumber % 2 = 0 AS z, l_returnflag AS f FROM lineitem)
SELECT CASE WHEN p % 6 IN (3, 4, 5) THEN 'text' WHEN z THEN 'text' WHEN p % 6 = 2 THEN 'float' ELSE 'int' END AS kind,
  CASE p % 6 WHEN 0 THEN CASE WHEN z THEN lpad(p::VARCHAR, greatest(6, length(p::VARCHAR))::INT, '0') ELSE p::VARCHAR END
    WHEN 1 THEN CASE WHEN z THEN '-' || lpad(p::VARCHAR, greatest(5, length(p::VARCHAR))::INT, '0') ELSE (-p)::VARCHAR END
    WHEN 2 THEN CASE WHEN z THEN lpad(p::VARCHAR, greatest(6, length(p::VARCHAR))::INT, '0') ELSE p || '.0' END
    WHEN 3 THEN '9000000000' || lpad(p::VARCHAR, 8, '0') WHEN 4 THEN f ELSE 'nan' END AS shown, count(*) AS n FROM v GROUP BY ALL""",
    "out_parts": """
SELECT o_orderstatus AS grp, o_orderkey AS row_no,
  ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, month(o_orderdate), o_orderkey) - 1) // 1000 + 1)::BIGINT AS part FROM orders""",
    "pattern_groups": audits.FILES_SQL + """, l AS (
  SELECT 'literal' AS mode, literal || ext AS pattern, ext, path FROM named UNION ALL SELECT 'structural', structural || ext, ext, path FROM named),
g AS (SELECT mode, pattern, count(*) AS count, min(ext) || ':' || count(*) AS extensions FROM l GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT mode, pattern, string_agg(path, ' | ' ORDER BY path) AS examples FROM
  (SELECT *, row_number() OVER (PARTITION BY mode, pattern ORDER BY path) AS n FROM l) x WHERE n <= 5 GROUP BY ALL)
SELECT mode, count, pattern, extensions, examples FROM g JOIN e USING (mode, pattern)""",
    "top_patterns": audits.FILES_SQL + """, x AS (SELECT structural AS pattern, ext, count(*) AS n FROM named GROUP BY ALL)
SELECT sum(n)::BIGINT AS count, pattern, string_agg(ext || ':' || n, '; ' ORDER BY n DESC, ext) AS extensions FROM x
GROUP BY pattern HAVING sum(n) >= 2 ORDER BY 1 DESC, 2 LIMIT 5""",
    "extension_distribution": """
WITH n AS (SELECT regexp_extract(url, '[^/]*$') AS name FROM pages),
x AS (SELECT coalesce(nullif(lower(CASE WHEN regexp_matches(name, '(?i)\\.(tar\\.gz|tar\\.bz2|tar\\.xz|nii\\.gz|backup\\.sql)$')
  THEN regexp_extract(name, '(?i)\\.(tar\\.gz|tar\\.bz2|tar\\.xz|nii\\.gz|backup\\.sql)$') ELSE regexp_extract(name, '^.+(\\.[^.]+)$', 1) END), ''), '<NO_EXT>') AS extension FROM n)
SELECT extension, count(*) AS count, (SELECT count(*) FROM x) AS total FROM x GROUP BY 1""",
    "listing_groups": _DOC_FILES + """, k AS (
  SELECT *, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS top FROM d WHERE doc_id % 13 <> 0 AND doc_id % 7 IN (0, 1)),
root AS (SELECT 'src1' || CASE WHEN EXISTS (SELECT 1 FROM k WHERE top = 'src1') THEN '_' ELSE '' END AS name)
SELECT coalesce(top, (SELECT name FROM root)) AS grp, count(*) AS files_found FROM k GROUP BY 1""",
    "skip_own_outputs": _DOC_FILES + """, marked AS (SELECT DISTINCT source || '/' || lang AS folder FROM documents WHERE lang = 'de'),
f AS (SELECT path, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN NULL ELSE source || '/' || lang END AS folder FROM d
  UNION ALL SELECT folder || '/gridwork-output.marker', folder FROM marked)
SELECT CASE WHEN folder IN (SELECT folder FROM marked) THEN 'skipped' ELSE 'kept' END AS outcome, count(*) AS files FROM f GROUP BY 1""",
    "safe_names": "SELECT page_id, " + _SAFE.format("url") + " AS name FROM pages",
    "name_splits": _DOC_FILES + """, n AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM d),
s AS (SELECT *, CASE WHEN name LIKE '%.tar.gz' THEN '.tar.gz' ELSE regexp_extract(name, '^.+(\\.[^.]+)$', 1) END AS suffix FROM n)
SELECT path, left(name, length(name) - length(suffix)) AS stem, suffix FROM s""",
    "worklist_plan": _MEDIA + """
SELECT path, regexp_replace(path, '\\.[^.]+$', '.mp3') AS target_path, 'audio' AS media,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skip' ELSE 'convert' END AS action,
  doc_id NOT IN (SELECT doc_id FROM labels) AS delete_source FROM m WHERE path LIKE '%.webm'""",
    "worklist_outcome": "SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS succeeded, count(*) AS total FROM documents",
    "media_classes": "SELECT 'video' AS media, count(*) AS files FROM documents",
    "sections_chat": """
WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations),
s AS (SELECT conv_id, section, arg_min(text, turn) AS title, count(*) AS paragraphs, string_agg(text, chr(10) ORDER BY turn) AS text
  FROM t WHERE section > 0 GROUP BY ALL)
SELECT conv_id AS doc_id, section::BIGINT AS section, printf('%02d', section::BIGINT) || '_' || """ + _SAFE.format("title")
    + " AS file_name, 1::BIGINT AS part, paragraphs, text FROM s",
    "sections_html": """
WITH m AS (SELECT page_id, string_split(replace(html, '<h1>', '</<h1>'), '</') AS parts FROM pages),
b AS (SELECT page_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS n FROM m),
l AS (SELECT page_id, n, starts_with(text, '<h1>') AS head, CASE WHEN starts_with(text, '<h1>') THEN substr(text, 5) ELSE text END AS text FROM b),
t AS (SELECT *, sum(head::INT) OVER (PARTITION BY page_id ORDER BY n) AS section FROM l),
s AS (SELECT page_id, section, arg_min(text, n) AS title, count(*) AS paragraphs, sum(length(text))::BIGINT AS chars FROM t WHERE section > 0 GROUP BY ALL)
SELECT page_id AS doc_id, section::BIGINT AS section, printf('%02d', section::BIGINT) || '_' || """ + _SAFE.format("title")
    + " AS file_name, paragraphs, chars FROM s",
    "eol_normalize": f"""
SELECT doc_id::VARCHAR AS path, md5(replace({_CRLF}, chr(13) || chr(10), chr(10))) AS digest,
  contains({_CRLF}, chr(13) || chr(10)) AS changed FROM documents WHERE doc_id % 10 <> 3""",
    "eol_counts": f"SELECT count(*) AS files, count(*) FILTER (contains({_CRLF}, chr(13) || chr(10))) AS converted FROM documents",
    "truncate_chunk": """
WITH n AS (SELECT *, unnest(range(greatest(ceil(length(text) / 30000)::BIGINT, 1))) AS piece_no FROM documents)
SELECT doc_id, md5(CASE WHEN length(text) > 32767 THEN left(text, 32750) || chr(10) || '[TRUNCATED]' ELSE text END) AS limited,
  piece_no, md5(substr(text, piece_no * 30000 + 1, 30000)) AS piece FROM n""",
    "field_profile": """
SELECT 'o_orderkey' AS "column", max(length(o_orderkey::VARCHAR)) AS longest_line FROM orders
UNION ALL SELECT 'o_orderstatus', max(length(o_orderstatus)) FROM orders UNION ALL SELECT 'o_orderdate', 19
UNION ALL SELECT 'o_orderpriority', max(length(o_orderpriority)) FROM orders
UNION ALL SELECT 'doc_id', max(length(doc_id::VARCHAR)) FROM documents
UNION ALL SELECT 'text', max(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))) FROM documents
UNION ALL SELECT 'lang', max(length(lang)) FROM documents""",
    "column_widths": """
WITH d AS (SELECT * FROM documents)
SELECT 'doc_id' AS "column", least(greatest(max(length(doc_id::VARCHAR)) + 2, 8, 14), 55) AS width FROM d
UNION ALL SELECT 'Comment text', least(greatest(max(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))) + 2, 45), 55) FROM d
UNION ALL SELECT 'source', least(greatest(max(length(source)) + 2, 8, 12), 55) FROM d
UNION ALL SELECT 'Summary of language', 35""",
    "moments": """
SELECT event_id, round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400000000.0, 9) AS fraction,
  CASE WHEN event_id % 2 = 0 OR ts = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown FROM events""",
    "issue_flatten": _ISSUES + """
SELECT 'ORD-' || o_orderkey AS key, 'https://tracker.example.com/browse/ORD-' || o_orderkey AS url, 'Order ' || o_orderkey AS summary,
  st AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Highest' ELSE o_orderpriority END AS priority, c_name AS assignee, day || ' 03:04:05' AS created,
  CASE WHEN o_orderkey % 2 = 0 THEN day ELSE 'soon' END AS due_date, c_mktsegment || chr(10) || o_orderstatus AS labels,
  o_custkey::VARCHAR AS story_points, CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS released,
  round(o_totalprice * 1000)::BIGINT || '.0' AS estimate, 'Order ' || o_orderkey || chr(10) || c_name AS description,
  c_name || ' [' || day || ']' || chr(10) || o_orderpriority || chr(10) || chr(10) || 'later' AS comment,
  CASE st WHEN 'Closed' THEN 'done' WHEN 'In Progress' THEN 'progress' ELSE 'blocked' END AS status_class,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' END AS priority_class FROM i""",
    "field_naming": _ISSUES + """
SELECT 'ORD-' || o_orderkey AS key, 'Order ' || o_orderkey AS summary, o_custkey::VARCHAR AS points,
  CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS released, c_mktsegment || chr(10) || o_orderstatus AS labels FROM i""",
    "issue_pick": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_orderpriority = '1-URGENT'",
    "doc_tree_text": """
SELECT conv_id, turn, trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x)), chr(10)), ' ' || chr(10)) AS text FROM conversations""",
    "comment_threads": """
SELECT 'supplier ' || l_suppkey || ' [' || strftime(l_shipdate, '%Y-%m-%d') || ']' || chr(10) || l_returnflag || chr(10) || chr(10) || 'qty ' || l_linenumber AS thread,
  count(*) AS n FROM lineitem GROUP BY 1""",
    "formula_merge": """
SELECT o_orderstatus AS file, o_orderkey AS row_no,
  '[' || CASE WHEN o_orderkey % 7 = 0 THEN 'null, "[FORMÜL SONUCU OKUNAMADI] =A' || o_orderkey || '"'
    WHEN o_orderkey % 3 <> 0 THEN o_orderkey || ', "' || o_orderpriority || '", "tail"'
    WHEN o_orderkey % 5 <> 0 THEN o_orderkey || ', "[FORMÜL SONUCU OKUNAMADI] =A' || o_orderkey || '", "tail"'
    ELSE o_orderkey || ', null, "tail"' END || ']' AS cells,
  CASE WHEN o_orderkey % 5 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 7 = 0) THEN 1 ELSE 0 END AS missing,
  CASE WHEN o_orderkey % 5 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 7 = 0) THEN '=A' || o_orderkey END AS formula
FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)""",
    "written_report": """
SELECT c_nationkey::BIGINT AS nation, count(*) AS records, sum(c_custkey)::BIGINT AS keys, count(*) FILTER (c_custkey % 10 <> 0) AS panels,
  round(sum(c_acctbal), 2) AS balance, CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS errors
FROM customer GROUP BY c_nationkey""",
}
