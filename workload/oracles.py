"""SQL twins of the queries, written over long cells."""

from __future__ import annotations

# Whitespace as the text functions see it, in the syntax of the other engine.
_WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def has_text(x: str) -> str:
    return rf"coalesce(regexp_matches({x}, '[^{_WS}]'), false)"


def clean(x: str) -> str:
    untagged = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    line = rf"regexp_extract({untagged}, '[^{_WS}][^\n]*', 0)"
    return rf"rtrim(regexp_replace({line}, '[{_WS}]+', ' ', 'g'))"


CONVERSATION_CELLS = """
SELECT concat('book', conv_id % 10) AS file, conv_id AS sheet_idx, CAST(conv_id AS VARCHAR) AS sheet, r AS row, c AS col, v AS value, t AS dtype, 'General' AS nf FROM (
  WITH b AS (SELECT conv_id, conv_id % 3 AS titles, turn, role, text FROM conversations),
  d AS (SELECT conv_id, titles + 2 + turn + CASE WHEN turn >= 4 THEN conv_id % 4 ELSE 0 END AS r, role, text,
               CASE WHEN turn % 4 <> 3 THEN CAST(turn AS VARCHAR) END AS n FROM b),
  h AS (SELECT DISTINCT conv_id, titles FROM b)
  SELECT conv_id, r, 1 AS c, role AS v, 's' AS t FROM d UNION ALL SELECT conv_id, r, 2, text, 's' FROM d UNION ALL SELECT conv_id, r, 3, n, 'n' FROM d
  UNION ALL SELECT conv_id, 1, 1, 'Export', 's' FROM h WHERE titles >= 1
  UNION ALL SELECT conv_id, 2, 1, '  ', 's' FROM h WHERE titles >= 2
  UNION ALL SELECT conv_id, titles + 1, 1, '<b>Role</b>', 's' FROM h
  UNION ALL SELECT conv_id, titles + 1, 2, concat('Text', chr(10), '(note)'), 's' FROM h
  UNION ALL SELECT conv_id, titles + 1, 3, ' Turn   No ', 's' FROM h) x"""

ORDER_CELLS = """
SELECT concat('in/', k % 3, '/f', k % 50, '.xlsx') AS file, k // 150 AS sheet_idx, concat('S', k // 150) AS sheet, r AS row, c AS col, v AS value, t AS dtype, nf FROM (
  WITH n AS (SELECT l_orderkey AS k, l_linenumber + 1 AS r, max(l_partkey) AS p, max(l_suppkey) AS s, CAST(sum(l_quantity) AS BIGINT) AS q, max(l_returnflag) AS f
             FROM lineitem GROUP BY l_orderkey, l_linenumber),
  h AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
  SELECT k, r, 1 AS c, CAST(p AS VARCHAR) AS v, 'n' AS t, 'General' AS nf FROM n
  UNION ALL SELECT k, r, 2, CASE WHEN s % 9 = 0 THEN '=A1' ELSE CAST(s AS VARCHAR) END, CASE WHEN s % 9 = 0 THEN 's' ELSE 'n' END, CASE WHEN s % 9 = 0 THEN 'General' ELSE '@' END FROM n
  UNION ALL SELECT k, r, 3, CAST(q AS VARCHAR), 'n', '0.00' FROM n
  UNION ALL SELECT k, r, 4, CASE WHEN f = 'N' THEN ' ' ELSE f END, 's', CASE WHEN f = 'N' THEN 'General' ELSE '@' END FROM n
  UNION ALL SELECT k, 1, 1, CASE k % 4 WHEN 0 THEN 'Part' WHEN 1 THEN 'part no' WHEN 2 THEN '<b>Part</b>' ELSE 'Item' END, 's', 'General' FROM h
  UNION ALL SELECT k, 1, 2, CASE k % 4 WHEN 0 THEN 'Supplier' WHEN 1 THEN 'Vendor' WHEN 2 THEN 'Supplier' ELSE 'Supplier  Name' END, 's', 'General' FROM h
  UNION ALL SELECT k, 1, 3, CASE k % 4 WHEN 0 THEN 'Qty' WHEN 1 THEN 'Quantity' WHEN 2 THEN 'Flag' ELSE 'QTY' END, 's', 'General' FROM h
  UNION ALL SELECT k, 1, 4, CASE k % 4 WHEN 3 THEN 'Return' ELSE 'Flag' END, 's', 'General' FROM h) x"""

EVENT_CELLS = r"""
SELECT 'log' AS file, si AS sheet_idx, sh AS sheet, r AS row, c AS col, v AS value, t AS dtype, 'General' AS nf FROM (
  WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id + 1 END AS si, CASE WHEN event_id % 3 = 0 THEN 'main' ELSE concat('user', user_id) END AS sh, * FROM events),
  h AS (SELECT DISTINCT si, sh FROM e)
  SELECT si, sh, event_id + 3 AS r, 1 AS c, CAST(user_id AS VARCHAR) AS v, 'n' AS t FROM e
  UNION ALL SELECT si, sh, event_id + 3, 2, event_type, 's' FROM e
  UNION ALL SELECT si, sh, event_id + 3, 3, concat(' ', chr(9)), 's' FROM e
  UNION ALL SELECT si, sh, event_id + 3, 4, CASE WHEN event_id % 4096 BETWEEN 2000 AND 2099 THEN NULL ELSE CAST(value AS VARCHAR) END, 'n' FROM e
  UNION ALL SELECT si, sh, 1, 1, 'Activity', 's' FROM h
  UNION ALL SELECT si, sh, 2, 1, '<i>User</i>', 's' FROM h
  UNION ALL SELECT si, sh, 2, 2, concat('Kind', chr(160), ' of'), 's' FROM h
  UNION ALL SELECT si, sh, 2, 3, '<br/>', 's' FROM h
  UNION ALL SELECT si, sh, 2, 4, concat('Value', chr(10), '(unit)'), 's' FROM h) x"""

BLANK_CELLS = """
SELECT 'blank' AS file, c_custkey AS sheet_idx, CAST(c_custkey AS VARCHAR) AS sheet, 1 AS row, c AS col, v AS value, 's' AS dtype, 'General' AS nf
FROM customer, (VALUES (1, '  '), (2, chr(9))) w(c, v)"""

ALL_CELLS = f"{CONVERSATION_CELLS} UNION ALL {ORDER_CELLS} UNION ALL {EVENT_CELLS} UNION ALL {BLANK_CELLS}"


def bounds_ctes(cells: str) -> str:
    """CTEs cells, filled, edge (rightmost column), bounds."""
    return f"""cells AS ({cells}),
filled AS (SELECT * FROM cells WHERE {has_text('value')}),
edge AS (SELECT file, sheet, max(col) AS max_col FROM filled GROUP BY file, sheet),
top AS (SELECT file, sheet, min(row) AS top FROM filled JOIN edge USING (file, sheet) WHERE col = max_col GROUP BY file, sheet),
sheets AS (SELECT file, sheet, min(sheet_idx) AS sheet_idx, max(row) AS max_row FROM cells GROUP BY file, sheet),
bounds AS (SELECT file, sheet, sheet_idx, CAST(max_col AS INTEGER) AS max_col, CAST(coalesce(top, 1) AS BIGINT) AS header_row, CAST(max_row AS BIGINT) AS max_row
  FROM sheets LEFT JOIN edge USING (file, sheet) LEFT JOIN top USING (file, sheet))"""


def header_ctes(cells: str) -> str:
    """As bounds_ctes, and headers: one row per header cell with raw, header, class."""
    return f"""{bounds_ctes(cells)},
texts AS (SELECT c.file, c.sheet, c.sheet_idx, c.row, CAST(c.col AS INTEGER) AS col, c.value AS text, coalesce({trim('c.value')}, '') AS raw
  FROM cells c JOIN bounds b ON c.file = b.file AND c.sheet = b.sheet AND c.row = b.header_row),
headers AS (SELECT *, nullif({clean('raw')}, '') AS header,
  CASE WHEN raw = '' THEN 'empty' WHEN {clean('raw')} = '' THEN 'emptied' WHEN {clean('raw')} <> raw THEN 'cleaned' ELSE 'as_is' END AS class FROM texts)"""


FIRST = "row_number() OVER (PARTITION BY header ORDER BY string_split(file, '/'), sheet_idx, col)"

SHEET_STATS = """SELECT file, sheet, any_value(header_row) AS header_row, count(header) AS headers_found,
  count(*) FILTER (WHERE class IN ('empty', 'emptied')) AS empty_headers, count(*) FILTER (WHERE class = 'cleaned') AS cleaned_headers,
  count(class) AS raw_headers
FROM bounds LEFT JOIN (SELECT file, sheet, header, class FROM headers) h USING (file, sheet) GROUP BY file, sheet"""

FILE_STATS = """SELECT file, count(*) AS sheets_processed, CAST(0 AS BIGINT) AS sheets_with_errors,
  CAST(sum(headers_found) AS BIGINT) AS headers_found, CAST(sum(empty_headers) AS BIGINT) AS empty_headers, false AS has_error
FROM sheet_stats GROUP BY file"""


def normal_ctes(entries: str, name: str = "normal") -> str:
    """Normal form of a stored mapping."""
    return f"""{name}_entries AS ({entries}),
{name} AS (SELECT scanned, CASE WHEN NOT ign THEN target END AS target, ign AS is_ignored FROM (
  SELECT scanned, bool_or(coalesce(is_ignored, false)) AS ign,
    arg_max(target, ord) FILTER (WHERE NOT coalesce(is_ignored, false) AND coalesce(target, '') <> '') AS target
  FROM {name}_entries GROUP BY scanned) x WHERE ign OR target IS NOT NULL)"""


def event_mapping(step: int = 1) -> str:
    return f"""SELECT event_id AS ord, concat('h', user_id * {step}) AS scanned,
  CASE WHEN event_type = 'signup' THEN '' ELSE concat('T', event_id % 8) END AS target,
  CASE WHEN event_type = 'error' AND event_id % 40 = 3 THEN true WHEN event_id % 3 <> 0 THEN false END AS is_ignored FROM events"""


PART_MAPPING = """SELECT p_partkey AS ord, CASE WHEN p_name LIKE '%ring' OR p_name LIKE 'hot %' THEN p_name ELSE concat('old ', p_name) END AS scanned,
  p_type AS target, p_size = 7 AS is_ignored FROM part"""

ORDER_MAPPING = """SELECT * FROM (VALUES (0,'Part','part_id',false),(1,'part no','part_id',false),(2,'Item','part_id',false),(3,'Supplier','supplier_id',false),
 (4,'Vendor','vendor',false),(5,'Vendor','supplier_id',false),(6,'Qty','qty',false),(7,'Quantity','qty',false),(8,'QTY','',true),(9,'Flag','flag',false),(10,'Return','flag',false),(11,'Return','',true),(12,'Old','',false)) AS m(ord, scanned, target, is_ignored)"""

TARGETS = "SELECT DISTINCT p_type AS target FROM part UNION SELECT r_name FROM region"

SESSION = f"""{normal_ctes(event_mapping(3))},
exact AS (SELECT DISTINCT concat('h', user_id) AS scanned FROM events WHERE concat('h', user_id) IN (SELECT concat('h', user_id * 5) FROM events) AND concat('h', user_id) NOT IN (SELECT scanned FROM normal)),
ranked AS (SELECT scanned, target, CASE WHEN is_ignored THEN 'ignored' ELSE 'mapped' END AS state, 0 AS rank FROM normal
  UNION ALL SELECT scanned, scanned, 'mapped', 1 FROM exact
  UNION ALL SELECT concat('h', c_custkey), concat('T', c_custkey % 8), 'suggested', 2 FROM customer),
session AS (SELECT scanned, target, state FROM ranked QUALIFY row_number() OVER (PARTITION BY scanned ORDER BY rank) = 1)"""

def decisions(step: int = 1) -> str:
    return f"""SELECT concat('h', user_id * {step}) AS scanned, event_id AS seq,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'map' ELSE 'toggle_ignore' END AS action,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN concat('T', event_id % 8) END AS target FROM events"""


def fold_ctes(log: str) -> str:
    return f"""log AS ({log}),
last AS (SELECT scanned, max(seq) FILTER (WHERE action = 'map') AS m, arg_max(target, seq) FILTER (WHERE action = 'map') AS t FROM log GROUP BY scanned),
flips AS (SELECT scanned, any_value(m) AS m, any_value(t) AS t, count(*) FILTER (WHERE action = 'toggle_ignore' AND (m IS NULL OR seq > m)) AS k
  FROM log JOIN last USING (scanned) GROUP BY scanned),
folded AS (SELECT scanned, CASE WHEN m IS NOT NULL AND k = 0 THEN t END AS target,
  CASE WHEN m IS NOT NULL AND k = 0 THEN 'mapped' WHEN k % 2 = 1 THEN 'ignored' ELSE 'undecided' END AS state FROM flips)"""


REPLIES = """SELECT p_partkey AS reply, CASE WHEN p_partkey % 2 = 0 THEN concat('ScannedColumn|TargetColumn|Confidence', chr(10), line, chr(10)) ELSE line END AS text FROM (
  SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN concat(p_name, '|', p_type)
    WHEN p_size % 13 = 0 THEN 'ScannedColumn|TargetColumn|Confidence'
    ELSE concat(' ', p_name, ' | ', CASE WHEN p_size % 7 = 0 THEN 'NO_MATCH' ELSE p_type END, ' | 0.', lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0'), CASE WHEN p_size % 5 = 0 THEN 'x' ELSE '' END) END AS line FROM part) x"""

PARSED = rf"""replies AS ({REPLIES}),
lines AS (SELECT reply, unnest(list_zip(range(0, len(ls)), ls)) AS l FROM (SELECT reply, string_split({trim('text')}, chr(10)) AS ls FROM replies) s),
parts AS (SELECT reply, CAST(l[1] AS INTEGER) AS line_no, string_split({trim('l[2]')}, '|') AS p FROM lines WHERE NOT starts_with({trim('l[2]')}, 'ScannedColumn|')),
parsed AS (SELECT reply, line_no, {trim('p[1]')} AS scanned, {trim('p[2]')} AS target,
  coalesce(TRY_CAST(nullif(regexp_extract({trim('p[3]')}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0), '') AS DOUBLE), 0.0) AS confidence
  FROM parts WHERE len(p) = 3),
accepted AS (SELECT * FROM parsed WHERE target <> 'NO_MATCH' AND confidence >= 0.6)"""

SIZED = "SELECT DISTINCT concat(p_name, ' ', p_size) AS header FROM part"


def batches(headers: str) -> str:
    return f"""SELECT header, row_number() OVER (ORDER BY header) - 1 AS pos,
  CASE WHEN count(*) OVER () <= 100 THEN 0 ELSE (row_number() OVER (ORDER BY header) - 1) // 50 END AS batch FROM ({headers}) s"""


def _name_parts(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace({x}, '(\p{{Ll}}|\p{{N}})(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _words(x: str) -> str:
    return f"list_sort(list_distinct({_name_parts(x)}))"


def _plain(x: str) -> str:
    return f"array_to_string({_name_parts(x)}, ' ')"


SIMILAR = f"""
headers AS (SELECT DISTINCT unnest([upper(replace(p_name, ' ', '_')), concat('my ', p_name), replace(p_name, 'i', 'y'), concat(p_name, ' ', p_size)]) AS scanned FROM part),
targets AS (SELECT p_name AS target FROM part UNION {TARGETS}),
hw AS (SELECT scanned, {_words('scanned')} AS w FROM headers),
tw AS (SELECT target, {_words('target')} AS w FROM targets),
hs AS (SELECT scanned, w, {_plain('scanned')} AS p FROM hw),
ts AS (SELECT target, w, {_plain('target')} AS p FROM tw),
scores AS (SELECT scanned, target, greatest(
    len(list_intersect(hs.w, ts.w)) / (len(hs.w) + len(ts.w) - len(list_intersect(hs.w, ts.w))),
    1 - levenshtein(hs.p, ts.p) / greatest(length(hs.p), length(ts.p))) AS score FROM hs, ts)
SELECT scanned, target, round(score, 6) AS confidence FROM scores WHERE score >= 0.6
QUALIFY row_number() OVER (PARTITION BY scanned ORDER BY score DESC, target) = 1"""

LAYOUT = ("part_id", "supplier_id", "qty", "flag", "note")


def plan_ctes(cells: str, layout: tuple[str, ...] = LAYOUT) -> str:
    """As header_ctes, and applicable: first input header per sheet and target."""
    names = ", ".join(f"('{t}')" for t in dict.fromkeys(layout))
    return f"""{header_ctes(cells)},
{normal_ctes(ORDER_MAPPING)},
layout AS (SELECT * FROM (VALUES {names}) l(target)),
inputs AS (SELECT file, sheet, header, min(col) AS first_col, max(col) AS value_col FROM headers WHERE header IS NOT NULL GROUP BY file, sheet, header),
applicable AS (SELECT file, sheet, i.target, header, value_col FROM (
  SELECT file, sheet, n.target, header, value_col, row_number() OVER (PARTITION BY file, sheet, n.target ORDER BY first_col) AS rn
  FROM inputs JOIN normal n ON n.scanned = header AND NOT n.is_ignored JOIN layout l ON l.target = n.target) i WHERE rn = 1)"""


def format_ctes(cells: str, layout: tuple[str, ...] = LAYOUT, header_row: int = 1) -> str:
    """As plan_ctes, and copied (long) and formatted (wide, aligned rows)."""
    wide = ", ".join(
        f"max(CASE WHEN target = '{t}' AND NOT starts_with(value, '=') THEN value END) AS {t}" for t in layout
    )
    return f"""{plan_ctes(cells, layout)},
rows AS (SELECT DISTINCT c.file, c.sheet, c.row, {header_row} + c.row - b.header_row AS target_row FROM cells c JOIN bounds b USING (file, sheet) WHERE c.row > b.header_row),
copied AS (SELECT r.file, r.sheet, r.target_row, a.target, c.value, c.dtype, c.nf FROM rows r
  LEFT JOIN applicable a USING (file, sheet) LEFT JOIN cells c ON c.file = r.file AND c.sheet = r.sheet AND c.row = r.row AND c.col = a.value_col),
formatted AS (SELECT file, sheet, CAST(target_row AS BIGINT) AS target_row, {wide} FROM copied GROUP BY file, sheet, target_row)"""


def any_data(columns: tuple[str, ...]) -> str:
    return " OR ".join(f"({has_text(c)} AND NOT starts_with(coalesce({c}, ''), '='))" for c in columns)


NARROW = ("supplier_id", "flag")
COPIED = f"{has_text('value')} AND NOT starts_with(value, '=')"

REJECTS = f"""sheet_stats AS ({SHEET_STATS}),
rejects AS (SELECT file, sheet, CASE WHEN headers_found = 0 THEN 'scan' ELSE 'format' END AS stage,
  CASE WHEN headers_found = 0 THEN 'no header' ELSE 'no applicable mapping' END AS reason
  FROM sheet_stats WHERE headers_found = 0 OR (file, sheet) NOT IN (SELECT (file, sheet) FROM applicable))"""

_TEMPLATE = """template AS (
  SELECT 1 AS target_row, 'Standard layout' AS part_id, NULL AS column_2, NULL AS supplier_id, NULL AS flag, NULL AS note, NULL AS flag_6
  UNION ALL SELECT 2, 'part_id', NULL, ' supplier_id ', 'flag', 'note', 'flag'
  UNION ALL SELECT r_regionkey + 3, NULL, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE '=B1' END, NULL, NULL, NULL, NULL FROM region)"""

_REQUEST_HEAD = (
    "Match each found column name to the one standard column with the same meaning.\n"
    "Answer one line per found column: ScannedColumn|TargetColumn|Confidence\n"
    "Confidence is between 0 and 1. Without a clear match write NO_MATCH as the target."
)


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    o["workbook_cells"] = """WITH c AS (SELECT concat('book', c_custkey // 500, '.xlsx') AS file, concat('part ', c_custkey % 2) AS sheet, c_custkey % 500 // 2 + 2 AS r, * FROM customer),
h AS (SELECT DISTINCT file, sheet FROM c)
SELECT file, sheet, CAST(r AS BIGINT) AS row, CAST(col AS INTEGER) AS col, v AS value, t AS dtype, nf AS number_format FROM (
  SELECT file, sheet, r, 1 AS col, CAST(c_custkey AS VARCHAR) AS v, 'n' AS t, 'General' AS nf FROM c
  UNION ALL SELECT file, sheet, r, 2, c_name, 's', 'General' FROM c
  UNION ALL SELECT file, sheet, r, 4, CAST(c_acctbal AS VARCHAR), 'n', '0.00' FROM c
  UNION ALL SELECT file, sheet, r, 5, strftime(DATE '1899-12-30' + CAST(40000 + c_custkey % 1000 AS INTEGER), '%Y-%m-%d %H:%M:%S'), 'd', 'yyyy-mm-dd' FROM c
  UNION ALL SELECT file, sheet, r, 6, CASE WHEN c_custkey % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END, 'b', 'General' FROM c
  UNION ALL SELECT file, sheet, 1, 1, 'Number', 's', 'General' FROM h UNION ALL SELECT file, sheet, 1, 2, '<b>Name</b>', 's', 'General' FROM h
  UNION ALL SELECT file, sheet, 1, 4, 'Balance', 's', 'General' FROM h UNION ALL SELECT file, sheet, 1, 5, 'Since', 's', 'General' FROM h) x"""
    o["table_to_cells"] = """WITH e AS (SELECT event_type AS sheet, event_id + 2 AS r, * FROM events), h AS (SELECT DISTINCT event_type AS sheet FROM events)
SELECT 'events' AS file, sheet, CAST(r AS BIGINT) AS row, CAST(c AS INTEGER) AS col, v AS value, t AS dtype FROM (
  SELECT sheet, r, 1 AS c, CAST(event_id AS VARCHAR) AS v, 'n' AS t FROM e UNION ALL SELECT sheet, r, 2, CAST(user_id AS VARCHAR), 'n' FROM e
  UNION ALL SELECT sheet, r, 3, CAST(value AS VARCHAR), 'n' FROM e UNION ALL SELECT sheet, r, 4, props, 's' FROM e
  UNION ALL SELECT sheet, 1, 1, 'event_id', 's' FROM h UNION ALL SELECT sheet, 1, 2, 'user_id', 's' FROM h
  UNION ALL SELECT sheet, 1, 3, 'value', 's' FROM h UNION ALL SELECT sheet, 1, 4, 'props', 's' FROM h) x WHERE v IS NOT NULL"""
    o["line_list"] = f"""SELECT doc_id, CAST(l[1] AS INTEGER) AS line_no, {trim('l[2]')} AS value FROM (
  SELECT doc_id, unnest(list_zip(range(0, len(ls)), ls)) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) s) x WHERE {has_text('l[2]')}"""
    o["load_mapping"] = """SELECT event_id AS doc, CAST(0 AS BIGINT) AS ord, concat('h', user_id) AS scanned, concat('T', event_id % 8) AS target, event_type = 'error' AS is_ignored FROM events
UNION ALL SELECT event_id, 1, event_type, 'kind', false FROM events"""
    o["default_targets"] = """WITH h AS (SELECT CASE event_type WHEN 'signup' THEN 'Email' WHEN 'purchase' THEN 'Amount' WHEN 'view' THEN concat('Date', user_id % 2) WHEN 'click' THEN 'Name' ELSE 'id' END AS header FROM events),
s AS (SELECT * FROM (VALUES (0,'ID'),(1,'Name'),(2,'Email'),(3,'Phone'),(4,'Address'),(5,'Date'),(6,'Amount'),(7,'Description')) d(pos, target))
SELECT CAST(pos AS BIGINT) AS pos, target, count(header) AS headers FROM s LEFT JOIN h ON header = target GROUP BY pos, target"""
    o["default_targets"] = o["default_targets"].replace("SELECT CAST(pos", """, l AS (SELECT 'none' AS list, pos, target FROM s UNION ALL
  SELECT 'own', row_number() OVER (ORDER BY p_type) - 1, p_type FROM (SELECT DISTINCT p_type FROM part))
SELECT list, CAST(pos""").replace("FROM s LEFT JOIN h ON header = target GROUP BY pos", "FROM l LEFT JOIN h ON header = target GROUP BY list, pos")
    o["workbook_pieces"] = o["workbook_cells"]
    o["workbook_source"] = f"SELECT * FROM ({o['workbook_cells']}) x WHERE sheet = 'part 1'"
    o["file_inventory"] = """SELECT concat('part', p_partkey, CASE WHEN p_partkey % 2 = 1 THEN '.XLSX' ELSE '.xlsx' END) AS name, p_partkey % 49 AS length,
  CASE WHEN p_partkey % 49 = 0 THEN 'empty' END AS audit FROM part WHERE p_partkey % 10 <> 0"""
    books = """books AS (SELECT l_orderkey // 1000 AS k, count(*) AS n FROM lineitem GROUP BY 1),
broken AS (SELECT concat(CASE k % 5 WHEN 0 THEN 'nozip' WHEN 1 THEN 'cut' ELSE 'empty' END, k, '.xlsx') AS file, k % 5 = 1 AS opens FROM books WHERE k % 5 IN (0, 1, 3))"""
    o["decode_rejects"] = f"""WITH {books}
SELECT concat('lines', k, '.xlsx') AS file, n + 1 AS rows, CAST(CASE WHEN k % 5 = 2 THEN n // 1000 ELSE 0 END AS BIGINT) AS errors, CAST(0 AS BIGINT) AS rejects FROM books
UNION ALL SELECT file, 0, 0, 1 FROM broken"""
    stats = f"""WITH {books},
files AS (SELECT concat('lines', k, '.xlsx') AS file, 1 AS sheets_processed, 0 AS sheets_with_errors, 10 AS headers_found, false AS has_error FROM books
  UNION ALL SELECT file, 0, CASE WHEN opens THEN 1 ELSE 0 END, 0, NOT opens FROM broken)"""
    o["scan_stats_broken_files"] = f"""{stats}
SELECT file, CAST(sheets_processed AS BIGINT) AS sheets_processed, CAST(sheets_with_errors AS BIGINT) AS sheets_with_errors,
  CAST(headers_found AS BIGINT) AS headers_found, CAST(0 AS BIGINT) AS empty_headers, has_error FROM files"""
    o["scan_rollup"] = f"""{stats},
sheets AS (SELECT 'sheet' AS level, file, 'lines' AS sheet, 0 AS nf, 0 AS ne, sheets_processed AS sp, sheets_with_errors AS se, headers_found AS h FROM files WHERE NOT has_error),
levels AS (SELECT *, h AS u FROM sheets
  UNION ALL SELECT 'file', file, NULL, 1, CAST(has_error AS INTEGER), sheets_processed, sheets_with_errors, headers_found, headers_found FROM files
  UNION ALL SELECT 'total', NULL, NULL, count(*), sum(CAST(has_error AS INTEGER)), sum(sheets_processed), sum(sheets_with_errors), sum(headers_found), 10 FROM files)
SELECT level, file, sheet, CAST(nf AS BIGINT) AS files_processed, CAST(ne AS BIGINT) AS files_with_errors, CAST(sp AS BIGINT) AS sheets_processed,
  CAST(se AS BIGINT) AS sheets_with_errors, CAST(h AS BIGINT) AS headers_found, CAST(0 AS BIGINT) AS empty_headers, CAST(0 AS BIGINT) AS cleaned_headers,
  CAST(u AS BIGINT) AS unique_headers FROM levels"""
    o["scan_stats_broken_total"] = f"""{stats}
SELECT count(*) AS files_processed, CAST(sum(CAST(has_error AS INTEGER)) AS BIGINT) AS files_with_errors, CAST(sum(sheets_processed) AS BIGINT) AS sheets_processed,
  CAST(sum(sheets_with_errors) AS BIGINT) AS sheets_with_errors, CAST(sum(headers_found) AS BIGINT) AS headers_found, CAST(0 AS BIGINT) AS empty_headers,
  CAST(0 AS BIGINT) AS headers_cleaned, CAST(10 AS BIGINT) AS unique_headers FROM files"""
    books = """p AS (SELECT p_partkey // 100 AS book, * FROM part),
lines AS (SELECT concat('book', book, '.xlsx') AS file, book % 3 = 1 AS new, book, p_partkey, p_name, p_size FROM p WHERE book % 4 <> 3
  UNION ALL SELECT concat('copy', book, '.xlsx'), false, book, p_partkey, p_name, p_size FROM p WHERE book % 5 = 0),
files AS (SELECT DISTINCT file, new FROM lines)"""
    o["rejects_in_pieces"] = o["decode_rejects"]
    o["ingest_changed"] = f"""WITH {books}
SELECT file, 'parts' AS sheet, CAST(row AS BIGINT) AS row, CAST(col AS INTEGER) AS col, value, dtype FROM (
  SELECT file, p_partkey % 100 + 2 AS row, 1 AS col, CAST(p_partkey AS VARCHAR) AS value, 'n' AS dtype FROM lines
  UNION ALL SELECT file, p_partkey % 100 + 2, 2, CASE WHEN new THEN upper(p_name) ELSE p_name END, 's' FROM lines
  UNION ALL SELECT file, p_partkey % 100 + 2, 3, CAST(p_size AS VARCHAR), 'n' FROM lines
  UNION ALL SELECT file, 1, 1, 'key', 's' FROM files
  UNION ALL SELECT file, 1, 2, CASE WHEN new THEN 'title' ELSE 'name' END, 's' FROM files
  UNION ALL SELECT file, 1, 3, 'size ', 's' FROM files)"""
    o["file_ledger"] = f"""WITH {books}
SELECT file, CAST(CASE WHEN new OR starts_with(file, 'copy') THEN 2 ELSE 1 END AS BIGINT) AS version FROM files"""
    o["kept_scan_stats"] = f"""WITH {books}
SELECT count(*) AS files_processed, CAST(0 AS BIGINT) AS files_with_errors, count(*) AS sheets_processed, CAST(0 AS BIGINT) AS sheets_with_errors,
  count(*) * 3 AS headers_found, CAST(0 AS BIGINT) AS empty_headers, CAST(0 AS BIGINT) AS headers_cleaned,
  CAST(2 + count(DISTINCT new) AS BIGINT) AS unique_headers FROM files"""
    o["kept_provenance"] = f"""WITH {books},
h AS (SELECT file, 'key' AS header, 1 AS col FROM files UNION ALL SELECT file, CASE WHEN new THEN 'title' ELSE 'name' END, 2 FROM files
  UNION ALL SELECT file, 'size', 3 FROM files)
SELECT header, min(file) AS first_file, 'parts' AS first_sheet, CAST(1 AS BIGINT) AS first_row, CAST(min(col) AS INTEGER) AS first_col,
  CAST(NULL AS VARCHAR) AS first_original, count(*) AS occurrences FROM h GROUP BY header"""
    o["mapping_round_trip"] = """SELECT concat(kind, ' "h', event_id) AS scanned, CASE WHEN event_id % 5 <> 0 THEN concat('T', event_id % 8) END AS target,
  event_id % 5 = 0 AS is_ignored FROM events, (VALUES ('a'), ('b')) k(kind)"""
    o["typed_values"] = """SELECT 'typed' AS file, event_type AS sheet, event_id + 2 AS target_row,
  concat('2024-02-', lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0'), ' ', lpad(CAST(event_id % 24 AS VARCHAR), 2, '0'), ':30:00') AS moment,
  concat(lpad(CAST(event_id % 24 AS VARCHAR), 2, '0'), ':15:00') AS clock, event_id + 9007199254740993 AS number, event_id % 2 = 0 AS truth,
  event_id / 8.0 AS amount, concat(event_id + 12345678901234567, '.8', event_id % 10) AS exact FROM events"""
    o["target_layout"] = f"WITH {header_ctes(CONVERSATION_CELLS)} SELECT file, sheet, col AS target_col, raw AS target FROM headers"

    o["sheet_bounds"] = f"WITH {bounds_ctes(ALL_CELLS)} SELECT * FROM bounds"

    def ends(cells: str, tolerance: int) -> str:
        return f"""SELECT * FROM (WITH {bounds_ctes(cells)},
points AS (SELECT f.file, f.sheet, f.row, lead(f.row) OVER (PARTITION BY f.file, f.sheet ORDER BY f.row) AS nxt
  FROM filled f JOIN bounds b ON b.file = f.file AND b.sheet = f.sheet AND f.col = b.max_col AND f.row >= b.header_row),
stops AS (SELECT file, sheet, min(row) AS stop FROM points WHERE nxt IS NULL OR nxt - row > {tolerance} GROUP BY file, sheet)
SELECT b.*, CAST(coalesce(stop, header_row) AS BIGINT) AS table_end_row FROM bounds b LEFT JOIN stops USING (file, sheet)) t"""

    o["table_end"] = f"{ends(CONVERSATION_CELLS, 2)} UNION ALL {ends(EVENT_CELLS, 30)}"

    headed = f"WITH {header_ctes(ALL_CELLS)}"
    o["sheet_headers"] = f"{headed} SELECT file, sheet, row, col, text FROM headers"
    o["clean_headers"] = f"""SELECT kind, id, {clean('raw')} AS header FROM (
  SELECT 'page' AS kind, page_id AS id, html AS raw FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents) x"""
    o["header_classes"] = f"""{headed} SELECT file, sheet, col, header, class,
  CASE WHEN header IS NOT NULL THEN {FIRST} = 1 END AS is_new FROM headers"""
    o["scan_headers"] = f"{headed} SELECT DISTINCT header FROM headers WHERE header IS NOT NULL"
    o["header_list_round_trip"] = f"""{headed} SELECT row_number() OVER (ORDER BY header) - 1 AS pos, header
FROM (SELECT DISTINCT header FROM headers WHERE header IS NOT NULL)"""
    o["header_provenance"] = f"""{headed}, placed AS (SELECT *, {FIRST} AS n FROM headers WHERE header IS NOT NULL),
changed AS (SELECT header, raw AS first_original FROM placed WHERE raw <> header QUALIFY {FIRST} = 1),
counts AS (SELECT header, count(*) AS occurrences FROM placed GROUP BY header)
SELECT p.header, file AS first_file, sheet AS first_sheet, CAST(row AS BIGINT) AS first_row, col AS first_col, first_original, occurrences
FROM placed p JOIN counts USING (header) LEFT JOIN changed USING (header) WHERE n = 1"""
    o["scan_stats_sheet"] = f"{headed} {SHEET_STATS}"
    o["scan_stats_file"] = f"{headed}, sheet_stats AS ({SHEET_STATS}) {FILE_STATS}"
    o["stats_append"] = f"{headed}, sheet_stats AS ({SHEET_STATS}), f AS ({FILE_STATS}) SELECT f.*, run FROM f, (VALUES ('first'), ('second')) r(run)"
    o["scan_stats_total"] = f"""{headed}, sheet_stats AS ({SHEET_STATS}), file_stats AS ({FILE_STATS})
SELECT count(*) AS files_processed, CAST(0 AS BIGINT) AS files_with_errors, CAST(sum(sheets_processed) AS BIGINT) AS sheets_processed,
  CAST(sum(sheets_with_errors) AS BIGINT) AS sheets_with_errors, CAST(sum(headers_found) AS BIGINT) AS headers_found,
  CAST(sum(empty_headers) AS BIGINT) AS empty_headers,
  (SELECT count(DISTINCT header) FROM headers WHERE raw <> header) AS headers_cleaned,
  (SELECT count(DISTINCT header) FROM headers) AS unique_headers FROM file_stats"""
    o["invalid_header_sheets"] = f"{headed}, sheet_stats AS ({SHEET_STATS}) SELECT * FROM sheet_stats WHERE headers_found = 0 AND raw_headers > 0"
    o["cell_refs"] = """WITH p AS (SELECT DISTINCT l_orderkey + 1 AS row, CAST(l_partkey * 7 % 16384 + 1 AS INTEGER) AS col FROM lineitem),
l AS (SELECT *, concat(CASE WHEN col > 702 THEN chr(65 + (col - 703) // 676) ELSE '' END,
  CASE WHEN col > 26 THEN chr(65 + (col - 27) // 26 % 26) ELSE '' END, chr(65 + (col - 1) % 26)) AS letter FROM p)
SELECT row, col, letter, concat(letter, row) AS ref FROM l"""
    o["suppress_formulas"] = f"""SELECT CAST(col AS INTEGER) AS col, count(*) FILTER (WHERE starts_with(value, '=')) AS formulas,
  count(*) FILTER (WHERE NOT starts_with(value, '=')) AS kept FROM ({ORDER_CELLS}) c GROUP BY col"""

    o["normalize_mapping"] = f"WITH {normal_ctes(event_mapping())} SELECT * FROM normal"
    o["auto_map_exact"] = f"""WITH {normal_ctes(PART_MAPPING)}, s AS (SELECT p_name AS h FROM part UNION SELECT p_type FROM part)
SELECT h AS scanned, h AS target FROM s WHERE h NOT IN (SELECT scanned FROM normal) AND h IN (SELECT p_name FROM part UNION {TARGETS})"""
    o["merge_mapping"] = f"WITH {SESSION} SELECT * FROM session"
    o["mapping_coverage"] = f"""WITH {SESSION}, n AS (SELECT count(*) FILTER (WHERE state = 'mapped') AS mapped, count(*) FILTER (WHERE state = 'suggested') AS suggested,
  count(*) FILTER (WHERE state = 'ignored') AS ignored, (SELECT count(*) FROM customer) AS total FROM session)
SELECT *, total - mapped - ignored - suggested AS unmapped FROM n"""
    o["mapping_fan_in"] = f"""WITH {normal_ctes(event_mapping())}, t AS (SELECT DISTINCT concat('T', event_id % 10) AS target FROM events)
SELECT t.target, count(scanned) AS headers, min(scanned) AS first_header, max(scanned) AS last_header FROM t LEFT JOIN normal USING (target) GROUP BY t.target"""
    still_open = f"SELECT p_partkey AS pos, p_name AS header FROM part WHERE p_name NOT IN (SELECT scanned FROM ({PART_MAPPING}) m)"
    o["unmapped_headers"] = still_open
    o["unmapped_report"] = still_open
    o["unmapped_counts"] = f"""SELECT (SELECT count(*) FROM part) AS total, (SELECT count(DISTINCT scanned) FROM ({PART_MAPPING}) m) AS decided,
  (SELECT count(*) FROM ({still_open}) u) AS unmapped"""
    o["append_targets"] = f"""SELECT 0 AS part, p_partkey AS pos, p_type AS target FROM part UNION ALL
SELECT 1, min(c_custkey), t FROM (SELECT c_custkey, {trim("CASE WHEN c_custkey % 4 = 0 THEN 'SMALL' ELSE concat(' ', c_mktsegment, chr(9)) END")} AS t FROM customer) c
WHERE t <> '' AND t NOT IN (SELECT p_type FROM part) GROUP BY t"""

    o["decision_fold"] = f"WITH {fold_ctes(decisions())} SELECT scanned, target, state FROM folded"
    earlier = f"""SELECT scanned, -1 AS seq, CASE WHEN is_ignored THEN 'toggle_ignore' ELSE 'map' END AS action, target FROM normal
  UNION ALL {decisions(2)}"""
    o["saved_mapping"] = f"""WITH {normal_ctes(event_mapping())}, {fold_ctes(earlier)}
SELECT scanned, CASE WHEN state = 'mapped' THEN target ELSE '' END AS target, state = 'ignored' AS is_ignored FROM folded WHERE state IN ('mapped', 'ignored')"""
    o["review_worklist"] = f"SELECT pos, header, pos < 100 AS wrapped FROM ({still_open}) u WHERE pos <> 100"

    o["suggestion_batches"] = batches(SIZED)
    head = _REQUEST_HEAD.replace("\n", "' || chr(10) || '")
    o["batch_requests"] = f"""WITH b AS ({batches(SIZED)}), t AS ({TARGETS})
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS headers, concat('{head}', chr(10), chr(10), 'FOUND COLUMNS', chr(10), string_agg('- ' || header, chr(10) ORDER BY pos),
  chr(10), chr(10), 'STANDARD COLUMNS', chr(10), (SELECT string_agg('- ' || target, chr(10) ORDER BY target) FROM t)) AS request FROM b GROUP BY batch"""
    o["parse_suggestions"] = f"WITH {PARSED} SELECT * FROM parsed"
    o["accepted_suggestions"] = f"WITH {PARSED} SELECT * FROM accepted"
    o["apply_suggestions"] = f"""WITH {PARSED}, {normal_ctes(PART_MAPPING)}
SELECT scanned, target, confidence, target IN (SELECT replace(p_type, 'PROMO', 'OTHER') FROM part) AS in_targets
FROM accepted WHERE scanned NOT IN (SELECT scanned FROM normal) QUALIFY row_number() OVER (PARTITION BY scanned ORDER BY reply DESC, line_no DESC) = 1"""
    o["suggest_similar"] = f"WITH {SIMILAR}"
    candidates = SIMILAR.partition("SELECT scanned, target, round(score, 6)")[0]
    o["suggest_scored"] = f"""WITH {candidates},
judged AS (SELECT scanned, target, least(length(scanned), length(target)) / greatest(length(scanned), length(target)) AS alike FROM scores WHERE score >= 0.6)
SELECT scanned, target, round(alike, 6) AS confidence FROM judged WHERE alike >= 0.6
QUALIFY row_number() OVER (PARTITION BY scanned ORDER BY alike DESC, target) = 1"""
    o["suggestion_audit"] = f"""WITH {PARSED}, sent AS ({batches('SELECT p_name AS header FROM part UNION SELECT p_type FROM part')}),
last AS (SELECT * FROM accepted QUALIFY row_number() OVER (PARTITION BY scanned ORDER BY reply DESC, line_no DESC) = 1)
SELECT pos, header, CASE WHEN scanned IS NULL THEN 'no match' ELSE 'suggested' END AS outcome, target, confidence FROM sent LEFT JOIN last ON scanned = header"""

    o["applicable_mappings"] = f"WITH {plan_ctes(ORDER_CELLS)} SELECT * FROM applicable"
    o["uncovered_targets"] = f"""WITH {plan_ctes(ORDER_CELLS)} SELECT b.file, b.sheet, l.target FROM bounds b, layout l
WHERE NOT EXISTS (SELECT 1 FROM applicable a WHERE a.file = b.file AND a.sheet = b.sheet AND a.target = l.target)"""
    whole = f"WITH {format_ctes(ORDER_CELLS)}"
    o["format_sheet"] = f"{whole} SELECT * FROM formatted"

    def renumbered(columns: tuple[str, ...]) -> str:
        return f"""SELECT file, sheet, row_number() OVER (PARTITION BY file, sheet ORDER BY target_row) + 1 AS target_row, {', '.join(columns)}
FROM formatted WHERE {any_data(columns)}"""

    o["drop_empty_rows"] = f"WITH {format_ctes(ORDER_CELLS, NARROW)} {renumbered(NARROW)}"
    o["format_all"] = f"{whole} {renumbered(LAYOUT)}"
    o["sink_round_trip"] = o["format_all"]
    o["format_projected"] = o["format_all"]
    o["sheets_by_folder"] = f"""WITH {bounds_ctes(CONVERSATION_CELLS)},
named AS (SELECT c.file, c.sheet, c.row, max(CASE WHEN c.col = 1 THEN value END) AS speaker, max(CASE WHEN c.col = 2 THEN value END) AS words
  FROM cells c JOIN bounds b ON b.file = c.file AND b.sheet = c.sheet WHERE c.row > header_row GROUP BY ALL)
SELECT file, sheet, 1 + row_number() OVER (PARTITION BY file, sheet ORDER BY row) AS target_row, speaker, words FROM named
WHERE {has_text('speaker')} OR {has_text('words')}"""
    o["fill_rows"] = f"""{whole}, every AS (SELECT file, sheet, unnest(range(2, 1 + max_row - header_row + 1)) AS target_row FROM bounds)
SELECT file, sheet, target_row, {', '.join(LAYOUT)} FROM every LEFT JOIN formatted USING (file, sheet, target_row)"""
    o["format_extent"] = f"WITH {bounds_ctes(ALL_CELLS)} SELECT file, sheet, greatest(7, 2 + max_row - header_row) AS last_target_row FROM bounds"
    o["typed_columns"] = f"""{whole} SELECT file, sheet, target_row, CAST(part_id AS BIGINT) AS part_id, TRY_CAST(supplier_id AS BIGINT) AS supplier_id,
  TRY_CAST(qty AS BIGINT) AS qty, flag, note FROM formatted"""
    o["column_formats"] = f"""{whole}, used AS (SELECT target, dtype, nf, regexp_matches(value, '^-?[0-9]+$') AS whole FROM copied WHERE {COPIED}),
nfs AS (SELECT target, nf, count(*) AS n FROM used WHERE nf <> 'General' GROUP BY target, nf),
best AS (SELECT target, nf FROM nfs QUALIFY row_number() OVER (PARTITION BY target ORDER BY n DESC, nf) = 1)
SELECT u.target, CASE WHEN min(dtype) = 'n' AND max(dtype) = 'n' THEN CASE WHEN bool_and(whole) THEN 'bigint' ELSE 'double' END ELSE 'string' END AS column_type,
  any_value(best.nf) AS number_format, count(*) AS cells FROM used u LEFT JOIN best USING (target) GROUP BY u.target"""
    columns = ("part_id", "column_2", "supplier_id", "flag", "note", "flag_6")
    o["template_overlay"] = f"""WITH {format_ctes(ORDER_CELLS, ('part_id', 'supplier_id', 'flag', 'note'), 2)}, {_TEMPLATE},
own AS (SELECT file, sheet, target_row, part_id, NULL AS column_2, supplier_id, flag, note, flag AS flag_6 FROM formatted WHERE {any_data(('part_id', 'supplier_id', 'flag', 'note'))}),
fixed AS (SELECT file, sheet, t.* FROM bounds, template t),
both_rows AS (SELECT file, sheet, target_row, coalesce(o.part_id, f.part_id) AS part_id, f.column_2, coalesce(o.supplier_id, f.supplier_id) AS supplier_id,
  coalesce(o.flag, f.flag) AS flag, coalesce(o.note, f.note) AS note, coalesce(o.flag_6, f.flag_6) AS flag_6 FROM own o FULL JOIN fixed f USING (file, sheet, target_row)),
kept AS (SELECT * FROM both_rows WHERE target_row = 2 OR {any_data(columns)})
SELECT file, sheet, row_number() OVER (PARTITION BY file, sheet ORDER BY target_row) AS target_row, {', '.join(columns)} FROM kept"""

    three = ("supplier_id", "flag", "note")
    o["format_summary"] = f"""WITH {format_ctes(ORDER_CELLS, three)},
counts AS (SELECT file, sheet, count(*) FILTER (WHERE {COPIED}) AS cells_copied, count(*) FILTER (WHERE starts_with(value, '=')) AS formulas_skipped,
  count(DISTINCT CASE WHEN {COPIED} THEN target_row END) AS kept FROM copied GROUP BY file, sheet),
maps AS (SELECT file, sheet, count(*) AS mapped FROM applicable GROUP BY file, sheet)
SELECT b.file, b.sheet, CAST(3 AS BIGINT) AS columns_processed, coalesce(mapped, 0) AS columns_mapped, 3 - coalesce(mapped, 0) AS columns_skipped,
  coalesce(cells_copied, 0) AS cells_copied, coalesce(formulas_skipped, 0) AS formulas_skipped, max_row - header_row - coalesce(kept, 0) AS rows_removed
FROM bounds b LEFT JOIN counts USING (file, sheet) LEFT JOIN maps USING (file, sheet)"""
    o["rejects"] = f"WITH {plan_ctes(ALL_CELLS)}, {REJECTS} SELECT * FROM rejects"
    o["batch_summary"] = f"""WITH {plan_ctes(ALL_CELLS)}, {REJECTS},
status AS (SELECT DISTINCT file, CASE WHEN file IN (SELECT file FROM rejects WHERE reason <> 'no header') THEN 'error' ELSE 'success' END AS status FROM bounds)
SELECT status, count(*) AS files FROM status GROUP BY status"""
    o["output_names"] = rf"""WITH {bounds_ctes(ALL_CELLS)},
n AS (SELECT file, sheet, concat(regexp_replace(regexp_extract(file, '[^/]*$', 0), '(.)[.][^.]*$', '\1'), '-', sheet) AS output FROM bounds)
SELECT file, sheet, output, count(*) OVER (PARTITION BY output) AS sheets FROM n"""
    o["published_runs"] = o["stats_append"]
    unique = """SELECT file, sheet, CASE WHEN count(*) OVER (PARTITION BY lower(output)) > 1 OR strlen(output) > 120 THEN
  concat(CASE WHEN strlen(output) > 120 THEN left(output, 30) ELSE output END, '-', left(sha256(to_json([file, sheet])), 32)) ELSE output END AS output FROM n"""
    o["unique_names"] = f"{o['output_names'][: o['output_names'].rindex('SELECT')]}{unique}"
    o["sheets_by_name"] = rf"""WITH n AS (SELECT DISTINCT file, sheet, concat(regexp_replace(regexp_extract(file, '[^/]*$', 0), '(.)[.][^.]*$', '\1'), '-', sheet) AS output
  FROM ({o['sheets_by_folder']}) x), named AS ({unique})
SELECT r.*, output FROM ({o['sheets_by_folder']}) r JOIN named USING (file, sheet)"""
    o["decision_stream"] = o["decision_fold"]
    return o
