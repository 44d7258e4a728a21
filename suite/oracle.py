"""SQL twins of the queries, written from the meaning of each operator.

Where a query reads rendered pages, the twin computes the expected rows from the
row that was printed; it never looks at positions.
"""

from __future__ import annotations

from inkgrid import fixed

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- A1 ------------------------------------------------------------------------

TOK = r"""
docs AS (SELECT doc_id AS d, regexp_split_to_array(text, '\s+') AS t FROM documents),
tok0 AS (SELECT d, unnest(range(0, len(t))) AS i, unnest(t) AS text FROM docs),
tok AS (
  SELECT CAST(d AS VARCHAR) AS doc_id, CAST(1 + (i // 12) // 50 AS INTEGER) AS page,
    CAST((i // 12) % 50 AS INTEGER) AS slot, CAST(i AS INTEGER) AS word_seq, text,
    40.0 * (i % 12) AS x0, 40.0 * (i % 12) + 5.0 * length(text) AS x1,
    14.0 * ((i // 12) % 50) + 0.5 * (i % 3) AS top,
    14.0 * ((i // 12) % 50) + 0.5 * (i % 3) + 8.0 + (i % 5) AS bottom
  FROM tok0 WHERE text <> ''),
placed AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY slot) - 1 AS INTEGER) AS line_no,
    CAST(row_number() OVER (PARTITION BY doc_id, page, slot ORDER BY x0) - 1 AS INTEGER) AS line_pos
  FROM tok)
"""
LINES = TOK + """,
lines AS (
  SELECT doc_id, page, line_no, min(top) AS top, max(bottom) AS bottom,
    string_agg(text, ' ' ORDER BY line_pos) AS text
  FROM placed GROUP BY ALL)
"""
PAGES = TOK + """,
pg AS (
  SELECT CAST(d AS VARCHAR) AS doc_id,
    CAST(unnest(range(1, CAST(ceil(len(t) / 600.0) AS BIGINT) + CASE WHEN d % 7 = 0 THEN 1 ELSE 0 END + 1)) AS INTEGER) AS page
  FROM docs),
wpp AS (
  SELECT pg.doc_id, pg.page, count(tok.word_seq) AS n_words
  FROM pg LEFT JOIN tok ON tok.doc_id = pg.doc_id AND tok.page = pg.page GROUP BY ALL)
"""

sql("cluster_lines", f"""WITH {TOK} SELECT doc_id, page, line_no, count(*) AS n, min(word_seq) AS first_word,
  max(word_seq) AS last_word, max(line_pos) AS last_pos FROM placed GROUP BY ALL""")
sql("cluster_slanted_lines", f"""WITH RECURSIVE {TOK},
  low AS (SELECT doc_id, page, word_seq, x0, top + 0.9 * (word_seq % 12) AS t, bottom + 0.9 * (word_seq % 12) AS b FROM tok),
  mid AS (SELECT *, (t + b) / 2 AS cy, greatest(2.0, 0.6 * median(b - t) OVER (PARTITION BY doc_id, page)) AS tol FROM low),
  pages AS (SELECT doc_id, page, any_value(tol) AS tol, list_sort(list(DISTINCT cy)) AS cys FROM mid GROUP BY ALL),
  refs AS (
    SELECT doc_id, page, tol, cys, cys[1] AS ref, 0 AS line_no FROM pages
    UNION ALL
    SELECT doc_id, page, tol, beyond, beyond[1], line_no + 1
    FROM (SELECT *, list_filter(cys, lambda c: c - ref > tol) AS beyond FROM refs) WHERE len(beyond) > 0),
  spans AS (SELECT doc_id, page, line_no, ref, lead(ref) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS following FROM refs),
  met AS (SELECT m.*, s.line_no, row_number() OVER (PARTITION BY m.doc_id, m.page, s.line_no ORDER BY x0, cy, word_seq) - 1 AS pos
    FROM mid m JOIN spans s ON s.doc_id = m.doc_id AND s.page = m.page AND m.cy >= s.ref AND (s.following IS NULL OR m.cy < s.following))
  SELECT doc_id, page, line_no, count(*) AS n, CAST(sum(word_seq) AS BIGINT) AS seqs, CAST(max(pos) AS INTEGER) AS last_pos,
    max(CASE WHEN pos = 0 THEN word_seq END) AS leftmost FROM met GROUP BY ALL""")
sql("line_text", f"WITH {LINES} SELECT doc_id, page, line_no, text FROM lines")
sql("agg_line_bounds", f"WITH {LINES} SELECT doc_id, page, line_no, top, bottom FROM lines")
sql("page_text", f"""WITH {LINES}, t AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL)
  SELECT doc_id, page, md5(text) AS digest, CAST(length(text) AS INTEGER) AS chars FROM t""")
# Ratcliff-Obershelp: the longest common block (of equals the first in the word, then in the title), then the same left and
# right of it. A block is one number: less is longer, then earlier.
sql("title_similarity_of_words", r"""WITH RECURSIVE
  w AS (SELECT DISTINCT lower(strip_accents(unnest(regexp_split_to_array(text, '\s+')))) AS w FROM documents),
  part AS (
    SELECT w, CAST(0 AS BIGINT) AS a0, CAST(length(w) AS BIGINT) AS a1, CAST(0 AS BIGINT) AS b0, CAST(7 AS BIGINT) AS b1, CAST(0 AS BIGINT) AS k FROM w
    UNION ALL
    SELECT w, unnest([a0, i + size]) , unnest([i, a1]), unnest([b0, j + size]), unnest([j, b1]), unnest([size, 0])
    FROM (
      SELECT w, a0, a1, b0, b1, (100 - best // 1000000000) AS size, (best % 1000000000) // 10 AS i, best % 10 AS j
      FROM (
        SELECT *, list_min(flatten(flatten(list_transform(range(a0, a1), lambda i: list_transform(range(b0, b1), lambda j:
          list_transform(list_filter(range(1, least(a1 - i, b1 - j) + 1), lambda n: substr(w, i + 1, n) = substr('entrada', j + 1, n)),
            lambda n: (100 - n) * 1000000000 + i * 10 + j)))))) AS best
        FROM part WHERE a0 < a1 AND b0 < b1)
      WHERE best IS NOT NULL))
  SELECT w, 2.0 * CAST(sum(k) AS DOUBLE) / (length(w) + 7) AS ratio FROM part GROUP BY w""")
sql("order_reading", f"""WITH {LINES} SELECT doc_id, page, arg_min(text, line_no) AS first_line, arg_max(text, line_no) AS last_line
  FROM lines GROUP BY ALL""")
sql("order_in_line", f"WITH {TOK} SELECT doc_id, page, line_pos, count(*) AS n, CAST(sum(word_seq) AS BIGINT) AS seqs FROM placed GROUP BY ALL")
sql("join_prev_line", f"""WITH {LINES} SELECT doc_id, page, line_no, text,
  coalesce(lag(text) OVER (PARTITION BY doc_id, page ORDER BY line_no), '') AS line_above FROM lines""")
sql("words_between", f"""WITH {TOK} SELECT doc_id, page, line_no,
  CAST(count(*) FILTER (WHERE (x0 + x1) / 2 >= 100 AND (x0 + x1) / 2 < 300) AS INTEGER) AS n,
  coalesce(string_agg(text, ' ' ORDER BY line_pos) FILTER (WHERE (x0 + x1) / 2 >= 100 AND (x0 + x1) / 2 < 300), '') AS text
  FROM placed GROUP BY ALL""")
sql("join_column_range", f"""WITH {TOK}, c AS (SELECT doc_id, page, word_seq, (x0 + x1) / 2 AS cx FROM tok),
  o AS (SELECT *, CASE WHEN cx < 450 THEN CAST(floor(cx / 90) AS INTEGER) ELSE 5 END AS ord FROM c WHERE cx < 600)
  SELECT doc_id, page, ord, count(*) AS n, CAST(sum(word_seq) AS BIGINT) AS seqs FROM o GROUP BY ALL""")
sql("agg_median_height", f"""WITH {TOK} SELECT doc_id, page, median(bottom - top) AS median_height FROM tok GROUP BY ALL""")
sql("agg_mean_width", f"""WITH {TOK} SELECT doc_id, page, line_no, avg(x1 - x0) AS mean_width FROM placed GROUP BY ALL""")
sql("agg_words_per_page", f"WITH {PAGES} SELECT * FROM wpp")
sql("page_is_empty", f"WITH {PAGES} SELECT doc_id, page, n_words = 0 AS is_empty FROM wpp")
sql("source_choice", f"""WITH {PAGES} SELECT doc_id, page, n_words,
  CASE WHEN n_words < 40 THEN 'ocr' ELSE 'texto_nativo' END AS source FROM wpp""")
DELIVERED = "(CAST(doc_id AS BIGINT) + page) % 3 <> 0"
sql("replace_pages", f"""WITH {PAGES} SELECT doc_id, page, n_words,
  CASE WHEN n_words < 300 AND {DELIVERED} THEN 'ocr' ELSE 'texto_nativo' END AS source FROM wpp""")
sql("sorted_distinct_pages", f"WITH {PAGES} SELECT doc_id, page FROM wpp WHERE n_words < 300")
sql("join_page_replace", f"""WITH {PAGES} SELECT tok.doc_id, tok.page, count(*) AS n,
  sum(top + CASE WHEN n_words < 300 AND (CAST(tok.doc_id AS BIGINT) + tok.page) % 3 <> 0 THEN 1 ELSE 0 END) AS tops
  FROM tok JOIN wpp ON tok.doc_id = wpp.doc_id AND tok.page = wpp.page GROUP BY ALL""")
sql("intake_page_limit", f"""WITH {PAGES} SELECT doc_id, max(page) AS n_pages,
  CASE WHEN max(page) > 6 THEN 'too_many_pages' END AS verdict FROM pg GROUP BY ALL""")
sql("src_words_json", f"""WITH {PAGES} SELECT doc_id, page, count(*) AS n, sum(round(x1, 2)) AS sum_x1,
  sum(round(bottom, 2)) AS sum_bottom, CAST(0 AS BIGINT) AS n_conf FROM tok GROUP BY ALL""")
sql("src_native_words", f"""WITH {TOK} SELECT doc_id, page, count(*) AS n, CAST(0 AS BIGINT) AS n_conf, CAST(sum(length(text)) AS BIGINT) AS chars
  FROM tok WHERE word_seq % 9 <> 0 GROUP BY ALL""")
OCR = TOK + """,
ocr AS (
  SELECT doc_id, page, text, CAST(word_seq % 101 AS DOUBLE) AS confidence, CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN 300 ELSE 200 END AS dpi,
    word_seq % 12 * 166 AS l, (word_seq // 12) % 50 * 58 AS t, length(text) * 20 AS w
  FROM tok WHERE word_seq % 17 <> 0 AND word_seq % 11 <> 0 AND word_seq % 13 <> 0)
"""
sql("src_ocr_tsv_words", f"""WITH {OCR} SELECT doc_id, page, count(*) AS n, sum(confidence) AS conf, min(confidence) AS lowest,
  round(sum((l + w) / (dpi / 72.0)), 3) AS x1, round(sum((t + 42) / (dpi / 72.0)), 3) AS bottom, CAST(sum(length(text)) AS BIGINT) AS chars
  FROM ocr GROUP BY ALL""")
sql("agg_confidence_stats", f"""WITH {OCR} SELECT doc_id, count(*) AS n, min(confidence) AS min_conf, round(quantile_cont(confidence, 0.1), 6) AS p10_conf,
  median(confidence) AS median_conf, count(*) FILTER (WHERE confidence < 30) AS below_30
  FROM ocr WHERE length(text) > 3 GROUP BY ALL""")
sql("block_id", f"""WITH {LINES}, b AS (
    SELECT *, CAST(sum(CASE WHEN regexp_matches(text, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS INTEGER) AS entry_no
    FROM lines)
  SELECT doc_id, page, entry_no, count(*) AS n_lines, arg_min(text, line_no) AS opening_line FROM b WHERE entry_no >= 0 GROUP BY ALL""")
sql("cell_grouping", f"""WITH {TOK}, m AS (
    SELECT *, greatest(0.8 * avg(x1 - x0) OVER (PARTITION BY doc_id, page, line_no), 8.0) AS lim,
      x0 - lag(x1) OVER (PARTITION BY doc_id, page, line_no ORDER BY line_pos) AS gap FROM placed),
  g AS (SELECT *, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_no ORDER BY line_pos) AS cell_no FROM m)
  SELECT doc_id, page, line_no, CAST(cell_no AS INTEGER) AS cell_no, string_agg(text, ' ' ORDER BY line_pos) AS label,
    (min(x0) + arg_max(x1, line_pos)) / 2 AS centre FROM g GROUP BY ALL""")
sql("code_column_cut", f"""WITH {TOK}, c AS (
    SELECT doc_id, x0 FROM tok WHERE word_seq % 5 = 0 OR regexp_full_match(text, '[0-9][0-9][0-9]')),
  r AS (SELECT doc_id, x0, row_number() OVER (PARTITION BY doc_id ORDER BY x0) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM c)
  SELECT doc_id, x0 - 5.0 AS cut FROM r WHERE n >= 3 AND k = n // 2""")
sql("normalize_text", "SELECT doc_id, md5(lower(regexp_replace(strip_accents(text), '^\\s+', '', 'g')) || ' oficial no 1\u20442 a \u1100\u1161\u11a8') AS digest FROM documents")


def brl(cents: str) -> str:
    return f"(replace(format('{{:,}}', ({cents}) // 100), ',', '.') || ',' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))"


MONEY = "'-?[0-9]{1,3}([.][0-9]{3})*,[0-9]{2}'"

# --- A6 ------------------------------------------------------------------------

A6 = TOK.replace("WHERE text <> ''", "") + f""",
a6_0 AS (
  SELECT doc_id, CAST(word_seq // 12 AS INTEGER) AS line_no, word_seq AS i,
    CASE WHEN word_seq % 6 = 0 THEN {brl('CAST(word_seq AS BIGINT) * 137')}
      WHEN word_seq % 5 = 4 THEN regexp_replace(text, ':+$', '') || ':'
      ELSE regexp_replace(text, '[:,]+$', '') END AS t
  FROM tok),
a6 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS k,
    regexp_full_match(t, {MONEY}) AS money, t LIKE '%:' AS ends
  FROM a6_0 WHERE t <> '')
"""
sql("first_money_in_line", f"WITH {A6} SELECT doc_id, line_no, arg_min(t, k) AS value FROM a6 WHERE money GROUP BY ALL")
sql("last_money_in_line", f"WITH {A6} SELECT doc_id, line_no, arg_max(t, k) AS value FROM a6 WHERE money GROUP BY ALL")
sql("label_value_pairs", f"""WITH {A6}, v AS (
    SELECT *, money AND coalesce(lag(ends) OVER w, false) AS is_value, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
    FROM a6 WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY k)),
  labels AS (
    SELECT doc_id, line_no, grp, trim(regexp_replace(string_agg(t, ' ' ORDER BY k) FILTER (WHERE NOT is_value), ':$', '')) AS label
    FROM v GROUP BY ALL HAVING bool_or(ends)),
  vals AS (SELECT doc_id, line_no, grp - 1 AS grp, t AS value FROM v WHERE is_value),
  p AS (SELECT l.*, coalesce(vals.value, '') AS value FROM labels l LEFT JOIN vals USING (doc_id, line_no, grp) WHERE label <> ''),
  k AS (SELECT *, max(value <> '') OVER (PARTITION BY doc_id, line_no) AS kept FROM p)
  SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY grp) - 1 AS INTEGER) AS pair_no, label, value FROM k WHERE kept""")
sql("is_value_line", rf"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS t, unnest(range(0, len(regexp_split_to_array(text, '\s+')))) AS i FROM documents)
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i // 5 AS INTEGER) AS line_no, CAST(count(*) AS INTEGER) AS n,
    count(*) FILTER (WHERE money) >= 3 AND count(*) FILTER (WHERE NOT money) <= 2 AS is_values
  FROM (SELECT doc_id, i, ((i // 5) >> (i % 5)) % 2 = 1 OR regexp_full_match(t, {MONEY}) AS money FROM t) GROUP BY doc_id, i // 5""")

# --- A2 ------------------------------------------------------------------------


def clock(token: str) -> str:
    """raw and norm of a clock token, as two SQL expressions."""
    h, m, s = (f"regexp_extract({token}, '^[+]?([^:]{{1,2}}):([^:]{{2}})(.?)$', {k})" for k in (1, 2, 3))
    dig = lambda x: f"regexp_replace({x}, '[^0-9]', '?', 'g')"
    raw = (
        f"(CASE WHEN {token} LIKE '+%' THEN '+' ELSE '' END || {dig(h)} || ':' || {dig(m)} || "
        f"CASE WHEN {s} = '' OR regexp_full_match({s}, '[A-Za-z]') THEN {s} ELSE '?' END)"
    )
    part = lambda x, top: (
        f"CASE WHEN regexp_full_match({x}, '[0-9]+') AND TRY_CAST({x} AS INTEGER) <= {top} THEN lpad({x}, 2, '0') ELSE '??' END"
    )
    return raw, f"({part(h, 23)} || ':' || {part(m, 59)})"


RAW, NORM = clock("token")
A2 = f"""
log AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS doc_id, ts, CAST(ts AS DATE) AS day,
    CAST((year(ts) - 2024) * 12 + month(ts) - 1 AS INTEGER) AS page_pos, CAST(day(ts) - 1 AS INTEGER) AS day_pos,
    CASE WHEN event_id % 53 = 0 THEN 'O' || substr(strftime(ts, '%H:%M'), 2)
      WHEN event_id % 97 = 0 THEN strftime(ts, '%H:%M') || '€'
      WHEN event_id % 5 = 0 THEN strftime(ts, '%H:%M') || 'd' ELSE strftime(ts, '%H:%M') END AS token
  FROM events),
days AS (
  SELECT doc_id, page_pos, day_pos, day, CASE WHEN min(event_id) % 61 = 0 THEN '?' || substr(strftime(day, '%d/%m/%Y'), 2)
    ELSE strftime(day, '%d/%m/%Y') END AS date_raw
  FROM log GROUP BY doc_id, page_pos, day_pos, day),
punches AS (
  SELECT doc_id, page_pos, day_pos, event_id, CAST(row_number() OVER w - 1 AS INTEGER) AS punch_pos,
    CASE WHEN row_number() OVER w % 2 = 1 THEN 'IN' ELSE 'OUT' END AS kind, {RAW} AS time_raw, {NORM} AS time_hhmm
  FROM log WINDOW w AS (PARTITION BY doc_id, day ORDER BY ts, event_id)),
"""


def chain(days: str, punches: str, prefix: str = "") -> str:
    """CTEs from days and punches to findings per day."""
    p = prefix
    return f"""
{p}sum_ AS (
  SELECT d.doc_id, d.page_pos, d.day_pos, d.date_raw, CAST(count(p.punch_pos) AS INTEGER) AS n_punches,
    d.date_raw LIKE '%?%' OR coalesce(bool_or(p.time_raw LIKE '%?%' OR p.time_hhmm LIKE '%?%'), false) AS marked
  FROM {days} d LEFT JOIN {punches} p USING (doc_id, page_pos, day_pos)
  GROUP BY d.doc_id, d.page_pos, d.day_pos, d.date_raw),
{p}dat AS (
  SELECT *, CASE WHEN regexp_full_match(date_raw, '[0-9]+/[0-9]+/[0-9]+') THEN TRY_CAST(
      split_part(date_raw, '/', 3) || '-' || split_part(date_raw, '/', 2) || '-' || split_part(date_raw, '/', 1) AS DATE) END AS dt
  FROM {p}sum_),
{p}prv AS (
  SELECT *, last_value(dt IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_pos, day_pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {p}dat),
{p}brk AS (
  SELECT *, CASE WHEN dt IS NULL THEN regexp_full_match(date_raw, '[0-9]+/[0-9]+/[0-9]+')
    ELSE coalesce(dt <> before + 1, false) END AS date_break FROM {p}prv),
{p}found AS (
  SELECT *, concat_ws(',', CASE WHEN n_punches % 2 = 1 THEN 'batidas_impares' END,
      CASE WHEN date_break THEN 'data_nao_sequencial' END, CASE WHEN marked THEN 'leitura_incerta' END) AS codes,
    concat_ws(' ', CASE WHEN n_punches % 2 = 1 THEN {q(fixed.ODD_PUNCHES[1])} END,
      CASE WHEN date_break THEN {q(fixed.DATE_BREAK[1])} END, CASE WHEN marked THEN {q(fixed.UNCERTAIN[1])} END) AS reasons,
    CASE WHEN date_break THEN 'vermelho' WHEN n_punches % 2 = 1 OR marked THEN 'amarelo' END AS severity
  FROM {p}brk)
"""


A2F = A2 + chain("days", "punches")

sql("read_clock", f"WITH {A2} x AS (SELECT event_id, token, {RAW} AS raw, {NORM} AS norm FROM log) SELECT *, raw LIKE '%?%' OR norm LIKE '%?%' AS uncertain FROM x")
sql("punch_ordinal", f"WITH {A2F} SELECT doc_id, page_pos, day_pos, punch_pos, kind, time_raw, time_hhmm FROM punches")
sql("find_date_break", f"WITH {A2F} SELECT doc_id, page_pos, day_pos, date_raw, date_break FROM found")
sql("find_odd_punches", f"WITH {A2F} SELECT doc_id, page_pos, day_pos, n_punches % 2 = 1 AS odd FROM found")
sql("find_uncertain", f"WITH {A2F} SELECT doc_id, page_pos, day_pos, marked FROM found")
sql("severity", f"WITH {A2F} SELECT doc_id, page_pos, day_pos, codes, severity FROM found")
sql("severity_style", f"""WITH {A2F} SELECT severity, CASE severity WHEN 'vermelho' THEN 'F8D7DA' WHEN 'amarelo' THEN 'FFF3CD' END AS fill,
  CASE WHEN severity = 'vermelho' THEN 'DC3545' END AS left_border, count(*) AS n FROM found GROUP BY ALL""")
sql("agg_review_summary", f"WITH {A2F} SELECT doc_id, count(*) AS rows_total, count(severity) AS rows_flagged FROM found GROUP BY ALL")
sql("agg_max_punches", f"WITH {A2F} SELECT doc_id, max(n_punches) AS max_punches, CAST((max(n_punches) + 1) // 2 AS INTEGER) AS pairs FROM found GROUP BY ALL")
sql("agg_doc_totals", f"""WITH {A2F} SELECT doc_id, count(DISTINCT page_pos) AS pages, count(*) AS days, CAST(sum(n_punches) AS BIGINT) AS punches,
  count(*) FILTER (WHERE marked) AS marked FROM found GROUP BY ALL""")


def ts_header(col: str) -> str:
    return (
        f"CASE WHEN {col} = 0 THEN 'Data' WHEN {col} % 2 = 1 THEN 'Entrada ' || ({col} + 1) // 2 ELSE 'Saída ' || ({col} + 1) // 2 END"
    )


def ts_grid(days: str, punches: str) -> str:
    """CTE ``grid`` from days with n_punches and flat punches."""
    return f"""
wide AS (SELECT doc_id, 2 * ((max(n_punches) + 1) // 2) AS cols FROM {days} GROUP BY ALL),
slots AS (SELECT d.doc_id, d.page_pos, d.day_pos, d.date_raw, CAST(unnest(range(0, wide.cols + 1)) AS INTEGER) AS col_pos FROM {days} d JOIN wide USING (doc_id)),
grid AS (
  SELECT s.doc_id, s.page_pos, s.day_pos, s.col_pos, {ts_header('s.col_pos')} AS header,
    CASE WHEN s.col_pos = 0 THEN s.date_raw ELSE coalesce(p.time_hhmm, '') END AS value,
    CASE WHEN s.col_pos = 0 THEN 'pages.' || s.page_pos || '.days.' || s.day_pos || '.date_raw'
      WHEN p.punch_pos IS NOT NULL THEN 'pages.' || s.page_pos || '.days.' || s.day_pos || '.punches.' || p.punch_pos || '.time_hhmm'
      ELSE '' END AS path
  FROM slots s LEFT JOIN {punches} p ON p.doc_id = s.doc_id AND p.page_pos = s.page_pos AND p.day_pos = s.day_pos AND p.punch_pos = s.col_pos - 1)
"""


sql("grid_timesheet", f"WITH {A2F}, {ts_grid('found', 'punches')} SELECT * FROM grid")

EDITS = A2 + """
cor0 AS (
  SELECT doc_id, ts, event_id,
    CASE WHEN event_id % 30 = 0 THEN 'pages.' || page_pos || '.days.' || day_pos || '.date_raw'
      WHEN event_id % 70 = 0 THEN 'pages.' || page_pos || '.days.' || day_pos || '.nothing'
      ELSE 'pages.' || page_pos || '.days.' || day_pos || '.punches.' || (event_id % 4) || '.time_hhmm' END AS path,
    CASE WHEN event_id % 30 = 0 THEN strftime(day, '%d/%m/%Y') ELSE strftime(ts, '%H:%M') END AS new_value
  FROM log),
cor AS (SELECT doc_id, path, arg_max(new_value, ts) AS new_value FROM cor0 GROUP BY ALL),
cdays AS (
  SELECT d.doc_id, d.page_pos, d.day_pos, coalesce(c.new_value, d.date_raw) AS date_raw FROM days d
  LEFT JOIN cor c ON c.doc_id = d.doc_id AND c.path = 'pages.' || d.page_pos || '.days.' || d.day_pos || '.date_raw'),
cpunches AS (
  SELECT p.doc_id, p.page_pos, p.day_pos, p.punch_pos, p.time_raw, coalesce(c.new_value, p.time_hhmm) AS time_hhmm FROM punches p
  LEFT JOIN cor c ON c.doc_id = p.doc_id AND c.path = 'pages.' || p.page_pos || '.days.' || p.day_pos || '.punches.' || p.punch_pos || '.time_hhmm'),
"""
sql("join_corrections", f"WITH {EDITS} z AS (SELECT 1) SELECT * FROM cpunches")
sql("compacted_corrections", f"WITH {EDITS} z AS (SELECT 1) SELECT doc_id, path, arg_max(new_value, (ts, new_value)) AS new_value FROM cor0 GROUP BY ALL")
sql("apply_path", f"WITH {EDITS} z AS (SELECT 1) SELECT * FROM cdays")
sql("apply_corrections", f"WITH {EDITS} {chain('cdays', 'cpunches')} SELECT doc_id, page_pos, day_pos, codes, severity FROM found")
sql("reject_corrections", f"""WITH {EDITS} z AS (SELECT 1) SELECT c.doc_id, c.path, c.new_value FROM cor c
  LEFT JOIN punches p ON p.doc_id = c.doc_id AND c.path = 'pages.' || p.page_pos || '.days.' || p.day_pos || '.punches.' || p.punch_pos || '.time_hhmm'
  WHERE p.doc_id IS NULL AND c.path NOT LIKE '%date_raw'""")

# --- A3 ------------------------------------------------------------------------

A3 = f"""
ent AS (
  SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS entry_pos,
    CASE WHEN o_orderkey % 23 = 0 THEN '?2' ELSE strftime(o_orderdate, '%m') END AS month, strftime(o_orderdate, '%Y') AS year,
    CASE WHEN o_orderkey % 29 <> 0 THEN 1 ELSE 0 END AS n_bases
  FROM orders),
li AS (
  SELECT l_orderkey, lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS code, p_type AS label, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',00' AS reference,
    {brl('CAST(round(l_extendedprice * 100) AS BIGINT)')} AS amount,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INTEGER) AS field_pos
  FROM lineitem JOIN part ON l_partkey = p_partkey),
fld AS (
  SELECT doc_id, entry_pos, field_pos, code, label, reference,
    CASE WHEN l_orderkey % 41 = 0 THEN substr(amount, 1, length(amount) - 1) || '?' ELSE amount END AS value
  FROM li JOIN ent ON o_orderkey = l_orderkey),
esum AS (
  SELECT e.doc_id, e.entry_pos, e.year, e.month, e.n_bases, CAST(count(f.value) AS INTEGER) AS n_fields,
    e.month LIKE '%?%' OR coalesce(bool_or(f.value LIKE '%?%'), false) AS marked
  FROM ent e LEFT JOIN fld f USING (doc_id, entry_pos) GROUP BY e.doc_id, e.entry_pos, e.year, e.month, e.n_bases),
eidx AS (SELECT *, CASE WHEN month NOT LIKE '%?%' THEN CAST(year AS BIGINT) * 12 + CAST(month AS BIGINT) END AS idx FROM esum),
eprv AS (
  SELECT *, last_value(idx IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY entry_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM eidx),
efound AS (
  SELECT *, coalesce(idx <> before + 1, false) AS month_break, n_fields = 0 AND n_bases = 0 AS is_void FROM eprv),
lab AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY e, f) - 1 AS label_no
  FROM (SELECT doc_id, label, min(entry_pos) AS e, arg_min(field_pos, entry_pos * 1000000 + field_pos) AS f FROM fld GROUP BY ALL)),
fst AS (SELECT doc_id, entry_pos, label, min(field_pos) AS field_pos, arg_min(value, field_pos) AS value FROM fld GROUP BY ALL)
"""
sql("payslip_contract", f"""WITH {A3}, r AS (SELECT doc_id, CASE WHEN o_orderkey % 9 = 1 THEN 'page missing' WHEN o_orderkey % 9 = 2 THEN 'month or year missing'
    WHEN o_orderkey % 9 = 3 THEN 'month unknown' WHEN o_orderkey % 9 = 4 THEN 'list missing' WHEN o_orderkey % 9 = 5 THEN 'field text missing'
    WHEN o_orderkey % 9 = 6 THEN 'base text missing' END AS reason FROM ent WHERE CAST(doc_id AS BIGINT) % 19 <> 3
    UNION ALL (SELECT DISTINCT doc_id, 'value unreadable' FROM ent WHERE CAST(doc_id AS BIGINT) % 19 = 3))
  SELECT doc_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL""")
PEDITS = A3 + f""",
bas AS (SELECT doc_id, entry_pos, 0 AS base_pos, 'Total' AS label, {brl('CAST(round(o_totalprice * 100) AS BIGINT)')} AS value
  FROM ent JOIN orders USING (o_orderkey) WHERE o_orderkey % 29 <> 0),
pcor AS (
  SELECT doc_id, 'pages.' || entry_pos || CASE o_orderkey % 6 WHEN 0 THEN '.month' WHEN 1 THEN '.year' WHEN 2 THEN '.bases.0.value'
      WHEN 3 THEN '.fields.' || (o_orderkey % 5) || '.value' WHEN 4 THEN '.bases.3.label' ELSE '.fields.0.colour' END AS path,
    CASE WHEN o_orderkey % 4 = 0 THEN '?' WHEN o_orderkey % 6 = 0 THEN lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0')
      WHEN o_orderkey % 6 = 1 THEN CAST(2000 + o_orderkey % 9 AS VARCHAR) ELSE {brl('o_orderkey')} END AS new_value FROM ent),
pent AS (
  SELECT e.doc_id, e.entry_pos, coalesce(m.new_value, e.month) AS month, coalesce(y.new_value, e.year) AS year FROM ent e
  LEFT JOIN pcor m ON m.doc_id = e.doc_id AND m.path = 'pages.' || e.entry_pos || '.month'
  LEFT JOIN pcor y ON y.doc_id = e.doc_id AND y.path = 'pages.' || e.entry_pos || '.year'),
pfld AS (
  SELECT f.doc_id, f.entry_pos, f.field_pos, f.code, f.label, f.reference, coalesce(c.new_value, f.value) AS value FROM fld f
  LEFT JOIN pcor c ON c.doc_id = f.doc_id AND c.path = 'pages.' || f.entry_pos || '.fields.' || f.field_pos || '.value'),
pbas AS (
  SELECT b.doc_id, b.entry_pos, b.base_pos, b.label, coalesce(c.new_value, b.value) AS value FROM bas b
  LEFT JOIN pcor c ON c.doc_id = b.doc_id AND c.path = 'pages.' || b.entry_pos || '.bases.' || b.base_pos || '.value')
"""
sql("correct_payslips", f"""WITH {PEDITS} SELECT doc_id, entry_pos, 'entry' AS section, 0 AS pos, month || '~' || year AS texts FROM pent
  UNION ALL SELECT doc_id, entry_pos, 'field', field_pos, code || '~' || label || '~' || reference || '~' || value FROM pfld
  UNION ALL SELECT doc_id, entry_pos, 'base', base_pos, label || '~' || value FROM pbas""")
sql("apply_payslip_corrections", f"""WITH {PEDITS}, s AS (
    SELECT e.doc_id, e.entry_pos, e.year, e.month, (SELECT count(*) FROM pfld f WHERE f.doc_id = e.doc_id AND f.entry_pos = e.entry_pos) AS nf,
      (SELECT count(*) FROM pbas b WHERE b.doc_id = e.doc_id AND b.entry_pos = e.entry_pos) AS nb,
      e.month LIKE '%?%' OR e.year LIKE '%?%' OR EXISTS (SELECT 1 FROM pfld f WHERE f.doc_id = e.doc_id AND f.entry_pos = e.entry_pos AND f.value LIKE '%?%')
        OR EXISTS (SELECT 1 FROM pbas b WHERE b.doc_id = e.doc_id AND b.entry_pos = e.entry_pos AND b.value LIKE '%?%') AS marked FROM pent e),
  i AS (SELECT *, CASE WHEN regexp_full_match(month, '[0-9]+') AND regexp_full_match(year, '[0-9]+') THEN CAST(year AS BIGINT) * 12 + CAST(month AS BIGINT) END AS idx FROM s),
  p AS (SELECT *, last_value(idx IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY entry_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
  b AS (SELECT *, coalesce(idx <> before + 1, false) AS month_break, nf = 0 AND nb = 0 AS is_void FROM p)
  SELECT doc_id, entry_pos, concat_ws(',', CASE WHEN is_void THEN 'pagina_vazia' END, CASE WHEN month_break THEN 'mes_nao_sequencial' END, CASE WHEN marked THEN 'leitura_incerta' END) AS codes,
    CASE WHEN month_break THEN 'vermelho' WHEN is_void OR marked THEN 'amarelo' END AS severity FROM b""")
sql("reject_payslip_corrections", f"""WITH {PEDITS} SELECT c.doc_id, c.path, c.new_value FROM pcor c
  WHERE c.path LIKE '%.label' OR c.path LIKE '%.colour'
    OR (c.path LIKE '%.fields.%.value' AND NOT EXISTS (SELECT 1 FROM fld f WHERE f.doc_id = c.doc_id AND c.path = 'pages.' || f.entry_pos || '.fields.' || f.field_pos || '.value'))
    OR (c.path LIKE '%.bases.0.value' AND NOT EXISTS (SELECT 1 FROM bas b WHERE b.doc_id = c.doc_id AND c.path = 'pages.' || b.entry_pos || '.bases.0.value'))""")
sql("field_ordinal", f"WITH {A3} SELECT * FROM fld")
sql("distinct_labels", f"WITH {A3} SELECT DISTINCT doc_id, label FROM fld")
sql("agg_label_union", f"WITH {A3} SELECT doc_id, label, CAST(label_no AS INTEGER) AS label_no FROM lab")
sql("agg_first_per_label", f"WITH {A3} SELECT doc_id, entry_pos, label, field_pos, value FROM fst")
sql("find_month_break", f"WITH {A3} SELECT doc_id, entry_pos, month, year, month_break FROM efound")
sql("find_empty_page", f"WITH {A3} SELECT doc_id, entry_pos, is_void AS empty FROM efound")
sql("payslip_severity", f"""WITH {A3} SELECT doc_id, entry_pos,
  concat_ws(',', CASE WHEN is_void THEN 'pagina_vazia' END, CASE WHEN month_break THEN 'mes_nao_sequencial' END, CASE WHEN marked THEN 'leitura_incerta' END) AS codes,
  concat_ws(' ', CASE WHEN is_void THEN {q(fixed.EMPTY_PAGE[1])} END, CASE WHEN month_break THEN {q(fixed.MONTH_BREAK[1])} END, CASE WHEN marked THEN {q(fixed.UNCERTAIN[1])} END) AS reasons,
  CASE WHEN month_break THEN 'vermelho' WHEN is_void OR marked THEN 'amarelo' END AS severity FROM efound""")
sql("agg_doc_totals_payslip", f"""WITH {A3} SELECT doc_id, count(*) AS entries, CAST(sum(n_fields) AS BIGINT) AS fields, CAST(sum(n_bases) AS BIGINT) AS bases,
  count(*) FILTER (WHERE marked) AS marked FROM efound GROUP BY ALL""")
A3G = A3 + """,
pgrid AS (
  SELECT doc_id, entry_pos, 0 AS col_pos, 'Pág.' AS header, CAST(entry_pos + 1 AS VARCHAR) AS value, '' AS path FROM ent
  UNION ALL SELECT doc_id, entry_pos, 1, 'Mês', month, 'pages.' || entry_pos || '.month' FROM ent
  UNION ALL SELECT doc_id, entry_pos, 2, 'Ano', year, 'pages.' || entry_pos || '.year' FROM ent
  UNION ALL SELECT e.doc_id, e.entry_pos, CAST(l.label_no + 3 AS INTEGER), l.label, coalesce(f.value, ''),
    CASE WHEN f.value IS NULL THEN '' ELSE 'pages.' || e.entry_pos || '.fields.' || f.field_pos || '.value' END
  FROM ent e JOIN lab l USING (doc_id) LEFT JOIN fst f ON f.doc_id = e.doc_id AND f.entry_pos = e.entry_pos AND f.label = l.label)
"""
sql("grid_payslip", f"WITH {A3G} SELECT * FROM pgrid")
sql("styled_sheet_header", f"WITH {A3G} SELECT DISTINCT doc_id, col_pos, header, '173772' AS fill, 'FFFFFF' AS font_color FROM pgrid")
sql("next_month", f"""WITH {A3}, m AS (SELECT o_orderkey, CASE WHEN month NOT LIKE '%?%' THEN CAST(year AS BIGINT) END AS y, CASE WHEN month NOT LIKE '%?%' THEN CAST(month AS BIGINT) END AS m FROM ent)
  SELECT o_orderkey, CASE WHEN m = 12 THEN y + 1 ELSE y END AS year, m % 12 + 1 AS month FROM m""")

# --- A4, A5 ------------------------------------------------------------------------

A4 = f"""
tr AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id, CASE WHEN user_id % 2 = 0 THEN 'cartao-ponto' ELSE 'holerite' END AS doc_type,
    CASE WHEN event_type IN ('signup', 'click') THEN 'processando' WHEN event_type = 'purchase' THEN 'concluido' ELSE 'erro' END AS status,
    CASE event_type WHEN 'view' THEN {q(fixed.MSG_UNKNOWN_LAYOUT)} WHEN 'error' THEN {q(fixed.MSG_FAILURE)} END AS error,
    CASE WHEN event_id % 10 <> 0 THEN props END AS value, ts FROM events),
upd AS (SELECT CAST(o_orderkey % 12000 AS VARCHAR) AS id, '{{"v": ' || o_orderkey || '}}' AS value, o_orderdate AS ts, o_orderkey FROM orders)
"""
sql("envelope_projection", f"WITH {A4} SELECT id, doc_type, status, error, CASE WHEN status <> 'processando' THEN value END AS value FROM tr")
sql("exportable", f"WITH {A4} SELECT id, doc_type, value FROM tr WHERE status = 'concluido' AND value IS NOT NULL")
sql("lookup_by_id", f"WITH {A4} SELECT id, doc_type, status, error FROM tr WHERE id = '123'")
sql("editable", f"""WITH {A4} SELECT upd.id, upd.value, CASE WHEN tr.id IS NULL THEN {q(fixed.MSG_NOT_FOUND)}
  WHEN tr.status = 'processando' THEN {q(fixed.MSG_STILL_PROCESSING)} END AS refused FROM upd LEFT JOIN tr USING (id)""")
sql("replace_value", f"""WITH {A4}, last AS (SELECT id, value AS v FROM upd QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, value DESC) = 1)
  SELECT tr.id, status, CASE WHEN v IS NOT NULL AND status <> 'processando' THEN v ELSE value END AS value,
    v IS NOT NULL AND status <> 'processando' AS moved FROM tr LEFT JOIN last USING (id)""")
sql("sink_store", f"""WITH {A4} SELECT strftime(ts, '%Y-%m-%d') AS created_on, doc_type, status, count(*) AS n, count(value) AS n_values,
  count(error) AS n_errors FROM tr GROUP BY ALL""")
sql("retention_expire", f"""WITH {A4} SELECT id, status, CASE WHEN ts < TIMESTAMP '2024-01-19 06:00:00' THEN 'removed' ELSE 'kept' END AS outcome FROM tr""")
sql("lifecycle_status", f"""WITH l AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS born FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
  SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN user_id % 2 = 0 THEN 'cartao-ponto' ELSE 'holerite' END AS doc_type,
    CASE WHEN event_type IN ('signup', 'click') THEN 'processando' WHEN event_type = 'purchase' THEN 'concluido' ELSE 'erro' END AS status,
    CASE event_type WHEN 'view' THEN {q(fixed.MSG_UNKNOWN_LAYOUT)} WHEN 'error' THEN {q(fixed.MSG_FAILURE)} END AS error,
    CASE WHEN event_type = 'purchase' THEN props END AS value, strftime(born, '%Y-%m-%d %H:%M:%S') AS created_at,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM l""")
A5 = """
f AS (
  SELECT page_id, url, CASE WHEN page_id % 10 = 0 THEN '' WHEN page_id % 3 = 0 THEN html ELSE '%PDF-' || html END AS body FROM pages),
g AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, url, CAST(strlen(body) AS BIGINT) AS length, body LIKE '\\%PDF-%' ESCAPE '\\' AS is_pdf,
    CASE WHEN page_id % 60 <> 7 THEN page_id % 60 END AS n_pages FROM f)
"""
sql("src_intake_files", f"""WITH {A5} SELECT doc_id, url AS source_path, length, CASE WHEN length > 4000 THEN 'too_large' WHEN length = 0 THEN 'empty' END AS verdict FROM g""")
sql("intake_signature", f"WITH {A5} SELECT doc_id, is_pdf FROM g")
sql("intake_verdict", f"""WITH {A5}, v AS (SELECT *, CASE WHEN length > 4000 THEN 'too_large' WHEN length = 0 THEN 'empty' WHEN NOT is_pdf THEN 'not_pdf'
    WHEN n_pages IS NULL THEN 'unreadable' WHEN n_pages = 0 THEN 'no_pages' WHEN n_pages > 50 THEN 'too_many_pages' END AS verdict FROM g)
  SELECT doc_id, verdict, CASE verdict WHEN 'too_large' THEN 'O arquivo excede o tamanho máximo permitido de 0 MB.'
    WHEN 'empty' THEN {q(fixed.MSG_EMPTY)} WHEN 'not_pdf' THEN {q(fixed.MSG_NOT_PDF)} WHEN 'no_pages' THEN {q(fixed.MSG_NO_PAGES)} WHEN 'unreadable' THEN {q(fixed.MSG_UNREADABLE)}
    WHEN 'too_many_pages' THEN 'O PDF tem ' || n_pages || ' páginas e o limite é 50.' END AS error FROM v""")
sql("bounded_intake", f"""WITH {A5}, v AS (SELECT *, CASE WHEN length > 4000 THEN 'too_large' WHEN length = 0 THEN 'empty' WHEN NOT is_pdf THEN 'not_pdf'
    WHEN n_pages IS NULL THEN 'unreadable' WHEN n_pages = 0 THEN 'no_pages' WHEN n_pages > 50 THEN 'too_many_pages' END AS verdict FROM g)
  SELECT doc_id, CAST(1 AS BIGINT) AS times, verdict, CASE verdict WHEN 'too_large' THEN 'O arquivo excede o tamanho máximo permitido de 0 MB.'
    WHEN 'empty' THEN {q(fixed.MSG_EMPTY)} WHEN 'not_pdf' THEN {q(fixed.MSG_NOT_PDF)} WHEN 'no_pages' THEN {q(fixed.MSG_NO_PAGES)} WHEN 'unreadable' THEN {q(fixed.MSG_UNREADABLE)}
    WHEN 'too_many_pages' THEN 'O PDF tem ' || n_pages || ' páginas e o limite é 50.' END AS error, false AS over_bound FROM v""")
sql("opaque_id", "SELECT url AS source_path, substr(sha256(url || 'salt'), 1, 12) AS id FROM pages")

# --- rendered time cards ----------------------------------------------------------


def rows_of_events(letter: str, per_doc: int, per_page: int) -> str:
    return f"""
ev AS (
  SELECT event_id AS e, strftime(ts, '%M') AS mm, event_id // {per_doc} AS docno, '{letter}' || (event_id // {per_doc}) AS doc_id,
    CAST(1 + (event_id % {per_doc}) // {per_page} AS INTEGER) AS page, CAST(event_id % {per_page} AS INTEGER) AS r FROM events)"""


def punch_list(*punches: tuple[str, str, str, str]) -> str:
    """Text of punches ``(condition, kind, raw, norm)`` in order."""
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN {c} THEN '{k}~' || {raw} || '~' || {norm} END" for c, k, raw, norm in punches
    ) + ")"


def punch_count(*punches) -> str:
    return " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, *_ in punches)


def simple(cond: str, kind: str, hour: int) -> tuple[str, str, str, str]:
    text = f"'{hour:02d}:' || mm"
    return cond, kind, f"({text})", f"({text})"


def _tab_punch(k: int):
    hour = f"{7 + 2 * k:02d}"
    tail = f"CASE WHEN (e + {k}) % 29 = 0 THEN '?' WHEN (e + {k}) % 3 = 0 THEN 'd' ELSE '' END"
    first = f"CASE WHEN (e + {k}) % 31 = 0 THEN '?{hour[1]}' ELSE '{hour}' END"
    sign = "+" if k == 7 else ""
    return (
        f"e % 9 > {k}", "IN" if k % 2 == 0 else "OUT", f"('{sign}' || {first} || ':' || mm || {tail})",
        f"(CASE WHEN (e + {k}) % 31 = 0 THEN '??' ELSE '{hour}' END || ':' || mm)",
    )


TAB_P = [_tab_punch(k) for k in range(8)]
CONT_P = [
    simple("e % 5 <> 0", "IN", 8), simple("true", "OUT", 12), simple("e % 3 > 0", "IN", 13), simple("e % 3 > 0", "OUT", 17),
]
_f = lambda cond, kind, text: (f"e % 10 <> 0 AND {cond}", kind, f"'{text}'", f"'{text}'")
INT_P = [
    simple("e % 10 <> 0", "IN", 9), simple("e % 10 <> 0", "OUT", 18), _f("true", "OUT", "12:00"), _f("true", "IN", "13:00"),
    _f("e % 7 = 0", "IN", "13:30"), _f("e % 6 = 0", "OUT", "15:00"),
]


def day_cte(source: str, where: str, date_raw: str, punches) -> str:
    return f"""{source},
day AS (
  SELECT doc_id, page, e, docno, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY e) - 1 AS INTEGER) AS day_pos,
    {date_raw} AS date_raw, {punch_list(*punches)} AS punches, {punch_count(*punches)} AS n_punches, mm
  FROM ev WHERE {where})"""


TAB = day_cte(
    rows_of_events("T", 90, 30), "NOT (docno % 11 = 0 AND page = 2)",
    "CASE WHEN e % 37 = 0 THEN '38/07/2020' ELSE strftime(DATE '2020-01-01' + CAST(e % 90 AS INTEGER), '%d/%m/%Y') END", TAB_P,
)
CONT = day_cte(
    rows_of_events("C", 62, 31), "true",
    "CASE WHEN docno % 13 = 0 THEN CAST(r + 1 AS VARCHAR) ELSE lpad(CAST(r + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST((docno + page) % 12 + 1 AS VARCHAR), 2, '0') || '/2012' END",
    CONT_P,
)
INT = day_cte(
    rows_of_events("I", 40, 20), "true",
    "lpad(CAST(r + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(docno % 12 + 1 AS VARCHAR), 2, '0') || '/2010'", INT_P,
)
for _name, _cte in (("ts_tabular", TAB), ("ts_continuation", CONT), ("ts_interval", INT), ("src_value_json", TAB)):
    sql(_name, f"WITH {_cte} SELECT doc_id, page, day_pos, date_raw, punches FROM day")
sql("join_competence", f"WITH {CONT} SELECT doc_id, page, day_pos, date_raw FROM day")
sql("first_competence_line", f"""WITH {rows_of_events('C', 62, 31)} SELECT DISTINCT doc_id, page,
  CASE WHEN docno % 13 = 0 THEN '' ELSE CAST((docno + page) % 12 + 1 AS VARCHAR) END AS month,
  CASE WHEN docno % 13 = 0 THEN '' ELSE '2012' END AS year FROM ev""")
sql("unmatched_page", f"""WITH {TAB} SELECT ev.doc_id, ev.page, CAST(count(day.e) AS INTEGER) AS n_days FROM ev LEFT JOIN day USING (doc_id, page, e) GROUP BY ALL""")
sql("day_carry", f"""WITH {CONT}, f AS (SELECT doc_id, page, day_pos, unnest(string_split(punches, '|')) AS t, unnest(range(0, len(string_split(punches, '|')))) AS p FROM day)
  SELECT doc_id, page, day_pos, CAST(p AS INTEGER) AS punch_pos, split_part(t, '~', 1) AS kind, split_part(t, '~', 3) AS time_hhmm FROM f""")
TABF = TAB + """,
fd AS (SELECT doc_id, page - 1 AS page_pos, day_pos, date_raw, n_punches, punches FROM day),
fp AS (
  SELECT doc_id, page_pos, day_pos, CAST(p AS INTEGER) AS punch_pos, split_part(t, '~', 2) AS time_raw, split_part(t, '~', 3) AS time_hhmm
  FROM (SELECT doc_id, page_pos, day_pos, unnest(string_split(punches, '|')) AS t, unnest(range(0, len(string_split(punches, '|')))) AS p FROM fd WHERE punches <> '')),
""" + chain("fd", "fp") + "," + ts_grid("found", "fp")
sql("has_uncertainty", f"WITH {TABF} SELECT doc_id, page_pos, day_pos, marked FROM found")
sql("cell_path", f"WITH {TABF} SELECT doc_id, path FROM grid WHERE path <> ''")
sql("agg_col_width", f"""WITH {TABF} SELECT doc_id, col_pos, CAST(least(greatest(max(length(value)), max(length(header))) + 2, 40) AS INTEGER) AS width FROM grid GROUP BY ALL""")
sql("join_findings_rows", f"""WITH {TABF}, c AS (SELECT doc_id, count(*) AS cells FROM grid GROUP BY ALL)
  SELECT doc_id, count(*) AS rows, count(severity) AS flagged, any_value(cells) AS cells FROM found JOIN c USING (doc_id) GROUP BY doc_id""")
sql("review_rows", f"""WITH {TABF}, c AS (SELECT doc_id, page_pos, day_pos, string_agg(value || '~' || path, '|' ORDER BY col_pos) AS cells FROM grid GROUP BY ALL)
  SELECT doc_id, page_pos, day_pos, cells, severity, reasons FROM found JOIN c USING (doc_id, page_pos, day_pos)""")
sql("sink_csv", f"""WITH {TABF} SELECT doc_id, page_pos, day_pos, string_agg(value, ';' ORDER BY col_pos) AS line FROM grid GROUP BY ALL
  UNION ALL SELECT doc_id, -1, -1, chr(65279) || string_agg(header, ';' ORDER BY col_pos) FROM (SELECT DISTINCT doc_id, col_pos, header FROM grid) GROUP BY ALL""")
sql("schema_contract", f"""WITH {TAB}, v AS (SELECT doc_id, page, n_punches, day_pos + 30 * (page - 1) AS k FROM day),
  d AS (SELECT *, CAST(substr(doc_id, 2) AS BIGINT) % 19 AS m FROM v), pages_of AS (SELECT DISTINCT doc_id, page FROM ev),
  r AS (SELECT doc_id, page, CASE WHEN k % 17 = 0 THEN 'date_raw missing' WHEN k % 13 = 0 AND n_punches > 0 THEN 'kind unknown' END AS reason FROM d WHERE m NOT IN (3, 5)
    UNION ALL (SELECT DISTINCT doc_id, NULL, 'value unreadable' FROM pages_of WHERE CAST(substr(doc_id, 2) AS BIGINT) % 19 = 3)
    UNION ALL (SELECT DISTINCT doc_id, page, 'days missing' FROM pages_of WHERE CAST(substr(doc_id, 2) AS BIGINT) % 19 = 5))
  SELECT doc_id, page, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL""")

TAB_SCORE = "(11 + 3 * 0.75) / 14"
sql("agg_mean_similarity", f"""WITH {rows_of_events('T', 90, 30)} SELECT DISTINCT doc_id, page, CASE WHEN docno % 2 = 0 THEN 1.0 ELSE round({TAB_SCORE}, 6) END AS score
  FROM ev WHERE NOT (docno % 11 = 0 AND page = 2)""")
sql("join_header_titles", f"""WITH {rows_of_events('T', 90, 30)}, t AS (
    SELECT DISTINCT doc_id, page, 1 AS line_no, 2 AS layout, CASE WHEN docno % 2 = 0 THEN 1.0 ELSE round({TAB_SCORE}, 6) END AS score, 14 AS n_titles
    FROM ev WHERE NOT (docno % 11 = 0 AND page = 2)),
  i AS (SELECT DISTINCT 'I' || (event_id // 40) AS doc_id, CAST(1 + (event_id % 40) // 20 AS INTEGER) AS page, 1 AS line_no, 3 AS layout, 1.0 AS score, 7 AS n_titles FROM events)
  SELECT * FROM t UNION ALL SELECT * FROM i""")


def ranges(titles: tuple[str, ...], xs: list[float], width: float) -> str:
    """VALUES rows ``(ord, name, x0, x1)`` from title positions."""
    rows = []
    for k, (title, x) in enumerate(zip(titles, xs)):
        left = 0.0 if k == 0 else (xs[k - 1] + 5.0 * len(titles[k - 1]) + x) / 2
        right = max(width, x + 5.0 * len(title)) if k == len(xs) - 1 else (x + 5.0 * len(title) + xs[k + 1]) / 2
        rows.append(f"({k}, {q(title)}, CAST({left} AS DOUBLE), CAST({right} AS DOUBLE))")
    return ", ".join(rows)


TAB_XS = [15, 95, 131, 184, 220, 256, 292, 328, 364, 400, 440, 480, 520, 580]
sql("detect_header", f"""WITH {rows_of_events('T', 90, 30)}, t AS (
    SELECT DISTINCT doc_id, page, 2 AS layout_id, CAST(50.0 AS DOUBLE) AS header_top, CASE WHEN docno % 2 = 0 THEN 1.0 ELSE round({TAB_SCORE}, 6) END AS score
    FROM ev WHERE NOT (docno % 11 = 0 AND page = 2)),
  m AS (SELECT 'M' || (o_orderkey // 12) AS doc_id, CAST(o_orderkey % 12 + 1 AS INTEGER) AS page, 4 AS layout_id, CAST(50.0 AS DOUBLE) AS header_top, 1.0 AS score
    FROM orders WHERE o_orderkey % 17 <> 0),
  ct(ord, name, x0, x1) AS (VALUES {ranges(fixed.TITLES_TABULAR, TAB_XS, 640.0)}),
  cm(ord, name, x0, x1) AS (VALUES {ranges(fixed.TITLES_MONTHLY, [10, 60, 200, 300, 400], 640.0)})
  SELECT t.*, ct.* FROM t CROSS JOIN ct UNION ALL SELECT m.*, cm.* FROM m CROSS JOIN cm""")
sql("column_by_name", f"""WITH {rows_of_events('I', 40, 20)} SELECT DISTINCT doc_id, page, 3 AS ord, CAST(197.5 AS DOUBLE) AS x0, CAST(292.5 AS DOUBLE) AS x1 FROM ev""")
sql("top1_header", """SELECT 'R' || (o_orderkey // 6) AS doc_id, CAST(o_orderkey % 6 + 1 AS INTEGER) AS page, 3 AS header_line, CAST(60.0 AS DOUBLE) AS header_top, 1.0 AS score FROM orders""")

# --- rendered payslips ------------------------------------------------------------


def rows_of_orders(letter: str, per_doc: int, per_page: int) -> str:
    return f"""
ord AS (
  SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, '{letter}' || (o_orderkey // {per_doc}) AS doc_id,
    o_orderkey // {per_doc} AS docno, CAST(1 + (o_orderkey % {per_doc}) // {per_page} AS INTEGER) AS page, CAST(o_orderkey % {per_page} AS INTEGER) AS entry_no FROM orders)"""


def amt(j: int) -> str:
    return brl(f"cents + {137 * j}")


def cut(text: str, cond: str) -> str:
    return f"(CASE WHEN {cond} THEN substr({text}, 1, length({text}) - 1) || '?' ELSE {text} END)"


def listed(*items: tuple[str, str]) -> str:
    """Text of items ``(condition, text expression)`` in order."""
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in items) + ")"


def counted(*items: tuple[str, str]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in items)


def field(code: str, label: str, reference: str, value: str) -> str:
    return f"{code} || '~' || {label} || '~' || {reference} || '~' || {value}"


def base(label: str, value: str) -> str:
    return f"'{label}~' || {value}"


MON_F = [
    (f"k % 17 <> 0 AND k % 6 >= {j}", field(f"'{j + 1:04d}'", f"'Verba N{j}'", "'30,00'" if j % 3 else "''", cut(amt(j), f"(k + {j}) % 41 = 0")))
    for j in range(6)
]
MON_B = [
    ("k % 17 <> 0", base("Total Proventos", amt(10))), ("k % 17 <> 0 AND k % 4 <> 0", base("Total Descontos", amt(11))),
    ("k % 17 <> 0", base("Líqüido", amt(12))), ("k % 17 <> 0", base("Base INSS", amt(13))),
    ("k % 17 <> 0", base("FGTS", f"CASE WHEN k % 3 <> 0 THEN {amt(14)} ELSE '' END")),
]
REC_F = []
for j in range(4):
    REC_F.append((f"k % 4 >= {j} AND (k + {j}) % 23 <> 0", field("''", f"'PROV{j}'", "'30'" if j % 2 == 0 else "''", amt(j))))
    if j % 3 != 2:
        REC_F.append((f"k % 4 >= {j}", field("''", f"'DESC{j}' || CASE WHEN (k + {j}) % 5 = 0 THEN ' AMIL' ELSE '' END", "''", amt(j + 20))))
REC_B = [
    ("true", base(label, amt(30 + n)))
    for n, label in enumerate(["TOTAL DE PROVENTOS", "TOTAL DE DESCONTOS", "LÍQUIDO A RECEBER", "Base INSS", "Base FGTS", "FGTS Mes"])
]
BLK_F = []
for j in range(4):
    name = "CASE WHEN k % 9 = 0 THEN 'AD/COMI' ELSE 'VENC' END" if j == 0 else "'VENC'"
    ref = {0: "''", 1: amt(40 + j), 2: "'JULHO/18'"}[j % 3]
    value = f"'-' || {amt(j)}" if j % 3 == 1 else amt(j)
    BLK_F.append((f"k % 4 >= {j}", field(f"'{10 + j:03d}'", f"{name} || ' P{j}'", ref, value)))
BLK_B = [
    ("true", base("Total Ref.", amt(50))),
    ("true", base("Retidos", f"CASE WHEN k % 3 <> 0 THEN {amt(51)} ELSE '' END")),
]
LED_F = [
    ("ok", field("''", "'REMUNMES'", "''", amt(1))), ("ok", field("CAST(k % 5 + 290 AS VARCHAR)", "'VA Func'", "'0'", amt(2))),
    ("ok AND k % 4 <> 0", field("'91'", "'Hr Adic'", "'146,67'", amt(4))), ("ok AND k % 4 <> 0", field("'511'", "'INSS'", "''", amt(5))),
]
LED_B = [
    ("ok", base("BASEINSS", amt(3))), ("ok AND k % 4 <> 0", base("FGTS", amt(6))), ("ok", base("TOT.REND", amt(7))),
    ("ok", base("TOTALDESC", amt(8))), ("ok", base("LIQUIDO", amt(9))),
]
MON = rows_of_orders("M", 12, 1) + f""",
ent AS (SELECT doc_id, page, 0 AS entry_no, k, CAST(k // 12 % 20 + 2000 AS VARCHAR) AS year, lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') AS month,
  {listed(*MON_F)} AS fields, {listed(*MON_B)} AS bases, {counted(*MON_F)} AS nf, {counted(*MON_B)} AS nb FROM ord)"""
REC = rows_of_orders("R", 6, 1) + f""",
ent AS (SELECT doc_id, page, 0 AS entry_no, k, CAST(k % 10 + 2015 AS VARCHAR) AS year,
  lpad(CAST(CASE WHEN k % 12 = 11 THEN 9 ELSE k % 12 + 1 END AS VARCHAR), 2, '0') AS month,
  {listed(*REC_F)} AS fields, {listed(*REC_B)} AS bases, {counted(*REC_F)} AS nf, {counted(*REC_B)} AS nb FROM ord)"""
BLK = rows_of_orders("B", 8, 2) + f""",
ent AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS INTEGER) AS entry_no, k,
  CASE WHEN k % 19 = 0 THEN '' ELSE CAST(k % 10 + 2010 AS VARCHAR) END AS year, CASE WHEN k % 19 = 0 THEN '' ELSE lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') END AS month,
  {listed(*BLK_F)} AS fields, {listed(*BLK_B)} AS bases, {counted(*BLK_F)} AS nf, {counted(*BLK_B)} AS nb FROM ord)"""
LED = rows_of_orders("F", 12, 6) + f""",
okd AS (SELECT *, sum(CASE WHEN k % 4 <> 0 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id) >= 3 AS ok,
  CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS INTEGER) AS n FROM ord),
ent AS (SELECT doc_id, page, n AS entry_no, k,
  CASE WHEN NOT ok OR k % 31 = 0 THEN '' ELSE '20' || (k % 15 + 10) END AS year, CASE WHEN NOT ok OR k % 31 = 0 THEN '' ELSE lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') END AS month,
  {listed(*LED_F)} AS fields, {listed(*LED_B)} AS bases, {counted(*LED_F)} AS nf, {counted(*LED_B)} AS nb FROM okd WHERE ok OR n = 0)"""
for _name, _cte in (("ps_monthly", MON), ("ps_receipt", REC), ("ps_blocks", BLK), ("ps_ledger", LED)):
    sql(_name, f"WITH {_cte} SELECT doc_id, page, entry_no, year, month, fields, bases FROM ent")
# Damaged amounts: each ends in a mark where the printed one ends in 7, and a receipt keeps its other damaged ones too.
REC_D = []
for j in range(4):
    REC_D.append((f"k % 4 >= {j}", field("''", f"'PROV{j}'", "'30'" if j % 2 == 0 else "''", cut(amt(j), f"(k + {j}) % 23 = 0"))))
    if j % 3 != 2:
        REC_D.append((f"k % 4 >= {j}", field("''", f"'DESC{j}' || CASE WHEN (k + {j}) % 5 = 0 THEN ' AMIL' ELSE '' END", "''", amt(j + 20))))
_MARKED = lambda col: f"regexp_replace({col}, ',([0-9])7([~|]|$)', ',\\1?\\2', 'g') AS {col}"
for _name, _cte, _fields in (
    ("ps_receipt_damaged", REC, listed(*REC_D)), ("ps_blocks_damaged", BLK, "fields"), ("ps_ledger_damaged", LED, "fields"),
):
    _from = "ent JOIN ord USING (doc_id, page, k)" if _cte is REC else "ent"
    sql(_name, f"""WITH {_cte}, d AS (SELECT ent.doc_id, ent.page, ent.entry_no, year, month, {_fields} AS fields, bases FROM {_from})
      SELECT doc_id, page, entry_no, year, month, {_MARKED('fields')}, {_MARKED('bases')} FROM d""")
sql("amount_balance", f"""WITH {rows_of_orders('F', 12, 6)},
  led AS (SELECT doc_id, page, k, 6 + CASE WHEN k % 4 <> 0 THEN 4 ELSE 0 END AS n,
    sum(CASE WHEN k % 4 <> 0 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id) >= 3 AS ok FROM ord),
  one AS (
    SELECT doc_id, page, n AS r, CASE WHEN ok THEN n ELSE 0 END AS kept FROM led
    UNION ALL SELECT 'B' || (k // 8), CAST(1 + (k % 8) // 2 AS INTEGER), b, b FROM (
      SELECT k, 2 + CASE WHEN k % 4 >= 1 THEN 2 ELSE 0 END + CASE WHEN k % 4 >= 2 THEN 1 ELSE 0 END + CASE WHEN k % 4 >= 3 THEN 1 ELSE 0 END
        + CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END AS b FROM ord)
    UNION ALL SELECT 'R' || (k // 6), CAST(1 + k % 6 AS INTEGER), 2 * c, c FROM (
      SELECT k, 6 + 2 + CASE WHEN k % 4 >= 1 THEN 2 ELSE 0 END + CASE WHEN k % 4 >= 2 THEN 1 ELSE 0 END + CASE WHEN k % 4 >= 3 THEN 2 ELSE 0 END AS c FROM ord))
  SELECT doc_id, page, CAST(sum(r) AS BIGINT) AS n_read, CAST(sum(kept) AS BIGINT) AS n_kept, false AS made_up FROM one GROUP BY ALL""")
_SPLIT = lambda col, pos, names: f"""SELECT doc_id, page, CAST(p AS INTEGER) AS {pos}, {names}
  FROM (SELECT doc_id, page, unnest(string_split({col}, '|')) AS t, unnest(range(0, len(string_split({col}, '|')))) AS p FROM ent WHERE {col} <> '')"""  # noqa: E731
_BASE = "split_part(t, '~', 1) AS label, split_part(t, '~', 2) AS value"
sql("union_sections", f"WITH {MON} {_SPLIT('bases', 'base_pos', _BASE)}")
sql("join_nearest_label", f"WITH {REC} {_SPLIT('bases', 'base_pos', _BASE)}")
sql("split_tables", f"""WITH {REC} {_SPLIT('fields', 'field_pos', "split_part(t, '~', 2) AS label, split_part(t, '~', 3) AS reference, split_part(t, '~', 4) AS value")}""")
sql("section_cut", f"WITH {MON} SELECT doc_id, page, nf AS n_fields, nb AS n_bases FROM ent")
sql("copy_cut", f"WITH {REC} SELECT doc_id, count(*) AS entries, CAST(sum(nf) AS BIGINT) AS n_fields, CAST(sum(nb) AS BIGINT) AS n_bases FROM ent GROUP BY ALL")
sql("year_lookahead", f"WITH {REC} SELECT doc_id, page, year FROM ent")
sql("read_competence_fuzzy", f"WITH {REC} SELECT doc_id, page, month, year FROM ent")
_MONTHS = ", ".join(f"({n}, '{m}')" for n, m in enumerate(fixed.MONTH_NAMES, 1))
sql("find_tied_month", f"""WITH RECURSIVE {rows_of_orders("Z", 6, 1)}, months(n, m) AS (VALUES {_MONTHS}),
  read AS (SELECT doc_id, page, k % 3 + 2015 AS year, CASE (k + k // 12) % 5 WHEN 1 THEN 'pe' || substr(m, 4) WHEN 2 THEN substr(m, 2)
    WHEN 3 THEN replace(m, 'o', '0') WHEN 4 THEN 'ju' || substr(m, 4) || 'o' ELSE m END AS w FROM ord JOIN months ON n = k % 12 + 1),
  part AS (
    SELECT w, m, n, CAST(0 AS BIGINT) AS a0, CAST(length(w) AS BIGINT) AS a1, CAST(0 AS BIGINT) AS b0, CAST(length(m) AS BIGINT) AS b1, CAST(0 AS BIGINT) AS k
    FROM (SELECT DISTINCT w FROM read) CROSS JOIN months
    UNION ALL
    SELECT w, m, n, unnest([a0, i + size]), unnest([i, a1]), unnest([b0, j + size]), unnest([j, b1]), unnest([size, 0])
    FROM (
      SELECT w, m, n, a0, a1, b0, b1, (100 - best // 1000000000) AS size, (best % 1000000000) // 10 AS i, best % 10 AS j
      FROM (
        SELECT *, list_min(flatten(flatten(list_transform(range(a0, a1), lambda i: list_transform(range(b0, b1), lambda j:
          list_transform(list_filter(range(1, least(a1 - i, b1 - j) + 1), lambda z: substr(w, i + 1, z) = substr(m, j + 1, z)),
            lambda z: (100 - z) * 1000000000 + i * 10 + j)))))) AS best
        FROM part WHERE a0 < a1 AND b0 < b1)
      WHERE best IS NOT NULL)),
  near AS (SELECT w, n, 2 * sum(k) / (length(w) + length(m)) AS r FROM part GROUP BY w, m, n HAVING r >= 0.75 AND length(w) >= 4),
  won AS (SELECT w, min(n) AS n, string_agg(lpad(CAST(n AS VARCHAR), 2, '0'), '|' ORDER BY n) AS months, count(*) AS ties
    FROM (SELECT *, max(r) OVER (PARTITION BY w) AS top FROM near) WHERE r = top GROUP BY w),
  e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS entry_pos, page, year * 12 + n AS idx, n,
    coalesce(months, '') AS months, coalesce(ties, 0) AS ties FROM read LEFT JOIN won USING (w)),
  f AS (SELECT *, coalesce(idx <> 1 + last_value(idx IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS broken FROM e)
  SELECT doc_id, CAST(entry_pos AS INTEGER) AS entry_pos, coalesce(lpad(CAST(n AS VARCHAR), 2, '0'), '') AS month,
    CASE WHEN ties > 1 THEN months ELSE '' END AS month_ties,
    concat_ws('|', '{fixed.EMPTY_PAGE[0]}', CASE WHEN broken THEN '{fixed.MONTH_BREAK[0]}' END, CASE WHEN ties > 1 THEN 'competencia_ambigua' END) AS codes,
    CASE WHEN broken AND '{fixed.MONTH_BREAK[2]}' = '{fixed.RED}' THEN '{fixed.RED}' ELSE '{fixed.YELLOW}' END AS severity FROM f""")
sql("total_kind", """SELECT 'R' || (o_orderkey // 6) AS doc_id, CAST(o_orderkey % 6 + 1 AS INTEGER) AS page,
    CAST(t + o_orderkey % 4 AS INTEGER) + extra AS line_no, kinds
  FROM orders CROSS JOIN (VALUES (5, 0, 'TOTAL DE PROVENTOS|TOTAL DE DESCONTOS'), (6, 0, 'LÍQUIDO A RECEBER')) v(t, extra, kinds)
  UNION ALL
  SELECT 'R' || (o_orderkey // 6), CAST(o_orderkey % 6 + 1 AS INTEGER), CAST(t + 2 * (o_orderkey % 4) AS INTEGER), kinds
  FROM orders CROSS JOIN (VALUES (14, 'TOTAL DE PROVENTOS|TOTAL DE DESCONTOS'), (15, 'LÍQUIDO A RECEBER')) v(t, kinds)""")
sql("below_header", f"""WITH {rows_of_orders('M', 12, 1)} SELECT doc_id, page, k % 6 + 1 + 4 AS n, CAST(64.0 AS DOUBLE) AS first_top,
  '0001 Verba N0 ' || (CASE WHEN k % 41 = 0 THEN substr({amt(0)}, 1, length({amt(0)}) - 1) || 'O' ELSE {amt(0)} END) AS first_line
  FROM ord WHERE k % 17 <> 0""")


def _json_lines(col: str, names: tuple[str, ...]) -> str:
    """Text of a list of items, eight blanks deep."""
    keys = " || ',' || chr(10) || ".join(f"""'          "{name}": "' || split_part(t, '~', {n}) || '"'""" for n, name in enumerate(names, 1))
    item = f"'        {{' || chr(10) || {keys} || chr(10) || '        }}'"
    items = f"array_to_string(list_transform(string_split({col}, '|'), lambda t: {item}), ',' || chr(10))"
    return f"CASE WHEN {col} = '' THEN '[]' ELSE '[' || chr(10) || {items} || chr(10) || '      ]' END"


sql("sink_json", f"""WITH {BLK}, p AS (SELECT doc_id, page, entry_no, '    {{' || chr(10) || '      "page": ' || page || ',' || chr(10)
    || '      "year": "' || year || '",' || chr(10) || '      "month": "' || month || '",' || chr(10)
    || '      "fields": ' || {_json_lines('fields', ('code', 'label', 'reference', 'value'))} || ',' || chr(10)
    || '      "bases": ' || {_json_lines('bases', ('label', 'value'))} || chr(10) || '    }}' AS text FROM ent)
  SELECT doc_id, '{{' || chr(10) || '  "pages": [' || chr(10) || string_agg(text, ',' || chr(10) ORDER BY page, entry_no) || chr(10) || '  ]' || chr(10) || '}}' AS json
  FROM p GROUP BY doc_id""")
sql("agg_nest", f"""WITH {LED} SELECT doc_id, string_agg(concat_ws('/', page, month, year, nf, nb), ' ' ORDER BY page, entry_no) AS pages FROM ent GROUP BY ALL""")
sql("split_three_groups", f"""WITH {rows_of_orders('F', 12, 6)}, n AS (
    SELECT *, CASE WHEN page = 1 THEN 1 ELSE 0 END + coalesce(sum(CASE WHEN k % 4 <> 0 THEN 5 ELSE 4 END) OVER (PARTITION BY doc_id, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ord)
  SELECT doc_id, page, CAST(pos + 2 AS INTEGER) AS line_no, 'REMUNMES ' || {amt(1)} AS earned, (k % 5 + 290) || ' VA Func 0 ' || {amt(2)} AS deducted, 'BASEINSS ' || {amt(3)} AS result FROM n
  UNION ALL SELECT doc_id, page, CAST(pos + 3 AS INTEGER), '91Hr Adic 146,67 ' || {amt(4)}, '511 INSS ' || {amt(5)}, 'FGTS ' || {amt(6)} FROM n WHERE k % 4 <> 0
  UNION ALL SELECT doc_id, page, CAST(pos + CASE WHEN k % 4 <> 0 THEN 4 ELSE 3 END AS INTEGER), 'TOT.REND ' || {amt(7)}, 'TOTALDESC ' || {amt(8)}, 'LIQUIDO ' || {amt(9)} FROM n""")

# --- choice of the layout -----------------------------------------------------------

NAMES = {
    "T": ("ts_tabular", "events", "event_id", 90), "C": ("ts_continuation", "events", "event_id", 62), "I": ("ts_interval", "events", "event_id", 40),
    "M": ("ps_monthly", "orders", "o_orderkey", 12), "R": ("ps_receipt", "orders", "o_orderkey", 6), "B": ("ps_blocks", "orders", "o_orderkey", 8), "F": ("ps_ledger", "orders", "o_orderkey", 12),
}
DOCS = "alld AS (" + " UNION ALL ".join(
    f"SELECT '{letter}' || ({key} // {n}) AS doc_id, {key} // {n} AS docno, '{layout}' AS own, '{'cartao-ponto' if letter in 'TCI' else 'holerite'}' AS own_type, "
    + (f"bool_or({key} % 17 <> 0)" if letter == "M" else "true")
    + f" AS has FROM {table} GROUP BY {key} // {n}"
    for letter, (layout, table, key, n) in NAMES.items()
) + """),
decl AS (SELECT *, CASE WHEN docno % 5 <> 0 THEN own_type WHEN own_type = 'holerite' THEN 'cartao-ponto' ELSE 'holerite' END AS doc_type FROM alld),
chosen AS (SELECT doc_id, doc_type, CASE WHEN has AND doc_type = own_type THEN own END AS layout FROM decl)
"""
sql("score_layouts", f"""WITH {DOCS}, l(layout) AS (VALUES ('ts_continuation'), ('ts_tabular'), ('ts_interval'), ('ps_monthly'), ('ps_receipt'), ('ps_blocks'), ('ps_ledger'))
  SELECT doc_id, layout, CASE WHEN has AND own = layout THEN 1.0 ELSE 0.0 END AS score FROM alld CROSS JOIN l""")
sql("select_layout", f"""WITH {DOCS} SELECT doc_id, doc_type, layout, CASE WHEN layout IS NULL THEN {q(fixed.MSG_UNKNOWN_LAYOUT)} END AS error FROM chosen""")
sql("top1_layout", f"""WITH {DOCS} SELECT doc_type, layout, count(*) AS n, CASE WHEN layout IS NOT NULL THEN CAST(count(*) AS DOUBLE) END AS score FROM chosen GROUP BY doc_type, layout""")
sql("join_layout_candidates", f"""WITH {DOCS}, l(layout) AS (VALUES ('ts_continuation'), ('ts_tabular'), ('ts_interval'), ('ps_monthly'), ('ps_receipt'), ('ps_blocks'), ('ps_ledger'))
  SELECT doc_id, doc_type, layout FROM decl JOIN l ON (doc_type = 'cartao-ponto') = (layout LIKE 'ts%') WHERE own IN ('ts_tabular', 'ps_monthly')""")
_TS = {"T": TAB, "C": CONT, "I": INT}
_PS = {"M": MON, "R": REC, "B": BLK, "F": LED}
_COUNTS = " UNION ALL ".join(
    [f"(WITH {c} SELECT doc_id, count(*) AS rows, CAST(sum(n_punches) AS BIGINT) AS items FROM day GROUP BY ALL)" for c in _TS.values()]
    + [f"(WITH {c} SELECT doc_id, count(*) AS rows, CAST(sum(nf + nb) AS BIGINT) AS items FROM ent GROUP BY ALL)" for c in _PS.values()]
)
sql("transcribe_corpus", f"""WITH {DOCS}, n AS ({_COUNTS})
  SELECT c.doc_id, c.layout, CASE WHEN c.layout IS NULL THEN 0 ELSE rows END AS rows, CAST(CASE WHEN c.layout IS NULL THEN 0 ELSE items END AS BIGINT) AS items
  FROM chosen c LEFT JOIN n USING (doc_id)""")

_VERTICAL = [
    ("true", "IN", "('08:' || mm)", "('08:' || mm)"), ("true", "OUT", "('12:' || mm)", "('12:' || mm)"),
    ("e % 3 = 0", "IN", "('?1:' || mm)", "('??:' || mm)"), ("e % 3 = 0", "OUT", "('17:' || mm)", "('17:' || mm)"),
]
sql("coded_layout", f"""WITH v AS (WITH {rows_of_events('V', 40, 20)}
    SELECT doc_id, docno, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY r) - 1 AS INTEGER) AS day_pos,
      strftime(DATE '2020-01-01' + CAST(e % 90 AS INTEGER), '%d/%m/%Y') AS date_raw,
      CASE WHEN e % 5 = 0 THEN '' ELSE {punch_list(*_VERTICAL)} END AS punches FROM ev),
  t AS (WITH {TAB} SELECT doc_id, page, day_pos, date_raw, punches FROM day),
  vd AS (SELECT DISTINCT doc_id, docno, docno % 5 = 0 AS other, docno % 11 = 0 AS undated, docno % 13 = 0 AS titled FROM v),
  td AS (SELECT DISTINCT 'T' || (event_id // 90) AS doc_id, (event_id // 90) % 5 = 0 AS other FROM events)
  SELECT vd.doc_id, CASE WHEN other THEN NULL WHEN NOT undated THEN 'ts_vertical' WHEN titled THEN 'ts_tabular' END AS layout,
    CASE WHEN other THEN NULL WHEN NOT undated THEN CASE WHEN vd.docno % 7 = 0 THEN 0.8 ELSE 1.0 END WHEN titled THEN 0.7 END AS score,
    coalesce(page, 0) AS page, coalesce(day_pos, -1) AS day_pos, date_raw, punches FROM vd LEFT JOIN v ON v.doc_id = vd.doc_id AND NOT other AND NOT undated
  UNION ALL SELECT td.doc_id, CASE WHEN NOT other THEN 'ts_tabular' END, CASE WHEN NOT other THEN 1.0 END,
    coalesce(page, 0), coalesce(day_pos, -1), date_raw, punches FROM td LEFT JOIN t ON t.doc_id = td.doc_id AND NOT other""")

# --- scalar functions -----------------------------------------------------------------

AMOUNTS = f"""
am0 AS (SELECT l_orderkey, l_partkey, l_orderkey + l_partkey AS k, {brl('CAST(round(l_extendedprice * 100) AS BIGINT)')} AS a FROM lineitem),
am AS (
  SELECT l_orderkey, l_partkey, CASE WHEN k % 7 = 0 THEN '-' || a WHEN k % 11 = 0 THEN replace(a, '1', 'l') WHEN k % 13 = 0 THEN replace(a, ',', '.')
    WHEN k % 17 = 0 THEN a || ',' WHEN k % 19 = 0 THEN 'R$' || a ELSE a END AS token FROM am0)
"""
sql("read_money", rf"""WITH {AMOUNTS}, p AS (
    SELECT *, regexp_full_match(token, '-?[^,-][^,]*,[^,][^,]') AS shaped, regexp_replace(split_part(token, ',', 1), '^-', '') AS body, split_part(token, ',', 2) AS cents FROM am),
  f AS (SELECT *, shaped AND length(regexp_replace(body || cents, '[^0-9]', '', 'g')) >= 0.6 * (length(replace(body, '.', '')) + 2) AS ok FROM p),
  r AS (SELECT *, CASE WHEN ok THEN CASE WHEN token LIKE '-%' THEN '-' ELSE '' END || regexp_replace(body, '[^0-9.]', '?', 'g') || ',' || regexp_replace(cents, '[^0-9]', '?', 'g') END AS raw FROM f)
  SELECT l_orderkey, l_partkey, token, raw, coalesce(raw LIKE '%?%', false) AS uncertain FROM r""")
sql("strict_money", f"WITH {AMOUNTS} SELECT l_orderkey, token, regexp_full_match(token, {MONEY}) AS is_money FROM am")
sql("money_to_decimal", f"""WITH {AMOUNTS} SELECT l_orderkey, token, CASE WHEN regexp_full_match(token, {MONEY})
  THEN CAST(CAST(replace(replace(token, '.', ''), ',', '.') AS DECIMAL(18, 2)) AS DOUBLE) END AS amount FROM am""")
sql("read_competence_numeric", """SELECT o_orderkey, CASE WHEN o_orderkey % 15 BETWEEN 1 AND 12 THEN CAST(o_orderkey % 15 AS VARCHAR) END AS month,
  CASE WHEN o_orderkey % 15 BETWEEN 1 AND 12 THEN strftime(o_orderdate, '%Y') END AS year FROM orders""")
sql("read_competence_abbrev", """SELECT o_orderkey, CASE WHEN o_orderkey % 12 <> 6 THEN lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') END AS month,
  CASE WHEN o_orderkey % 12 <> 6 THEN CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y')
    WHEN year(o_orderdate) % 100 + 10 >= 100 THEN CAST(year(o_orderdate) % 100 + 10 AS VARCHAR) ELSE '20' || (year(o_orderdate) % 100 + 10) END END AS year FROM orders""")
sql("compose_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(day(o_orderdate) AS VARCHAR) ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date_raw FROM orders""")
DATES = """
dd AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '3' || substr(strftime(o_orderdate, '%d/%m/%Y'), 2)
    WHEN o_orderkey % 13 = 0 THEN '?' || substr(strftime(o_orderdate, '%d/%m/%Y'), 2)
    WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date_raw FROM orders),
pd AS (SELECT *, TRY_CAST(split_part(date_raw, '/', 3) || '-' || split_part(date_raw, '/', 2) || '-' || split_part(date_raw, '/', 1) AS DATE) AS d FROM dd)
"""
sql("date_shape", f"WITH {DATES} SELECT o_orderkey, date_raw, regexp_full_match(date_raw, '[0-9]+/[0-9]+/[0-9]+') AS shaped FROM dd")
sql("parse_date", f"WITH {DATES} SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS day FROM pd")
sql("next_day", f"WITH {DATES} SELECT o_orderkey, strftime(d + 1, '%Y-%m-%d') AS day FROM pd")
sql("split_interval", """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 2 ELSE 1 END AS n,
  CASE WHEN event_id % 3 = 1 THEN strftime(ts, '%H:%M') || '|' || strftime(ts + INTERVAL 1 HOUR, '%H:%M') ELSE strftime(ts, '%H:%M') END AS parts FROM events""")
sql("day_prefix", """SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN -1 WHEN event_id % 40 BETWEEN 1 AND 31 THEN CAST(event_id % 40 AS INTEGER) ELSE -1 END AS day FROM events""")
sql("day_digits", """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN -1 WHEN event_id % 40 BETWEEN 1 AND 31 THEN CAST(event_id % 40 AS INTEGER) ELSE -1 END AS day FROM events""")
sql("split_code", """WITH t AS (SELECT p_partkey, p_partkey % 1500 AS n, p_partkey AS k, p_type FROM part)
  SELECT p_partkey, CASE k % 3 WHEN 0 THEN n || p_type WHEN 1 THEN CAST(k AS VARCHAR) ELSE p_type END AS token,
    CASE k % 3 WHEN 0 THEN CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE '' END WHEN 1 THEN CAST(k AS VARCHAR) ELSE '' END AS code,
    CASE k % 3 WHEN 0 THEN CASE WHEN n < 1000 THEN p_type ELSE n || p_type END WHEN 1 THEN '' ELSE p_type END AS rest FROM t""")
sql("is_total_label", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'TOT. ' || p_type WHEN 1 THEN 'Total' || p_type WHEN 2 THEN 'Tot ' || p_type ELSE p_type END AS label,
  p_partkey % 4 IN (0, 1) AS is_total FROM part""")
sql("px_to_points", """SELECT l_orderkey, l_linenumber, round(floor(l_extendedprice) / (CASE WHEN l_orderkey % 2 = 0 THEN 300 ELSE 200 END / 72.0), 4) AS points FROM lineitem""")
