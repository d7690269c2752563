"""SQL for queries on papers: pages to clean pages, sections, chunks and metadata, each step a table of a WITH list.

The SQL reads the texts themselves; nothing in it knows how the pages of plans.texts came about.
"""

from __future__ import annotations

from paperloom.functions import text as T
from paperloom.operators import chunk, metadata

WIDE = r"[\t-\r\x{1c}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"
SPACE = r"[ \t\n\x0b\f\r]"
BREAKS = r"\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]"
NL = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WIDE}+|{WIDE}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def blank(x: str) -> str:
    return f"(({x}) IS NULL OR {strip(x)} = '')"


def lines(x: str) -> str:
    tidy = f"regexp_replace(regexp_replace({x}, '\\r\\n?', {NL}, 'g'), '\\n+$', '')"
    return f"CASE WHEN {blank(x)} THEN CAST([] AS VARCHAR[]) ELSE string_split({tidy}, {NL}) END"


def section_type(x: str) -> str:
    keys = [k for names in T.SECTION_TYPES.values() for k in names]
    kinds = [kind for kind, names in T.SECTION_TYPES.items() for _ in names]
    own = collapse(x)
    bare = collapse(rf"regexp_replace(lower(regexp_replace({own}, {lit(T.SECTION_PREFIX)}, '')), '[^a-z0-9\x{{4e00}}-\x{{9fff}} ]', ' ', 'g')")
    return f"CASE WHEN length({own}) BETWEEN 2 AND 120 THEN list_extract({items(kinds)}, list_position({items(keys)}, {bare})) END"


def tokens(x: str) -> str:
    return (
        rf"CAST(floor(length(regexp_replace({x}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) * 1.5::DOUBLE + "
        rf"length(regexp_replace({x}, '{WIDE}|[\x{{4e00}}-\x{{9fff}}]', '', 'g')) * 0.3::DOUBLE) AS INTEGER)"
    )


def chunk_type(text: str, page: str) -> str:
    return f"CASE WHEN contains({text}, '[TABLE]') THEN 'TABLE' WHEN NOT {blank(page)} AND {page} <> 'MIXED' THEN {page} ELSE 'TEXT' END"


def field(label: str, value: str) -> str:
    return f"CASE WHEN NOT {blank(f'CAST({value} AS VARCHAR)')} THEN '{label}: ' || {strip(f'CAST({value} AS VARCHAR)')} END"


# --- pages (doc_id, page_num, raw) to parsed (doc_id, page_num, text, section_title, section_type, content_type) ---

_OWN = strip("line")
_NOISE = (
    f"(regexp_matches({_OWN}, {lit(T.PAGE_NUMBER)}) OR (length({strip('lower(line)')}) <= 180 AND (regexp_matches({strip('lower(line)')}, {lit(T.NOISE_STARTS)})"
    + "".join(f" OR contains(lower(line), {lit(p)})" for p in T.NOISE_PHRASES)
    + ")))"
)
_CELLS = (
    f"CASE WHEN length(own) < 8 OR {section_type('own')} IS NOT NULL THEN CAST([] AS VARCHAR[]) WHEN own[1] = '|' AND own[-1] = '|' THEN string_split(own, '|') "
    r"WHEN (contains(own, '  ') OR contains(own, chr(9))) AND (regexp_matches(own, '[0-9]') OR regexp_matches(own, '[A-Za-z].*[A-Za-z]')) THEN regexp_split_to_array(own, '\t+| {2,}') "
    "ELSE CAST([] AS VARCHAR[]) END"
)
PARSED = f"""cleaned AS (SELECT doc_id, page_num, {strip(f"regexp_replace(regexp_replace(coalesce(raw, ''), '{chr(92)}r{chr(92)}n?', {NL}, 'g'), '{chr(92)}n{{3,}}', {NL} || {NL}, 'g')")} AS text FROM pages_in),
split AS (SELECT doc_id, page_num, {lines("text")} AS ls FROM cleaned),
line AS (SELECT doc_id, page_num, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, lower({collapse("line")}) AS line_key FROM line),
often AS (SELECT doc_id, line_key, count(DISTINCT page_num) AS n FROM keyed WHERE line_key <> '' AND length(line_key) <= 140 GROUP BY ALL),
totals AS (SELECT doc_id, greatest(3, least(count(*), ceil(count(*) * 0.35::DOUBLE))) AS most FROM pages_in GROUP BY doc_id),
kept AS (SELECT k.doc_id, page_num, pos, CASE WHEN {_OWN} = '' THEN '' ELSE line END AS line FROM keyed k JOIN totals USING (doc_id) LEFT JOIN often USING (doc_id, line_key)
 WHERE {_OWN} = '' OR NOT ({_NOISE} OR coalesce(n, 0) >= most)),
tidy AS (SELECT doc_id, page_num, regexp_split_to_array(string_agg(line, {NL} ORDER BY pos) || {NL}, '{BREAKS}') AS ls FROM kept GROUP BY ALL),
rows1 AS (SELECT doc_id, page_num, {strip("unnest(ls)")} AS own, generate_subscripts(ls, 1) AS pos FROM tidy),
rows2 AS (SELECT *, length(own) BETWEEN 8 AND 300 AND regexp_matches(own, '(?i)^table{SPACE}+[ivxlcdm0-9]+{SPACE}*[:.\\-]?.*$') AS is_caption, list_filter(list_transform({_CELLS}, lambda c: replace({strip("c")}, '|', '/')), lambda c: c <> '') AS cells FROM rows1),
rows3 AS (SELECT *, CASE WHEN is_caption THEN 'C' WHEN len(cells) >= 2 THEN 'R' ELSE 'O' END AS kind FROM rows2),
rows4 AS (SELECT *, lag(kind) OVER w AS before, sum(CASE WHEN kind = 'R' THEN 0 ELSE 1 END) OVER w AS run FROM rows3 WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY pos)),
rows5 AS (SELECT *, last_value(CASE WHEN kind = 'C' THEN own WHEN kind = 'O' AND before = 'R' THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id, page_num ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caption FROM rows4),
runs AS (SELECT doc_id, page_num, run, min(pos) AS pos, list(cells ORDER BY pos) AS grid, max(len(cells)) AS width, arg_min(caption, pos) AS caption FROM rows5 WHERE kind = 'R' GROUP BY ALL),
drawn AS (SELECT doc_id, page_num, pos, caption, list_transform(grid, lambda r: '|' || array_to_string(list_transform(r || list_transform(range(width - len(r)), lambda k: ''), lambda c: ' ' || c || ' |'), '')) AS shown, grid, width FROM runs),
out AS (SELECT doc_id, page_num, pos, own AS line FROM rows5 WHERE kind = 'O' AND own <> '' UNION ALL
 SELECT doc_id, page_num, pos, CASE WHEN len(grid) = 1 THEN array_to_string(grid[1], ' ') ELSE CASE WHEN coalesce(caption, '') <> '' THEN '[TABLE_CAPTION]' || caption || '[/TABLE_CAPTION]' || {NL} ELSE '' END
 || '[TABLE]' || {NL} || shown[1] || {NL} || '|' || repeat(' --- |', width) || {NL} || array_to_string(shown[2:], {NL}) || {NL} || '[/TABLE]' END FROM drawn),
marked AS (SELECT doc_id, page_num, {strip(f"regexp_replace(regexp_replace(string_agg(line, {NL} ORDER BY pos), '[ {chr(92)}t]+', ' ', 'g'), '{chr(92)}n{{3,}}', {NL} || {NL}, 'g')")} AS text FROM out GROUP BY ALL),
heads AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '{BREAKS}')[1:8], lambda x: struct_pack(title := {collapse("x")}, kind := {section_type("x")})), lambda h: h.kind IS NOT NULL)[1] AS head FROM marked WHERE text <> ''),
parsed AS (SELECT doc_id, page_num, text, last_value(head.title IGNORE NULLS) OVER w AS section_title, last_value(head.kind IGNORE NULLS) OVER w AS section_type,
 CASE WHEN NOT contains(text, '[TABLE]') THEN 'TEXT' WHEN {strip(r"regexp_replace(regexp_replace(text, '(?s)\[TABLE\].*?\[/TABLE\]', '', 'g'), '(?s)\[TABLE_CAPTION\].*?\[/TABLE_CAPTION\]', '', 'g')")} = '' THEN 'TABLE' ELSE 'MIXED' END AS content_type
 FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY page_num ROWS UNBOUNDED PRECEDING))"""


# --- windows (key, t) to win (key, pos, start_at, end_at, content) ---


def _aligned(at: str) -> str:
    torn = f"{at} > 0 AND {at} < n AND regexp_matches(substr(t, {at}, 2), '^[A-Za-z0-9]{{2}}$')"
    ahead = f"length(regexp_extract(substr(t, {at} + 1, 40), '^(?s:.*?){WIDE}'))"
    back = f"length(regexp_extract(substr(t, greatest({at} - 40, 0) + 1, least({at}, 40)), '^(?s:.*){WIDE}'))"
    return f"CASE WHEN {torn} THEN CASE WHEN {ahead} > 0 THEN {at} + {ahead} WHEN {back} > 0 THEN greatest({at} - 40, 0) + {back} ELSE {at} END ELSE {at} END"


def _end(size: int, overlap: int) -> str:
    full, low = f"(s + {size})", f"greatest(s + {max(1, overlap)}, s + {size} - {max(120, 2 * overlap)})"
    choices = ""
    for mark in chunk.SEPARATORS:
        seen = f"substr(t, {low} + 1, {full} + {len(mark)} - {low})"
        text = " || ".join(NL if c == "\n" else lit(c) for c in mark)
        choices += f"WHEN contains({seen}, {text}) THEN {low} + length({seen}) - strpos(reverse({seen}), reverse({text})) + 1 "
    space = f"length(regexp_extract(substr(t, {low}, {full} - {low} + 2), '^(?s:.*){WIDE}'))"
    return f"CASE WHEN {full} >= n THEN n {choices}WHEN {space} > 0 THEN least({low} - 1 + {space}, {full}) ELSE {full} END"


def windows(size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> str:
    """Each step takes the next window's start from the last one's end."""
    follow = f"CASE WHEN {_aligned('f')} > s THEN {_aligned('f')} ELSE e END"
    return f"""step AS (SELECT key, t, length(t) AS n, 0 AS s, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS f, 0 AS phase FROM win_in WHERE t <> ''
 UNION ALL SELECT key, t, n, CASE WHEN phase = 2 THEN {_aligned("s2")} ELSE s END, pos + CASE WHEN phase = 2 THEN 1 ELSE 0 END, CASE WHEN phase = 0 THEN {_end(size, overlap)} ELSE e END,
 CASE WHEN phase = 1 THEN greatest(s + 1, e - {overlap}) WHEN phase = 2 THEN s2 ELSE f END, CASE WHEN phase = 2 THEN 0 ELSE phase + 1 END
 FROM (SELECT *, CASE WHEN phase = 2 THEN {follow} ELSE 0 END AS s2 FROM step) WHERE phase = 0 OR e < n),
win AS (SELECT key, pos, s AS start_at, e AS end_at, {strip("substr(t, s + 1, e - s)")} AS content FROM step WHERE phase = 1 AND s < n AND {strip("substr(t, s + 1, e - s)")} <> '')"""


# --- parsed to sectioned, and to structured chunks ---

_BLOCK = chunk.TABLE_BLOCK.replace("'", "''")
SECTIONS = f"""pg1 AS (SELECT *, coalesce(lag(ends_table) OVER w, TRUE) AS fresh, NOT {blank("section_type")} OR NOT {blank("section_title")} AS known
 FROM (SELECT *, ends_with({strip("text")}, '[/TABLE]') AS ends_table FROM parsed) WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)),
pg2 AS (SELECT *, CASE WHEN known OR fresh THEN struct_pack(a := section_title, b := section_type) END AS own FROM pg1),
pg3 AS (SELECT *, fresh OR (known AND own IS DISTINCT FROM last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS new FROM pg2),
pg4 AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER w AS island,
 last_value(CASE WHEN new THEN struct_pack(title := section_title, kind := section_type, content := content_type, page := page_num) END IGNORE NULLS) OVER w AS data FROM pg3 WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)),
pt1 AS (SELECT *, regexp_split_to_array(text, '{_BLOCK}') AS prose, regexp_extract_all(text, '{_BLOCK}', 0) AS blocks FROM pg4),
pt2 AS (SELECT doc_id, page_num, island, data, unnest(prose) AS body, 2 * generate_subscripts(prose, 1) AS part, FALSE AS is_table FROM pt1
 UNION ALL SELECT doc_id, page_num, island, data, unnest(blocks), 2 * generate_subscripts(blocks, 1) + 1, TRUE FROM pt1),
pt3 AS (SELECT *, sum(CASE WHEN is_table THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_num, part ROWS UNBOUNDED PRECEDING) AS tables FROM pt2 WHERE {strip("body")} <> ''),
gr AS (SELECT doc_id, is_table, string_agg({strip("body")}, {NL} || {NL} ORDER BY page_num, part) AS body, min(page_num * 100000 + part) AS place, min(page_num) AS first_page, any_value(data) AS data FROM pt3 GROUP BY doc_id, island, tables, is_table),
sc AS (SELECT *, CASE WHEN is_table THEN {strip("regexp_extract(body, '(?s)" + chr(92) + "[TABLE" + chr(92) + "](.*?)" + chr(92) + "[/TABLE" + chr(92) + "]', 1)")} ELSE {strip("body")} END AS text,
 CASE WHEN is_table THEN nullif({strip("regexp_extract(body, '(?s)" + chr(92) + "[TABLE_CAPTION" + chr(92) + "](.*?)" + chr(92) + "[/TABLE_CAPTION" + chr(92) + "]', 1)")}, '') END AS table_caption FROM gr),
sections AS (SELECT doc_id, text, table_caption, CASE WHEN is_table THEN first_page ELSE least(data.page, first_page) END AS page_num, data.title AS section_title, data.kind AS section_type,
 CASE WHEN is_table THEN 'TABLE' ELSE data.content END AS content_type, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS sec_no FROM sc WHERE text <> '')"""


def _unique(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


#: tables (key, raw, caption, title, kind, page) to facts (key, datasets, metrics, methods, keywords, summary)
FACTS = f"""tl AS (SELECT *, list_filter(list_transform(list_filter(list_transform({lines("raw")}, lambda x: {strip("x")}), lambda x: starts_with(x, '|') AND ends_with(x, '|') AND length(x) > 1),
 lambda x: list_filter(list_transform(string_split(substr(x, 2, length(x) - 2), '|'), lambda c: {strip("c")}), lambda c: c <> '')), lambda r: len(r) > 0 AND len(list_filter(r, lambda c: NOT regexp_matches(c, '^:?-{{3,}}:?$'))) > 0) AS grid FROM tables_in),
tm AS (SELECT *, regexp_extract_all(concat_ws({NL}, coalesce(caption, ''), raw), '{chunk.DATASETS}', 1) AS named, upper(concat_ws(' ', coalesce(array_to_string(grid[1], ' '), ''), coalesce(caption, ''), raw)) AS said,
 greatest(1, coalesce(list_position(list_transform(grid[1], lambda h: regexp_matches(lower(h), '{chunk.METHOD_HEADERS}')), TRUE), 0)) AS col FROM tl),
tn AS (SELECT *, CASE WHEN len(grid) > 1 THEN list_filter(list_transform(grid[2:], lambda r: {strip("replace(r[col], '*', '')")}), lambda c: c IS NOT NULL AND c <> '' AND length(c) <= 80 AND NOT regexp_matches(c, '^[0-9.,%+ -]+$')) ELSE CAST([] AS VARCHAR[]) END AS cells,
 lower(concat_ws(' ', coalesce(caption, ''), coalesce(title, ''), coalesce(kind, ''))) AS about FROM tm),
tf AS (SELECT *, {_unique("named")} AS datasets, list_sort(list_filter({items(chunk.METRICS)}, lambda m: contains(said, m))) AS metrics, {_unique("cells")}[1:20] AS methods,
 list_filter(['table', 'experimental results', CASE WHEN contains(about, 'ablation') THEN 'ablation study' END, CASE WHEN regexp_matches(about, 'baseline|comparison|compare') THEN 'baseline comparison' END,
 CASE WHEN contains(about, 'dataset') THEN 'dataset statistics' END, CASE WHEN regexp_matches(about, 'result|experiment|evaluation') THEN 'performance comparison' END], lambda x: x IS NOT NULL) AS keywords FROM tn),
facts AS (SELECT *, concat_ws({NL}, {field("Table caption", "caption")}, {field("Section", "title")}, {field("Section type", "kind")}, {field("Page", "page")},
 CASE WHEN len(datasets) > 0 THEN 'Datasets mentioned: ' || array_to_string(datasets, ', ') || '.' END, CASE WHEN len(metrics) > 0 THEN 'Metrics mentioned: ' || array_to_string(metrics, ', ') || '.' END,
 CASE WHEN len(methods) > 0 THEN 'Methods or variants mentioned: ' || array_to_string(methods, ', ') || '.' END, 'Retrieval keywords: ' || array_to_string(keywords, ', ') || '.', {lit(chunk.TABLE_NOTE)}) AS summary FROM tf)"""

STRUCTURED = f"""{SECTIONS},
tables_in AS (SELECT doc_id * 100000 + sec_no AS key, text AS raw, table_caption AS caption, section_title AS title, section_type AS kind, page_num AS page FROM sections WHERE content_type = 'TABLE'),
{FACTS},
win_in AS (SELECT doc_id * 100000 + sec_no AS key, text AS t FROM sections WHERE coalesce(content_type, '') <> 'TABLE' AND length(text) > {chunk.SIZE}),
{windows()},
cut AS (SELECT s.*, coalesce(w.content, f.summary, s.text) AS content, coalesce(w.pos, 0) AS pos FROM sections s LEFT JOIN win w ON w.key = doc_id * 100000 + sec_no LEFT JOIN facts f ON f.key = doc_id * 100000 + sec_no),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, pos) - 1 AS INTEGER) AS chunk_index, content, CASE WHEN content_type = 'TABLE' THEN text END AS raw_content, table_caption, page_num, section_title, section_type,
 CASE WHEN content_type = 'TABLE' THEN 'TABLE' ELSE {chunk_type("content", "content_type")} END AS content_type, {tokens("content")} AS token_count FROM cut),
chunked AS (SELECT * FROM chunks WHERE length(content) >= {chunk.LEAST})"""

SLIDING = f"""win_in AS (SELECT doc_id * 100000 + page_num AS key, text AS t FROM plain WHERE NOT {blank("text")}),
{windows()},
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num, pos) - 1 AS INTEGER) AS chunk_index, content, CAST(NULL AS VARCHAR) AS raw_content, CAST(NULL AS VARCHAR) AS table_caption, page_num,
 CAST(NULL AS VARCHAR) AS section_title, CAST(NULL AS VARCHAR) AS section_type, {chunk_type("content", "CAST(NULL AS VARCHAR)")} AS content_type, {tokens("content")} AS token_count FROM plain JOIN win ON key = doc_id * 100000 + page_num),
chunked AS (SELECT * FROM chunks WHERE length(content) >= {chunk.LEAST})"""


# --- parsed to titles and metadata ---

_CREDIT = r"(contains(low, '@') OR contains(low, 'university') OR contains(low, 'institute') OR contains(low, 'department') OR contains(low, 'arxiv') OR starts_with(low, 'http') OR regexp_matches(low, '\b20[0-9]{2}\b'))"
TITLES = rf"""firsts AS (SELECT doc_id, arg_min(text, page_num) AS text FROM parsed GROUP BY doc_id),
tt1 AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{BREAKS}')) AS raw, generate_subscripts(regexp_split_to_array(text, '{BREAKS}'), 1) AS pos FROM firsts),
tt2 AS (SELECT doc_id, pos, {strip("raw")} AS l, lower({strip("raw")}) AS low, {section_type("raw")} IS NOT NULL AS heading FROM tt1),
tt3 AS (SELECT *, {_CREDIT} AS credit, length(l) BETWEEN 6 AND 180 AND NOT {_CREDIT} AND l NOT IN ('[TABLE]', '[/TABLE]') AND NOT starts_with(l, '|') AND NOT starts_with(l, '[TABLE_CAPTION]') AS good FROM tt2),
tt4 AS (SELECT *, coalesce(sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS got FROM tt3),
tt5 AS (SELECT doc_id, coalesce(min(pos) FILTER (WHERE got = 3 OR (got > 0 AND (l = '' OR credit)) OR (l <> '' AND heading)), 1000000) AS stop FROM tt4 GROUP BY doc_id),
titled AS (SELECT doc_id, nullif({strip("string_agg(l, ' ' ORDER BY pos) FILTER (WHERE good AND pos < stop)")}, '') AS title FROM tt4 JOIN tt5 USING (doc_id) GROUP BY doc_id)"""

_NAME = r"[A-ZÀ-ÖØ-Þ]\p{L}[\p{L}\p{N}_.''-]*"
_LOOSE = r"regexp_replace(lower({}), '[^a-z0-9\x{{3400}}-\x{{9fff}}]+', '', 'g')"
_HIT = lambda pattern: f"nullif(regexp_extract(flat, {lit(pattern)}, 1), '')"
_TRIMMED = lambda x: rf"regexp_replace({x}, '[\s.,;:]+$', '')"
METADATA = rf"""{TITLES},
whole AS (SELECT doc_id, {collapse(f"string_agg(text, {NL} || {NL} ORDER BY page_num)")} AS flat FROM parsed GROUP BY doc_id),
plain AS (SELECT doc_id, nullif({_TRIMMED(collapse(_HIT(metadata.KEYWORDS)))}, '') AS keywords, {_TRIMMED(_HIT(metadata.DOI))} AS doi, {_HIT(metadata.ARXIV)} AS arxiv_id,
 list_filter(list_transform(regexp_extract_all(flat, {lit(metadata.YEAR)}, 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND 2026)[1] AS year, nullif({collapse(_HIT(metadata.ABSTRACT))}, '') AS loose FROM whole),
ab1 AS (SELECT doc_id, min(page_num) FILTER (WHERE upper(section_type) = 'ABSTRACT') AS first FROM parsed GROUP BY doc_id),
ab2 AS (SELECT p.doc_id, any_value(first) AS first, coalesce(min(page_num) FILTER (WHERE page_num > first AND upper(section_type) <> 'ABSTRACT'), 1000000) AS stop FROM parsed p JOIN ab1 USING (doc_id) GROUP BY p.doc_id),
ab3 AS (SELECT doc_id, nullif({collapse(r"string_agg(regexp_replace(text, '(?is)^\s*abstract\s*[:\-]?\s*', ''), ' ' ORDER BY page_num)")}, '') AS body FROM parsed JOIN ab2 USING (doc_id) WHERE page_num >= first AND page_num < stop AND upper(section_type) = 'ABSTRACT' GROUP BY doc_id),
ab4 AS (SELECT doc_id, {strip(r"regexp_replace(body, '(?is)\s+(keywords|key words|index terms)\s*[:\-]?.*$', '')")} AS body FROM ab3),
au1 AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{BREAKS}'), lambda x: {strip("regexp_replace(x, '" + chr(92) + "s+', ' ', 'g')")}), lambda x: x <> '') AS ls FROM firsts),
au2 AS (SELECT doc_id, ls, CASE WHEN title IS NULL THEN 0 ELSE coalesce(list_position(list_transform(ls, lambda x: {_LOOSE.format("x")}), {_LOOSE.format(collapse("title"))}), len(ls)) END AS skip FROM au1 LEFT JOIN titled USING (doc_id)),
au3 AS (SELECT doc_id, unnest(ls[skip + 1:]) AS l, generate_subscripts(ls[skip + 1:], 1) AS pos FROM au2),
au4 AS (SELECT *, regexp_matches(lower(l), 'abstract|keywords|introduction') AS ends, NOT regexp_matches(lower(l), '{"|".join(w.replace(".", "[.]") for w in metadata.AFFILIATION + metadata.CREDITS)}') AND length(l) BETWEEN 3 AND 300
 AND (contains(l, ',') OR contains(l, ';') OR contains(lower(l), ' and ') OR regexp_matches(l, '{_NAME}\s+{_NAME}')) AS good FROM au3),
au5 AS (SELECT *, max(CASE WHEN ends THEN 1 ELSE 0 END) OVER w AS over, sum(CASE WHEN good AND NOT ends THEN 1 ELSE 0 END) OVER w AS nth FROM au4 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
au6 AS (SELECT doc_id, string_agg(l, '; ' ORDER BY pos) AS authors FROM au5 WHERE over = 0 AND good AND nth <= 3 GROUP BY doc_id),
metadata AS (SELECT p.doc_id, p.keywords, p.doi, p.arxiv_id, p.year, nullif({collapse("t.title")}, '') AS title, coalesce(ab4.body, p.loose) AS abstract_text, au6.authors FROM plain p LEFT JOIN titled t USING (doc_id) LEFT JOIN ab4 USING (doc_id) LEFT JOIN au6 USING (doc_id))"""
