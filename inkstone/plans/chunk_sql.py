"""SQL that cuts notices into chunks, as recursive queries over lines, sentences and units."""

from __future__ import annotations

from inkstone.config import Settings
from inkstone.functions import text as T

BLANK = r"[\t\x0B\f\r \x1C-\x1F\x{85}\p{Z}]"
_MARK = T.MARK.replace(T.BLANK, BLANK)
_EDGE = r"[\n\t\x0B\f\r \x1C-\x1F\x{85}\p{Z}]+"
OPENS = rf"^\s*[\[(【]?\s*(?:{T.spaced(T.QUALIFIER)}\s*)?[\[(【]?\s*({T.LABEL})[\])】]?(?:\s|$)"


def cleaned(expr: str) -> str:
    """``clean_text``."""
    steps = [("<[^>]+>", "' '"), (r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", "''"), (r"\r\n?", "chr(10)"), (r"[ \t\x{3000}]+", "' '"), (f"(?m)^{BLANK}+|{BLANK}+$", "''"), (r"\n{3,}", "chr(10)||chr(10)"), (r"^\n+|\n+$", "''")]
    out = f"nfc_normalize({expr})"
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    return out


def trimmed(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_EDGE}|{_EDGE}$', '', 'g')"


def unmarked(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s*{_MARK}(?:\s+|$)', '')"


def bare(expr: str) -> str:
    """A line without its mark, without marks and labels after sentence ends, trimmed."""
    glued = rf"((?:^|[^{T.ORDINALS}\d])[.!?])\s+(?:{_MARK}|{T.LABEL})(\s|$)"
    return trimmed(rf"regexp_replace({unmarked(expr)}, '{glued}', '\1\2', 'g')")


def lines_of(expr: str) -> str:
    return f"list_filter(list_transform(string_split({expr}, chr(10)), lambda x: {trimmed('x')}), lambda x: x <> '')"


def sentences_of(expr: str) -> str:
    cut = rf"regexp_replace(regexp_replace({expr}, '([.!?])[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: {trimmed('x')}), lambda x: x <> '')"


def chunks(source: str, p: str = "", settings: Settings | None = None) -> str:
    """Common table expressions that end in ``{p}chunks`` for the relation ``source`` of notices; needs WITH RECURSIVE."""
    s = settings or Settings()
    most, least, overlap = s.chunk_max_chars, s.chunk_min_chars, s.chunk_overlap_chars
    tail = "win[len(win) - k + 1:]"
    carried = f"coalesce(list_max(list_filter(range(0, len(win) + 1), lambda k: coalesce(list_sum(list_transform({tail}, lambda x: length(x))), 0) <= {overlap} AND (k = 0 OR length(array_to_string({tail}, chr(10))) + 1 + length(u) <= lim))), 0)"
    closed = f"CASE WHEN length(array_to_string(win, chr(10))) < {least} AND len(done) > 0 THEN list_append(done[:len(done) - 1], done[len(done)] || chr(10) || array_to_string(win[rep + 1:], chr(10))) ELSE list_append(done, array_to_string(win, chr(10))) END"
    return f"""
{p}n AS (SELECT row_number() OVER () AS rid, notice_num, {trimmed("coalesce(subject, '')")} AS subject, {trimmed("coalesce(committee, '')")} AS committee, {cleaned("coalesce(proposal_reason, '')")} AS r, {cleaned("coalesce(ai_summary, '')")} AS y FROM ({source})),
{p}m AS (SELECT rid, greatest({most} - CASE WHEN subject = '' THEN 0 ELSE length(subject) + 1 END, {least}) AS lim, {bare('subject')} AS title, list_transform({lines_of('y')}, lambda x: {bare('x')}) AS summary FROM {p}n),
{p}l AS (SELECT rid, pos, line, regexp_extract(line, '{OPENS}', 1) AS label, {trimmed(f"regexp_replace(line, '{OPENS}', '')")} AS tail FROM (SELECT rid, i AS pos, x[i] AS line FROM (SELECT rid, {lines_of('r')} AS x FROM {p}n), unnest(range(1, len(x) + 1)) t(i))),
{p}o AS (SELECT rid, pos, label, CASE WHEN label = '' THEN line ELSE tail END AS own, sum(CASE WHEN label <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos)::BIGINT AS ord FROM {p}l),
{p}own AS (SELECT rid, ord, coalesce(nullif(max(label), ''), '{T.NO_SECTION}') AS section, list({bare('own')} ORDER BY pos) FILTER (WHERE own <> '' OR label = '') AS x FROM {p}o GROUP BY rid, ord HAVING count(*) FILTER (WHERE own <> '' OR label = '') > 0),
{p}secs AS (SELECT * FROM {p}own UNION ALL SELECT rid, 1000000, '{T.SUMMARY_SECTION}', summary FROM {p}m WHERE len(summary) > 0 UNION ALL SELECT rid, -1, '{T.NO_SECTION}', [title] FROM {p}m WHERE len(summary) > 0 AND rid NOT IN (SELECT rid FROM {p}own)),
{p}para AS (SELECT rid, ord, j, x[j] AS line, lim FROM {p}secs JOIN {p}m USING (rid), unnest(range(1, len(x) + 1)) t(j) WHERE x[j] <> ''),
{p}long AS (SELECT rid, ord, j, lim, {sentences_of('line')} AS sent, 1 AS i, []::VARCHAR[] AS units, '' AS buf FROM {p}para WHERE length(line) > lim
  UNION ALL SELECT rid, ord, j, lim, sent, i + 1, CASE WHEN length(st) > lim THEN list_concat(u0, list_transform(range(0, length(st), lim), lambda a: substr(st, a + 1, lim))) ELSE u0 END, CASE WHEN length(st) > lim THEN '' WHEN b0 = '' THEN st ELSE b0 || ' ' || st END
  FROM (SELECT *, CASE WHEN flushed THEN '' ELSE buf END AS b0, CASE WHEN flushed THEN list_append(units, buf) ELSE units END AS u0 FROM (SELECT *, sent[i] AS st, buf <> '' AND length(buf) + 1 + length(sent[i]) > lim AS flushed FROM {p}long WHERE i <= len(sent)))),
{p}u AS (SELECT rid, ord, j, lim, [line] AS units FROM {p}para WHERE length(line) <= lim UNION ALL SELECT rid, ord, j, lim, CASE WHEN buf = '' THEN units ELSE list_append(units, buf) END FROM {p}long WHERE i > len(sent)),
{p}sec AS (SELECT rid, ord, any_value(lim) AS lim, flatten(list(units ORDER BY j)) AS units FROM {p}u GROUP BY rid, ord),
{p}pack AS (SELECT rid, ord, lim, units, 1 AS i, []::VARCHAR[] AS win, 0::BIGINT AS rep, []::VARCHAR[] AS done FROM {p}sec
  UNION ALL SELECT rid, ord, lim, units, i + 1, list_append(CASE WHEN spills THEN win[len(win) - keep + 1:] ELSE win END, u), CASE WHEN spills THEN keep ELSE rep END, CASE WHEN spills THEN {closed} ELSE done END
  FROM (SELECT *, CASE WHEN spills THEN {carried} ELSE 0 END AS keep FROM (SELECT *, units[i] AS u, len(win) > rep AND length(array_to_string(win, chr(10))) + 1 + length(units[i]) > lim AS spills FROM {p}pack WHERE i <= len(units)))),
{p}packed AS (SELECT rid, ord, CASE WHEN len(win) > rep THEN {closed} ELSE done END AS out FROM {p}pack WHERE i > len(units)),
{p}cut AS (SELECT rid, ord, k, out[k] AS text FROM {p}packed, unnest(range(1, len(out) + 1)) t(k)),
{p}every AS (SELECT rid, (row_number() OVER (PARTITION BY rid ORDER BY ord, k) - 1)::INTEGER AS chunk_index, section, text FROM {p}cut JOIN {p}secs USING (rid, ord) UNION ALL SELECT rid, 0, '{T.NO_SECTION}', {trimmed(f"subject || chr(10) || array_to_string(list_filter(list_transform(string_split(r, chr(10)), lambda x: {unmarked(trimmed('x'))}), lambda x: x <> ''), chr(10))")} FROM {p}n WHERE rid NOT IN (SELECT rid FROM {p}cut)),
{p}chunks AS (SELECT notice_num || '-' || printf('%04d', chunk_index) AS chunk_id, notice_num, subject, committee, section, chunk_index, text, length(text)::INTEGER AS char_count, len({sentences_of('text')})::INTEGER AS sentence_count, sha256(notice_num || '-' || printf('%04d', chunk_index) || chr(0) || CASE WHEN subject = '' OR starts_with(text, subject) THEN text ELSE subject || chr(10) || text END || chr(10)) AS digest FROM {p}every JOIN {p}n USING (rid))"""


def squashed(expr: str) -> str:
    return rf"regexp_replace(coalesce({expr}, ''), '[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]+', '', 'g')"


def capabilities(name: str, source: str, p: str = "", rows: str | None = None) -> str:
    """Common table expression ``name`` (capability, notice_num) of the notices ``source`` cut in ``chunks(source, p)``, or
    of other chunk ``rows`` of theirs."""
    texts = f"SELECT notice_num, {squashed('string_agg(text, chr(0) ORDER BY chunk_index, text)')} AS whole FROM {rows or p + 'chunks'} GROUP BY notice_num"
    return f"""
{name}t AS (SELECT notice_num, replace(whole, chr(0), '') AS whole FROM ({texts})),
{name} AS (SELECT 'indexed' AS capability, notice_num FROM ({source}) JOIN {name}t USING (notice_num)
  UNION SELECT 'title_text', notice_num FROM ({source}) JOIN {name}t USING (notice_num) WHERE {squashed('subject')} <> '' AND contains(whole, {squashed('subject')})
  UNION SELECT 'derived:ai_summary', notice_num FROM ({source}) JOIN {name}t USING (notice_num) WHERE {squashed('ai_summary')} <> '' AND contains(whole, {squashed('ai_summary')})
  UNION SELECT 'section:' || o.section, n.notice_num FROM {p}own o JOIN {p}n n USING (rid) JOIN (SELECT DISTINCT notice_num, section FROM {rows or p + 'chunks'}) c ON c.notice_num = n.notice_num AND c.section = o.section)"""
