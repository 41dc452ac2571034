"""SQL that must give the same rows, for the llm queries SQL can express."""

from __future__ import annotations

from inkstone.llm.canon import invisible, rules
from inkstone.llm.splitting import LABELS, NO_SECTION

_WHITE = r"\n\t\x0B\f\r \x1C-\x1F\x{85}\p{Z}"
_OTHER = r"[^\p{L}\p{N}\p{M}]"


def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


def _label(expr: str) -> str:
    """The squashed label of a heading line; other lines give something that is none of the labels."""
    bare = rf"regexp_replace(regexp_replace({expr}, '^(?:{_OTHER}|\(?(?:\d{{1,2}}|[가-하]|[IVX]+)[.)]{_OTHER})+', ''), '{_OTHER}+$', '')"
    return f"regexp_replace({bare}, '[{_WHITE}]+', '', 'g')"


def _one_of(expr: str) -> str:
    cases = " ".join(f"WHEN '{label.replace(' ', '')}' THEN '{label}'" for label in LABELS)
    return f"CASE {_label(expr)} {cases} END"


def _bodies() -> str:
    """Common table expressions: ``b`` of notices' section bodies, ``c`` of chunk rows, each once."""
    lines = "SELECT notice_num, i AS pos, p[i] AS line FROM (SELECT notice_num, string_split(proposal_reason, chr(10)) AS p FROM (SELECT DISTINCT notice_num, proposal_reason FROM notices_chunk_coverage WHERE proposal_reason IS NOT NULL)), unnest(range(1, len(p) + 1)) u(i)"
    return f"""
WITH l AS (SELECT *, {_one_of('line')} AS label FROM ({lines})),
s AS (SELECT *, count(label) OVER (PARTITION BY notice_num ORDER BY pos) AS no FROM l),
b AS (SELECT notice_num::VARCHAR AS item_id, no, coalesce(max(label), '{NO_SECTION}') AS section, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE label IS NULL) AS body FROM s GROUP BY notice_num, no),
c AS (SELECT chunk_id AS item_id, coalesce({_one_of('section')}, nullif({_trim('section')}, ''), '{NO_SECTION}') AS section, text AS body FROM (SELECT DISTINCT chunk_id, section, text FROM chunks)),
x AS (SELECT 'notice' AS origin, item_id, section, body FROM b WHERE length({_trim('body')}) > 200 UNION ALL SELECT 'chunk', item_id, section, body FROM c WHERE length({_trim('body')}) > 200)"""


def p1_found() -> str:
    return _bodies() + " SELECT DISTINCT origin, item_id, section FROM x"


def p1_tiles() -> str:
    return _bodies() + f" SELECT origin, item_id, section, sum(length(regexp_replace(body, '[{_WHITE}]+', '', 'g')))::BIGINT AS signs, true AS fits FROM x GROUP BY ALL"


def canonical(expr: str) -> str:
    """The consistent form: unseen signs out, single signs translated, letters composed, gaps at line ends out."""
    pairs = {a: b for name, group in rules() if name not in ("unseen", "unified") for a, b in group.items() if len(a) == len(b) == 1}
    source, target = ("".join(x).replace("'", "''") for x in zip(*sorted(pairs.items()), strict=True))
    unseen = "".join(f"\\x{{{ord(c):X}}}" for c in sorted(invisible()) if ord(c) < 0x1000 or 0x2000 <= ord(c) < 0x2100 or ord(c) in (0xFEFF, *range(0xFE00, 0xFE10)))
    out = f"replace({expr}, chr(13) || chr(10), chr(10))"
    out = f"translate(regexp_replace({out}, '[{unseen}]', '', 'g'), '{source}', '{target}')"
    return f"regexp_replace(nfc_normalize({out}), ' +(\\n|$)', '\\1', 'g')"


def p3_found() -> str:
    field = "SELECT DISTINCT notice_num, '{0}' AS field_name, {0} AS t, {1} AS c FROM notices_capability_gate WHERE {0} IS NOT NULL"
    rows = " UNION ALL ".join(field.replace("{0}", f).replace("{1}", canonical(f)) for f in ("subject", "proposal_reason"))
    return f"WITH r AS ({rows}), k AS (SELECT * FROM r WHERE regexp_replace(c, '\\s+', '', 'g') <> '') SELECT DISTINCT a.notice_num AS notice_num_a, b.notice_num AS notice_num_b, a.field_name FROM k a JOIN k b ON a.field_name = b.field_name AND a.c = b.c AND a.t <> b.t AND a.notice_num < b.notice_num"


def p3_canonical() -> str:
    a, b = canonical("subject"), canonical("proposal_reason")
    return f"SELECT notice_num, s AS subject_canonical, r AS proposal_reason_canonical, sha256(coalesce(s, '') || chr(10) || coalesce(r, '')) AS look_digest FROM (SELECT notice_num, {a} AS s, {b} AS r FROM (SELECT DISTINCT notice_num, subject, proposal_reason FROM notices_capability_gate))"


def _word_sets() -> str:
    """``w``: the distinct words of each notice with enough of them; ``p``: pairs of similar ones, smaller number first."""
    both = canonical("coalesce(subject, '') || chr(10) || coalesce(proposal_reason, '')")
    words = f"list_filter(regexp_split_to_array({both}, '\\s+'), lambda x: x <> '')"
    return f"WITH RECURSIVE w AS (SELECT notice_num, list_distinct(w) AS s FROM (SELECT DISTINCT notice_num, {words} AS w FROM notices_capability_gate) WHERE len(w) >= 40), p AS (SELECT a.notice_num AS a, b.notice_num AS b, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS t FROM w a JOIN w b ON a.notice_num < b.notice_num AND least(len(a.s), len(b.s)) >= 0.6 * greatest(len(a.s), len(b.s)))"


def p6_found() -> str:
    return _word_sets() + " SELECT DISTINCT a AS notice_num_a, b AS notice_num_b FROM p WHERE c / (t - c) >= 0.6"


def p6_groups() -> str:
    """Groups by reachability; ``links`` counts the different word sets similar to a notice's own."""
    return _word_sets() + ", q AS (SELECT a, b FROM p WHERE c / (t - c) >= 0.6 UNION SELECT b, a FROM p WHERE c / (t - c) >= 0.6), r AS (SELECT notice_num, notice_num AS other FROM w UNION SELECT r.notice_num, q.b FROM r JOIN q ON q.a = r.other), g AS (SELECT notice_num, min(other) AS group_id FROM r GROUP BY notice_num), k AS (SELECT q.a, count(DISTINCT list_sort(o.s)) AS links FROM q JOIN w m ON m.notice_num = q.a JOIN w o ON o.notice_num = q.b WHERE list_sort(m.s) <> list_sort(o.s) GROUP BY q.a) SELECT notice_num, group_id, coalesce(links, 0)::BIGINT AS links FROM g LEFT JOIN k ON k.a = g.notice_num"


def _neighbours(dimension: int = 64) -> str:
    return f"WITH v AS (SELECT chunk_id AS id, min(embedding) AS e FROM chunk_embeddings WHERE len(embedding) = {dimension} GROUP BY chunk_id), u AS (SELECT id, list_transform(e, lambda x: x::DOUBLE) AS e FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0), s AS (SELECT a.id AS q, b.id AS n, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.id <> b.id)"


def p7_found() -> str:
    return _neighbours() + ", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS r FROM s WHERE c >= 0.9) SELECT DISTINCT least(q, n) AS chunk_id_a, greatest(q, n) AS chunk_id_b FROM r WHERE r <= 5"


def p7_neighbours() -> str:
    return _neighbours() + ", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS r FROM s WHERE split_part(q, '-', 1)::BIGINT % 20 = 0) SELECT q AS chunk_id, n AS neighbour, round(c, 5) AS cosine FROM r WHERE r <= 5"


def p8_cover() -> str:
    return "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars, true AS whole, true AS fits FROM documents"


def p9_use() -> str:
    plain = f"nullif(lower({_trim('source')}), '')"
    return f"SELECT t.source, count(d.s)::BIGINT AS records, 0::BIGINT AS used_too_often FROM source_targets t LEFT JOIN (SELECT {plain} AS s FROM documents) d ON d.s = t.source GROUP BY t.source"


ORACLES = {f.__name__: f() for f in (p1_found, p1_tiles, p3_found, p3_canonical, p6_found, p6_groups, p7_found, p7_neighbours, p8_cover, p9_use)}
