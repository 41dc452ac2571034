"""Queries over texts: scans, cleaning, structure, chunks, digests, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.config import Settings
from inkstone.functions import lexical, text
from inkstone.operators import chunking, incremental
from inkstone.plans import chunk_sql
from inkstone.plans.registry import query
from inkstone.session import table
from inkstone.sources import io

#: Notices of both notice tables, each row once, nulls as empty strings; those of one table have no summary column.
NOTICES = """
SELECT notice_num, coalesce(subject,'') AS subject, coalesce(proposer_category,'') AS proposer_category, coalesce(committee,'') AS committee, coalesce(proposal_reason,'') AS proposal_reason FROM notices_chunk_coverage
UNION SELECT notice_num, coalesce(subject,''), coalesce(proposer_category,''), coalesce(committee,''), coalesce(proposal_reason,'') FROM notices_capability_gate"""
SUMMARIES = "SELECT notice_num, max(ai_summary) AS ai_summary FROM notices_capability_gate WHERE ai_summary IS NOT NULL GROUP BY notice_num"
BLANK = r"[\t\x0B\f\r \x1C-\x1F\x{85}\p{Z}]"
CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({{0}}), '<[^>]+>', ' ', 'g'), '[\x{{{{200B}}}}\x{{{{200C}}}}\x{{{{200D}}}}\x{{{{FEFF}}}}]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t\x{{{{3000}}}}]+', ' ', 'g'), '(?m)^{BLANK.replace('{', '{{').replace('}', '}}')}+|{BLANK.replace('{', '{{').replace('}', '}}')}+$', '', 'g'), '\n{{{{3,}}}}', chr(10)||chr(10), 'g'), '^\n+|\n+$', '', 'g')"


def cleaned(expr: str) -> str:
    """SQL of ``clean_text``."""
    return CLEAN.format(expr).replace("{{", "{").replace("}}", "}")


TRIM = r"regexp_replace({0}, '^[\n\t\x0B\f\r \x1C-\x1F\x{{85}}\p{{Z}}]+|[\n\t\x0B\f\r \x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"


def notices(spark: SparkSession, d: str) -> DataFrame:
    cols = ["notice_num", "subject", "proposer_category", "committee", "proposal_reason"]
    both = table(spark, d, "notices_chunk_coverage").select(cols).unionByName(table(spark, d, "notices_capability_gate").select(cols))
    return both.fillna("").distinct()


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notices_capability_gate").where("ai_summary IS NOT NULL").groupBy("notice_num").agg(F.max("ai_summary").alias("ai_summary"))


@query("notice_scan_left_summary", f"SELECT n.notice_num, n.subject, n.proposer_category, n.committee, sha256(n.proposal_reason) AS reason_digest, coalesce(s.ai_summary,'') AS ai_summary FROM ({NOTICES}) n LEFT JOIN ({SUMMARIES}) s USING (notice_num)")
def notice_scan_left_summary(spark: SparkSession, d: str) -> DataFrame:
    return io.scan_notices(notices(spark, d), summaries(spark, d)).select("notice_num", "subject", "proposer_category", "committee", F.sha2("proposal_reason", 256).alias("reason_digest"), "ai_summary")


@query("latest_notices_of_category", f"SELECT notice_num, subject FROM ({NOTICES}) WHERE proposer_category = '의원' ORDER BY notice_num DESC LIMIT 50")
def latest_notices_of_category(spark: SparkSession, d: str) -> DataFrame:
    """The scan with a caller's condition and limit; both are its features."""
    return io.scan_notices(notices(spark, d), summaries(spark, d), where="proposer_category = '의원'", limit=50).select("notice_num", "subject")


@query("stratified_sample", f"SELECT notice_num, length_bucket FROM (SELECT *, row_number() OVER (PARTITION BY length_bucket ORDER BY notice_num DESC) r FROM (SELECT notice_num, CASE WHEN length(proposal_reason) BETWEEN 80 AND 400 THEN 'short' WHEN length(proposal_reason) BETWEEN 401 AND 1200 THEN 'medium' WHEN length(proposal_reason) > 1200 THEN 'long' END length_bucket FROM ({NOTICES})) WHERE length_bucket IS NOT NULL) WHERE r <= 20")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return io.stratified_sample(notices(spark, d), 20).select("notice_num", "length_bucket")


@query("normalize_documents", f"SELECT doc_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT doc_id, {cleaned('coalesce(text, chr(0))')} t FROM documents WHERE text IS NOT NULL)")
def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.clean_text("text").alias("t"))
    return docs.select("doc_id", F.length("t").cast("bigint").alias("chars"), F.sha2("t", 256).alias("digest"))


_RESIDUE = [("가\r\n나\r다", "가\n나\n다"), ("<b>굵게</b> 보통", "굵게 보통"), ("a\u200bb\u200cc\u200dd\ufeff", "abcd"), ("  앞 \t　 뒤  ", "앞 뒤"), ("가\n\n\n\n나", "가\n\n나"), ("\u1100\u1161\u11a8", "각"), (None, ""), ("", ""), ("a < b and c > d", "a d")]


@query("normalize_golden", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{b}')" for i, (_, b) in enumerate(_RESIDUE)) + ") t(id, cleaned)")
def normalize_golden(spark: SparkSession, d: str) -> DataFrame:
    """Texts with every kind of residue."""
    rows = [(i, a) for i, (a, _) in enumerate(_RESIDUE)]
    return spark.createDataFrame(rows, "id int, raw string").select("id", text.clean_text("raw").alias("cleaned"))


@query("paragraphs_exploded", f"SELECT doc_id, (i - 1)::INTEGER AS pos, sha256(p[i]) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format('x').replace('{{', '{').replace('}}', '}')}), lambda x: x <> '') p FROM documents WHERE text IS NOT NULL), unnest(range(1, len(p) + 1)) u(i)")
def paragraphs_exploded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.paragraphs("text")).alias("pos", "p")).select("doc_id", "pos", F.sha2("p", 256).alias("digest"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '([.!?])[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: {1}), lambda x: x <> '')"


def sentence_list(expr: str) -> str:
    return _SENT.replace("{{", "{").replace("}}", "}").replace("{0}", expr).replace("{1}", TRIM.replace("{{", "{").replace("}}", "}").replace("{0}", "x"))


@query("sentence_counts", f"SELECT doc_id, len({sentence_list('text')})::INTEGER AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(text.split_sentences("text")).alias("sentences"))


_OPENS = rf"^\s*[\[(【]?\s*(?:{text.spaced(text.QUALIFIER)}\s*)?[\[(【]?\s*({text.LABEL})[\])】]?"
_TRIM_LINE = TRIM.replace("{{", "{").replace("}}", "}")
#: Lines of cleaned notices with their label and what follows it.
LINES = f"""
l AS (SELECT notice_num, pos, line, regexp_extract(line, '{_OPENS}(?:\\s|$)', 1) AS label, {_TRIM_LINE.replace('{0}', f"regexp_replace(line, '{_OPENS}(?:\\s|$)', '')")} AS tail FROM (SELECT notice_num, i AS pos, p[i] AS line FROM (SELECT notice_num, list_filter(list_transform(string_split({cleaned('proposal_reason')}, chr(10)), lambda x: {_TRIM_LINE.replace('{0}', 'x')}), lambda x: x <> '') p FROM n), unnest(range(1, len(p) + 1)) u(i))),
s AS (SELECT *, sum(CASE WHEN label <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY notice_num ORDER BY pos)::BIGINT AS no, CASE WHEN label = '' THEN line ELSE tail END AS own FROM l)"""


@query("section_running_number", f"""
WITH n AS (SELECT DISTINCT notice_num, proposal_reason FROM notices_chunk_coverage WHERE proposal_reason IS NOT NULL), {LINES}
SELECT notice_num, (row_number() OVER (PARTITION BY notice_num ORDER BY no) - 1)::INTEGER AS place, section, lines FROM (SELECT notice_num, no, coalesce(nullif(max(label), ''), 'body') AS section, (count(*) FILTER (WHERE own <> '' OR label = ''))::INTEGER AS lines FROM s GROUP BY notice_num, no) WHERE lines > 0""")
def section_running_number(spark: SparkSession, d: str) -> DataFrame:
    """The sections of each notice in order, with their number of lines."""
    n = table(spark, d, "notices_chunk_coverage").where("proposal_reason IS NOT NULL").select("notice_num", "proposal_reason").distinct()
    found = n.select("notice_num", F.posexplode(chunking.sections_of(text.clean_text("proposal_reason"))).alias("place", "s"))
    return found.select("notice_num", "place", "s.section", F.size("s.lines").alias("lines"))


@query("item_marks", r"""SELECT notice_num, count(*) AS lines, count(*) FILTER (WHERE regexp_replace(line, '^\s*(?:[가나다라마바사아자차카타파하]\s*[.)]|\d{1,3}\s*[.)]|[①-⑳]|[\[\(][가나다라마바사아자차카타파하\d]{1,3}[\]\)]|[ㅇ○●◦•])(?:\s+|$)', '') <> line) AS marked FROM (SELECT notice_num, unnest(string_split(proposal_reason, chr(10))) AS line FROM (SELECT DISTINCT notice_num, proposal_reason FROM notices_chunk_coverage WHERE proposal_reason IS NOT NULL)) GROUP BY notice_num""")
def item_marks(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notices_chunk_coverage").where("proposal_reason IS NOT NULL").select("notice_num", "proposal_reason").distinct()
    lines = n.select("notice_num", F.explode(F.split("proposal_reason", "\n")).alias("line"))
    return lines.groupBy("notice_num").agg(F.count("*").alias("lines"), F.count_if(text.strip_mark("line") != F.col("line")).alias("marked"))


@query("ko_structure_golden", "SELECT * FROM (VALUES ('mark','가. 내용','내용'),('mark','2) 내용','내용'),('mark','① 내용','내용'),('mark','(나) 내용','내용'),('mark','ㅇ 내용','내용'),('mark','가격을 정함','가격을 정함'),('glued','정함. 참고사항 이 법은','정함. 이 법은'),('glued','함(안 제2조). 바. 검사의 처리','함(안 제2조). 검사의 처리'),('glued','가. 주요 내용 첫 항목','가. 주요 내용 첫 항목'),('header','제안이유 및 주요내용 현행법은','제안이유 및 주요내용'),('header','[주요내용] 가','주요내용'),('header','주요 내용은 다음과 같음',''),('header','대안의 제안이유','제안이유'),('law','도로교통법 일부개정법률안(대안)','도로교통법'),('law','민사 집행법 전부개정 법률안 (의원 등 10인)','민사집행법'),('law','어떤 결의안',NULL)) t(kind, raw, result)")
def ko_structure_golden(spark: SparkSession, d: str) -> DataFrame:
    rows = [("mark", x) for x in ("가. 내용", "2) 내용", "① 내용", "(나) 내용", "ㅇ 내용", "가격을 정함")] + [("glued", x) for x in ("정함. 참고사항 이 법은", "함(안 제2조). 바. 검사의 처리", "가. 주요 내용 첫 항목")]
    rows += [("header", x) for x in ("제안이유 및 주요내용 현행법은", "[주요내용] 가", "주요 내용은 다음과 같음", "대안의 제안이유")] + [("law", x) for x in ("도로교통법 일부개정법률안(대안)", "민사 집행법 전부개정 법률안 (의원 등 10인)", "어떤 결의안")]
    r = spark.createDataFrame(rows, "kind string, raw string")
    return r.select("kind", "raw", F.when(F.col("kind") == "mark", text.strip_mark("raw")).when(F.col("kind") == "glued", text.strip_glued("raw")).when(F.col("kind") == "header", text.header_label("raw")).otherwise(text.amended_law("raw")).alias("result"))


@query("amended_laws", f"SELECT regexp_replace(left(t, length(t) - length(e)), '\\s+', '', 'g') AS law, count(DISTINCT notice_num) AS notices FROM (SELECT *, regexp_extract(t, '(?:{'|'.join(map(text.spaced, text.AMENDMENTS))})$') AS e FROM (SELECT notice_num, regexp_replace({cleaned('subject')}, '(\\s*\\([^()]*\\))+$', '') AS t FROM notices_capability_gate WHERE subject IS NOT NULL)) WHERE e <> '' AND trim(left(t, length(t) - length(e))) <> '' GROUP BY law")
def amended_laws(spark: SparkSession, d: str) -> DataFrame:
    """Notices per law they amend."""
    n = table(spark, d, "notices_capability_gate").select("notice_num", text.amended_law("subject").alias("law"))
    return n.where("law IS NOT NULL").groupBy("law").agg(F.countDistinct("notice_num").alias("notices"))


COMPOSED = r"CASE WHEN s = '' OR starts_with(text, s) THEN text ELSE s || chr(10) || text END"
_CHUNK_ROWS = f"SELECT DISTINCT chunk_id, notice_num, committee, section, chunk_index, text, {TRIM.format('coalesce(subject, chr(32))').replace('{{', '{').replace('}}', '}')} AS s FROM chunks"


@query("compose_and_digest", f"SELECT chunk_id, length(c) AS chars, sha256(chunk_id || chr(0) || c || chr(10)) AS digest FROM (SELECT DISTINCT chunk_id, {COMPOSED} AS c FROM ({_CHUNK_ROWS}))")
def compose_and_digest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", text.compose("subject", "text").alias("c"), text.digest("chunk_id", "subject", "text").alias("digest")).distinct()
    return c.select("chunk_id", F.length("c").cast("bigint").alias("chars"), "digest")


@query("set_fingerprint", f"WITH r AS (SELECT chunk_id, sha256(chunk_id || chr(0) || c || chr(10)) AS digest, substr(sha256(chunk_id), 1, 3) AS leaf FROM (SELECT DISTINCT chunk_id, {COMPOSED} AS c FROM ({_CHUNK_ROWS}))), l AS (SELECT leaf, sha256(string_agg(digest, '' ORDER BY chunk_id, digest)) AS digest, count(*) AS n FROM r GROUP BY leaf) SELECT sha256(string_agg(digest, '' ORDER BY leaf)) AS fingerprint, sum(n)::BIGINT AS chunks FROM l")
def set_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return incremental.set_fingerprint(table(spark, d, "chunks"))


def _chunks(spark: SparkSession, d: str, settings: Settings | None = None) -> DataFrame:
    n = notices(spark, d).join(summaries(spark, d), "notice_num", "left")
    return chunking.chunk_notices(n, settings)


#: Notices with the longest of their summaries in order, and their chunks.
NOTED = f"SELECT n.*, y.ai_summary FROM ({NOTICES}) n LEFT JOIN ({SUMMARIES}) y USING (notice_num)"
CHUNKS = "WITH RECURSIVE " + chunk_sql.chunks(NOTED)


@query("chunk_notices", CHUNKS + " SELECT * FROM chunks")
def chunk_notices(spark: SparkSession, d: str) -> DataFrame:
    """Every notice cut into chunks, with the digest of what would be embedded."""
    return _chunks(spark, d).withColumn("digest", text.digest("chunk_id", "subject", "text"))


_UNCOVERED = "WITH RECURSIVE " + chunk_sql.chunks(f"SELECT *, NULL::VARCHAR AS ai_summary FROM ({NOTICES})") + f", t AS (SELECT notice_num, string_agg({chunk_sql.squashed('text')}, '' ORDER BY chunk_index) AS whole FROM chunks GROUP BY notice_num)"


@query("chunk_coverage_violations", _UNCOVERED + f" SELECT count(*) FILTER (WHERE NOT contains(whole, {chunk_sql.squashed(chunk_sql.bare('own'))})) AS violations FROM o JOIN n USING (rid) JOIN t USING (notice_num) WHERE {chunk_sql.bare('own')} <> ''")
def chunk_coverage_violations(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned lines of the shaped fixture notices that no chunk of their notice holds: none."""
    n = notices(spark, d)
    return chunking.uncovered_paragraphs(n, chunking.chunk_notices(n)).agg(F.count("*").alias("violations"))


@query("chunk_budget_violations", CHUNKS + ", b AS (SELECT *, greatest(200 - CASE WHEN subject = '' THEN 0 ELSE length(subject) + 1 END, 40) AS budget, lag(section) OVER w AS before, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY notice_num) AS alone FROM chunks WINDOW w AS (PARTITION BY notice_num ORDER BY chunk_index)) SELECT count(*) FILTER (WHERE char_count > budget + 41 AND alone > 1) AS too_long, count(*) FILTER (WHERE char_count < 40 AND before = section) AS too_short, count(*) FILTER (WHERE place <> chunk_index) AS gaps FROM b")
def chunk_budget_violations(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over their notice's budget and floor, small chunks other than a section's first, and gaps in numbering."""
    from pyspark.sql import Window

    s = Settings()
    c = _chunks(spark, d).withColumn("budget", F.greatest(s.chunk_max_chars - F.when(F.col("subject") != "", F.length("subject") + 1).otherwise(0), F.lit(s.chunk_min_chars)))
    w = Window.partitionBy("notice_num").orderBy("chunk_index")
    c = c.withColumn("before", F.lag("section").over(w)).withColumn("place", F.row_number().over(w) - 1).withColumn("only", F.count("*").over(Window.partitionBy("notice_num")))
    fallback = F.col("only") == 1
    return c.agg(F.count_if((F.col("char_count") > F.col("budget") + s.chunk_min_chars + 1) & ~fallback).alias("too_long"), F.count_if((F.col("char_count") < s.chunk_min_chars) & (F.col("before") == F.col("section"))).alias("too_short"), F.count_if(F.col("place") != F.col("chunk_index")).alias("gaps"))


@query("chunk_stats", CHUNKS + " SELECT section, count(*) AS chunks, count(DISTINCT notice_num) AS notices, round(avg(char_count), 2) AS mean_chars, min(char_count) AS min_chars, max(char_count) AS max_chars, sum(sentence_count)::BIGINT AS sentences FROM chunks GROUP BY ROLLUP(section)")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, notices and lengths per section label, all labels in the last row."""
    return _chunks(spark, d).rollup("section").agg(F.count("*").alias("chunks"), F.countDistinct("notice_num").alias("notices"), F.round(F.avg("char_count"), 2).alias("mean_chars"), F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars"), F.sum("sentence_count").alias("sentences"))


@query("delivered_chunk_stats", "SELECT section, count(*) AS chunks, count(DISTINCT notice_num) AS notices, round(avg(length(text)), 2) AS mean_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM chunks GROUP BY ROLLUP(section)")
def delivered_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text").cast("bigint")
    return table(spark, d, "chunks").rollup("section").agg(F.count("*").alias("chunks"), F.countDistinct("notice_num").alias("notices"), F.round(F.avg(n), 2).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


@query("chunk_golden_shapes", "SELECT * FROM (VALUES ('title only', 0, 'body', '제목'), ('summary without reason', 0, 'body', '제목'), ('summary without reason', 1, 'AI 요약', '요약 문장임.'), ('two sections', 0, '제안이유', '이유 문장임.'), ('two sections', 1, '주요내용', '첫 내용임.' || chr(10) || '둘째 내용임.'), ('no title', 0, 'body', '본문만 있음.')) t(shape, chunk_index, section, text)")
def chunk_golden_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "title only", "제목", "", None), (2, "summary without reason", "제목", None, "요약 문장임."), (3, "two sections", "제목", "제안이유\n이유 문장임.\n주요내용\n가. 첫 내용임.\n나. 둘째 내용임.", ""), (4, "no title", None, "본문만 있음.", None)]
    n = spark.createDataFrame(rows, "notice_num bigint, committee string, subject string, proposal_reason string, ai_summary string")
    return chunking.chunk_notices(n).select(F.col("committee").alias("shape"), "chunk_index", "section", "text")


@query("chunk_previews", "SELECT DISTINCT chunk_id, left(replace(text, chr(10), ' '), 80) AS preview FROM chunks")
def chunk_previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", text.preview("text").alias("preview")).distinct()


@query("packing_golden_shapes", "SELECT * FROM (VALUES ('carry', 0, 'aaaa' || chr(10) || 'bb'), ('carry', 1, 'bb' || chr(10) || 'cccc' || chr(10) || 'dd'), ('carry', 2, 'dd' || chr(10) || 'eeeeee'), ('carry gives way', 0, 'aaaaa' || chr(10) || 'bbb'), ('carry gives way', 1, 'cccccccc'), ('small tail', 0, 'aaaaaaaaaa' || chr(10) || 'b'), ('small tail with carry', 0, 'aaaaaa' || chr(10) || 'bbb' || chr(10) || 'c'), ('small first', 0, 'a'), ('small first', 1, 'bbbbbbbbbb'), ('sentences', 0, '가나. 다라.'), ('sentences', 1, '마바. 사아.'), ('slices', 0, '가나다라마바사아자차'), ('slices', 1, '카타.' || chr(10) || '파하.')) t(shape, chunk_index, text)")
def packing_golden_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of packing with a limit of 10 characters: what is repeated, what gives way, how small rests join."""
    shapes = [("carry", ["aaaa", "bb", "cccc", "dd", "eeeeee"], 3, 1), ("carry gives way", ["aaaaa", "bbb", "cccccccc"], 4, 1), ("small tail", ["a" * 10, "b"], 3, 2), ("small tail with carry", ["aaaaaa", "bbb", "c"], 5, 6), ("small first", ["a", "b" * 10], 0, 2), ("sentences", ["가나. 다라. 마바. 사아."], 0, 1), ("slices", ["가나다라마바사아자차카타. 파하."], 0, 4)]
    rows = [(i, name, "\n".join(lines), overlap, least) for i, (name, lines, overlap, least) in enumerate(shapes)]
    cut = F.udtf(chunking.PackLines, returnType="shape string, chunk_index int, text string")
    r = spark.createDataFrame(rows, "id int, shape string, lines string, overlap int, least int")
    spark.udtf.register("pack_lines", cut)
    return spark.sql("SELECT c.* FROM {r} r, LATERAL pack_lines(r.shape, r.lines, 10, r.overlap, r.least) c", r=r)


@query("duplicate_notice_guard", "SELECT notice_num, count(*) AS n FROM notices_capability_gate GROUP BY notice_num HAVING count(*) > 1")
def duplicate_notice_guard(spark: SparkSession, d: str) -> DataFrame:
    return chunking.duplicate_numbers(table(spark, d, "notices_capability_gate"))


@query("token_stats", "SELECT source, count(*) AS texts, sum(n)::BIGINT AS tokens, round(avg(n), 1) AS mean_tokens, max(n) AS max_tokens, count(*) FILTER (WHERE n > 512) AS truncated FROM (SELECT source, len(regexp_extract_all(coalesce(text,''), '[^ \t\n\r\f\x0B]+')) AS n FROM documents) GROUP BY source")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in white-space tokens and how many texts a window of 512 would cut; the tokenizer is pluggable."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1))).cast("bigint")
    return table(spark, d, "documents").select("source", n.alias("n")).groupBy("source").agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 1).alias("mean_tokens"), F.max("n").alias("max_tokens"), F.count_if(F.col("n") > 512).alias("truncated"))


@query("alias_expand_golden", "SELECT * FROM (VALUES ('중처법','중대재해 처벌 등에 관한 법률','중처법'),('「집시법」과 집시법상 신고 의무, 정자법은?','「집회 및 시위에 관한 법률」과 집회 및 시위에 관한 법률상 신고 의무, 정치자금법은?','집시법,정자법'),('집시법률 개정','집시법률 개정',''),('비집시법 위반','비집시법 위반',''),('AI기본법이 뭐야','인공지능 발전과 신뢰 기반 조성 등에 관한 기본법이 뭐야','AI 기본법'),('개발원조를 확대하려는 법안','국제개발협력기본법을 확대하려는 법안','개발원조'),('ODA 개발원조를 확대','국제개발협력기본법을 확대','ODA,개발원조'),('개발원조와 ODA 예산','국제개발협력기본법과 국제개발협력기본법 예산','개발원조,ODA'),('개발원조금','개발원조금',''),('','','')) t(query, text, matched)")
def alias_expand_golden(spark: SparkSession, d: str) -> DataFrame:
    rows = [("중처법",), ("「집시법」과 집시법상 신고 의무, 정자법은?",), ("집시법률 개정",), ("비집시법 위반",), ("AI기본법이 뭐야",), ("개발원조를 확대하려는 법안",), ("ODA 개발원조를 확대",), ("개발원조와 ODA 예산",), ("개발원조금",), ("",)]
    q = spark.createDataFrame(rows, "query string").withColumn("e", lexical.expand("query"))
    return q.select("query", "e.text", F.array_join("e.matched", ",").alias("matched"))


_PACK = lexical.KOREAN
#: Every alias with every particle that may follow it, as one run of letters, and what it becomes.
FORMS = "forms AS (SELECT lower(replace(alias, ' ', '')) || p AS run, alias, name || CASE WHEN alias = '" + _PACK.synonyms[1] + "' THEN coalesce(agreed, p) ELSE p END AS becomes FROM (VALUES " + ",".join(f"('{a}','{b}')" for a, b in _PACK.aliases.items()) + ") a(alias, name), (VALUES (''), " + ",".join(f"('{p}')" for p in _PACK.particles) + ") q(p) LEFT JOIN (VALUES " + ",".join(f"('{a}','{b}')" for a, b in _PACK.agreement.items()) + ") g(given, agreed) ON given = p)"
#: Aliases of two words count as one run where they stand alone.
_JOINED = "regexp_replace({0}, '(^|[^0-9A-Za-z가-힣])(AI|인공지능)\\s+기본법', '\\1\\2기본법', 'gi')"
_STOP = ",".join(f"'{t}'" for t in _PACK.stop_tokens)


def token_sql(source: str, key: str, expr: str) -> str:
    """Rows (key, ``tokens``) of the SQL relation ``source``: runs of letters, aliases replaced, cut into tokens."""
    runs = f"SELECT {key}, i, r[i] AS run FROM (SELECT {key}, regexp_extract_all({_JOINED.format(cleaned(expr))}, '[0-9A-Za-z가-힣]+|ß+') AS r FROM {source}), unnest(range(1, len(r) + 1)) u(i)"
    whole = f"SELECT {key}, string_agg(coalesce(becomes, x.run), ' ' ORDER BY i) AS t FROM ({runs}) x LEFT JOIN forms ON lower(x.run) = forms.run GROUP BY {key}"
    return f"SELECT {key}, list_filter(list_distinct(regexp_extract_all(lower(t), '[0-9a-z가-힣]{{2,}}')), lambda x: x NOT IN ({_STOP})) AS tokens FROM ({whole})"


@query("alias_expand_queries", f"WITH {FORMS}, q AS (SELECT DISTINCT query_id, query FROM train_queries), r AS (SELECT query_id, unnest(regexp_extract_all({_JOINED.format('query')}, '[0-9A-Za-z가-힣]+')) AS run FROM q) SELECT alias, count(DISTINCT query_id) AS queries FROM r JOIN forms ON lower(r.run) = forms.run GROUP BY alias")
def alias_expand_queries(spark: SparkSession, d: str) -> DataFrame:
    """Aliases found in the training queries, with the number of queries they rewrite."""
    q = table(spark, d, "train_queries").select("query_id", "query").distinct().withColumn("e", lexical.expand("query"))
    return q.select("query_id", F.explode("e.matched").alias("alias")).groupBy("alias").agg(F.countDistinct("query_id").alias("queries"))


@query("query_path_orders", "SELECT * FROM (VALUES (1, '한국투자공사법 개정', '한국투자공사법,개정'), (2, 'KIC 개정', '한국투자공사법,개정'), (3, '한국투자공사법', '한국투자공사법'), (4, '', '')) t(id, embedded, tokens)")
def query_path_orders(spark: SparkSession, d: str) -> DataFrame:
    """Embedding replaces aliases before it cleans, tokens are cut after cleaning: an unseen sign inside an alias hides it
    from the one only."""
    rows = [(1, "<b>KIC</b> 개정"), (2, "KI\u200bC 개정"), (3, "  kic "), (4, None)]
    q = spark.createDataFrame(rows, "id int, query string")
    return q.select("id", lexical.prepared_query("query").alias("embedded"), F.array_join(lexical.lexical_tokens("query"), ",").alias("tokens"))


@query("lexical_token_frequency", f"WITH {FORMS}, t AS ({token_sql('documents', 'doc_id', 'text')}) SELECT token, count(*) AS df FROM (SELECT unnest(tokens) AS token FROM t) GROUP BY token")
def lexical_token_frequency(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each content token occurs."""
    return table(spark, d, "documents").select(F.explode(lexical.lexical_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


#: Queries of both labelled sets and chunks, each row once; a chunk and a query meet where they name the same notice.
_PAIRS = f"""
WITH {FORMS}, qs AS (SELECT DISTINCT query_id, notice_num, query FROM eval_queries UNION SELECT DISTINCT query_id, notice_num, query FROM eval_holdout_queries),
cs AS (SELECT chunk_id, any_value(notice_num) AS notice_num, min(coalesce(subject,'') || chr(10) || coalesce(text,'')) AS t FROM chunks GROUP BY chunk_id),
q AS (SELECT query_id, any_value(notice_num) AS notice_num, any_value(tokens) AS qt FROM qs JOIN ({token_sql('qs', 'query_id', 'query')}) USING (query_id) GROUP BY query_id),
c AS (SELECT chunk_id, notice_num, tokens AS ct FROM cs JOIN ({token_sql('cs', 'chunk_id', 't')}) USING (chunk_id)),
p AS (SELECT query_id, chunk_id, len(list_filter(qt, lambda a: len(list_filter(ct, lambda b: contains(b, a) OR contains(a, b))) > 0)) AS overlap FROM q JOIN c USING (notice_num))"""


def labelled_queries(spark: SparkSession, d: str) -> DataFrame:
    cols = ["query_id", "notice_num", "query"]
    return table(spark, d, "eval_queries").select(cols).unionByName(table(spark, d, "eval_holdout_queries").select(cols)).distinct()


def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    """(``chunk_id``, ``notice_num``, ``ct``): one row a chunk; of unlike texts the least."""
    whole = F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = table(spark, d, "chunks").groupBy("chunk_id").agg(F.first("notice_num").alias("notice_num"), F.min(whole).alias("t"))
    return rows.select("chunk_id", "notice_num", lexical.lexical_tokens("t").alias("ct"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    q = labelled_queries(spark, d).select("query_id", "notice_num", lexical.lexical_tokens("query").alias("qt"))
    return q.join(token_chunks(spark, d), "notice_num").select("query_id", "chunk_id", lexical.overlap_count("qt", "ct").cast("bigint").alias("overlap"))


@query("token_overlap_pairs", _PAIRS + "SELECT query_id, chunk_id, overlap FROM p")
def token_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Shared tokens of each query and each chunk of its notice."""
    return _overlaps(spark, d)


@query("lexical_gate", _PAIRS + "SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE overlap > 0) AS kept FROM p GROUP BY query_id")
def lexical_gate(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(F.col("overlap") > 0).alias("kept"))


@query("lexical_evidence_flags", _PAIRS + "SELECT query_id, chunk_id, section <> 'AI 요약' AND overlap >= 3 AS evidence FROM p JOIN (SELECT chunk_id, min(section) AS section FROM chunks GROUP BY chunk_id) USING (chunk_id)")
def lexical_evidence_flags(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("section").alias("section"))
    return _overlaps(spark, d).join(s, "chunk_id").select("query_id", "chunk_id", ((F.col("section") != text.SUMMARY_SECTION) & (F.col("overlap") >= 3)).alias("evidence"))
