"""Structured chunks of documents that are laid out as files: headings, articles, lists, questions, qualifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.operators import chunks as C
from tessera.sources.tables import table

NAMES = ("운영 안내.md", "고시 제3조.md", "질의응답 faq.md", "비교표.md", "평가매뉴얼.md", "guide.txt")
#: What becomes of a document's k-th line, k from 1, line l: (condition, text), the first that holds.
LAYOUT = (
    ("k % 23 = 0", "concat('제', k, '조(', substr(l, 1, 12), ')')"), ("k % 19 = 4", "concat('# ', substr(l, 1, 24))"), ("k % 11 = 3", "concat('### ', substr(l, 1, 30))"), ("k % 7 = 5", "concat('## ', substr(l, 1, 20))"),
    ("k % 17 = 8", "concat('질문 ', k)"), ("k % 17 = 9", "concat('답변 ', k)"), ("k % 13 IN (6, 7)", "concat('- ', l)"), ("k % 29 = 12", "concat('1. ', substr(l, 1, 40))"),
    ("k % 10 = 1", "concat(substr(l, 1, 1100), ' 단, 3일 이내  제외')"), ("k % 31 = 2", "'평가기준:'"), ("k % 8 = 2", "''"),
)
_CASE = "CASE {} ELSE l END".format(" ".join(f"WHEN {test} THEN {then}" for test, then in LAYOUT))


def files(spark, sf):
    """documents as files: a document's name follows from its number, its layout from its lines; sentences are lines of their own, every third behind an empty one."""
    names = F.array(*map(F.lit, NAMES))
    docs = table(spark, sf, "documents").select("doc_id", "source", "text").withColumn("name", F.get(names, (F.col("doc_id") % len(NAMES)).cast("int")))
    cut = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n")), "\n", -1)
    laid = F.expr("array_join(transform(cut, (l, j) -> " + _CASE.replace("k", "(j + 1)") + " || CASE WHEN j % 3 = 2 THEN '\\n' ELSE '' END), '\\n')")
    docs = docs.withColumn("cut", cut).withColumn("text", laid).withColumn("path", F.concat(F.lit("/knowledge/"), F.coalesce("source", F.lit("none")), F.lit("/"), "name"))
    return R.metadata(docs.drop("cut"))


def structured_sections(spark, sf):
    rows = C.section_rows(files(spark, sf))
    return rows.select("doc_id", "section_no", "section_id", "line_start", "line_end", "reason", F.md5("section_title").alias("title_md5"), F.array_join("section_path", ">").alias("path"), "article_no", "depth", F.md5("content").alias("content_md5"))


def structured_windows(spark, sf):
    """Windows with overlap, as the fold over each section's blocks gives them."""
    windows = C.section_windows(C.section_blocks(C.section_lines(files(spark, sf))))
    return windows.select("doc_id", "section_no", "window_index", "span_start", "span_end", "list_group_id", "contains_checklist", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def structured_chunks(spark, sf):
    c = C.chunk_rows(files(spark, sf))
    return c.select(
        "doc_id", "chunk_index", "chunk_id", "chunk_hash", "citation_group_id", F.md5("embedding_input").alias("input_md5"), F.md5("search_text").alias("search_md5"),
        F.array_join("matched_labels", "|").alias("labels"), F.length("text_preview").alias("n_preview"),
    )


def structured_documents(spark, sf):
    own = files(spark, sf)
    return C.document_rows(own, C.chunk_rows(own)).select("doc_id", "title", "chunk_policy", "version_id", "content_hash", "n_chunks", "n_sections")


QUERIES = {f.__name__: f for f in (structured_sections, structured_windows, structured_chunks, structured_documents)}

_HEADED = f"regexp_matches(bare, '{C.HEADING}')"
_LAW = f"{C.LAW_HEADING}|{C.LAW_APPENDIX}|{C.LAW_ATTACHMENT}"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace({0}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_ARTICLE = r"nullif(regexp_replace(regexp_extract({0}, '제\s*[0-9]+\s*조(?:의\s*[0-9]+)*'), '\s+', '', 'g'), '')"
_LEVELS = ", ".join(f"max(CASE WHEN depth = {k} THEN line_no END) OVER u AS p{k}" for k in range(1, 7))
_TRAIL = ", ".join(
    f"CASE WHEN p{k} > greatest(-1{''.join(f', coalesce(p{j}, -1)' for j in range(1, k))}) THEN (SELECT heading FROM opened o WHERE o.doc_id = l.doc_id AND o.line_no = l.p{k}) END" for k in range(1, 7)
)
_KIND = (
    f"CASE WHEN {_HEADED} THEN 'markdown-heading' WHEN regexp_matches(bare, '{C.LAW_HEADING}') THEN 'law-heading' WHEN regexp_matches(bare, '{C.LAW_APPENDIX}|{C.LAW_ATTACHMENT}') THEN 'law-appendix' "
    f"WHEN regexp_matches(bare, '{C.QA}') THEN 'qa-boundary' WHEN regexp_matches(bare, '{C.EVALUATION}') THEN 'evaluation-subheading' WHEN regexp_matches(bare, '{C.NUMBERED}') THEN 'numbered-subheading' END"
)
_POLICY = ("manual", "law", "qa", "comparison", "evaluation", "general")
_TYPE = ("guide", "notice", "qa", "comparison", "manual", "other")
_GROUP = ("guide", "legal", "qa", "comparison", "manual", "general")


def _of_name(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][(doc_id % {len(NAMES)}) + 1]"


_FILES = f"""
cut AS (SELECT doc_id, source, {_of_name(NAMES)} AS name, string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)) AS ls FROM documents),
files AS (SELECT doc_id, source, name, regexp_replace(name, '(?i)\\.(md|txt)$', '') AS title, {_of_name(_POLICY)} AS policy, {_of_name(_TYPE)} AS kind_, {_of_name(_GROUP)} AS group_,
  array_to_string(list_transform(range(1, len(ls) + 1), lambda k: list_transform([ls[k]], lambda l: {_CASE} || CASE WHEN k % 3 = 0 THEN chr(10) ELSE '' END)[1]), chr(10)) AS text FROM cut)"""
_LINES = f"""{_FILES},
raw AS (SELECT doc_id, title, policy, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM files),
bare AS (SELECT *, regexp_replace(raw, '[ \\t]+', ' ', 'g') AS line, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS bare FROM raw),
items AS (SELECT *, regexp_matches(bare, '{C.LIST_ITEM}') AS item FROM bare),
beside AS (SELECT *, item AND (coalesce(lag(item) OVER o, false) OR coalesce(lead(item) OVER o, false)) AS beside FROM items WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
kinds AS (SELECT *, CASE WHEN NOT beside AND bare <> '' THEN {_KIND} END AS kind FROM beside),
headed AS (SELECT *, CASE WHEN kind = 'markdown-heading' THEN trim(regexp_extract(bare, '{C.HEADING}', 2)) WHEN kind IS NOT NULL THEN bare END AS heading FROM kinds),
answers AS (SELECT *, coalesce(kind = 'qa-boundary' AND regexp_matches(heading, '{C.ANSWER}'), false) AS answer FROM headed),
asked AS (SELECT *, last_value(CASE WHEN kind IS NOT NULL AND NOT answer THEN regexp_matches(heading, '{C.QUESTION}') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM answers),
opened AS (SELECT *, kind IS NOT NULL AND NOT (answer AND policy = 'qa' AND coalesce(asked, regexp_matches(title, '{C.QUESTION}'))) AS opens FROM asked),
deep AS (SELECT *, CASE WHEN opens AND kind = 'markdown-heading' THEN length(regexp_extract(bare, '{C.HEADING}', 1)) END AS depth, CASE WHEN opens THEN 1 ELSE 0 END AS step FROM opened),
placed AS (SELECT *, sum(step) OVER u AS section_no, {_LEVELS} FROM deep WINDOW u AS (PARTITION BY doc_id ORDER BY line_no)),
heads AS (SELECT doc_id, section_no, kind AS reason, heading AS section_title, list_filter([title, {_TRAIL}, CASE WHEN kind <> 'markdown-heading' THEN heading END], lambda x: x IS NOT NULL) AS section_path FROM placed l WHERE opens),
spans AS (SELECT doc_id, section_no, any_value(title) AS title, min(line_no) + 1 AS line_start, max(line_no) + 1 AS line_end, min(line_no) FILTER (bare <> '') AS first, max(line_no) FILTER (bare <> '') AS last FROM placed GROUP BY ALL),
heads_ AS (SELECT s.*, coalesce(reason, 'document-root') AS reason, coalesce(section_title, title) AS section_title, coalesce(section_path, [title]) AS section_path FROM spans s LEFT JOIN heads USING (doc_id, section_no) WHERE first IS NOT NULL),
sects AS (SELECT *, coalesce({_ARTICLE.format("section_title")}, {_ARTICLE.format("title")}) AS article_no FROM heads_),
near AS (SELECT p.doc_id, p.section_no, line_no, bare, line, lag(line) OVER (PARTITION BY p.doc_id, p.section_no ORDER BY line_no) AS prior, first, last, article_no IS NOT NULL OR regexp_matches(section_title, '{_LAW}') AS lawful
  FROM placed p JOIN sects s USING (doc_id, section_no) WHERE line_no BETWEEN first AND last),
kept AS (SELECT * REPLACE (CASE WHEN line_no = first THEN ltrim(line) ELSE line END AS line) FROM near WHERE NOT (line = '' AND coalesce(prior, 'x') = '')),
trimmed AS (SELECT * REPLACE (CASE WHEN line_no = last THEN rtrim(line) ELSE line END AS line) FROM kept),
offs AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, section_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, lag(bare) OVER (PARTITION BY doc_id, section_no ORDER BY line_no) AS behind FROM trimmed),
begun AS (SELECT *, CASE WHEN behind IS NULL THEN 1 WHEN lawful THEN regexp_matches(bare, '{_LAW}')::INTEGER ELSE (bare <> '' AND behind = '')::INTEGER END AS begins FROM offs),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, section_no ORDER BY line_no) AS block_no FROM begun),
contents AS (SELECT doc_id, section_no, string_agg(line, chr(10) ORDER BY line_no) AS content FROM numbered GROUP BY ALL),
sections AS (SELECT *, sha1(doc_id || ':' || array_to_string(section_path, '>') || ':' || line_start || ':' || line_end) AS section_id FROM sects JOIN contents USING (doc_id, section_no))"""
_BLOCKS = f"""{_LINES},
b0 AS (SELECT doc_id, section_no, block_no, any_value(lawful) AS lawful, {_NORMAL.format("string_agg(line, chr(10) ORDER BY line_no)")} AS text,
  count(*) FILTER (regexp_matches(bare, '{C.LIST_ITEM}')) AS n_items, count(*) FILTER (regexp_matches(bare, '{C.TABLE_ROW}')) AS n_rows,
  min(off + length(line) - length(ltrim(line))) FILTER (bare <> '') AS span_start, max(off + length(rtrim(line))) FILTER (bare <> '') AS span_end, max(off + length(line) + 1) AS next_at
  FROM numbered WHERE bare <> '' OR lawful GROUP BY doc_id, section_no, block_no),
b1 AS (SELECT b0.*, NOT lawful AND (n_items >= 2 OR n_rows >= 2) AS protected, CASE WHEN lawful THEN greatest(span_end, least(next_at, length(content))) ELSE span_end END AS stop FROM b0 JOIN contents USING (doc_id, section_no) WHERE text <> ''),
b2 AS (SELECT *, NOT lawful AND (protected OR regexp_matches(text, '{C.CUE}') OR regexp_matches(text, '{C.QUALIFIER}')) AS checklist, CASE WHEN protected THEN sha1(span_start || ':' || text) END AS list_group_id, CASE WHEN protected THEN 2400 ELSE 1200 END AS most FROM b1)"""
_STOP = f"""(CASE WHEN checklist AND start + most < length(text) AND regexp_matches(substr(text, greatest(start, start + most - 160) + 1, least(160, most)), '{C.QUALIFIER}')
  THEN CASE WHEN regexp_matches(substr(text, start + most + 1, 600), '\\n\\s*\\n') THEN start + most + length(regexp_extract(substr(text, start + most + 1, 600), '(?s)^.*?\\n\\s*\\n')) ELSE least(length(text), start + most + 600) END
  ELSE least(start + most, length(text)) END)"""
# A block above its limit is cut piece by piece; a section's pieces fill windows one by one. Both are recursions over one step's state.
_WINDOWS = f"""{_BLOCKS},
cuts AS (
  SELECT doc_id, section_no, block_no, 0 AS piece, 0 AS start, {_STOP} AS stop FROM (SELECT *, 0 AS start FROM b2 WHERE length(text) > most)
  UNION ALL
  SELECT doc_id, section_no, block_no, piece, start, {_STOP} FROM (SELECT b2.*, c.piece + 1 AS piece, greatest(c.stop - 120, c.start + 1) AS start FROM cuts c JOIN b2 USING (doc_id, section_no, block_no) WHERE c.stop < length(text))),
pieces AS (
  SELECT doc_id, section_no, block_no, 0 AS piece, text, span_start, stop AS span_end, protected, checklist, list_group_id FROM b2 WHERE length(text) <= most
  UNION ALL
  SELECT doc_id, section_no, block_no, piece, regexp_replace(part, '^\\s+|\\s+$', '', 'g'), span_start + start + length(part) - length(regexp_replace(part, '^\\s+', '')), span_start + stop_, protected, checklist, list_group_id
  FROM (SELECT b2.* EXCLUDE (stop), c.piece, c.start, c.stop AS stop_, substr(text, c.start + 1, c.stop - c.start) AS part FROM cuts c JOIN b2 USING (doc_id, section_no, block_no)) WHERE regexp_matches(part, '\\S')),
listed AS (SELECT doc_id, section_no, list({{'text': text, 'size': length(text), 'a': span_start, 'b': span_end, 'flag': protected OR checklist, 'checklist': checklist, 'lst': list_group_id}} ORDER BY block_no, piece) AS ps FROM pieces GROUP BY ALL),
fold AS (
  SELECT doc_id, section_no, ps, 1 AS i, 1 AS lo, 0 AS number, false AS closes, 0 AS was FROM listed
  UNION ALL
  SELECT doc_id, section_no, ps, i + 1, CASE WHEN over THEN tail ELSE lo END, CASE WHEN over THEN number + 1 ELSE number END, over, lo FROM (
    SELECT *, list_sum(list_transform(ps[lo:i + 1], lambda x: x.size)) + 2 * (i + 1 - lo) > CASE WHEN len(list_filter(ps[lo:i + 1], lambda x: x.flag)) > 0 THEN 2400 ELSE 1200 END AS over,
      list_max(list_concat([lo], list_filter(range(lo, i + 1), lambda j: list_sum(list_transform(ps[j:i], lambda x: x.size)) >= 120))) AS tail FROM fold WHERE i < len(ps))),
closed AS (SELECT doc_id, section_no, number - 1 AS number, ps[was:i - 1] AS held FROM fold WHERE closes UNION ALL SELECT doc_id, section_no, number, ps[lo:i] FROM fold WHERE i = len(ps)),
w0 AS (SELECT doc_id, section_no, number::INTEGER AS window_index, {_NORMAL.format("array_to_string(list_transform(held, lambda x: x.text), chr(10) || chr(10))")} AS text, held[1].a AS span_start, held[-1].b AS span_end,
  len(list_filter(held, lambda x: x.checklist)) > 0 AS contains_checklist, list_filter(list_transform(held, lambda x: x.lst), lambda x: x IS NOT NULL) AS lists, held FROM closed),
w1 AS (SELECT *, list_filter(lists, lambda x, k: list_position(lists, x) = k) AS groups FROM w0),
windows AS (SELECT w1.doc_id, w1.section_no, window_index, span_start, span_end, CASE WHEN len(groups) = 0 THEN NULL WHEN len(groups) = 1 THEN groups[1] ELSE sha1(array_to_string(groups, ':')) END AS list_group_id, contains_checklist,
  CASE WHEN starts_with(text, section_title) THEN text ELSE {_NORMAL.format("section_title || chr(10) || text")} END AS text, section_title, section_path, article_no, section_id, reason
  FROM w1 JOIN sections USING (doc_id, section_no))"""
_CHUNKS = f"""{_WINDOWS},
inputs AS (SELECT w.*, f.title, f.name, f.kind_, f.group_, f.policy,
  {_NORMAL.format("'[문서: ' || f.title || ']' || chr(10) || '[섹션: ' || section_title || ']' || chr(10) || '[경로: ' || array_to_string(section_path, ' > ') || ']' || chr(10) || coalesce('[조문: ' || article_no || ']', '') || chr(10) || chr(10) || w.text")} AS input,
  {_NORMAL.format("f.title || chr(10) || name || chr(10) || kind_ || chr(10) || group_ || chr(10) || array_to_string(section_path, ' ') || chr(10) || coalesce(article_no, '') || chr(10) || section_title || chr(10) || w.text")} AS search
  FROM windows w JOIN files f USING (doc_id)),
hashed AS (SELECT *, sha1(doc_id || ':' || section_id || ':' || window_index || ':' || input) AS chunk_hash FROM inputs)"""
SQL = {
    "structured_sections": f"WITH {_LINES} SELECT doc_id, section_no, section_id, line_start, line_end, reason, md5(section_title) AS title_md5, array_to_string(section_path, '>') AS path, article_no, len(section_path) AS depth, md5(content) AS content_md5 FROM sections",
    "structured_windows": f"WITH RECURSIVE {_WINDOWS} SELECT doc_id, section_no, window_index, span_start, span_end, list_group_id, contains_checklist, length(text) AS n_chars, md5(text) AS text_md5 FROM windows",
    "structured_chunks": f"""WITH RECURSIVE {_CHUNKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section_no, window_index) - 1)::INTEGER AS chunk_index, sha1(doc_id || ':' || chunk_hash) AS chunk_id, chunk_hash,
  sha1(doc_id || ':' || section_id) AS citation_group_id, md5(input) AS input_md5, md5(search) AS search_md5,
  array_to_string(list_filter([title, kind_, group_, 'chunk-policy:' || policy, 'chunk-boundary:' || reason, CASE WHEN list_group_id IS NOT NULL THEN 'chunk-protected:group' END, CASE WHEN contains_checklist THEN 'chunk-protected:checklist' END] || section_path, lambda x: coalesce(x, '') <> ''), '|') AS labels,
  length(substr(text, 1, 220)) AS n_preview FROM hashed""",
    "structured_documents": f"""WITH RECURSIVE {_WINDOWS}, n AS (SELECT doc_id, count(*) AS n_chunks, count(DISTINCT section_id) AS n_sections FROM windows GROUP BY doc_id)
SELECT doc_id, title, policy AS chunk_policy, doc_id || ':v1' AS version_id, sha256(text) AS content_hash, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_sections, 0) AS n_sections FROM files LEFT JOIN n USING (doc_id)""",
}
