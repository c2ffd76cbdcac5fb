"""Structured chunks of files: sections under a trail of headings, blocks of sections, windows of blocks, chunk rows.

Lines, sections and blocks are window functions over one partitioning by document: boundaries are flags, numbers are
running sums, the trail is the last heading of each depth that no higher one has closed. Only the packing of a section's
blocks carries state from block to block; it is a fold over the section's row, linear in its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import QUALIFIERS
from tessera.functions.text import article_no, normalised_space, one_blank, whole

# --- fixed values: sizes in characters and patterns that decide results -------------------------
LIMIT, PROTECTED_LIMIT, OVERLAP, PROBE, EXTENSION, PREVIEW = 1200, 2400, 120, 160, 600, 220
HEADING = r"^(#{1,6})\s+(.+)$"
LAW_HEADING = r"^\s*제\s*[0-9]+\s*조(?:의\s*[0-9]+)?"
LAW_APPENDIX = r"^\s*\[?\s*(?:별표|별지)\s*[0-9]+"
LAW_ATTACHMENT = r"^\s*\(?붙임\)?"
QA = r"(?i)^(?:q\s*&\s*a|질문\(q\)|답변\(a\)|질문\s*[0-9]+|답변\s*[0-9]+|사례\s*[0-9]+|문\s*[0-9]+[.)]?)"
QUESTION = r"(?i)^(?:질문\(q\)|질문\s*[0-9]+|문\s*[0-9]+[.)]?|q\s*[.)]?\s*[0-9]*|q\s*&\s*a)"
ANSWER = r"(?i)^(?:답변\(a\)|답변\s*[0-9]+|a\s*[.)]?\s*[0-9]*)"
EVALUATION = r"^(?:평가기준|확인방법|관련근거|평가방법|평가자료|확인사항|준비서류|급여제공기록|작성방법|유의사항|점검사항)\s*[:：]?\s*$"
NUMBERED = r"^\s*(?:[0-9]{1,2}|[가-하])[.)]\s+\S.{0,80}$"
LIST_ITEM = r"^\s*(?:[-*•‣▪▫]|[0-9]{1,2}[.)]|[①-⑳]|[가-힣][.)])\s+"
TABLE_ROW = r"^\s*\|.+\|\s*$"
CUE = "체크리스트|지침|확인|예방|교육|안내|필수|점검|서류|기록|업무|절차|방법|기한|이내|수급자|보호자"
DEPTHS = {"law-heading": 3, "law-appendix": 2, "qa-boundary": 4, "evaluation-subheading": 4, "numbered-subheading": 4}
# ------------------------------------------------------------------------------------------------
QUALIFIER = "|".join(f"(?:{p})" for patterns in QUALIFIERS.values() for p in patterns)
#: White space of any script; what Python's strip takes away.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
STRIPPED = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WINDOWS = "window_index int, text string, span_start int, span_end int, list_group_id string, contains_checklist boolean"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _law_line(text: Column) -> Column:
    return text.rlike(f"{LAW_HEADING}|{LAW_APPENDIX}|{LAW_ATTACHMENT}")


def boundary_kind(bare: Column) -> Column:
    """What sort of section a stripped line begins; null for none. The first sort that fits counts."""
    out = F.when(bare.rlike(HEADING), "markdown-heading").when(bare.rlike(LAW_HEADING), "law-heading")
    out = out.when(bare.rlike(f"{LAW_APPENDIX}|{LAW_ATTACHMENT}"), "law-appendix").when(bare.rlike(QA), "qa-boundary")
    return out.when(bare.rlike(EVALUATION), "evaluation-subheading").when(bare.rlike(NUMBERED), "numbered-subheading")


def section_lines(files: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title", policy: str = "chunk_policy") -> DataFrame:
    """One row a line, normalised, with its section, what the section begins with, and its place there; files without key have none.

    A list item beside another one begins nothing. In files of policy ``qa`` an answer stays with its question. Lines
    that only hold white space before a section's text and empty lines behind an empty one are marked as gone.
    All patterns are looked at before the only shuffle; behind it a line passes three windows over its document's order.
    """
    name = F.col(title)
    docs = files.filter(F.col(key).isNotNull()).select(
        key, (F.col(policy) == "qa").alias("qa"), stripped(name).rlike(QUESTION).alias("asked_first"), article_no(name).isNotNull().alias("in_article"), _law_line(name).alias("lawful_title"),
        name.alias("doc_title"), F.explode(F.array(F.split(F.replace(whole(F.col(text)), F.lit("\r\n"), F.lit("\n")), "\n", -1))).alias("raws"),
    )
    lines = docs.select(key, "qa", "asked_first", "in_article", "lawful_title", "doc_title", F.posexplode("raws").alias("line_no", "raw"))
    lines = lines.withColumns({"line": one_blank(F.col("raw")), "bare": stripped(F.col("raw"))})
    code = F.ascii("bare")
    # no list item and no boundary begins with a Latin letter but Q: most lines are spared the patterns
    lines = lines.withColumn("word", (code.between(65, 90) | code.between(97, 122)) & ~code.isin(81, 113))
    lines = lines.withColumns({
        "blank": F.col("bare") == "", "empty": F.col("line") == "", "item": ~F.col("word") & F.col("bare").rlike(LIST_ITEM), "row": F.startswith("bare", F.lit("|")) & F.col("bare").rlike(TABLE_ROW),
        "sort": F.when((F.col("bare") != "") & ~F.col("word"), boundary_kind(F.col("bare"))), "ahead": F.length("line") - F.length(F.ltrim("line", F.lit(BLANKS))), "full": F.length(F.rtrim("line", F.lit(BLANKS))),
    })
    marked = F.col("sort") == "markdown-heading"
    lines = lines.withColumn("heading", F.when(marked, stripped(F.regexp_extract("bare", HEADING, 2))).when(F.col("sort").isNotNull(), F.col("bare")))
    lines = lines.withColumns({
        "level": F.when(marked, F.length(F.regexp_extract("bare", HEADING, 1))), "answer": F.coalesce((F.col("sort") == "qa-boundary") & F.col("heading").rlike(ANSWER), F.lit(False)),
        "question": F.col("heading").rlike(QUESTION), "lawful_here": F.when(F.col("sort").isNotNull(), article_no(F.col("heading")).isNotNull() | _law_line(F.col("heading"))),
        "law_line": F.coalesce(F.col("sort").isin("law-heading", "law-appendix"), F.lit(False)),
        "doc_title": F.when(F.col("line_no") == 0, F.col("doc_title")),  # one line carries it through the shuffle
    }).drop("raw", "bare", "word")
    order = Window.partitionBy(key).orderBy("line_no")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    no = F.lit(False)
    lines = lines.withColumns({
        "beside": F.coalesce(F.lag("item").over(order), no) | F.coalesce(F.lead("item").over(order), no), "behind_blank": F.coalesce(F.lag("blank").over(order), no),
        "behind_empty": F.coalesce(F.lag("empty").over(order), no), "seen": F.coalesce(F.max(~F.col("blank")).over(before), no),
    })
    lines = lines.withColumn("kind", F.when(~(F.col("item") & F.col("beside")), F.col("sort")))
    asked = F.last(F.when(F.col("kind").isNotNull() & ~F.col("answer"), F.col("question")), ignorenulls=True).over(before)
    lines = lines.withColumn("held", F.col("answer") & F.col("qa") & F.coalesce(asked, F.col("asked_first")))
    lines = lines.withColumn("opens", F.col("kind").isNotNull() & ~F.col("held")).withColumn("first", F.col("opens") | (~F.col("blank") & ~F.col("seen")))
    lines = lines.withColumns({
        "line": F.when(F.col("first"), F.ltrim("line", F.lit(BLANKS))).otherwise(F.col("line")), "full": F.when(F.col("first"), F.col("full") - F.col("ahead")).otherwise(F.col("full")),
        "ahead": F.when(F.col("first"), 0).otherwise(F.col("ahead")), "gone": (F.col("blank") & ~F.col("seen")) | (F.col("empty") & F.col("behind_empty")), "depth": F.when(F.col("opens"), F.col("level")),
    })
    lines = lines.withColumns({
        "section_no": F.sum(F.col("opens").cast("int")).over(until), "lawful": F.last(F.when(F.col("opens"), F.col("lawful_here")), ignorenulls=True).over(until),
        "offset": F.coalesce(F.sum(F.when(F.col("gone"), 0).otherwise(F.length("line") + 1)).over(before), F.lit(0)).cast("int"), "doc_title": F.first("doc_title", ignorenulls=True).over(until),
        **{f"h{k}": F.last(F.when(F.col("depth") == k, F.struct("line_no", "heading")), ignorenulls=True).over(until) for k in range(1, 7)},
    })
    lawful = F.col("in_article") | F.coalesce("lawful", "lawful_title")
    begins = F.when(F.col("first"), True).when(lawful, F.col("law_line")).otherwise(~F.col("blank") & F.col("behind_blank"))
    trail, closed = [], F.lit(-1)
    for k in range(1, 7):
        trail.append(F.when(F.col(f"h{k}.line_no") > closed, F.col(f"h{k}.heading")))
        closed = F.greatest(closed, F.coalesce(F.col(f"h{k}.line_no"), F.lit(-1)))
    own = F.when(F.col("opens") & F.col("level").isNull(), F.col("heading"))
    path = F.when(F.col("opens"), F.array_compact(F.array("doc_title", *trail, own))).otherwise(F.array("doc_title"))
    head = F.struct(F.coalesce(F.when(F.col("opens"), F.col("kind")), F.lit("document-root")).alias("reason"), F.when(F.col("opens"), F.col("heading")).otherwise(F.col("doc_title")).alias("section_title"), path.alias("section_path"), "doc_title", lawful.alias("lawful"))
    return lines.select(key, "section_no", "line_no", "line", "blank", "item", "row", "offset", "ahead", "full", begins.alias("begins"), "gone", F.when(F.col("first"), head).alias("head"))


def block_text(text: Column, last: Column) -> Column:
    """normalised_space of lines, which hold no runs of blanks; the last block of a section ends where its text does."""
    odd = text.contains("\r") | text.contains("\n\n\n")
    own = F.when(odd, normalised_space(text)).otherwise(F.btrim(text, F.lit(" \t\n\x0b\f\r")))
    return F.when(last, F.rtrim(own, F.lit(BLANKS))).otherwise(own)


SECTION = ("line_start", "line_end", "reason", "section_title", "section_path", "article_no")


def section_blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section_no, SECTION columns, content, blocks): blocks in order, each with text, its span in content, whether it is protected or holds a checklist, and its list's id.

    Paragraphs are what blank lines part, and two list or table lines make one protected. In a section under an article
    a block begins at each article, appendix or attachment line. A section's lines are gathered once; its blocks are slices of them.
    """
    line = F.struct("line_no", "line", "blank", "item", "row", "offset", "ahead", "full", "begins", "head")
    out = lines.groupBy(key, "section_no").agg((F.min("line_no") + 1).alias("line_start"), (F.max("line_no") + 1).alias("line_end"), F.sort_array(F.collect_list(F.when(~F.col("gone"), line))).alias("held"))
    n = F.coalesce(F.array_max(F.transform("held", lambda x, i: F.when(~x["blank"], i + 1))), F.lit(0))
    starts = F.array_compact(F.transform("held", lambda x, i: F.when(x["begins"], i + 1)))
    content = F.btrim(F.array_join(F.transform("held", lambda x: x["line"]), "\n"), F.lit(BLANKS))
    # behind a generator, here and below, so that what reads a list doesn't make it again
    out = out.select("*", F.inline(F.array(F.struct(n.alias("n"), starts.alias("starts"), content.alias("content"), F.length(content).alias("size"), F.get("held", F.lit(0)).alias("first"))))).filter("n > 0")
    out = out.select(
        key, "section_no", "line_start", "line_end", "first.head.reason", "first.head.section_title", "first.head.section_path",
        F.coalesce(article_no(F.col("first.head.section_title")), article_no(F.col("first.head.doc_title"))).alias("article_no"), F.col("first.head.lawful").alias("lawful"), "held", "n", F.col("first.offset").alias("base"), "starts", "content", "size",
    )
    lawful, last = F.col("lawful"), F.size("starts") - 1
    parts = F.transform("starts", lambda at, j: F.slice("held", at, F.coalesce(F.get("starts", j + 1), F.col("n") + 1) - at))
    blocks = F.transform(parts, lambda part, j: F.struct(F.filter(part, lambda x: lawful | ~x["blank"]).alias("own"), (j == last).alias("last")))
    blocks = F.transform(blocks, lambda b: F.struct(
        F.array_join(F.transform(b["own"], lambda x: x["line"]), "\n").alias("text"), b["last"].alias("last"), F.element_at(b["own"], 1).alias("first"), F.element_at(b["own"], -1).alias("end"),
        F.array_max(F.transform(b["own"], lambda x: F.when(~x["blank"], x["offset"] + x["full"]))).alias("span_end"),
        ((F.size(F.filter(b["own"], lambda x: x["item"])) >= 2) | (F.size(F.filter(b["own"], lambda x: x["row"])) >= 2)).alias("listed"),
    ))
    base = F.col("base")
    blocks = F.transform(blocks, lambda b: F.struct(
        block_text(b["text"], b["last"]).alias("text"), (b["first"]["offset"] + b["first"]["ahead"] - base).alias("span_start"),
        F.when(lawful, F.greatest(b["span_end"] - base, F.least(b["end"]["offset"] + F.length(b["end"]["line"]) + 1 - base, F.col("size")))).otherwise(b["span_end"] - base).alias("span_end"),
        (~lawful & b["listed"]).alias("protected"),
    ))
    blocks = F.transform(F.filter(blocks, lambda b: b["text"] != ""), lambda b: F.struct(
        b["text"].alias("text"), b["span_start"].alias("span_start"), b["span_end"].alias("span_end"), b["protected"].alias("protected"),
        (~lawful & (b["protected"] | b["text"].rlike(f"(?=[가-힣0-9])(?:{CUE}|{QUALIFIER})"))).alias("checklist"), F.when(b["protected"], F.sha1(F.concat_ws(":", b["span_start"], b["text"]))).alias("list_group_id"),
    ))
    return out.select(key, "section_no", *SECTION, "content", F.explode(F.array(blocks)).alias("blocks")).filter(F.size("blocks") > 0)


def _pieces(block: dict) -> Iterator[dict]:
    """A block above its limit as overlapping pieces; a piece that ends in a qualification runs on to the paragraph's end."""
    text, limit, start = block["text"], PROTECTED_LIMIT if block["protected"] else LIMIT, 0
    if len(text) <= limit:
        yield block
        return
    while True:
        end = min(start + limit, len(text))
        if block["checklist"] and end < len(text) and re.search(QUALIFIER, text[max(start, end - PROBE) : end]):
            more = re.search(r"\n\s*\n", text[end : end + EXTENSION])
            end = end + more.end() if more else min(len(text), end + EXTENSION)
        part = text[start:end]
        if part.strip():
            yield {**block, "text": part.strip(), "span_start": block["span_start"] + start + len(part) - len(part.lstrip()), "span_end": block["span_start"] + end}
        if end >= len(text):
            return
        start = max(end - OVERLAP, start + 1)


def windows_of(blocks: Iterable[dict]) -> Iterator[tuple]:
    """WINDOWS of a section's blocks, filled up in order; each takes over the last blocks before it, of OVERLAP characters or more together."""
    held: list[dict] = []
    size = marked = number = 0

    def window() -> tuple:
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "\n\n".join(b["text"] for b in held))).strip()
        lists = list(dict.fromkeys(b["list_group_id"] for b in held if b["list_group_id"]))
        group = None if not lists else lists[0] if len(lists) == 1 else hashlib.sha1(":".join(lists).encode()).hexdigest()
        return number, text, held[0]["span_start"], held[-1]["span_end"], group, any(b["checklist"] for b in held)

    for block in (piece for b in blocks for piece in _pieces(b)):
        flag = bool(block["protected"] or block["checklist"])
        if held and size + len(block["text"]) + 2 * len(held) > (PROTECTED_LIMIT if marked or flag else LIMIT):
            yield window()
            number, keep, chars = number + 1, len(held), 0
            while keep and chars < OVERLAP:
                keep -= 1
                chars += len(held[keep]["text"])
            held = held[keep:]
            size, marked = chars, sum(bool(b["protected"] or b["checklist"]) for b in held)
        held.append(block)
        size, marked = size + len(block["text"]), marked + flag
    if held:
        yield window()


def section_windows(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """section_blocks' rows with a row for each window: WINDOWS beside the section's columns; the text begins with the section's title.

    Blocks that are no longer than LIMIT together are one window, which needs no fold.
    """
    kept = [c for c in sections.columns if c not in ("content", "blocks")]
    size = F.aggregate("blocks", F.lit(-2).cast("long"), lambda n, b: n + F.length(b["text"]) + 2)
    lists = F.array_distinct(F.filter(F.transform("blocks", lambda b: b["list_group_id"]), lambda x: x.isNotNull()))
    group = F.when(F.size("lists") == 1, F.element_at("lists", 1)).when(F.size("lists") > 1, F.sha1(F.array_join("lists", ":")))
    text = F.btrim(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"), F.lit(STRIPPED))
    one = F.array(F.struct(
        F.lit(0).alias("window_index"), text.alias("text"), F.element_at("blocks", 1)["span_start"].alias("span_start"), F.element_at("blocks", -1)["span_end"].alias("span_end"),
        group.alias("list_group_id"), F.exists("blocks", lambda b: b["checklist"]).alias("contains_checklist"),
    ))
    fold = F.udf(lambda blocks: None if blocks is None else list(windows_of(b.asDict() for b in blocks)), f"array<struct<{WINDOWS.replace(' ', ': ').replace(',:', ',')}>>")
    rows = sections.withColumns({"fits": size <= LIMIT, "lists": lists})
    rows = rows.withColumn("folded", fold(F.when(~F.col("fits"), F.col("blocks"))))
    windows = rows.select(*kept, F.inline(F.when(F.col("fits"), one).otherwise(F.col("folded"))))
    named = F.startswith("text", F.col("section_title"))
    return windows.withColumn("text", F.when(named, F.col("text")).otherwise(normalised_space(F.concat_ws("\n", "section_title", "text"))))


def embedding_input(title: Column, section: Column, path: Column, article: Column, text: Column) -> Column:
    """Document, section, path and article in square brackets, then the text."""
    line = lambda name, value: F.concat(F.lit(f"[{name}: "), value, F.lit("]"))
    article_ = F.when(article.isNotNull(), line("조문", article)).otherwise("")
    return normalised_space(F.concat_ws("\n", line("문서", title), line("섹션", section), line("경로", F.array_join(path, " > ")), article_, F.lit(""), text))


def chunk_rows(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunks of files with ``rules.metadata``'s columns: text, place, ids, labels, search text and embedding input.

    A null, empty or blank text has no chunks; an empty table gives none; files that share a key are read as one. Ids are
    hashes of document, section and text, so they stay as long as these do. Lengths and spans count code points.
    """
    sections = section_blocks(section_lines(files, key, text), key)
    rows = section_windows(sections.join(files.select(key, "title", "name", "path", "mode", "source_type", "source_role", "document_group", "chunk_policy", "effective_date"), key), key)
    trail = F.array_join("section_path", ">")
    rows = rows.withColumn("section_id", F.sha1(F.concat_ws(":", key, trail, "line_start", "line_end")))
    rows = rows.withColumn("embedding_input", embedding_input(F.col("title"), F.col("section_title"), F.col("section_path"), F.col("article_no"), F.col("text")))
    rows = rows.withColumn("chunk_hash", F.sha1(F.concat_ws(":", key, "section_id", "window_index", "embedding_input")))
    labels = F.concat(
        F.array(F.col("title"), F.col("source_type"), F.col("document_group"), F.concat(F.lit("chunk-policy:"), "chunk_policy"), F.concat(F.lit("chunk-boundary:"), "reason")),
        F.array(F.when(F.col("list_group_id").isNotNull(), "chunk-protected:group"), F.when(F.col("contains_checklist"), "chunk-protected:checklist")), F.col("section_path"),
    )
    search = normalised_space(F.concat_ws("\n", "title", "name", "source_type", "document_group", F.array_join("section_path", " "), F.coalesce("article_no", F.lit("")), "section_title", "text"))
    place = Window.partitionBy(key).orderBy("section_no", "window_index")
    return rows.withColumns({
        "chunk_id": F.sha1(F.concat_ws(":", key, "chunk_hash")), "chunk_index": (F.row_number().over(place) - 1).cast("int"), "text_preview": F.substring("text", 1, PREVIEW),
        "matched_labels": F.filter(F.array_compact(labels), lambda x: x != ""), "search_text": search, "citation_group_id": F.sha1(F.concat_ws(":", key, "section_id")),
    })


def section_rows(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a section: its id, title, path, article, reason, lines and content."""
    sections = section_blocks(section_lines(files, key, text), key)
    return sections.select(key, "section_no", F.sha1(F.concat_ws(":", key, F.array_join("section_path", ">"), "line_start", "line_end")).alias("section_id"), *SECTION, F.size("section_path").alias("depth"), "content")


def document_rows(files: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """files with the hash of their text, its version id, and their numbers of chunks and sections; files without chunks have none of either."""
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("section_id").alias("n_sections"))
    rows = files.withColumn("content_hash", F.sha2(whole(F.col(text)), 256)).withColumn("version_id", F.concat(F.col(key).cast("string"), F.lit(":v1")))
    return rows.join(counts, key, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_chunks", "n_sections")})


def evidence_context(chunks: DataFrame, per: str, order: str, label: str = "label") -> DataFrame:
    """(per, n, context): the chunks of each list in order, each with id, source, document, article, path, date and content, parted by rules."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    block = F.concat_ws(
        "\n", line("EvidenceId", F.col("chunk_id")), line("Source", F.col(label)), line("Document", F.col("title")), line("Article", F.col("article_no")),
        F.when(F.size("section_path") > 0, line("Path", F.array_join("section_path", " > "))), line("EffectiveDate", F.col("effective_date")), F.concat(F.lit("Content:\n"), "text"),
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), block.alias("block"))))
    return chunks.groupBy(per).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n---\n\n").alias("context"))
