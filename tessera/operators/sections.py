"""Sections and chunks: line scans with running sections, blank-line blocks packed to windows, neighbours, cards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import whole

# --- fixed values: chunk sizes in characters ----------------------------------------------------
WINDOW, PROTECTED_WINDOW, OVERLAP, OVERSIZED = 1200, 2400, 120, 4800
# ------------------------------------------------------------------------------------------------


def lines(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) with line_no from 0."""
    return files.select(F.col(key), F.posexplode(F.split(whole(F.col(text)), "\n", -1)).alias("line_no", "line"))


def is_heading(line: Column) -> Column:
    """A markdown heading, an article or appendix line, a question line, or a numbered subheading."""
    return line.rlike(r"^(#{1,6}\s+\S|제\s*[0-9]+\s*조|(부칙|별표)|[QA][0-9]*[.:]\s|[0-9]+(\.[0-9]+)*[.)]\s+\S)")


def sections(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_no, title, content, n_lines, start_line): a section begins at each heading; blank ones are dropped.

    The whole scan works on one row's array of lines, so no document is ever spread over tasks and nothing is shuffled.
    """
    split = F.split(whole(F.col(text)), "\n", -1)
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | is_heading(F.get("_lines", i)))
    at = files.select(F.col(key), split.alias("_lines")).select(key, "_lines", starts.alias("_starts"))
    cut = at.select(key, "_lines", "_starts", F.posexplode("_starts").alias("section_no", "start_line"))
    end = F.coalesce(F.get("_starts", F.col("section_no") + 1), F.size("_lines"))
    body = F.slice("_lines", F.col("start_line") + 1, end - F.col("start_line"))
    out = cut.select(key, "section_no", "start_line", body.alias("_body"))
    content = F.array_join("_body", "\n")
    return out.select(
        key, "section_no", "start_line", F.size("_body").alias("n_lines"),
        F.trim(F.regexp_replace(F.get("_body", F.lit(0)), r"^#{1,6}\s+", "")).alias("title"), content.alias("content"),
    ).filter(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def windows(files: DataFrame, key: str = "doc_id", text: str = "text", limit: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key, window_index, span_start, span_end, content): sliding windows of ``limit`` characters that share ``overlap``."""
    step = limit - overlap
    length = F.length(whole(F.col(text)))
    count = F.greatest(F.lit(1), F.ceil((length - overlap) / F.lit(step))).cast("int")
    spread = files.select(F.col(key), whole(F.col(text)).alias("_t"), F.explode(F.sequence(F.lit(0), count - 1)).alias("window_index"))
    start = F.col("window_index") * step
    stop = F.least(start + limit, F.length("_t"))
    return spread.filter(F.length("_t") > 0).select(key, "window_index", start.alias("span_start"), stop.alias("span_end"), F.col("_t").substr(start + 1, stop - start).alias("content"))


def packed(files: DataFrame, key: str = "doc_id", text: str = "text", limit: int = WINDOW) -> DataFrame:
    """(key, chunk_index, n_blocks, content): line blocks filled greedily up to ``limit`` characters, with a line end between two.

    Where a chunk ends depends on where it began, so the lines of a row are filled in order, in time linear in its text. A line
    above the limit is a chunk by itself; lines of white space alone are left out, and so are texts without others.
    """
    schema = f"{key} {files.schema[key].dataType.simpleString()}, chunk_index int, n_blocks int, content string"

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, lines_ in zip(batch[key], batch["lines"], strict=True):
                number, held, size = 0, [], 0
                for line in lines_:
                    if held and size + 1 + len(line) > limit:
                        rows.append((own, number, len(held), "\n".join(held)))
                        number, held, size = number + 1, [], 0
                    size += len(line) + bool(held)
                    held.append(line)
                if held:
                    rows.append((own, number, len(held), "\n".join(held)))
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "n_blocks", "content"])

    blocks = F.filter(F.transform(F.split(whole(F.col(text)), r"\n", -1), lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: b != "")
    return files.select(key, blocks.alias("lines")).mapInPandas(fill, schema)


def neighbours(chunks: DataFrame, key: str = "doc_id", order: str = "window_index") -> DataFrame:
    """chunks with the index of the windows before and after, null at the ends or across a gap."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = F.lag(order).over(w), F.lead(order).over(w)
    return chunks.select("*", F.when(F.col(order) - before == 1, before).alias("previous"), F.when(after - F.col(order) == 1, after).alias("next"))


def cards(section_rows: DataFrame, key: str = "doc_id", most: int = 8) -> DataFrame:
    """A card a document: sections, characters, the first distinct titles in order, the opening 220 characters."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("section_no", "title"))), lambda s: s["title"])
    return section_rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("content")).alias("n_chars"),
        F.array_join(F.slice(F.array_distinct(titles), 1, most), " | ").alias("titles"),
        F.substring(F.min_by("content", "section_no"), 1, 220).alias("summary"),
    )


def char_budget(ranked: DataFrame, budget: int, text: str = "content", per: str = "query_id") -> DataFrame:
    """The leading rows of each list whose texts together fit the budget; the first overflow ends the list."""
    running = F.sum(F.length(text)).over(Window.partitionBy(per).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", running).filter(F.col("used") <= budget)
