"""What lists of candidates gain from their surroundings: routed sections, neighbouring windows under a budget, whole lists of items, entities that a question names.

A list is a table (query_id, chunk_id, rank, score); chunks are ``chunks.chunk_rows``-like tables. Lists are joined to chunks
once; what depends on the order inside a list is a fold over that list's own few rows, in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import QUALIFIERS
from tessera.functions.text import whole

# --- fixed values: points, limits and words that decide results ---------------------------------
ROUTED, ROUTE_HEAD, ROUTE_POINTS, HEADING_POINTS = 3, 6, 6.0, 3.0
CONTEXT_CHUNKS, CONTEXT_CHARS, CONTEXT_CHUNK_CHARS = 6, 2400, 700
ROLE_POINTS = {"primary_evaluation": 40.0, "support_reference": 20.0, "routing_summary": 15.0}
OTHER_ROLE_POINTS = 10.0
LABEL_POINTS = (("chunk-policy:evaluation", 12.0), ("chunk-policy:law", 10.0), ("chunk-protected:checklist", 8.0), ("chunk-protected:group", 6.0), ("chunk-policy:manual", 4.0))
LIST_HEAD, LIST_POINTS, FORCED = 30, 4.0, 4
ENTITY_ANCHORS = {
    "신규수급자": ("신규수급자", "신규 수급자", "신규로 등록", "처음 온 수급자", "신규 등록"),
    "퇴소": ("퇴소", "종결", "서비스 종료", "퇴원", "종료 시"),
    "입소": ("입소", "입실", "처음 입소", "입소 시"),
    "민원": ("민원", "불만", "고충", "이의제기", "항의"),
    "사고발생": ("사고 발생", "사고발생", "응급상황", "사건 발생", "사고 시"),
    "12월신규": ("12월 신규", "12월에 신규", "12월 신규 수급자", "12월 등록"),
}
ANCHORED, ANCHORED_POINTS = 12, 24.0
CHECKLIST_POINTS, QUALIFIER_POINTS, SECTION_POINTS, PRIMARY_POINTS, NUMBERED_TITLE_POINTS, WORKFLOW_POINTS, TERM_POINTS, QA_POINTS = 18.0, 8.0, 12.0, 40.0, 80.0, 30.0, 20.0, -28.0
NUMBERED_TITLE, WORKFLOW_TITLE, QA_TITLE = "^[0-9]{2}-[0-9]{2}-", "욕구사정|급여제공계획|정보제공|지침|상담|계획", "Q&A|qa|사례집|업무의 이해"
QUALIFIER_TERMS = r"14일\s*이내|급여제공\s*시작일|8가지|연\s*1회|분기별|다만"
# ------------------------------------------------------------------------------------------------


def section_routes(candidates: DataFrame, chunks: DataFrame, most: int = ROUTED) -> DataFrame:
    """(query_id, place, section_id, doc_id, n): the sections that hold most of a list's candidates; ties to the one met first."""
    met = candidates.join(chunks.select("chunk_id", "section_id", "doc_id"), "chunk_id")
    counts = met.groupBy("query_id", "section_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.min("doc_id").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "first", "section_id"))
    return counts.withColumn("place", place).filter(F.col("place") <= most).select("query_id", "place", "section_id", "doc_id", "n")


def routed(candidates: DataFrame, chunks: DataFrame, focus: DataFrame) -> DataFrame:
    """candidates ranked anew: chunks of the first candidates' sections gain points, more where a heading holds one of the question's focus terms.

    focus is (query_id, focus array<string>); chunks give section_id and heading. Equal scores keep their order.
    """
    met = candidates.join(chunks.select("chunk_id", "section_id", "heading"), "chunk_id").join(focus.select("query_id", "focus"), "query_id", "left")
    heads = met.filter(F.col("rank") <= ROUTE_HEAD).select("query_id", "section_id").distinct().withColumn("head", F.lit(True))
    low = F.lower(whole(F.col("heading")))
    named = F.coalesce(F.exists("focus", lambda t: low.contains(F.lower(t))), F.lit(False))
    points = F.when(F.col("head"), F.lit(ROUTE_POINTS) + F.when(named, HEADING_POINTS).otherwise(0.0)).otherwise(0.0)
    scored = met.join(heads, ["query_id", "section_id"], "left").withColumn("routed_score", F.col("score") + points)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("routed_score"), "rank"))
    return scored.select("query_id", "chunk_id", "section_id", F.col("rank").alias("was"), "score", "routed_score", place.alias("rank"))


def sibling_windows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, relation, neighbour): the windows before (0) and after (1) each chunk in its section."""
    order = Window.partitionBy("doc_id", "section_id").orderBy("window_index", "chunk_id")
    both = chunks.select("chunk_id", F.lag("chunk_id").over(order).alias("before"), F.lead("chunk_id").over(order).alias("after"))
    return both.select("chunk_id", F.posexplode(F.array("before", "after")).alias("relation", "neighbour")).filter("neighbour IS NOT NULL")


def _role_points(role: Column) -> Column:
    out = F
    for name, points in ROLE_POINTS.items():
        out = out.when(role == name, points)
    return out.otherwise(OTHER_ROLE_POINTS)


def _label_points(labels: Column) -> Column:
    out = F
    for name, points in LABEL_POINTS:
        out = out.when(F.array_contains(labels, name), points)
    return out.otherwise(0.0)


def neighbour_candidates(evidence: DataFrame, chunks: DataFrame, chunk_chars: int = CONTEXT_CHUNK_CHARS) -> DataFrame:
    """(query_id, place, chunk_id, n_chars, n_chars_of the trimmed text, priority): neighbours of a list's chunks that are not in it, once each, best first.

    Of a chunk that neighbours several, the first of the list counts.
    """
    own = chunks.select("chunk_id", F.col("source_role").alias("anchor_role"))
    met = evidence.select("query_id", "chunk_id", "rank", "score").join(sibling_windows(chunks), "chunk_id").join(own, "chunk_id")
    listed = evidence.select("query_id", F.col("chunk_id").alias("neighbour"))
    met = met.join(listed, ["query_id", "neighbour"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id", "neighbour").orderBy("rank", "relation"))
    met = met.withColumn("first", first).filter("first = 1")
    there = chunks.select(F.col("chunk_id").alias("neighbour"), "source_role", "matched_labels", F.length(whole(F.col("text"))).alias("n_chars"), F.length(F.regexp_replace(F.substring("text", 1, chunk_chars), r"\s+$", "")).alias("n_cut"))
    met = met.join(there, "neighbour")
    priority = F.round(_role_points(F.col("source_role")) + _role_points(F.col("anchor_role")) + _label_points(F.col("matched_labels")) + F.coalesce("score", F.lit(0.0)) / 10, 9)
    used = F.when((F.lit(chunk_chars) <= 0) | (F.col("n_chars") <= chunk_chars), F.col("n_chars")).otherwise(F.col("n_cut") + 3)
    met = met.withColumns({"priority": priority, "n_used": used})
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("priority"), "rank", "relation"))
    return met.select("query_id", place.alias("place"), F.col("neighbour").alias("chunk_id"), "n_chars", "n_used", "priority")


def small_to_big(evidence: DataFrame, chunks: DataFrame, most_chunks: int = CONTEXT_CHUNKS, most_chars: int = CONTEXT_CHARS, chunk_chars: int = CONTEXT_CHUNK_CHARS, role_chars: dict[str, int] | None = None) -> DataFrame:
    """neighbour_candidates with ``verdict``: included, skipped-chunks or skipped-chars.

    A neighbour that would pass the budget of characters is skipped, and later, shorter ones may still come in; so each
    verdict depends on those before it. role_chars raises a list's budget where one of its chunks has that role. Lists
    without neighbours have no rows.
    """
    candidates = neighbour_candidates(evidence, chunks, chunk_chars)
    budget = F.lit(most_chars)
    roles = evidence.join(chunks.select("chunk_id", "source_role"), "chunk_id").groupBy("query_id").agg(F.collect_set("source_role").alias("roles"))
    for role, chars in (role_chars or {}).items():
        budget = F.greatest(budget, F.when(F.array_contains("roles", role), chars).otherwise(most_chars))
    row = F.struct("place", "chunk_id", "n_chars", "n_used", "priority")
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(roles, "query_id").withColumn("budget", budget)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("verdicts"))

    def step(state: Column, r: Column) -> Column:
        full, wide = state["n"] >= most_chunks, state["used"] + r["n_used"] > F.col("budget")
        taken = ~full & ~wide
        verdict = F.when(full, "skipped-chunks").when(wide, "skipped-chars").otherwise("included")
        return F.struct(
            (state["n"] + taken.cast("int")).alias("n"), (state["used"] + F.when(taken, r["n_used"]).otherwise(0)).alias("used"),
            F.concat(state["verdicts"], F.array(verdict)).alias("verdicts"),
        )

    folded = lists.select("query_id", "rows", F.aggregate("rows", start, step, lambda s: s["verdicts"]).alias("verdicts"))
    out = folded.select("query_id", F.explode(F.arrays_zip("rows", "verdicts")).alias("x"))
    return out.select("query_id", "x.rows.*", F.col("x.verdicts").alias("verdict"))


def small_to_big_summary(context: DataFrame) -> DataFrame:
    """(query_id, n_candidates, n_included, n_skipped_chunks, n_skipped_chars, chars)."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return context.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), count("included").alias("n_included"), count("skipped-chunks").alias("n_skipped_chunks"), count("skipped-chars").alias("n_skipped_chars"),
        F.coalesce(F.sum(F.when(F.col("verdict") == "included", F.col("n_used"))), F.lit(0).cast("long")).alias("chars"),
    )


def in_sequence(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, n_runs, sequential): how many pairs of consecutive windows of one section a list holds, and whether there is one."""
    met = evidence.select("query_id", "chunk_id").distinct().join(chunks.select("chunk_id", "doc_id", "section_id", "window_index"), "chunk_id")
    order = Window.partitionBy("query_id", "doc_id", "section_id").orderBy("window_index")
    pairs = met.withColumn("next", (F.lead("window_index").over(order) - F.col("window_index")) == 1)
    return pairs.groupBy("query_id").agg(F.count_if("next").alias("n_runs")).withColumn("sequential", F.col("n_runs") > 0)


def with_list_groups(selected: DataFrame, candidates: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """selected, filled up to top_k with candidates of the lists that the first candidates hold, in their order and with some points more; ranked anew.

    A list that has top_k rows or more keeps its best top_k.
    """
    group = chunks.filter("list_group_id IS NOT NULL").select("chunk_id", "list_group_id")
    met = candidates.join(group, "chunk_id")
    wanted = met.filter(F.col("rank") <= LIST_HEAD).select("query_id", "list_group_id").distinct()
    more = met.join(wanted, ["query_id", "list_group_id"], "left_semi").join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    room = selected.groupBy("query_id").agg((F.lit(top_k) - F.count(F.lit(1))).alias("room"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    more = more.join(room, "query_id").withColumn("turn", turn).filter("turn <= room")
    own = selected.select("query_id", "chunk_id", "score", F.lit(False).alias("expanded"), F.col("rank").alias("at"))
    rows = own.unionByName(more.select("query_id", "chunk_id", (F.col("score") + LIST_POINTS).alias("score"), F.lit(True).alias("expanded"), (F.col("turn") + 1_000_000).alias("at")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "at"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= top_k).select("query_id", "chunk_id", "score", "expanded", "rank")


def anchor_table(spark, anchors: dict | None = None) -> DataFrame:
    """(anchor_id, place, needles): each anchor's synonyms without white space, in lower case; a synonym that occurs twice counts twice."""
    rows = [(name, k, ["".join(s.split()).lower() for s in synonyms]) for k, (name, synonyms) in enumerate((ENTITY_ANCHORS if anchors is None else anchors).items())]
    return spark.createDataFrame(rows, "anchor_id string, place int, needles array<string>")


def _dense(text: Column) -> Column:
    return F.lower(F.regexp_replace(whole(text), r"\s+", ""))


def anchors_in(rows: DataFrame, key: str, text: str, anchors: DataFrame) -> DataFrame:
    """(key, anchor_id, place, points): the anchors of which the text holds a synonym; a point for each character of each such synonym.

    anchors is a list made by hand, far smaller than any corpus, and goes to every task.
    """
    dense = rows.select(key, _dense(F.col(text)).alias("dense"))
    held = lambda n: (n != "") & F.col("dense").contains(n)
    points = F.aggregate(F.filter("needles", held), F.lit(0), lambda s, n: s + F.greatest(F.lit(1), F.length(n)))
    return dense.join(F.broadcast(anchors), F.exists("needles", held)).select(key, "anchor_id", "place", points.alias("points"))


def indicator(title: Column, article: Column, section: Column) -> Column:
    return F.concat_ws("::", whole(title), F.coalesce(article, section, F.lit("")))


def with_entities(selected: DataFrame, candidates: DataFrame, chunks: DataFrame, asked: DataFrame, anchors: DataFrame, most: int = FORCED) -> DataFrame:
    """selected with ``anchor_id`` and ``forced``: its chunks that name one of the question's anchors are marked; up to ``most`` candidates come in for anchors, each for an indicator that the list lacks.

    asked is (query_id, question). Anchors have their turn in order. Within one the candidates with the most points
    come first, then those of higher score, then of lower rank. chunks give text, title, article_no and section_title.
    A question without anchors keeps its list as it is.
    """
    wanted = anchors_in(asked, "query_id", "question", anchors).select("query_id", "anchor_id", "place")
    named = chunks.select("chunk_id", indicator(F.col("title"), F.col("article_no"), F.col("section_title")).alias("indicator"), "text")
    shown = candidates.select("chunk_id").union(selected.select("chunk_id")).distinct().join(named, "chunk_id")
    points = anchors_in(shown, "chunk_id", "text", anchors).select("chunk_id", "anchor_id", "points")
    own = selected.join(named.select("chunk_id", "indicator"), "chunk_id")
    marks = own.join(points, "chunk_id").join(wanted, ["query_id", "anchor_id"]).groupBy("query_id", "chunk_id").agg(F.min_by("anchor_id", "place").alias("anchor_id"))
    marked = own.join(marks, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "score", "rank", "anchor_id", F.lit(False).alias("forced"), F.col("anchor_id").isNotNull().alias("by_entity"))
    free = candidates.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(named.select("chunk_id", "indicator"), "chunk_id")
    free = free.join(own.select("query_id", "indicator"), ["query_id", "indicator"], "left_anti").join(points, "chunk_id").join(wanted, ["query_id", "anchor_id"])
    # Of an anchor's candidates with one indicator the first is the only one that can come in.
    order = ("place", F.desc("points"), F.desc("score"), "rank")
    free = free.withColumn("best", F.row_number().over(Window.partitionBy("query_id", "anchor_id", "indicator").orderBy(*order))).filter("best = 1")
    free = free.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    lists = free.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", "chunk_id", "indicator", "anchor_id", "score", "rank"))).alias("rows"))
    kind = lists.schema["rows"].dataType.simpleString()

    def step(taken: Column, r: Column) -> Column:
        again = F.exists(taken, lambda t: (t["indicator"] == r["indicator"]) | (t["chunk_id"] == r["chunk_id"]))
        return F.when((F.size(taken) < most) & ~again, F.concat(taken, F.array(r))).otherwise(taken)

    forced = lists.select("query_id", F.explode(F.aggregate("rows", F.array().cast(kind), step)).alias("r"))
    return marked.unionByName(forced.select("query_id", "r.chunk_id", "r.score", "r.rank", "r.anchor_id", F.lit(True).alias("forced"), F.lit(True).alias("by_entity")))


def anchored_candidates(chunks: DataFrame, asked: DataFrame, anchors: DataFrame, base: DataFrame | None = None, most: int = ANCHORED) -> DataFrame:
    """(query_id, chunk_id, anchor_id, points, score, rank): the best chunk of each indicator that names one of a question's anchors.

    A chunk counts for the anchor it has most points for, the earlier of equals. Its score is that of base (query_id, chunk_id,
    score), where it has one, and points for checklists, qualifications, its section, role and title. Chunks and
    questions meet by anchor, so a chunk without anchors meets none.
    """
    held = anchors_in(chunks, "chunk_id", "text", anchors)
    wanted = anchors_in(asked, "query_id", "question", anchors).select("query_id", "anchor_id")
    met = wanted.join(held, "anchor_id").withColumn("first", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("points"), "place"))).filter("first = 1")
    title = F.concat_ws(" ", whole(F.col("title")), whole(F.col("section_title")))
    qualifier = "|".join(f"(?:{p})" for patterns in QUALIFIERS.values() for p in patterns)
    when = lambda test, points: F.when(test, points).otherwise(0.0)
    fixed = (
        when(F.col("contains_checklist"), CHECKLIST_POINTS) + when(F.col("text").rlike(qualifier), QUALIFIER_POINTS) + when(F.col("source_role") == "primary_evaluation", PRIMARY_POINTS)
        + when(F.col("title").rlike(NUMBERED_TITLE), NUMBERED_TITLE_POINTS) + when(title.rlike(WORKFLOW_TITLE), WORKFLOW_POINTS) + when(F.col("text").rlike(QUALIFIER_TERMS), TERM_POINTS) + when(title.rlike(QA_TITLE), QA_POINTS)
    )
    own = chunks.select("chunk_id", indicator(F.col("title"), F.col("article_no"), F.col("section_title")).alias("indicator"), _dense(F.col("section_title")).alias("dense"), fixed.alias("fixed"))
    met = met.join(own, "chunk_id").join(F.broadcast(anchors.select("anchor_id", "needles")), "anchor_id")
    sectional = when(F.exists("needles", lambda n: (n != "") & F.col("dense").contains(n)), SECTION_POINTS)
    if base is not None:
        met = met.join(base.select("query_id", "chunk_id", F.col("score").alias("base")), ["query_id", "chunk_id"], "left")
    start = F.coalesce("base", F.lit(0.0)) if base is not None else F.lit(0.0)
    met = met.withColumn("score", start + ANCHORED_POINTS + F.col("points") + F.col("fixed") + sectional)
    best = F.row_number().over(Window.partitionBy("query_id", "indicator").orderBy(F.desc("score"), "chunk_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return met.withColumn("best", best).filter("best = 1").withColumn("rank", place).filter(F.col("rank") <= most).select("query_id", "chunk_id", "anchor_id", "points", "score", "rank")
