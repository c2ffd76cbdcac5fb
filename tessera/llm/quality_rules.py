"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Every text becomes uni- and bigrams of its letter runs and symbol runs, hashed into a number of
buckets that grows with the corpus. The trusted texts and all texts give two smoothed multinomials over the buckets; a
document's score is the mean, over its n-grams, of the log ratio of the two. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, free_name, table, with_struct, written

#: Buckets for a corpus of up to MIN_BUCKETS * CHARS_PER_BUCKET characters; beyond, as many as keep a bucket for so many characters.
MIN_BUCKETS, CHARS_PER_BUCKET = 1 << 14, 1 << 16
#: Up to so many log ratios stand in one row beside each text (8 bytes each); more are a table that n-grams are joined to, with the same result.
MAX_IN_ROW = 1 << 20
#: Log ratios are whole numbers of this part of a nat, so that sums don't depend on their order.
UNIT = 1_000_000_000
#: Mean log ratio, in nats an n-gram, under which a document is rejected.
THRESHOLD = -0.1
#: Occurrences that either side of a ratio has beforehand.
PRIOR = 5.0
#: Trusted documents that give the target multinomial: at most so many, those with the smallest hash of their id.
MAX_TRUSTED = 100_000
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"


def base_counts(text: Column, words: str) -> dict[str, Column]:
    """The counts of the base rules but repeats; words is the column of the text's words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD))
    return {
        "word_chars": F.length(F.concat_ws("", words)).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.aggregate(F.array(lines), F.lit(0).cast("long"), lambda _, x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def repeat_words(words: str) -> Column:
    """Words inside windows of three words whose 64-bit hash occurs twice or more.

    The windows are sorted by hash with their place; a window equal to a neighbour repeats, and each repeated
    window adds the words that the one before it has not covered.
    """
    return F.expr(f"""
      CASE WHEN size({words}) < 4 THEN 0L ELSE aggregate(
        array(transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))), 0L,
        (none, hashes) -> CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE aggregate(
          array(sort_array(transform(hashes, (h, i) -> struct(h AS h, i AS i)))), 0L,
          (none2, sorted) -> aggregate(
            sort_array(transform(
              filter(sequence(0, size(sorted) - 1), j -> sorted[j].h <=> get(sorted, j - 1).h OR sorted[j].h <=> get(sorted, j + 1).h),
              j -> sorted[j].i)),
            struct(-3 AS last, 0L AS n),
            (acc, p) -> struct(p AS last, acc.n + least(3, p - acc.last) AS n),
            acc -> acc.n)) END) END""")


def grams(tokens: str, buckets: int) -> Column:
    """Buckets of the unigrams and bigrams of an array of token hashes."""
    return F.expr(f"""concat(
      transform({tokens}, t -> cast(pmod(t, {buckets}) AS int)),
      transform({tokens}, (t, i) -> cast(pmod(xxhash64(get({tokens}, i - 1), t), {buckets}) AS int)))""")


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_hashes(text: Column) -> Column:
    return F.transform(tokens_of(text), lambda t: F.xxhash64(t))


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """Ids labelled good and not toxic, ``most`` at the most: those with the smallest hash."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def n_buckets(docs: DataFrame) -> int:
    """The power of two that gives each CHARS_PER_BUCKET characters of all texts a bucket, MIN_BUCKETS at least."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(MIN_BUCKETS, 1 << (-(-chars // CHARS_PER_BUCKET) - 1).bit_length()) if chars else MIN_BUCKETS


def _exploded(docs: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """keep and ``bucket``: a row for each n-gram of docs (keep, token array)."""
    # Each token beside the one before it; hashing the rows stays in generated code, which lambdas over arrays leave.
    pairs = docs.withColumn("before", F.concat(F.array(F.lit(None).cast("string")), "token"))
    rows = pairs.select(*keep, F.explode(F.arrays_zip("token", "before")).alias("p")).filter("p.token IS NOT NULL")
    hashed = rows.select(*keep, F.xxhash64("p.token").alias("t"), F.when(F.col("p.before").isNotNull(), F.xxhash64("p.before")).alias("b"))
    both = F.array(*[F.pmod(h, F.lit(buckets)).cast("long") for h in (F.col("t"), F.xxhash64("b", "t"))])
    return hashed.select(*keep, F.explode(both).alias("bucket"))


def counts(docs: DataFrame, trusted: DataFrame, buckets: int = MIN_BUCKETS) -> DataFrame:
    """(bucket, raw, target): how often the n-grams of all texts, and of the trusted ones, fall into each bucket that any falls into."""
    marked = docs.select("doc_id", tokens_of(F.col("text")).alias("token")).join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left"
    )
    return _exploded(marked, ["good"], buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target"))


#: Of one bucket, with the sums n_raw and n_target of all.
_RATIO = f"cast(round(ln((target + {PRIOR}D) / (raw * (n_target / n_raw) + {PRIOR}D)) * {UNIT}) AS bigint)"


def ratio_table(counted: DataFrame) -> DataFrame:
    """(bucket, ratio) of the buckets that n-grams fall into."""
    sums = {n: counted.agg(F.sum(n)).scalar() for n in ("raw", "target")}
    return counted.withColumns({f"n_{n}": x for n, x in sums.items()}).select("bucket", F.expr(_RATIO).alias("ratio"))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = MIN_BUCKETS) -> DataFrame:
    """One row ``ratio``: the log ratio of each bucket, in UNIT parts of a nat.

    Raw counts are scaled to the number of trusted n-grams, and both sides get PRIOR added to every bucket: what is rare
    in the corpus weighs little whether the trusted texts have it or not.

    The counts cover all documents, and all of the trusted among them; trusted has at most MAX_TRUSTED ids. Without trusted documents
    every log ratio is zero.
    """
    got = ratio_table(written(counts(docs, trusted, buckets), "quality-counts")).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "ratio"))).alias("by"))
    return got.select(F.expr(f"""transform(array_sort(concat(map_entries(by),
          transform(array_except(sequence(0L, {buckets}L - 1), map_keys(by)), b -> struct(b AS key, 0L AS value)))), e -> e.value)""").alias("ratio"))


def _sums(docs: DataFrame, ratios: DataFrame, buckets: int) -> DataFrame:
    """(q1, q2, total): the sum of the log ratios of each text's n-grams, by the text's digests; n-grams meet a table of ratios."""
    digests = (F.xxhash64("text").alias("q1"), F.xxhash64(F.lit(1), "text").alias("q2"))
    texts = docs.filter("text IS NOT NULL").select("text").distinct().select(*digests, tokens_of(F.col("text")).alias("token"))
    held = _exploded(texts, ["q1", "q2"], buckets).groupBy("q1", "q2", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return held.join(ratios, "bucket").groupBy("q1", "q2").agg(F.sum(F.col("n") * F.col("ratio")).alias("total"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int | None = None,
    most: int = MAX_TRUSTED,
    out: str = "quality",
    max_in_row: int = MAX_IN_ROW,
) -> DataFrame:
    """docs with struct ``out``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    A document fails the base rules with under 50 words or with over half its words in repeated windows. Else it is
    kept if its score reaches the threshold. A null or empty text has no words and fails; a text without n-grams
    scores 0; a very long text is judged whole, with arrays of its words in memory; repeated rows and ties get equal results; labels of unknown
    documents and null ids count for nothing; an empty table of documents stays empty, and without trusted documents all
    scores are 0. buckets: n_buckets(docs) if not given. Columns of docs stay; one named as ``out`` is replaced.
    """
    buckets = buckets or n_buckets(docs)
    trusted, text = trusted_ids(labels, most), F.col("text")
    ratio, words, tokens, got, total = (free_name(docs, n) for n in ("ratio", "words", "tokens", "got", "total"))
    rich = docs.withColumns({words: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))})
    if buckets <= max_in_row:
        model = fit(docs, trusted, buckets)
        rich = rich.withColumns({tokens: token_hashes(text), ratio: model.scalar()})
        score = F.expr(f"""CASE WHEN size({tokens}) = 0 THEN 0D ELSE
          aggregate(transform({tokens}, (t, i) -> get({ratio}, cast(pmod(t, {buckets}) AS int)) + get({ratio}, cast(pmod(xxhash64(get({tokens}, i - 1), t), {buckets}) AS int))),
            0L, (s, x) -> s + x) / {UNIT}D / (2 * size({tokens})) END""")
    else:
        ratios = written(ratio_table(written(counts(docs, trusted, buckets), "quality-counts")), "quality-ratios")
        sums = written(_sums(docs, ratios, buckets).select(F.struct("*").alias(total)), "quality-sums")
        rich = rich.withColumns({tokens: F.xxhash64("text"), ratio: F.xxhash64(F.lit(1), "text")})
        rich = rich.join(sums, (F.col(tokens) == F.col(f"{total}.q1")) & (F.col(ratio) == F.col(f"{total}.q2")), "left")
        n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))
        score = F.when(n == 0, 0.0).otherwise(F.col(f"{total}.total") / F.lit(float(UNIT)) / (2 * n))
    columns = {"n_words": F.size(words).cast("long"), **base_counts(text, words), "n_repeat_words": repeat_words(words), "score": score}
    rich = with_struct(rich, got, F.struct(*[c.alias(n) for n, c in columns.items()])).drop(words, tokens, ratio, total)
    failed = f"({got}.n_words < 50 OR 100 * {got}.n_repeat_words > 50 * {got}.n_words)"
    verdict = F.struct(f"{got}.*", F.expr(failed).alias("base_failed"), F.expr(f"NOT {failed} AND {got}.score >= {threshold}").alias("kept"))
    return rich.withColumn(out, verdict).drop(got)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document judged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", *[f"quality.{n}" for n in names])
