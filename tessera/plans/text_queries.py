"""Scalar functions over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.tables import table

#: For texts without Hangul: those give further forms, which literal tests cover.
_SPACES, _KEPT = (re.sub(r"\\u([0-9a-f]{4})", r"\\x{{\1}}", x) for x in (T.SPACES, T.KEPT))
_SIGNS = T.SIGNS.replace("'", "''").replace("{", "{{").replace("}", "}}").replace('\\"', '"')
CUT_SQL = f"list_filter(string_split_regex(regexp_replace(lower(coalesce({{0}}, '')), '[^{_KEPT}{_SPACES}{_SIGNS}]+', '', 'g'), '[{_SPACES}{_SIGNS}]+'), lambda t: length(t) >= 2)"
TOKENS_SQL = f"list_distinct({CUT_SQL})"


def text_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.array_min("t").alias("first_token"), F.array_max("t").alias("last_token"))


def text_normalised(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalised_space(t)).alias("spaces_md5"), F.md5(T.compact(t)).alias("compact_md5"), F.length(T.compact(t)).alias("n_compact"))


def text_masked(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(T.masked(t)).alias("masked_md5"), F.md5(T.masked(t, ids_first=True)).alias("log_masked_md5"),
        F.regexp_count(T.whole(t), F.lit(T.EMAIL)).alias("n_mails"), F.regexp_count(T.whole(t), F.lit(T.PHONE)).alias("n_phones"),
    )


def text_previews(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.preview(t).alias("preview"), T.trimmed_to(t, 40).alias("trimmed"))


def text_markup(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.without_markdown(t)).alias("plain_md5"), F.array_join(T.linked_names(t), ",").alias("links"), T.article_no(t).alias("article_no"))


def page_title_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.title_key(F.col("url")).alias("title_key"))


QUERIES = {f.__name__: f for f in (text_tokens, text_normalised, text_masked, text_previews, text_markup, page_title_keys)}

_MASK = r"""regexp_replace(regexp_replace(regexp_replace({0}, '{1}', '{2}', 'g'), '{3}', '{4}', 'g'), '{5}', '{6}', 'g')"""
_P, _E, _I = zip((T.PHONE, T.EMAIL, T.RESIDENT_ID), T.MASKS)
SQL = {
    "text_tokens": f"WITH d AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, list_min(t) AS first_token, list_max(t) AS last_token FROM d",
    "text_normalised": r"""
WITH d AS (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS s,
  regexp_replace(lower(coalesce(text, '')), '[^\x{ac00}-\x{d7a3}\x{1100}-\x{11ff}\x{3130}-\x{318f}0-9a-z]+', '', 'g') AS c FROM documents)
SELECT doc_id, md5(s) AS spaces_md5, md5(c) AS compact_md5, length(c) AS n_compact FROM d""",
    "text_masked": f"""
SELECT doc_id, md5({_MASK.format("coalesce(text, '')", *_P, *_E, *_I)}) AS masked_md5, md5({_MASK.format("coalesce(text, '')", *_I, *_P, *_E)}) AS log_masked_md5,
  len(regexp_extract_all(coalesce(text, ''), '{T.EMAIL}')) AS n_mails, len(regexp_extract_all(coalesce(text, ''), '{T.PHONE}')) AS n_phones FROM documents""",
    "text_previews": rf"""
WITH f AS (SELECT conv_id, turn, coalesce(text, '') AS text, trim(regexp_replace({_MASK.format("coalesce(text, '')", *_I, *_P, *_E)}, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 119)) || '…' ELSE t END AS preview,
  CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS trimmed FROM f""",
    "text_markup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '`([^`]*)`', '\1', 'g'), '\*\*([^*]*)\*\*', '\1', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '\|', ' ', 'g')) AS p FROM documents)
SELECT doc_id, md5(p) AS plain_md5,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '`([^`]+\.(?:md|txt))`', 1), lambda x: list_last(string_split(x, '/'))))), ','), '') AS links,
  nullif(regexp_replace(regexp_extract(text, '제\s*[0-9]+\s*조(?:의\s*[0-9]+)*'), '\s+', '', 'g'), '') AS article_no FROM d""",
    "page_title_keys": r"""
SELECT page_id, lower(regexp_replace(regexp_replace(list_last(string_split(replace(coalesce(url, ''), '\', '/'), '/')), '(?i)\.(md|txt)$', ''), '\s+', '', 'g')) AS title_key FROM pages""",
}
