"""Column expressions over texts: tokens, normalised forms, masks, cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns that decide results -------------------------------------------------
#: White space of any script, and the signs that part tokens; of other characters tokens keep these alone.
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SIGNS = r".,!?;:'\"()\[\]{}<>/\\|@#$%^&*+=~`_\-"
KEPT = r"\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f0-9a-z"
CONTROLS = r"[\x00-\x08\x0e-\x1f\x7f]"
PARTICLES = (
    "으로부터", "에게서", "에서는", "으로는", "으로도", "까지는", "부터는", "한테서", "에게는", "에게도", "한테는", "한테도", "으로", "에서", "에게", "한테", "부터", "까지", "처럼", "보다", "마다",
    "은", "는", "이", "가", "을", "를", "의", "에", "도", "만", "과", "와", "로", "나", "랑",
)
FRAGMENTS = (
    "직원", "인권", "침해", "교육", "보호", "대응", "지침", "권익", "폭언", "폭행", "성희롱", "성폭력", "고충",
    "수급자", "보호자", "급여", "평가", "매뉴얼", "주야간보호", "재가급여", "평가매뉴얼", "사례집", "개정", "비교표", "인건비", "지출", "비율", "다빈도", "질의응답", "장기근속", "장려금", "청구",
    "전산", "기능회복", "일상생활", "훈련", "낙상", "욕창", "감염", "재난", "응급", "안전", "환경", "예방", "시설", "인력", "현황", "배치", "신고", "기준", "본인부담금", "의사소견서",
)
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:\+?82[-\s]?)?0[0-9]{1,2}[-\s]?[0-9]{3,4}[-\s]?[0-9]{4}"
RESIDENT_ID = r"\b[0-9]{6}[-\s]?[1-4][0-9]{6}\b"
MASKS = ("[REDACTED_PHONE]", "[REDACTED_EMAIL]", "[REDACTED_ID]")
ARTICLE = r"제\s*[0-9]+\s*조(?:의\s*[0-9]+)*"
# ------------------------------------------------------------------------------------------------


#: What SQL's trim takes off: white space that parts words, in any script.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def as_sql(pattern: str) -> str:
    r"""A pattern as SQL reads it: \b and \s know ASCII alone, only \n ends a line, and $ stands behind the whole text.

    Java's \b takes letters of all scripts for parts of a word. A sign $ in brackets is not provided for.
    """
    edge = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
    return "(?d)" + pattern.replace(r"\b", edge).replace(r"\s", r"[\t\n\f\r ]").replace("$", r"\z")


def lowered(text: Column) -> Column:
    """Lower case letter by letter, as SQL does it: without the sigma at the end of a word, and without a dot of its own on i."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def without_particle(token: Column) -> Column:
    """The token without its longest ending particle, if two characters stay."""
    return F.regexp_replace(token, f"(?<=..)(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))})$", "")


def fragments(token: Column) -> Column:
    """The known parts of a Hangul compound of four characters or more, longest first; none where it has fewer than two."""
    known = F.array(*[F.lit(f) for f in sorted(FRAGMENTS, key=len, reverse=True)])
    held = F.filter(known, lambda f: (F.length(f) < F.length(token)) & token.contains(f))
    compound = token.rlike("^[\\uac00-\\ud7a3]{4,}$") & (F.size(held) >= 2)
    return F.when(compound, held).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, shortest: int = 2) -> Column:
    """The distinct lower-case tokens of at least ``shortest`` characters, in order of first occurrence.

    Tokens keep Hangul, digits and a-z. Hangul tokens also give their form without particle and the parts of compounds.
    """
    low = F.lower(whole(text))
    low = F.when(low.rlike(CONTROLS), F.regexp_replace(low, CONTROLS, "")).otherwise(low)
    # what is not ASCII is looked at token by token: most tokens are spared the pattern
    pure = lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, f"[^{KEPT}]+", ""))
    # letters and digits of ASCII are passed at once, without a look at each kind of white space
    cut = F.filter(F.transform(F.split(low, f"(?![a-z0-9])[{SPACES}{SIGNS}]+", -1), pure), lambda t: F.length(t) >= shortest)

    def forms(t: Column) -> Column:
        bare = without_particle(t)
        return F.concat(F.array(t), fragments(t), F.array(bare), fragments(bare))

    return F.array_distinct(F.when(low.rlike("[\\uac00-\\ud7a3]"), F.flatten(F.transform(cut, forms))).otherwise(cut))


def one_blank(text: Column) -> Column:
    """Runs of blanks and tabs to one blank; a text without any is spared the pattern."""
    return F.when(text.contains("  ") | text.contains("\t"), F.regexp_replace(text, "[ \\t]+", " ")).otherwise(text)


def normalised_space(text: Column) -> Column:
    """CRLF to LF, runs of blanks to one, three or more line ends to two, trimmed."""
    lines = one_blank(F.replace(whole(text), F.lit("\r\n"), F.lit("\n")))
    lines = F.when(lines.contains("\n\n\n"), F.regexp_replace(lines, "\n{3,}", "\n\n")).otherwise(lines)
    return F.btrim(lines, F.lit(" \t\n\x0b\f\r"))


def compact(text: Column) -> Column:
    """Lower case, Hangul, digits and a-z only."""
    return F.regexp_replace(F.lower(whole(text)), "[^\\uac00-\\ud7a3\\u1100-\\u11ff\\u3130-\\u318f0-9a-z]+", "")


def title_key(name: Column) -> Column:
    """The base name without extension and white space, lower case."""
    base = F.element_at(F.split(F.replace(whole(name), F.lit("\\"), F.lit("/")), "/", -1), -1)
    return lowered(F.regexp_replace(F.regexp_replace(base, as_sql(r"(?i)\.(md|txt)$"), ""), as_sql(r"\s+"), ""))


def masked(text: Column, ids_first: bool = False) -> Column:
    """Phone numbers, mail addresses and resident ids replaced; ids first for logs."""
    steps = list(zip((PHONE, EMAIL, RESIDENT_ID), MASKS, strict=True))
    out = whole(text)
    for pattern, mask in (steps[2:] + steps[:2]) if ids_first else steps:
        out = F.regexp_replace(out, pattern, mask)
    return out


def preview(text: Column, limit: int = 120) -> Column:
    """Masked, white space collapsed, cut at ``limit`` with an ellipsis."""
    flat = F.trim(F.regexp_replace(masked(text, ids_first=True), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def trimmed_to(text: Column, limit: int) -> Column:
    return F.when(F.length(whole(text)) > limit, F.concat(F.substring(whole(text), 1, limit), F.lit("..."))).otherwise(whole(text))


def article_no(text: Column) -> Column:
    """The first article number, without white space; null where there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(whole(text), ARTICLE, 0), r"\s+", ""), F.lit(""))


def without_markdown(text: Column) -> Column:
    """Code marks, emphasis, links, list marks and table bars removed."""
    out = F.regexp_replace(whole(text), r"`([^`]*)`", "$1")
    out = F.regexp_replace(out, r"\*\*([^*]*)\*\*", "$1")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?m)^\s*[-*+]\s+", ""), r"\|", " "))


def linked_names(text: Column) -> Column:
    """The distinct names of text files in back quotes, sorted."""
    found = F.regexp_extract_all(whole(text), F.lit(r"`([^`]+\.(?:md|txt))`"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.element_at(F.split(p, "/", -1), -1))))


def is_follow_up(text: Column, longest: int = 18) -> Column:
    """A turn that leans on the one before: short, or begun by a pointing word."""
    t = F.trim(whole(text))
    return (F.length(t) <= longest) | F.lower(t).rlike(r"^(그|이|저|그럼|그러면|and|then|it|that|this)(\s|$)")
