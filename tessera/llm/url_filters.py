"""URL filters: a bit-parallel automaton that runs every glob over every canonical URL at once.

Globs are over ``host + path``: ``*`` is a run without ``/``, ``**`` any run, ``?`` one byte that is
not ``/``; everything else stands for itself. Each glob is a chain of states packed into 64-bit words;
one pass over a URL's bytes moves all states of all globs by shift, mask and self-loop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ascii_lower, free_name

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Globs for what a text corpus does without: spam shops, gambling, adult hosts, trackers, binaries.
BLOCK_GLOBS = (
    "*pills*/**", "*viagra*/**", "*cialis*/**", "*pharma-*/**", "*casino*/**", "*poker*/**", "*slots-*/**",
    "*-slots.*/**", "*betting*/**", "*bet365*/**", "*lottery*/**", "*jackpot*/**", "*porn*/**", "*xxx*/**",
    "*adult-*/**", "*-adult.*/**", "*escort*/**", "*camgirls*/**", "*hentai*/**", "*nsfw*/**", "*replica-*/**",
    "*cheap-*/**", "*payday*/**", "*fast-loan*/**", "*crypto-double*/**", "*free-followers*/**", "*spam*/**",
    "*warez*/**", "*torrent*/**", "*keygen*/**", "*crack-*/**", "*phish*/**", "*malware*/**", "*clickbait*/**",
    "ads.*/**", "*.ads.*/**", "adserver.*/**", "*.adserver.*/**", "track.*/**", "tracker.*/**", "*.tracker.*/**",
    "*doubleclick*/**", "pixel.*/**", "*.pixel.*/**",
    "**/ads/**", "**/adserver/**", "**/track/**", "**/pixel/**", "**/redirect/**", "**/wp-login*", "**/xmlrpc.php",
    "**/cgi-bin/**", "**/login", "**/signup", "**/cart", "**/checkout", "**.exe", "**.zip", "**.tar.gz", "**.iso",
    "**.mp4", "**.mp3", "**.jpg", "**.jpeg", "**.png", "**.gif", "**.css", "**.js",
)


@dataclass(frozen=True)
class Automaton:
    """Masks by byte: ``step`` admits a shifted state, ``loop`` keeps a state; ``start`` and ``final`` states."""

    step: np.ndarray
    loop: np.ndarray
    start: np.ndarray
    final: tuple[tuple[int, int], ...]

    @classmethod
    def compiled(cls, globs: Sequence[str]) -> Automaton:
        step: list[tuple[int, list[int]]] = []
        loop: list[tuple[int, list[int]]] = []
        start, final, state = [], [], -1
        any_byte = list(range(256))
        no_slash = [b for b in any_byte if b != ord("/")]
        for glob in globs:
            state += 1
            start.append(state)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loop.append((state, any_byte))
                    i += 2
                elif raw[i : i + 1] == b"*":
                    loop.append((state, no_slash))
                    i += 1
                else:
                    state += 1
                    step.append((state, no_slash if raw[i : i + 1] == b"?" else [raw[i]]))
                    i += 1
            final.append((state // 64, state % 64))
        words = state // 64 + 1
        masks = np.zeros((2, 256, words), dtype=np.uint64)
        for kind, moves in enumerate((step, loop)):
            for at, accepted in moves:
                masks[kind, accepted, at // 64] |= np.uint64(1 << (at % 64))
        first = np.zeros(words, dtype=np.uint64)
        for at in start:
            first[at // 64] |= np.uint64(1 << (at % 64))
        return cls(masks[0], masks[1], first, tuple(final))

    def matches(self, urls: Sequence[str]) -> np.ndarray:
        """Boolean matrix: URL by glob. URLs are walked together, the longest first, each to its end."""
        raw = [u.encode() for u in urls]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        order = np.argsort(-length, kind="stable")
        length = length[order]
        text = np.frombuffer(b"".join(raw[i] for i in order) + b"\0", dtype=np.uint8)
        begin = np.cumsum(length) - length
        live = np.tile(self.start, (len(raw), 1))
        alive = len(raw)
        for at in range(int(length[0]) if len(raw) else 0):
            while alive and length[alive - 1] <= at:
                alive -= 1
            byte = text[begin[:alive] + at]
            state = live[:alive]
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            live[:alive] = (moved & self.step[byte]) | (state & self.loop[byte])
        out = np.empty((len(raw), len(self.final)), dtype=bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (live[:, word] >> np.uint64(bit)) & np.uint64(1) != 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_globs(rules: Sequence[tuple[str, str, str]]) -> list[tuple[int, str]]:
    """Each host rule as two globs, of the host itself and of its subdomains, with the rule's number."""
    return [(k, glob) for k, (_, host, path) in enumerate(rules) for glob in (f"{host}{path}**", f"*.{host}{path}**")]


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """pages with struct ``url_verdict``: host, path, rule, block_glob, verdict.

    The longest fitting host rule decides; where none fits, a URL that any block glob matches is blocked
    and all others are allowed. A null URL, or one without ``://``, has an empty host and path, no rule and is
    allowed. Every row is judged by itself, repeated ones too. Other columns stay; one named ``url_verdict`` is replaced. An empty table gives an empty table.
    """
    by_rule = rule_globs(rules)
    longest = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1] + rules[k][2]), k))
    globs = [g for _, g in by_rule] + list(block_globs)

    @F.pandas_udf("struct<rule:int,glob:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton.compiled(globs)
        for batch in batches:
            hit = automaton.matches(batch.tolist())
            rule = np.full(len(batch), -1, dtype=np.int32)
            for k in reversed(longest):
                rule[hit[:, [j for j, (r, _) in enumerate(by_rule) if r == k]].any(axis=1)] = k
            blocked = hit[:, len(by_rule) :]
            glob = np.where(blocked.any(axis=1), blocked.argmax(axis=1), -1) if blocked.shape[1] else np.full(len(batch), -1)
            yield pd.DataFrame({"rule": rule, "glob": glob.astype(np.int32)})

    def named(at: Column, names: Sequence[str]) -> Column:
        return F.when(at >= 0, F.element_at(F.array(*map(F.lit, names)), at + 1)) if names else F.lit(None).cast("string")

    found = run(F.concat(host_of(F.col(url)), path_of(F.col(url))))
    hit = free_name(pages, "hit")
    rule, glob = F.col(f"{hit}.rule"), F.col(f"{hit}.glob")
    verdict = F.coalesce(named(rule, [v for v, _, _ in rules]), F.when(glob >= 0, F.lit("block")).otherwise(F.lit("allow")))
    return pages.withColumn(hit, found).withColumn(
        "url_verdict",
        F.struct(
            host_of(F.col(url)).alias("host"),
            path_of(F.col(url)).alias("path"),
            named(rule, [h + p for _, h, p in rules]).alias("rule"),
            named(glob, list(block_globs)).alias("block_glob"),
            verdict.alias("verdict"),
        ),
    ).drop(hit)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every URL of pages judged."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "url_verdict.host", "url_verdict.path", "url_verdict.rule", "url_verdict.block_glob", "url_verdict.verdict")


def _regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() else c), i + 1
    return f"^{out}$"


def sql() -> str:
    """The same verdicts with regular expressions in place of the automaton."""
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    order = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in order]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, order, strict=True))
    ruled = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, order, strict=True))
    glob = " ".join(f"WHEN regexp_matches(host || path, '(?s){_regex(g)}') THEN '{g}'" for g in BLOCK_GLOBS)
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {lower}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hits AS (SELECT *, CASE {rule} END AS rule, CASE {glob} END AS block_glob, CASE {ruled} END AS ruled FROM parts)
SELECT page_id, host, path, rule, block_glob, coalesce(ruled, CASE WHEN block_glob IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM hits"""
