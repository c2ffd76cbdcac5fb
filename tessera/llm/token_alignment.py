"""Alignment of two tokenizers' tokens by byte offsets, and how often ids meet over the whole corpus.

Each batch's tokens of both sides stand in pandas frames with their document and first byte. merge_asof, keyed by
document, finds for each token's first byte the other side's token that covers it; both directions together are all
overlaps. Places where tokens of both sides end cut a text into groups. The id pairs of each document are written once;
their document counts and each A id's highest are tables that documents' pairs are joined to.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ranked_words import byte_of_sign
from tessera.llm.shared import erase, table, written
from tessera.llm.tokenizing import MEMO_CHARS, MEMO_PIECES, SPACE, PieceEncoder

#: Texts are aligned in groups of about so many characters; a longer text is aligned in parts of that length, cut where both sides' tokens end.
GROUP_CHARS = 1_000_000
#: A table of up to so many (counted) pairs is sent to all tasks, some 30 bytes each; a larger one is joined by shuffle.
BROADCAST_PAIRS = 1_000_000
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
SPACES = re.compile(f"[{SPACE}]")


class BothEncoder:
    """Ids of space+text by a byte-level tokenizer (A) and by a sentencepiece model (B); one instance lives in a Python worker.

    Texts fall into chunks, each white space with what follows it. A's pattern never takes a token over such a boundary,
    and neither does B where none of its pieces has white space behind another sign, which is looked up in its
    vocabulary. So a chunk's ids are the same wherever it stands, and chunks are encoded by the libraries once.
    """

    _own: dict[tuple[str, str], BothEncoder] = {}

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        with open(a, encoding="utf-8") as f:
            made = json.load(f)
        signs = byte_of_sign()
        named = made["model"]["vocab"] | {t["content"]: t["id"] for t in made["added_tokens"]}
        self.bytes_a = [b""] * (1 + max(named.values()))
        for token, k in named.items():
            self.bytes_a[k] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.bytes_b = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.names_a, self.names_b = _names(len(self.bytes_a), "|"), _names(len(self.bytes_b), ";")
        self.ranked = self._ranked(made)
        self.chunk = self._chunks() if PieceEncoder._kind(made) == "keeps space" and not self.b.encode("") else None
        self.before = self.b.encode("a")
        self.memo: dict[str, tuple[bytes, bytes, bool]] = {}

    @classmethod
    def of(cls, a: str, b: str) -> BothEncoder:
        if (a, b) not in cls._own:
            cls._own = {(a, b): cls(a, b)}
        return cls._own[a, b]

    def _ranked(self, made: dict):
        """An encoder of A's by rank, which gives the same ids where they are in the order of merges; None where they aren't.

        It divides a text by the same pattern, but by its own table of characters: only chunks of Latin signs are given to it.
        """
        import tiktoken

        model, special = made["model"], {t["id"] for t in made["added_tokens"]}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"].get(m.replace(" ", "", 1), -1) for m in merges]
        ranks = {raw: k for k, raw in enumerate(self.bytes_a) if raw and k not in special}
        if PieceEncoder._kind(made) != "keeps space" or ids != sorted(set(ids)) or any(ranks.get(bytes([b]), ids[0]) >= ids[0] for b in range(256)):
            return None
        return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _ids_a(self, chunks: list[str]) -> Iterator[list[int]]:
        plain = [self.ranked is not None and max(c) < "\u0250" for c in chunks]
        others = iter(self.a.encode_batch_fast([c for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False))
        return (self.ranked(c) if p else next(others).ids for c, p in zip(chunks, plain, strict=True))

    def _chunks(self) -> re.Pattern:
        """Chunks begin where white space follows another sign; not at white space that stands behind such a sign in one of B's pieces."""
        inner = set()
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k).replace("▁", " ")
            inner.update(y for x, y in zip(piece, piece[1:]) if SPACES.match(y) and not SPACES.match(x))
        word = f"[^{SPACE}]"
        if not inner:
            return re.compile(f"[{SPACE}]*{word}+|[{SPACE}]+")
        within = "".join(map(re.escape, sorted(inner)))
        rest = f"(?:[{within}][{SPACE}]*{word}*)*"
        return re.compile(f"[{SPACE}]+(?:{word}+{rest})?|{word}+{rest}")

    def forget(self) -> None:
        self.memo = {}

    def _encode(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Of chunks that begin with white space: both sides' ids, and whether both sides' bytes are the chunk's."""
        out, skip = [], len(self.before)
        for at in range(0, len(chunks), 20_000):
            some = chunks[at : at + 20_000]
            ids_b = self.b.encode([f"a{c}" for c in some], num_threads=1)
            for c, ids, eb in zip(some, self._ids_a(some), ids_b, strict=True):
                own = eb[skip:]
                raw = c.encode()
                same = eb[:skip] == self.before and b"".join([self.bytes_a[i] for i in ids]) == raw and b"".join([self.bytes_b[i] for i in own]) == raw
                out.append((array("i", ids).tobytes(), array("i", own).tobytes(), same))
        return out

    def whole(self, text: str) -> tuple[bytes, bytes, bool]:
        """The same for space+text as one, for texts whose chunks don't tell."""
        ids, own, raw = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text), f" {text}".encode()
        same = b"".join([self.bytes_a[i] for i in ids]) == raw and b"".join([self.bytes_b[i] for i in own]) == raw
        return np.array(ids, dtype="<i4").tobytes(), np.array(own, dtype="<i4").tobytes(), same

    def known(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """The encoded chunks, new ones through the libraries; short ones are kept."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        new = [c for c in chunks if c not in self.memo]
        self.memo.update(zip(new, self._encode(new), strict=True))
        out = list(map(self.memo.__getitem__, chunks))
        for c in new:
            if len(c) > MEMO_CHARS:
                del self.memo[c]
        return out


def _names(n: int, last: str) -> np.ndarray:
    """At 2 * id the id with a comma, at 2 * id + 1 with the sign that ends a side of a group."""
    out = np.empty(2 * n, dtype=object)
    out[0::2] = [f"{k}," for k in range(n)]
    out[1::2] = [f"{k}{last}" for k in range(n)]
    return out


class Aligned:
    """What a text's parts add up to."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest = hashlib.sha256()
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, n_a: int, n_b: int, n_groups: int, n_links: int, names: str, pairs: np.ndarray, times: np.ndarray) -> None:
        if n_a:
            self.digest.update((f";{names}" if self.n_a else names).encode())
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups, self.n_links + n_links
        self.pairs.append(pairs)
        self.times.append(times)

    def row(self) -> tuple:
        if len(self.pairs) > 1:
            pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate(self.times), minlength=len(pairs)).astype(np.int32)
        else:
            pairs, times = (self.pairs[0], self.times[0]) if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        return self.n_a, self.n_b, self.n_groups, self.n_links, self.digest.hexdigest() if self.n_a else "", pairs, times


def _taken(encoded: list[tuple[bytes, bytes, bool]], side: int, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chunks ``at``, one behind the other, and how many each of the runs of chunks with these ends has."""
    pool = np.frombuffer(b"".join([e[side] for e in encoded]), dtype="<i4")
    length = np.fromiter((len(e[side]) for e in encoded), dtype=np.int64, count=len(encoded)) // 4
    start, each = np.cumsum(length) - length, length[at]
    stop = np.cumsum(each)
    ids = pool[np.repeat(start[at] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)]
    return ids, np.diff(np.concatenate(([0], stop))[ends], prepend=0)


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all tokens that share a byte; starts are sorted, over all documents, and tokens have no gaps."""
    a = pd.DataFrame({"doc": doc_a, "start": start_a, "a": np.arange(len(doc_a))})
    b = pd.DataFrame({"doc": doc_b, "start": start_b, "b": np.arange(len(doc_b))})
    first = pd.merge_asof(a, b, on="start", by="doc")
    second = pd.merge_asof(b, a, on="start", by="doc")
    more = start_a[second["a"].to_numpy(np.int64)] != second["start"].to_numpy()  # tokens that begin together are found from both sides
    return np.concatenate((first["a"].to_numpy(np.int64), second["a"].to_numpy(np.int64)[more])), np.concatenate((first["b"].to_numpy(np.int64), second["b"].to_numpy(np.int64)[more]))


def _aligned(encoder: BothEncoder, ids: tuple[np.ndarray, np.ndarray], numbers: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """Aligned.add's arguments for each text, from both sides' ids and the texts' numbers of tokens."""
    (ids_a, ids_b), docs = ids, len(numbers[0])
    doc_a, doc_b = (np.repeat(np.arange(docs), n) for n in numbers)
    long_a, long_b = encoder.length_a[ids_a], encoder.length_b[ids_b]
    end_a, end_b = np.cumsum(long_a), np.cumsum(long_b)
    at_a, at_b = overlaps(doc_a, end_a - long_a, doc_b, end_b - long_b)
    last_a = end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a if len(end_b) else np.zeros(0, bool)
    last_b = end_a[np.minimum(np.searchsorted(end_a, end_b), len(end_a) - 1)] == end_b if len(end_a) else np.zeros(0, bool)
    # both sides of each group, A's first, in one row of names
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    behind_a, behind_b = np.concatenate((np.flatnonzero(last_a) + 1, [0])), np.concatenate(([0], np.flatnonzero(last_b) + 1))
    names = np.empty(len(ids_a) + len(ids_b), dtype=object)
    names[np.arange(len(ids_a)) + behind_b[group_a]] = encoder.names_a[2 * ids_a.astype(np.int64) + last_a]
    names[np.arange(len(ids_b)) + behind_a[group_b]] = encoder.names_b[2 * ids_b.astype(np.int64) + last_b]
    # pairs of each text, counted
    bits_a, bits_b = len(encoder.bytes_a).bit_length(), len(encoder.bytes_b).bit_length()
    key = (doc_a[at_a] << (bits_a + bits_b)) | (ids_a[at_a].astype(np.int64) << bits_b) | ids_b[at_b]
    key, times = np.unique(key, return_counts=True)
    cuts = np.searchsorted(key, np.arange(docs + 1) << (bits_a + bits_b))
    pairs = ((key >> bits_b & ((1 << bits_a) - 1)) << 32) | (key & ((1 << bits_b) - 1))
    links, groups = np.bincount(doc_a[at_a], minlength=docs), np.bincount(doc_a[last_a], minlength=docs)
    stop = np.concatenate(([0], np.cumsum(numbers[0] + numbers[1])))
    for k in range(docs):
        some = "".join(names[stop[k] : stop[k + 1]].tolist())[:-1]
        yield int(numbers[0][k]), int(numbers[1][k]), int(groups[k]), int(links[k]), some, pairs[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]].astype(np.int32)


def align_texts(encoder: BothEncoder, texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, digest, pairs, times) of each text."""
    found = [Aligned() for _ in texts]
    odd: set[int] = set()
    held: list[tuple[int, list[str]]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        flat = pa.array([c for _, chunks in held for c in chunks], pa.large_string()).dictionary_encode()
        encoded = encoder.known(flat.dictionary.to_pylist())
        at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.array([len(chunks) for _, chunks in held])
        same = np.fromiter((e[2] for e in encoded), dtype=bool, count=len(encoded))[at]
        sound = np.add.reduceat(~same, np.cumsum(number) - number) == 0
        odd.update(k for (k, _), ok in zip(held, sound) if not ok)
        at, ends = at[np.repeat(sound, number)], np.cumsum(number[sound])
        ids_a, numbers_a = _taken(encoded, 0, at, ends)
        ids_b, numbers_b = _taken(encoded, 1, at, ends)
        own = [k for (k, _), ok in zip(held, sound) if ok]
        for k, got in zip(own, _aligned(encoder, (ids_a, ids_b), (numbers_a, numbers_b)), strict=True):
            found[k].add(*got)
        held, size = [], 0

    for k, text in enumerate(texts):
        if not text:
            continue
        if encoder.chunk is None:
            odd.add(k)
            continue
        chunks, begin = encoder.chunk.findall(f" {text}"), 0
        while begin < len(chunks):
            stop, chars = begin, 0
            while stop < len(chunks) and (stop == begin or chars + len(chunks[stop]) <= GROUP_CHARS):
                chars += len(chunks[stop])
                stop += 1
            if size and size + chars > GROUP_CHARS:
                flush()
            held.append((k, chunks[begin:stop]))
            size, begin = size + chars, stop
    if held:
        flush()
    for k in odd:  # encoded as one; mostly texts that B doesn't give back
        found[k] = Aligned()
        ids_a, ids_b, same = encoder.whole(texts[k])
        if same:
            a, b = np.frombuffer(ids_a, dtype="<i4"), np.frombuffer(ids_b, dtype="<i4")
            found[k].add(*next(_aligned(encoder, (a, b), (np.array([len(a)]), np.array([len(b)])))))
    return [f.row() for f in found]


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """ALIGNED for each document: numbers of tokens, groups and links, the groups' digest, distinct id pairs (A's id * 2^32 + B's) and how often each is linked.

    docs needs doc_id and text, other columns are not read. A text that is null, empty or whose tokens don't give its
    bytes back has no tokens: zeros, an empty digest, no pairs. Repeated rows and null ids keep their rows, a very long
    text is aligned in parts and whole. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BothEncoder.of(a, b)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = align_texts(encoder, part.column("text").to_pylist())
                ends = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
                pairs, times = (np.concatenate([r[k] for r in rows]) for k in (5, 6))
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.string())]
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents each id pair is linked, and whether no other pair of its A id is in more."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pair-counts")
    side = counts.withColumn("a", F.shiftright("pair", 32))
    most = side.groupBy("a").agg(F.max("docs").alias("most"))
    out = written(side.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-best")
    erase(counts)
    return out


def with_counts(aligned: DataFrame, counts: DataFrame, row: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned with n_best, the links whose pair is its A id's most frequent (ties included), and count_sum, the sum of all links' document counts.

    The column ``row`` numbers the rows of aligned. A document without pairs has zeros; every row stays.
    """
    linked = aligned.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(row, F.col("link.pairs").alias("pair"), "link.times")
    joined = linked.join(F.broadcast(counts) if counts.count() <= broadcast_pairs else counts, "pair")
    sums = joined.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum"))
    out = aligned.join(sums, row, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def align_corpus(docs: DataFrame, a: str, b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``align``'s columns with n_best and count_sum, by the pairs of all rows of docs. Two tables stay in the shared folder, which the result reads."""
    aligned = written(align(docs, a, b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    return with_counts(aligned, pair_counts(aligned), "row", broadcast_pairs).drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all documents by a byte-level and a sentencepiece tokenizer."""
    path = public_tokenizers.path
    out = align_corpus(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
