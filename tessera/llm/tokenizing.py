"""Token ids of texts, exactly as the tokenizers library gives them, with a bounded memo of pieces.

The library splits a text at white space before it merges anything, so a text's ids are the ids of its pieces in
order, and a piece that has been seen costs one look-up. The pieces are encoded by the library itself. A tokenizer
of another make, or a text that holds one of the special tokens, is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the library's patterns have it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A byte-level pattern keeps white space: one space goes with the next piece.
KEEPS_SPACE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: ASCII signs but the apostrophe.
SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Stands between words that are encoded together. Its first byte begins U+E000 to U+EFFF only.
MARK, MARKED = "\ue000", re.compile("[\ue000-\uefff]")
MEMO_PIECES, MEMO_CHARS, BATCH, GROUP_CHARS, TOGETHER = 400_000, 48, 20_000, 4_000_000, 400


def _body_and_signs(word: str) -> tuple[str, str]:
    """A word without the signs behind its last letter, and those signs: the pattern for words divides them there.

    ASCII words are lower-cased as the library does it. An apostrophe may begin a contraction, so it stays.
    """
    if word.isascii():
        word = word.lower()
    body = word.rstrip(SIGNS)
    if len(body) < len(word) and body and body[-1] < "\u0250" and body[-1].lower().isalpha():
        return body, word[len(body) :]
    return word, ""


class PieceEncoder:
    """Ids of texts by one tokenizer file; one instance lives in a Python worker."""

    _own: dict[str, PieceEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made["added_tokens"]]
        self.kind = self._kind(made)
        self.mark = np.array(self.tokenizer.encode(MARK, add_special_tokens=False).ids, dtype="<u4")
        self.memo: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._own:
            cls._own = {path: cls(path)}
        return cls._own[path]

    @staticmethod
    def _kind(made: dict) -> str | None:
        """How a text falls into pieces, None where pieces aren't known to be independent."""
        before, norm = made["pre_tokenizer"] or {}, made["normalizer"]
        parts = before.get("pretokenizers", [before])
        if made["model"]["type"] != "BPE" or made["model"].get("dropout"):
            return None
        if norm is None and [p.get("type") for p in parts] == ["ByteLevel"] and parts[0]["use_regex"] and not parts[0]["add_prefix_space"]:
            return "keeps space"
        kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if kinds == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
            return "drops space"
        return None

    def forget(self) -> None:
        """Empties the memo: at a task's end, so that an idle worker holds no memory."""
        self.memo = {}

    def _encoded(self, texts: list[str]) -> Iterable[bytes]:
        for at in range(0, len(texts), BATCH):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + BATCH], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers, one behind the other."""
        out: list[bytes] = []
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                out += self._group(group)
                group, chars = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        """The same for texts whose pieces are held at once."""
        out: list = [None] * len(texts)
        own: list[int] = []
        for k, text in enumerate(texts):
            if self.kind is None or any(s in text for s in self.special):
                out[k] = next(iter(self._encoded([text])))
            else:
                own.append(k)
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        if own:
            found = (self._by_words if self.kind == "drops space" else self._by_pieces)([texts[k] for k in own])
            for k, ids in zip(own, found, strict=True):
                out[k] = ids
        return out

    def _remember(self, new: list[str], ids: Iterable[bytes]) -> list[str]:
        """Puts pieces into the memo; returns the long ones, which leave it with the group."""
        self.memo.update(zip(new, ids, strict=True))
        return [piece for piece in new if len(piece) > MEMO_CHARS]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        split = list(map(KEEPS_SPACE.findall, texts))
        new = [p for p in set().union(*split) if p not in self.memo]
        long = self._remember(new, self._encoded(new))
        out = [b"".join(map(self.memo.__getitem__, pieces)) for pieces in split]
        for piece in long:
            del self.memo[piece]
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Words end at ASCII white space; what other white space is inside one, the library drops."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = lists.values.dictionary_encode()
        at, words = numbered.indices.to_numpy(), numbered.dictionary.to_pylist()
        pairs = list(map(_body_and_signs, words))
        new = [p for p in set(chain.from_iterable(pairs)) if p not in self.memo]
        long = self._remember(new, self._encoded_words(new))
        ids = [self.memo[body] + self.memo[signs] if signs else self.memo[body] for body, signs in pairs]
        for word in long:
            del self.memo[word]
        pool, length = np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start, each = np.cumsum(length) - length, length[at]
        ends = np.concatenate(([0], np.cumsum(each)))
        raw = pool[np.repeat(start[at] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """The same as _encoded for words, TOGETHER of them in one text with MARK between."""
        runs = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        out: list[bytes] = []
        for at in range(0, len(runs), 50):
            some = runs[at : at + 50]
            joined = self.tokenizer.encode_batch_fast([f"\n{MARK}\n".join(run) for run in some], add_special_tokens=False)
            for run, e in zip(some, joined, strict=True):
                ids, n = np.array(e.ids, dtype="<u4"), len(self.mark)
                same = np.ones(max(0, len(ids) - n + 1), dtype=bool)
                for k, mark in enumerate(self.mark):
                    same &= ids[k : k + len(same)] == mark
                marks = np.flatnonzero(same)
                if len(marks) != len(run) - 1 or any(map(MARKED.search, run)):
                    out += self._encoded(run)
                    continue
                raw, begin = ids.tobytes(), 0
                for stop in (*(4 * marks).tolist(), len(raw)):
                    out.append(raw[begin:stop])
                    begin = stop + 4 * n
        return out
