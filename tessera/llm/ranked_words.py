"""Ids of plain words by rank, for tokenizers of words whose vocabulary is in the order of its merges.

Merging always takes the pair that was learned first, so where ids follow that order the merged piece's id is its rank, and
a merge by rank gives the same ids as the tokenizer's own. A byte that UTF-8 never has stands for the end of a word. Only
words of Latin letters and runs of ASCII signs are taken this way, which the tokenizer's pattern never divides; all
others go through the tokenizer's library.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable

from tessera.llm.tokenizing import SIGNS, PieceEncoder

WORD_END = b"\xff"


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones are themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def word_ranks(made: dict) -> dict[bytes, int] | None:
    """Bytes to ids of a vocabulary with ends of words; None where ids aren't in the order of merges."""
    model, signs = made["model"], byte_of_sign()
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get("".join(m), -1) for m in merges]
    special = {t["content"] for t in made["added_tokens"]}
    out = {}
    for token, k in model["vocab"].items():
        body, end = (token[: -len(suffix)], WORD_END) if token.endswith(suffix) else (token, b"")
        if token not in special and all(c in signs for c in body):
            out[bytes(signs[c] for c in body) + end] = k
    if ids != sorted(set(ids)) or min(ids) < 512 or any(out.get(bytes([b])) is None or out.get(bytes([b]) + WORD_END, 512) >= 512 for b in range(256)):
        return None
    return out


class RankedEncoder(PieceEncoder):
    """PieceEncoder that encodes plain words by rank, where the tokenizer allows it."""

    _own: dict[str, PieceEncoder] = {}

    def __init__(self, path: str) -> None:
        super().__init__(path)
        import tiktoken

        with open(path, encoding="utf-8") as f:
            ranks = word_ranks(json.load(f)) if self.kind == "drops space" else None
        if ranks is not None:
            # the byte for a word's end never stands alone in a result: it is merged before anything else
            free = max(ranks.values()) + 1
            ranks = {WORD_END: free} | {bytes(k): v for k, v in ranks.items() if k != WORD_END}
        self.core = None if ranks is None else tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @staticmethod
    def _plain(word: str) -> bool:
        return (word.isalpha() and max(word) < "ɐ" and "İ" not in word) or not word.strip(SIGNS)

    def _encoded_words(self, words: list[str]) -> Iterable[bytes]:
        if self.core is None:
            return super()._encoded_words(words)
        plain = [bool(w) and self._plain(w) for w in words]
        others = iter(super()._encoded_words([w for w, p in zip(words, plain, strict=True) if not p]))
        one = self.core.encode_single_piece
        return [array("I", one(w.lower().encode() + WORD_END)).tobytes() if p else next(others) for w, p in zip(words, plain, strict=True)]
