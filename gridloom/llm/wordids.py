"""Ids of a lower-casing word BPE, equal to those of the tokenizers library, with a bounded memory of words.

A text of common characters is split at white space, which no token spans. Words that are not remembered are cut as the
vocabulary's own pattern cuts them and get their ids by the same merges in a faster library, all of a batch at once. Any
other text goes through the tokenizers library as it is.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import regex

from gridloom.llm.bpe import tokenizer_of
from gridloom.llm.packing import byte_letters

WORDS = 500_000  # that a Python worker remembers
#: Texts of characters that neither composition nor a context changes in lower case: white space, printable ASCII and Latin letters but for one.
COMMON = regex.compile(r"[\t\n\r -~¡-įı-ɏ]*")
#: Fixed value: the pattern that the vocabulary's file names, and the ends of words.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
END = "\0"  # stands for the end of a piece


class WordIds:
    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) > 0xFFFF:
            raise ValueError("ids of more than two bytes")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.merges = self._ranked()
        self.line = self.merges.encode_single_token(f"\n{END}".encode()) if self.merges else None

    def _ranked(self):
        """The merges by the bytes of their results; None for other kinds of vocabulary."""
        try:
            import tiktoken
        except ImportError:
            return None
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix, byte, ranks = model.get("end_of_word_suffix"), {c: b for b, c in byte_letters().items()}, {END.encode(): 0xFFFFF}
        for piece, n in model["vocab"].items():
            if piece in self.special:
                continue
            last = bool(suffix) and piece.endswith(suffix)
            raw = bytes(byte.get(c, 0) for c in (piece[: -len(suffix)] if last else piece))
            if 0 not in raw:  # the letter of byte 0 doesn't occur in common texts
                ranks[raw + (END.encode() if last else b"")] = n
        whole = [ranks.get(bytes([b]) + END.encode(), 1 << 20) for b in range(1, 256)]
        merged = min((n for raw, n in ranks.items() if len(raw.rstrip(END.encode())) > 1), default=0)
        if not suffix or max(whole) >= merged:
            return None
        return tiktoken.Encoding("pieces", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, new: list[str]) -> None:
        tokens = CUT.findall("\n".join(new).lower() + "\n")
        ids = np.array(self.merges.encode_ordinary(END.join(tokens) + END), np.int64)
        raw, ends = ids.astype("<u2").tobytes(), np.flatnonzero(ids == self.line).tolist()
        for word, lo, hi in zip(new, [-1, *ends], ends, strict=False):
            self.known[word] = raw[2 * lo + 2 : 2 * hi]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, two bytes each, low byte first."""
        split = [t.split() if self.merges and COMMON.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        if len(self.known) > WORDS:
            for word in list(islice(self.known, WORDS // 2)):  # the older half
                del self.known[word]
        if new := list(set().union(*filter(None, split)).difference(self.known)):
            self._learn(new)
        return [self._library(t) if words is None else b"".join(map(self.known.__getitem__, words)) for t, words in zip(texts, split)]


_loaded: dict[str, WordIds] = {}


def ids_of(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
