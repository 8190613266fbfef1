"""Token ids of many texts, part by part, with a vocabulary of a public byte-level BPE.

Such a tokenizer never joins what stands on both sides of a single space between
two visible characters: its pattern puts that space in front of the next word. So
a slice of texts is cut at its spaces at once in numpy, each distinct part is
encoded once, and the ids of all texts are gathered from those of the parts. A
text with runs of white space, spaces at its ends or wide spaces beyond ASCII is
encoded whole.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

from facetframe.llm.words import Words, mixed

#: Parts remembered by one task.
REMEMBERED = 600_000
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[0x20] = False
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
# The white space of Unicode beyond ASCII, in UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_STARTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def vocabulary_path(name: str) -> str:
    """A file's own path, or that of a public vocabulary of this name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteEncoder:
    """Ids of texts by a vocabulary of ranks, the same as in the tokenizer file of its name.

    Special tokens are ordinary text to the ranks; a text that holds one of them is
    given to the tokenizer file, which is loaded for the first such text.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        self.file, self.model = vocabulary_path(f"{vocabulary}.json"), None
        with open(self.file, encoding="utf-8") as lines:
            self.special = [t["content"].encode() for t in json.load(lines).get("added_tokens") or []]
        with open(vocabulary_path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def _whole(self, text: bytes) -> list[int]:
        plain = text.decode("utf-8")
        if any(s in text for s in self.special):
            if self.model is None:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                self.model = Tokenizer.from_file(self.file)
            return self.model.encode(plain, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(plain)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        words = Words(texts, _NOT_SPACE, lower=False, gap=b" ")
        whole = self._to_be_read_whole(texts, words)
        part = np.flatnonzero(~whole[words.text])
        leads = words.starts[part] == self._begins(texts)[words.text[part]]
        keys = np.where(leads, mixed(words.hashes[part]), words.hashes[part])
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self._forget()
        new = np.flatnonzero(~np.isin(distinct, self.hashes, assume_unique=True))
        self._learn(words, distinct[new], part[where[new]], leads[where[new]])
        known = np.searchsorted(self.hashes, distinct)
        size, at = self.size[known][which], self.at[known][which]
        per_text = np.bincount(words.text[part], weights=size, minlength=len(texts)).astype(np.int64)
        total = np.cumsum(size)
        inner = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size, size)
        ids = self.ids[np.repeat(at, size) + inner]
        if not whole.any():
            return ids, per_text
        bounds = np.concatenate(([0], np.cumsum(per_text)))
        pieces = []
        for t in range(len(texts)):
            if whole[t]:
                pieces.append(np.array(self._whole(texts[t]), dtype=np.uint32))
                per_text[t] = len(pieces[-1])
            else:
                pieces.append(ids[bounds[t] : bounds[t + 1]])
        return np.concatenate(pieces), per_text

    @staticmethod
    def _begins(texts: list[bytes]) -> np.ndarray:
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        return np.cumsum(lengths) - lengths

    def _to_be_read_whole(self, texts: list[bytes], words: Words) -> np.ndarray:
        begins = self._begins(texts)
        data = words.data
        space, white = data == 0x20, _WHITE[data]
        space[begins[1:] - 1] = white[begins[1:] - 1] = False
        space[-1:] = white[-1:] = False
        odd = np.flatnonzero((space[:-1] & white[1:]) | (white[:-1] & space[1:]))
        whole = np.zeros(len(texts), dtype=bool)
        whole[np.searchsorted(begins, odd, side="right") - 1] = True
        for t, text in enumerate(texts):
            if text[:1] == b" " or text[-1:] == b" " or any(s in text for s in self.special):
                whole[t] = True
            elif any(s in text for s in _WIDE_STARTS) and _WIDE.search(text):
                whole[t] = True
        return whole

    def _learn(self, words: Words, hashes: np.ndarray, part: np.ndarray, leads: np.ndarray) -> None:
        encode = self.ranks._core_bpe.encode_ordinary if hasattr(self.ranks, "_core_bpe") else self.ranks.encode_ordinary
        data = words.data.tobytes()
        found = [
            encode(data[s if lead else s - 1 : e].decode("utf-8"))
            for s, e, lead in zip(words.starts[part].tolist(), words.ends[part].tolist(), leads.tolist())
        ]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        order = np.argsort(np.concatenate((self.hashes, hashes)), kind="stable")
        self.hashes = np.concatenate((self.hashes, hashes))[order]
        self.at = np.concatenate((self.at, at))[order]
        self.size = np.concatenate((self.size, size))[order]
        self.ids = np.concatenate((self.ids, flat))
