"""Encoding of texts with a `tokenizers` file, exactly as that library does it, in less time.

A byte-level file whose merges stand in the order of their ids, and that splits words as PATTERN does, holds the same rule
as ranked byte pairs: `tiktoken` then applies the file's vocabulary to texts of ordinary characters, several times faster.
Every other file or text goes through `tokenizers` itself, each distinct word once:

A text splits at single spaces and line ends into chunks that no pre-tokenizer of the two kinds supported joins again: one
that attaches a space to the word after it, or one that drops white space. A text for which that is not sure (longer runs
of white space, strings that look like special tokens) is encoded whole.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import json
import os
import re
from array import array

from tallyframe.llm.common import PieceCache, odd_space


#: Fixed value: how the byte-level files split words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose class the regex engines of both libraries might differ.
UNSURE = re.compile("[^\n\x20-\x7e¡-ɏ–—‘’“”…€]")


def ranked(tok):
    """The same rule in `tiktoken`, where the file allows it, or None."""
    import tiktoken

    rule = json.loads(tok.to_str())
    if rule["normalizer"] or rule["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return None
    vocab, merges = rule["model"]["vocab"], rule["model"]["merges"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if made != sorted(made) or rule["model"].get("end_of_word_suffix"):
        return None
    # byte-level files write bytes that have no printable sign of their own as the code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in rule["added_tokens"]}
    ranks = {bytes(byte[c] for c in s): i for s, i in vocab.items() if s not in special}
    made = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return made if alike(tok, made, ranks) else None


def alike(tok, made, ranks: dict[bytes, int]) -> bool:
    """Whether both libraries encode every string of the vocabulary alike, that is, merge it in the same way. Strings that
    are no UTF-8 by themselves occur inside of others only."""
    texts = []
    for b in ranks:
        with contextlib.suppress(UnicodeDecodeError):
            texts.append(b.decode())
    theirs = tok.encode_batch_fast(texts, add_special_tokens=False)
    return all(e.ids == made.encode_ordinary(t) for e, t in zip(theirs, texts, strict=True))


class Encoder:
    SIGNS = (".", ",", ";", ":", "!", "?")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.ranked = ranked(self.tok)
        #: Whether white space is dropped; otherwise a space belongs to the word after it.
        self.drops = not self._raw([" "])[0]
        if not self.drops and self._raw(["a b\nc"])[0] != b"".join(self._raw(["a", " b", "\n", "c"])):
            raise ValueError("this tokenizer joins words over spaces or line ends")
        self.after_space = PieceCache(lambda words: self._raw([" " + w for w in words]), 500_000)
        self.first = PieceCache(self._stems if self.drops else self._raw, 600_000 if self.drops else 100_000)
        self.newline = self._raw(["\n"])[0]
        #: Lower case first, where that is what the file does anyway.
        self.lowers = self.drops and self._raw(["ABÀ"]) == self._raw(["abà"])
        self.stems_split = self.drops and self._raw(["ab."])[0] == b"".join(self._raw(["ab", "."]))

    def _raw(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, words: list[str]) -> list[bytes]:
        """Words, and words with one sign after them: a letter run and the sign are separate to the file."""
        if not self.stems_split:
            return self._raw(words)
        parted = [(w[:-1], w[-1]) if w[-1:] in self.SIGNS and w[:-1].isalpha() else (w, "") for w in words]
        known = self.first
        new = [w for w in {*(stem for stem, _ in parted), *self.SIGNS} if w not in known]
        values = dict(zip(new, self._raw(new), strict=True))
        of = lambda w: values[w] if w in values else known[w]
        return [of(stem) + of(sign) if sign else of(stem) for stem, sign in parted]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        direct, split = [], []
        if self.ranked:
            for i, t in enumerate(texts):
                if "<|" in t or UNSURE.search(t):
                    direct.append(i)
                else:
                    out[i] = array("I", self.ranked.encode_ordinary(t)).tobytes()
            texts = [texts[i] for i in direct]
            for i, ids in zip(direct, self._words(texts), strict=True):
                out[i] = ids
            return out
        return self._words(texts)

    def _words(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        direct, split = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if odd_space(t):
                direct.append(i)
            elif self.drops:
                if self.lowers and (t.isascii() or "İ" not in t and not UNSURE.search(t)):
                    t = t.lower()
                split.append((i, t.replace("\n", " ").split(" ")))
            else:
                split.append((i, [line.split(" ") for line in t.split("\n")]))
        for i, ids in zip(direct, self._raw([texts[i] for i in direct]), strict=True):
            out[i] = ids
        of = self.first.__getitem__
        if self.drops:
            self.first.know(itertools.chain.from_iterable(words for _, words in split))
            for i, words in split:
                out[i] = b"".join(map(of, words))
            return out
        self.first.know(line[0] for _, lines in split for line in lines)
        self.after_space.know(itertools.chain.from_iterable(line[1:] for _, lines in split for line in lines))
        then = self.after_space.__getitem__
        for i, lines in split:
            out[i] = self.newline.join([of(line[0]) + b"".join(map(then, line[1:])) for line in lines])
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
