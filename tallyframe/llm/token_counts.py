"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved beforehand by encoding them. A text then splits into units
that the tokenizer never merges across: a unit found among those strings counts one, and only the rest is merged, each
distinct unit once. A text for which the split is not proved (runs of spaces, other white space, the tokenizer's own
space sign, characters that its normalizer may change) is encoded whole.

Defined cases: null text is empty and has 0 tokens; a text of spaces is encoded whole; repeated rows count each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, PieceCache, text_bytes

SPACE = "▁"
#: Characters that the normalizer may change, or white space other than spaces and line ends.
UNSAFE = re.compile("[^\n\x20-\x7e¡¿-ÿŒœ–—‘’“”]")


def unproved(text: str) -> bool:
    """Whether a text has anything but safe characters and words between single spaces and line ends."""
    return "  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or UNSAFE.search(text) is not None


def prove(processor) -> dict[str, int]:
    """Vocabulary strings that start a word and encode alone as exactly themselves, without the space sign: 1 each.
    Raises if a vocabulary string spans words or lines, as the split into units would then not be exact."""
    size = processor.get_piece_size()
    pieces = [processor.id_to_piece(i) for i in range(size) if not (processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i))]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
        raise ValueError("a vocabulary string spans words or lines")
    words = [p[1:] for p in pieces if p.startswith(SPACE) and p[1:] and SPACE not in p[1:] and not unproved(p[1:])]
    return {w: 1 for w, ids in zip(words, processor.encode(words, num_threads=1), strict=True) if len(ids) == 1 and processor.id_to_piece(ids[0]) == SPACE + w}


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = prove(self.sp)
        self.words = PieceCache(self._words)
        self.heads = PieceCache(self._heads)
        newline = self.sp.encode("\nx", out_type=str)
        #: Tokens before the first word of a line when a line end stands before it.
        self.lead = len(newline) - len([t for t in newline if t == "x"])
        self.lines_split = newline[-1] == "x" and self.lead == 2

    def _words(self, words: list[str]) -> list[int]:
        """Tokens of words that follow a space or start the text."""
        rest = [w for w in words if w not in self.whole]
        merged = dict(zip(rest, map(len, self.sp.encode(rest, num_threads=1)), strict=True))
        return [self.whole.get(w) or merged[w] for w in words]

    def _heads(self, words: list[str]) -> list[int]:
        """Tokens of words that follow a line end."""
        return [len(ids) - self.lead for ids in self.sp.encode(["\n" + w for w in words], num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        direct, split = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if unproved(t) or not self.lines_split:
                direct.append(i)
            else:
                first, *lines = t.split("\n")
                lines = [x.split(" ") for x in lines]
                split.append((i, list(itertools.chain(first.split(" "), *(x[1:] for x in lines))), [x[0] for x in lines]))
        for i, ids in zip(direct, self.sp.encode([texts[i] for i in direct], num_threads=1), strict=True):
            out[i] = len(ids)
        self.words.know(itertools.chain.from_iterable(w for _, w, _ in split))
        self.heads.know(itertools.chain.from_iterable(h for _, _, h in split))
        of, of_head = self.words.__getitem__, self.heads.__getitem__
        for i, words, heads in split:
            out[i] = sum(map(of, words)) + sum(map(of_head, heads)) + len(heads)
        return out


@functools.lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_bytes, n_tokens, over_limit; model_path is a sentencepiece model that all executors can open."""

    def run(batches):
        counter = _counter(model_path)
        for batch in batches:
            texts = Flat(batch.column("bytes"))
            for lo, hi in texts.runs(2 << 20):
                strings = [texts[i].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]
                tokens = counter.count(strings)
                yield pa.record_batch(
                    {
                        "id": batch.column("id").slice(lo, hi - lo),
                        "n_bytes": pa.array([int(texts.offsets[i + 1] - texts.offsets[i]) for i in range(lo, hi)], pa.int64()),
                        "n_tokens": pa.array(tokens, pa.int64()),
                        "over_limit": pa.array([n > limit for n in tokens]),
                    }
                )

    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("bytes"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
