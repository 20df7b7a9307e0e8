import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tallyframe.llm.packing import make_patterns, pack


def test_patterns_hold_the_histogram():
    rng = random.Random(4)
    for size in (1, 7, 64, 300):
        hist = {n: rng.randrange(1, 50) for n in rng.sample(range(1, size + 1), min(size, 40))}
        got = defaultdict(int)
        for lengths, count in make_patterns(hist, size):
            assert sum(lengths) <= size and count > 0
            for n in lengths:
                got[n] += count
        assert got == hist
    assert make_patterns({}, 8) == []


def test_pieces(spark):
    rng = random.Random(1)
    rows = [(i * 11 % 997, None if i == 7 else " ".join(rng.choice(("Word", "of", "x!", "é1")) for _ in range(rng.choice((0, 3, rng.randrange(900), rng.randrange(900), rng.randrange(9000))))), "z") for i in range(300)]
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack(df, path).collect()
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r["id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["id"]]) and zlib.crc32(np.asarray(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"] > 0
        seen[r["id"]] += range(r["start"], r["start"] + r["length"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(len(x))) for d, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(map(len, ids.values()))
    assert len(sequences) * 2048 < 1.03 * total + 2048
    assert pack(df.limit(0), path).count() == 0
    again = pack(df, path, with_ids=True).filter("id = 11").orderBy("start").collect()
    assert [x for r in again for x in r["ids"]] == ids[11]
