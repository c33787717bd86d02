import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from crawlloom.llm import packing


def test_chunk_ids_are_the_tokenizers_own():
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "É", "Σ", "σ", "İ", "1", "23", ".", ",", "'s", "don't", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "漢字", "<|endoftext|>", "<|ENDOFTEXT|>", "&&&", "%%%", " ", "ß", "🙂", "word", "Ing", "the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(packing.ChunkTokenizer().ids(texts)) == want


def test_plan_uses_every_length_once_and_few_sequences():
    rng = random.Random(1)
    for capacity in (7, 50, 4096):
        for _ in range(20):
            counts: dict[int, int] = {}
            for _ in range(rng.randint(0, 400)):
                x = min(capacity, int(rng.expovariate(4 / capacity)) + 1)
                counts[x] = counts.get(x, 0) + rng.choice([1, 1, 5])
            used: dict[int, int] = {}
            bins = 0
            for pattern, m in packing.plan(counts, capacity):
                assert m > 0 and sum(x * k for x, k in pattern) <= capacity
                bins += m
                for x, k in pattern:
                    used[x] = used.get(x, 0) + k * m
            assert used == counts
            bound = -(-sum(x * n for x, n in counts.items()) // capacity)
            assert bins <= 1.25 * bound + 2


def test_pack(spark):
    long = "word " * 9000
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", None), (4, long, "y"), (5, "one two three", "y"), (5, "one two three", "y"), (None, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(df).toPandas()
    assert len(got) == 3 + 2 + 3 + 1
    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for doc, text, _ in rows[:4]:
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        part = got[got.doc_id == doc].sort_values("piece")
        assert part.length.sum() == len(ids)
        for _, r in part.iterrows():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[int(r.start) : int(r.start + r.length)], "<u4").tobytes())
    for _, part in got.groupby("sequence_id"):
        at = 0
        for _, r in part.sort_values("offset").iterrows():
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert packing.pack(df.limit(0)).count() == 0
