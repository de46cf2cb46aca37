import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from llm.helpers import ODD, docs
from tokenizers import Tokenizer

from shoebox.llm.packing import Piece, SumOfSquares, pack_documents

PATH = P.path("word_bpe_49k.json")


def check_pieces(pieces, texts, window=4096):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at <= window and at & (at - 1) == 0


@pytest.mark.parametrize("window, open_tokens", [(4096, 1 << 20), (64, 300)])
def test_every_id_once_and_no_padding(spark, window, open_tokens):
    rnd = random.Random(3)
    texts = ODD + [" ".join("".join(rnd.choice("etaoin.'É") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 400))) for _ in range(150)]
    frame = docs(spark, texts).repartition(3, "doc_id").selectExpr("*", "'x' start", "1 ids_crc32")
    check_pieces(pack_documents(frame, PATH, window, open_tokens=open_tokens).collect(), texts, window)


def test_empty_table(spark):
    assert pack_documents(docs(spark, ["a"]).limit(0), PATH).collect() == []


def test_level_choice_minimises_the_sum_of_squares():
    rnd = random.Random(4)
    packer = SumOfSquares(16, 10_000)
    for i in range(400):
        s = rnd.randint(1, 15)
        before = packer.counts.copy()
        packer.add(Piece(i, 0, s, bytes(4 * s)))

        def after(h):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + s < 16:
                n[h + s] += 1
            return int((n**2).sum())

        choices = [h for h in range(17 - s) if h == 0 or before[h]]
        assert int((packer.counts**2).sum()) == min(map(after, choices))
        assert all(len(level) == n for level, n in zip(packer.levels, packer.counts[:-1], strict=True))
