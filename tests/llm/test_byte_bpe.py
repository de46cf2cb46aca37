import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from llm.helpers import ODD, docs

from shoebox.llm.byte_bpe import Encoder, encode_documents, load_ranks

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def by_definition():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_as_the_library(spark, by_definition):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("aehint .\n'sé1") for _ in range(rnd.randint(0, 300))) for _ in range(60)] + ["<|endoftext|>", "a" * 5000 + "ab" * 3000]
    got = {r.doc_id: r for r in encode_documents(docs(spark, texts), PATH, P.PATTERN, with_ids=True).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = by_definition.encode_ordinary(text or "")
        assert list(struct.unpack(f"<{got[i].n_tokens}I", got[i].ids)) == ids
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_one_long_pre_token(by_definition):
    rnd = random.Random(6)
    encoder = Encoder(load_ranks(PATH))
    for n in (1, 2, 50, 20_000):
        piece = "".join(rnd.choice("etaoinshrdlu") for _ in range(n))
        assert encoder.encode(piece.encode()) == by_definition.encode_ordinary(piece)


def test_empty_table_and_clashing_columns(spark):
    frame = docs(spark, ["a b"]).selectExpr("*", "'x' ids", "7 n_tokens")
    assert encode_documents(frame, PATH, P.PATTERN).first().n_tokens == 2
    assert encode_documents(frame.limit(0), PATH, P.PATTERN).collect() == []
