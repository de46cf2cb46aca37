import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from llm.helpers import DOC_SCHEMA, ODD, docs

from shoebox.llm import repeats
from shoebox.llm.common import table


def by_definition(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(r)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def compare(spark, texts, length, window, batches):
    frame = docs(spark, texts).selectExpr("*", "'x' row", "1 lo", "2 span", "3 places")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in repeats.remove_repeats(frame, length, window, batches).collect()}
    want = by_definition(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    return want


@pytest.mark.parametrize("length, window, batches", [(40, 17, 4), (30, 5, 3), (24, 20, 1)])
def test_equals_trying_all_starts(spark, length, window, batches):
    rnd = random.Random(length)
    prose = lambda n: "".join(rnd.choice("abcdeé \n") for _ in range(n))
    passages = [prose(rnd.randint(length - 3, 3 * length)) for _ in range(6)]
    texts = [prose(rnd.randint(0, 60)) + rnd.choice(passages) + prose(rnd.randint(0, 50)) + rnd.choice([*passages, ""]) for _ in range(60)]
    for base in list(texts[:12]):  # near copies: a character changed, cut, or moved into another document
        at = rnd.randrange(max(1, len(base)))
        texts += [base, base[:at] + "X" + base[at + 1 :], base[at:], prose(9) + base[: at + length] + prose(9)]
    texts += ["ab" * 90, "The " * 70 + prose(50), "z" * 300, "z" * length, "z" * (length - 1)] + [t for t in ODD if len(t or "") < 40_000]
    want = compare(spark, texts, length, window, batches)
    assert sum(w[1] for w in want) > 0


def test_production_lengths(spark):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    passage, exact = words(90), words(300)
    texts = [words(100) + passage + words(50) for _ in range(12)] + [exact, exact, words(200), None, "The " * 200]
    texts += [exact[:700] + "#" + exact[701:], exact[:399], passage[:400], passage[1:400]]
    want = compare(spark, texts, 400, repeats.WINDOW, 4)
    assert want[14][1] == 0 and want[12][1] == len(exact)


def test_every_start_has_one_entry():
    rnd = random.Random(5)
    for raw in (bytes(rnd.randrange(4) for _ in range(3000)), b"ab" * 500, bytes(400), bytes(rnd.randrange(256) for _ in range(400))):
        anchors, lo, hi = repeats.Anchors(400, 161).runs(np.frombuffer(raw, dtype=np.uint8))
        assert lo[0] == 0 and hi[-1] == len(raw) - 400 and (lo[1:] == hi[:-1] + 1).all()
        assert ((lo <= hi) & (hi <= anchors) & (anchors <= lo + 160)).all()


def test_repeated_rows_and_no_rows(spark):
    text = "".join(random.Random(1).choices("abcdef", k=500))
    frame = spark.createDataFrame([(1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text[::-1], "en", "s", 5)], DOC_SCHEMA)
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame).collect()) == [(0, 0, 0), (1, 500, 1), (1, 500, 1)]
    assert repeats.remove_repeats(frame.limit(0)).collect() == []


def test_on_the_table(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table(spark, SF, "documents")).collect()}
    want = by_definition([r.text for r in rows], 400)
    assert [got[r.doc_id] for r in rows] == [w[:4] for w in want]
