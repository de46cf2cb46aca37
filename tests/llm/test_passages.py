import random
import re
from collections import Counter

import numpy as np
from conftest import SF
from llm.helpers import ODD, docs

import corpus_pipeline
from shoebox.llm import repeats


def by_definition(texts, words, length):
    raws = [(t or "").encode() for t in texts]
    split = [r.split() for r in raws]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    strings = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for t, r, w in zip(texts, raws, split, strict=True):
        at = [m.span() for m in re.finditer(rb"\S+", r)]
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone[at[i][0] : at[i + words - 1][1]] = True
        for i in range(len(r) - length + 1):
            if strings[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore") if gone.any() else t)
    return out


def prose(rnd, n):
    return [("é" if rnd.random() < 0.05 else "") + "".join(rnd.choice("etaoins") for _ in range(rnd.randint(2, 6))) for _ in range(n)]


def test_equals_trying_all_places(spark):
    rnd = random.Random(3)
    shared = [prose(rnd, rnd.randint(8, 40)) for _ in range(8)]
    texts = [rnd.choice([" ", "\n", "  "]).join(prose(rnd, rnd.randint(0, 30)) + rnd.choice(shared) + prose(rnd, rnd.randint(0, 30)) + rnd.choice(shared)[:9]) for _ in range(80)]
    texts += [t for t in ODD if len(t or "") < 20_000] + ["The " * 60, " ".join(shared[0]), " ".join(shared[1][1:])]
    got = {r.doc_id: r.text for r in repeats.without_repeats(docs(spark, texts), words=10).collect()}
    assert [got[i] for i in range(len(texts))] == by_definition(texts, 10, 400)


def test_the_stage_cuts_passages_of_51_to_65_words(spark):
    rnd = random.Random(4)
    passages = {n: prose(rnd, n) for n in (50, *range(51, 66, 2))}
    assert all(len(" ".join(p).encode()) < 400 for p in passages.values())
    around = [(n, prose(rnd, 40), prose(rnd, 30)) for n in passages for _ in range(2)]
    texts = [" ".join(a) + " " + (" " if i % 2 else "\n").join(passages[n]) + " " + " ".join(b) for i, (n, a, b) in enumerate(around)]
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs(spark, texts), SF).collect()}
    for i, (n, a, b) in enumerate(around):
        assert got[i].text.split() == (a + b if n > 50 else a + passages[n] + b) and got[i].n_chars == len(got[i].text), n


def test_white_space_between_passages_that_follow_each_other_stays(spark):
    rnd = random.Random(8)
    one, two = " ".join(prose(rnd, 12)), " ".join(prose(rnd, 12))
    texts = [f"{one} {two}", f"{one} and", f"so {two}"]
    got = {r.doc_id: r.text for r in repeats.without_repeats(docs(spark, texts), words=12).collect()}
    assert [got[i] for i in range(3)] == [" ", " and", "so "] == by_definition(texts, 12, 400)
