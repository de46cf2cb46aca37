import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF
from llm.helpers import ODD, docs

from shoebox.llm import pii
from shoebox.llm.common import table


def by_definition(text):
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]

    def passes(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == 1:
            return all(int(p) <= 255 for p in found.split("."))
        if kind == 2:
            total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[::-1]))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if passes(k, m.group())]


def test_base_spans_are_the_patterns():
    rnd = random.Random(1)
    alphabets = ["ab.@-+%", "0123.", "0123456789 -", "+0123456789 ().-", "a1.@+ -(é😀\n"]
    for n in range(4000):
        text = "".join(rnd.choice(alphabets[n % 5]) for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(text) == by_definition(text), text
    assert pii.base_spans("001.002.3.0255 4539 1488 0343 6467") == by_definition("001.002.3.0255 4539 1488 0343 6467")


@pytest.mark.parametrize("text", ["a" * 200_000, "a@" * 50_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "+" + "1 " * 100_000, "." * 100_000 + "@"])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


def test_gradients():
    tagger, rng = pii.Tagger(), np.random.default_rng(0)
    ids, tags = rng.integers(0, 20, (3, 10)), np.array([[0, 1, 2, 2, 0, 0, 3, 4, 0, 0], [7, 8, 8, 0, 0, 1, 2, 0, 5, 6], [0] * 10])
    _, grads = tagger.loss(ids, tags)
    at = {"embed": (ids[0, 0], 1), "step": (0, 1), "start": (0,)}
    for name, w in tagger.w.items():
        i = at.get(name, tuple(s // 2 for s in w.shape))
        w[i] += 1e-5
        up, _ = tagger.loss(ids, tags)
        w[i] -= 2e-5
        down, _ = tagger.loss(ids, tags)
        w[i] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-4, name


def test_decoding_and_posteriors_by_trying_all_paths():
    from itertools import product

    tagger = pii.Tagger(3)
    e = np.random.default_rng(4).normal(0, 2, (1, 3, pii.TAGS))
    step, start = tagger._steps()
    paths = {p: start[p[0]] + sum(e[0, t, k] for t, k in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:], strict=False)) for p in product(range(pii.TAGS), repeat=3)}
    assert tuple(tagger.decode(e)[0]) == max(paths, key=paths.get)
    total = np.logaddexp.reduce(list(paths.values()))
    assert np.isclose(tagger.marginals(e)[3][0, 1, 2], sum(np.exp(v - total) for p, v in paths.items() if p[1] == 2))


def test_windows_cover_every_trigger():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice("abc 1@" if rnd.random() < 0.05 else "abc ") for _ in range(rnd.randint(0, 700)))
        starts = pii.windows(text)
        assert all(any(at <= i < at + pii.WIDTH for at in starts) for i, c in enumerate(text) if c in "1@")
        assert starts == sorted(set(starts))


def test_reconciled_is_the_best_choice():
    from itertools import combinations

    rnd = random.Random(3)
    for _ in range(60):
        spans = [pii.Found(rnd.randrange(2), s, s + rnd.randint(1, 9), rnd.random() + 0.01) for s in (rnd.randint(0, 20) for _ in range(7))]
        got = pii.reconciled(spans)
        assert all(a.end <= b.start for a, b in zip(got, got[1:], strict=False))
        unique = {}
        for f in spans:
            unique[f.kind, f.start, f.end] = unique.get((f.kind, f.start, f.end), 0) + f.score
        best = max(
            sum(unique[x] for x in c) for n in range(len(unique) + 1) for c in combinations(unique, n)
            if all(a[2] <= b[1] or b[2] <= a[1] for a, b in combinations(c, 2))
        )
        assert np.isclose(sum(unique[f.kind, f.start, f.end] for f in got), best)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


@pytest.mark.parametrize("source", ["odd", "table"])
def test_documents(spark, source):
    texts = ODD + ["x@y.zz 1.2.3.4 +1 (867) 555-2364"] if source == "odd" else [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    frame = docs(spark, texts).selectExpr("*", "'x' spans", "1 n_ip")
    rows = {r.doc_id: r for r in pii.find_personal_data(frame, per_kind=60, steps=30).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = by_definition(text or "")
        assert rows[i].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(filter(None, written(base).split(","))) <= set(rows[i].spans.split(","))


def test_tagger_learns_and_adds(spark):
    rnd = random.Random(4)
    fill = lambda: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(12))
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    kinds = [
        lambda: f"{fill()[:5].strip().replace(' ', '')}.{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
        lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{rnd.randrange(100)}",
    ]
    texts = [f"{fill()} {rnd.choice(kinds)()} {fill()}" for _ in range(400)]
    tagger = pii.learn(docs(spark, texts).select("text"), 100, 200)
    base = [pii.base_spans(t) for t in texts]
    kept = [pii.window_spans(tagger, [t[max(0, s - 30) : s + 60]])[0] for t, spans in zip(texts, base, strict=True) for _, s, _ in spans]
    assert np.mean([bool(k) for k in kept]) > 0.9
    loose = [f"{fill()} 1 ({digits(3)}) {digits(3)}-{digits(4)} {fill()}" for _ in range(50)]
    assert np.mean([bool(a) for a in pii.added_spans(tagger, loose, [[]] * 50)]) > 0.5
    assert not any(pii.added_spans(tagger, [fill() + " 12 " + fill() for _ in range(50)], [[]] * 50))


def test_masking(spark):
    assert pii.masked("a x@y.zz b +1 2", [(0, 2, 8), (3, 11, 15), (2, 12, 14)]) == "a <EMAIL> b <PHONE>"
    frame = docs(spark, ["mail x@y.zz now", None, "plain", "mail x@y.zz now"])
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_personal_data(frame, 20, 5).collect()}
    assert got == {0: ("mail <EMAIL> now", 16), 1: (None, 0), 2: ("plain", 5), 3: ("mail <EMAIL> now", 16)}
    assert pii.mask_personal_data(frame.limit(0)).collect() == [] and pii.find_personal_data(frame.limit(0)).collect() == []


def test_found_spans_stay_clear_of_every_base_span(monkeypatch):
    """An e-mail with six addresses in it: what a tagger says inside it is not added, however many base spans begin in between."""
    text = "write to 1.2.3.4-5.6.7.8-9.10.11.12-13.14.15.16-17.18.19.20-21.22.23.24-aaaa@mail.example.com or (x) at home dot org now"
    inside, beside = text.index("aaaa"), text.index("(x)")
    monkeypatch.setattr(pii, "window_spans", lambda tagger, parts, width: [[pii.Found(0, p.index("aaaa"), p.index("aaaa") + 4, 1.0)] if "aaaa" in p else [] for p in parts])
    monkeypatch.setattr(pii, "plausible", lambda kind, t: True)
    base = pii.base_spans(text)
    assert sum(k == 1 for k, _, _ in base) >= 5 and pii.added_spans(object(), [text], [base]) == [[]]
    monkeypatch.setattr(pii, "window_spans", lambda tagger, parts, width: [[pii.Found(0, p.index("(x)"), p.index("(x)") + 8, 1.0)] if "(x)" in p else [] for p in parts])
    assert pii.added_spans(object(), [text], [base]) == [[(0, beside, beside + 8)]] and inside < beside


def test_windows_widen_until_a_long_span_is_whole(monkeypatch):
    text = "a" * 300 + "9" * 5000 + "b" * 300

    def tag(tagger, parts, width):
        out = []
        for p in parts:
            at, n = p.find("9"), p.count("9")
            out.append([pii.Found(0, at, at + n, 1.0)] if n else [])
        return out

    monkeypatch.setattr(pii, "window_spans", tag)
    monkeypatch.setattr(pii, "plausible", lambda kind, t: True)
    assert pii.added_spans(object(), [text, ""], [[], []]) == [[(0, 300, 5300)], []]
