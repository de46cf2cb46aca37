import random
import re
import zlib
from collections import Counter

import duckdb
from compare import check
from llm.helpers import ODD, docs

from shoebox.llm import spelling
from shoebox.llm.spelling import near_words, spelling_variants, variant_groups


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_definition(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        fits = sorted((-words[v], v) for v in others if words[v] >= 2 * n)
        out[w] = [fits[0][1] if fits else None, w, n, len(others), -fits[0][0] if fits else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return sorted((w, *r) for w, r in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def texts(seed, words, letters="abÀ", size=(4, 8)):
    rng = random.Random(seed)
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(*size))) for _ in range(words)]
    often = [2 ** rng.randint(0, 6) for _ in some]
    return [" ".join(rng.choices(some, often, k=900)) for _ in range(6)]


def test_equals_comparing_all_words(spark):
    given = [*texts(1, 90), *texts(2, 60, "aB", (5, 7)), *texts(3, 20, "xyz", (3, 30))]
    want = by_definition(enumerate(given))
    assert len(want) > 100 and any(r[1] and r[2] != r[1] for r in want)  # chains of forms
    assert rows_of(spelling_variants(docs(spark, given))) == want
    assert rows_of(spelling_variants(docs(spark, given), hot=5)) == want  # crowded nodes apart


def test_words_longer_than_the_walk(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 6)
    given = [*texts(1, 60), *texts(3, 40, "xy", (6, 12))]
    want = by_definition(enumerate(given))
    assert any(len(r[0]) > 7 and r[4] for r in want) and rows_of(spelling_variants(docs(spark, given))) == want


def test_very_long_words(spark):
    long = ["x" * 900, "x" * 899, "x" * 400 + "y" + "x" * 499, "y" * 64, "y" * 65, "y" * 66, "z" * 3000]
    rows = [(w, 3 + i) for i, w in enumerate(long)]
    got = {(r.word, r.near) for r in near_words(spark.createDataFrame(rows, "word string, n bigint")).collect()}
    assert got == {(a, b) for a in long for b in long if near(a, b)} and len(got) == 10


def test_odd_rows_and_sql(spark):
    frame = docs(spark, [*ODD, *["Straße strasse ×÷abc ÷×abc", "words WORDS Words wordS wordés cafes cafés"] * 4])
    frame = frame.unionByName(frame.filter("doc_id > 12")).unionByName(frame.filter("doc_id = 13").selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars"))
    frame = frame.selectExpr("*", "1 n", "'x' word", "'y' form")
    got = rows_of(spelling_variants(frame))
    assert got == by_definition([(r.doc_id, r.text) for r in frame.collect()]) and got
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r.doc_id, r.text) for r in frame.collect()])
    assert check(con, spelling.check_sql(), spelling_variants(frame)) is None
    assert spelling_variants(frame.limit(0)).collect() == [] == spelling_variants(docs(spark, ["a b c", None])).collect()


def test_groups(spark):
    frame = spelling_variants(docs(spark, ["colour " * 8 + "color " * 3 + "colours " * 4 + "other " * 5]))
    got = {r.root: r for r in variant_groups(frame).collect()}
    assert sum(r.words for r in got.values()) == frame.count() and all(r.variants[0] == r.root for r in got.values())


def test_counts_are_passed_on_in_pieces(spark, monkeypatch):
    given = texts(5, 50)
    want = rows_of(spelling_variants(docs(spark, given)))
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    assert rows_of(spelling_variants(docs(spark, given))) == want
