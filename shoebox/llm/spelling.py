"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie held as a table.

The trie is an edge table: a node is a prefix, its row lists the letters that go on from it and, if the prefix is itself a word, how
often that occurs. A state (text, position, node, edits) says that the first ``position`` letters of a word lead to a node
with that many edits. Each level joins all states with the edge table on the node: a state without an edit goes on along its own
letter, and by one edit to every other child (a replaced letter, or one that the node's words have more); a state with an edit may
only go on by its next letter. A state at the end of its word on a node that is a word has found a neighbour.

* One edit leaves one half of a word whole. So every word also stands in the trie reversed, behind a mark, and both start
  in their middle: edits are tried only where the trie is deep and a node has few children.
* Being near is symmetric: a state looks for the longer word, or for the later letter, and the pair is mirrored. An inserted
  letter goes behind a run of its like, and a reversed pair counts only if its edit lies in the first half: no pair is found twice.
* A child's row tells which letters may follow it, so most dead ends are seen one level ahead.
* A node that many words pass is joined apart: such nodes are few by definition and are broadcast.
* Walking is for words of up to ``LONG`` letters, so its levels are bounded. Pairs of longer words are found exactly by their
  texts without one letter (``long_pairs``), whose keys are rolling hashes; every such pair is compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.common import map_arrow, materialize
from shoebox.llm.sql_parts import CRC_TABLE, crc32_of
from shoebox.session import materialize_counted

LETTERS, FEWEST = 5, 3  # code points and occurrences that make a word
DROP_EVERY = 97
TIMES = 2  # a form occurs at least so many times as often
LONG = 64
MARK = "-"  # before reversed words; no letter
END_BIT = 60
HELD_WORDS = 400_000  # counts a task holds before it passes them on
HOT, HOT_SHARE = 100_000, 2000  # a node is joined apart above this many texts and above this share of all; so at most HOT_SHARE a level
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003

_RUN = re.compile("[a-zÀ-ÿ]+")


def count_words(docs: DataFrame, letters: int = LETTERS, fewest: int = FEWEST) -> DataFrame:
    """(word, n) over the whole texts of ``docs`` (doc_id, text), after the letters that the checksum drops."""

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        held: Counter[str] = Counter()

        def take() -> pa.Table:
            kept = {w: n for w, n in held.items() if len(w) >= letters}
            held.clear()
            return pa.table({"word": pa.array(kept.keys(), "string"), "n": pa.array(kept.values(), "int64")})

        for rows in slices:
            for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                lower = (text or "").encode("utf-8", "replace").lower().decode()  # of bytes: A-Z only
                for word, n in Counter(_RUN.findall(lower)).items():
                    h = zlib.crc32(word.encode(), head)
                    if not h % DROP_EVERY:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield take()
        yield take()

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def both_ways(words: DataFrame) -> DataFrame:
    """(text, n, size, low, high): every word and its mirror behind the mark. Edits are tried from position ``high`` on; a
    neighbour may have its first edit at ``low``.
    """
    size = F.length("word")
    ahead = words.select(F.col("word").alias("text"), "n", size.alias("size"), F.floor((size - 1) / 2).alias("low"), F.floor(size / 2).alias("high"))
    back = words.select(F.concat(F.lit(MARK), F.reverse("word")).alias("text"), "n", size.alias("size"), (F.floor(size / 2) + 1).alias("low"), (F.ceil(size / 2) + 1).alias("high"))
    return ahead.unionByName(back).withColumns({c: F.col(c).cast("int") for c in ("low", "high")})


def letter_bit(letter) -> Column:
    """A letter's place in a mask of 64; letters may share one. The empty string stands for the end of a word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.when(letter == "", END_BIT).otherwise(F.ascii(letter) % 64))


def edge_table(texts: DataFrame) -> DataFrame:
    """(node, children, n, below): the deep half of the trie. ``n`` is null where the node is no word; a child is a letter with the mask of
    what may follow it.
    """
    steps = texts.select("text", "n", F.explode(F.sequence("low", F.length("text"))).alias("at"))
    letter = F.substring("text", F.col("at") + 1, F.lit(1))
    steps = steps.select(F.substring("text", F.lit(1), F.col("at")).alias("node"), letter_bit(letter).alias("bit"), F.when(F.col("at") == F.length("text"), F.col("n")).alias("n"))
    nodes = steps.groupBy("node").agg(F.bit_or("bit").alias("mask"), F.max("n").alias("n"), F.count(F.lit(1)).alias("below"))
    child = F.struct(F.right("node", F.lit(1)).alias("letter"), "mask")
    rows = F.array(
        F.struct("node", "n", "below", F.lit(None).cast("struct<letter:string,mask:bigint>").alias("child")),
        F.struct(F.substring("node", F.lit(1), F.length("node") - 1).alias("node"), F.lit(None).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("below"), child.alias("child")),
    )
    rows = nodes.select(F.explode(rows).alias("row")).select("row.*")
    # a node has at most as many children as there are letters
    return rows.groupBy("node").agg(F.collect_list("child").alias("children"), F.max("n").alias("n"), F.max("below").alias("below"))


class Trie:
    """The edge table, written, with its crowded nodes (and their children, which edits lead to) apart."""

    def __init__(self, texts: DataFrame, hot: int = HOT):
        self.nodes, seen = materialize_counted(edge_table(texts), "llm-spelling-edges", steps=F.sum("below"))
        bound = max(hot, (seen["steps"] or 0) // HOT_SHARE)
        crowded, seen = materialize_counted(self.nodes.filter(F.col("below") > bound).select("node"), "llm-spelling-crowded", n=F.count(F.lit(1)))
        self.hot = None
        if seen["n"]:
            own = self.nodes.join(F.broadcast(crowded), "node", "left_semi")
            child = self.nodes.join(F.broadcast(crowded.withColumnRenamed("node", "parent")), F.expr("substring(node, 1, length(node) - 1) = parent"), "left_semi")
            self.hot = materialize(own.unionByName(child).dropDuplicates(["node"]), "spelling-hot")

    def at(self, states: DataFrame) -> DataFrame:
        """``states`` with the children and the count of their nodes."""
        nodes = self.nodes.select("node", "children", F.col("n").alias("found_n"))
        if self.hot is None:
            return states.join(nodes, "node")
        hot = self.hot.select("node", "children", F.col("n").alias("found_n"))
        keys = F.broadcast(hot.select("node"))
        return states.join(F.broadcast(hot), "node").unionByName(states.join(keys, "node", "left_anti").join(nodes.join(keys, "node", "left_anti"), "node"))


def advance(met: DataFrame) -> DataFrame:
    """The states of the next level; one with two edits is a neighbour found, and ``near_n`` its count. A state with an edit is made only
    where the child's mask has what must follow.
    """
    node, pos, letter = F.col("node"), F.col("pos"), F.col("letter")
    here, behind = (letter_bit(F.substring("text", pos + i, F.lit(1))) for i in (1, 2))

    def state(pos, to, edits, near_n=None):
        near_n = F.lit(None).cast("bigint") if near_n is None else near_n
        return F.struct(pos.cast("int").alias("pos"), to.alias("node"), F.lit(edits).alias("edits"), near_n.alias("near_n"))

    def leads(c, bit):
        return c["mask"].bitwiseAND(bit) != 0

    none = F.slice(F.array(state(F.lit(0), F.lit(""), 0)), 1, 0)
    own = F.array(state(pos + 1, F.concat(node, letter), 0))
    inserted = F.transform(F.filter("children", lambda c: (c["letter"] != letter) & leads(c, here)), lambda c: state(pos, F.concat(node, c["letter"]), 1))
    replaced = F.transform(F.filter("children", lambda c: (c["letter"] > letter) & leads(c, behind)), lambda c: state(pos + 1, F.concat(node, c["letter"]), 1))
    free = F.when(letter == "", inserted).otherwise(F.concat(own, inserted, replaced))
    ended = F.when(F.col("found_n").isNotNull(), F.array(state(pos, node, 2, F.col("found_n")))).otherwise(none)
    on = F.when(F.exists("children", lambda c: (c["letter"] == letter) & leads(c, behind)), F.array(state(pos + 1, F.concat(node, letter), 1))).otherwise(none)
    after = F.when(F.col("edits") == 0, free).when(letter == "", ended).otherwise(on)
    met = met.withColumn("letter", F.substring("text", F.col("pos") + 1, F.lit(1)))
    return met.select("text", "n", F.explode(after).alias("to")).select("text", "n", "to.*")


def trie_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, near, near_n): each pair of near words once, the shorter of which has at most ``LONG`` letters."""
    texts = materialize(both_ways(words.filter(F.length("word") <= LONG + 1)), "spelling-texts")
    trie = Trie(texts, hot)
    states = texts.filter(F.col("size") <= LONG).select("text", "n", F.col("high").alias("pos"), F.substring("text", F.lit(1), F.col("high")).alias("node"), F.lit(0).alias("edits"))
    found = [texts.limit(0).select("text", "n", F.col("text").alias("near"), F.col("n").alias("near_n"))]
    more = True
    while more:
        level, seen = materialize_counted(advance(trie.at(states)), "llm-spelling-level", found=F.count_if(F.col("edits") == 2), more=F.count_if(F.col("edits") < 2))
        more = seen["more"]
        if seen["found"]:
            found.append(level.filter("edits = 2").select("text", "n", F.col("node").alias("near"), "near_n"))
        states = level.filter("edits < 2").drop("near_n")
    pairs = reduce(DataFrame.unionByName, found)
    back = F.col("text").startswith(MARK)
    plain = lambda c: F.when(back, F.reverse(F.substring(c, F.lit(2), F.length(c)))).otherwise(F.col(c))
    pairs = pairs.select(back.alias("back"), plain("text").alias("word"), "n", plain("near").alias("near"), "near_n")
    half = F.floor(F.length("word") / 2).cast("int")
    return pairs.filter(~F.col("back") | (F.substring("word", F.lit(1), half) != F.substring("near", F.lit(1), half))).drop("back")


def _without_one(word: str) -> tuple[int, list[int]]:
    """The rolling hash of a text, and of the text without its i-th letter for each i."""
    n = len(word)
    head, power = [0] * (n + 1), [1] * (n + 1)
    for i, c in enumerate(word):
        head[i + 1] = (head[i] * _BASE + ord(c)) % _MODULUS
        power[i + 1] = power[i] * _BASE % _MODULUS
    tail = lambda i: head[n] - head[i + 1] * power[n - i - 1]
    return head[n], [(head[i] * power[n - i - 1] + tail(i)) % _MODULUS for i in range(n)]


def long_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of near words once, both longer than ``LONG``.

    A replaced letter leaves equal rests at the same place; an inserted one leaves the shorter word. Only pairs with such an
    equal key meet, so what is compared is what is found, but for chance.
    """

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            for word, own in zip(rows["word"].to_pylist(), rows["own"].to_pylist(), strict=True):
                whole, rests = _without_one(word)
                n, last = len(word), len(word) - 1
                kept = [i for i in range(n) if i == last or word[i] != word[i + 1]]
                at, size = [*range(n), *([-1] * len(kept)), -1], [n] * n + [n - 1] * len(kept) + [n]
                kind, key = [0] * n + [1] * len(kept) + [2], [*rests, *[rests[i] for i in kept], whole]
                yield pa.table({"own": pa.array([own] * len(at), "int64"), "kind": pa.array(kind, "int8"), "at": pa.array(at, "int32"), "size": pa.array(size, "int32"), "key": pa.array(key, "int64")})

    long = materialize(words.filter(F.length("word") > LONG).withColumn("own", F.xxhash64("word")), "spelling-long")
    keys = materialize(map_arrow(long.select("word", "own"), run, "own bigint, kind byte, at int, size int, key bigint"), "spelling-long-keys")
    on, other = ["at", "size", "key"], keys.select("at", "size", "key", F.col("kind").alias("other_kind"), F.col("own").alias("other"))
    met = keys.join(other, on).filter("(kind = 0 and other_kind = 0 and own < other) or (kind = 2 and other_kind = 1)").select("own", "other").distinct()
    met = met.join(long, "own").join(long.select(F.col("own").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n")), "other")
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, near, near_n) for ``words`` (word, n), in both directions: exactly one code point inserted, deleted or replaced."""
    pairs = materialize(trie_pairs(words, hot).unionByName(long_pairs(words)), "spelling-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form): the end of the chain of forms. Chains double their reach each round; they
    are short, as counts at least double along them.
    """
    reach = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reach, seen = materialize_counted(
            reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("_on")), "llm-spelling-roots", on=F.count_if("_on")
        )
        reach = reach.drop("_on")
        if not seen["on"]:
            return reach


def spelling_variants(docs: DataFrame, letters: int = LETTERS, fewest: int = FEWEST, times: int = TIMES, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the whole texts of ``docs`` (doc_id, text).

    Words are the runs of letters (A-Z lower-cased) with at least ``letters`` code points and ``fewest`` occurrences, after the
    checksum of doc_id and run has dropped a letter here and there. A word's form is its near word of largest n (ties: the first in code-point
    order) that occurs ``times`` as often or more. A null text has no words; a null doc_id counts as an empty string. Repeated rows
    count as often as they come; an empty table, or one without words, gives no rows; other columns are ignored.
    """
    words = materialize(count_words(docs, letters, fewest), "spelling-words")
    form = F.min(F.when(F.col("near_n") >= times * F.col("n"), F.struct((-F.col("near_n")).alias("less"), "near")))
    near = materialize(near_words(words, hot).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), form.alias("form")), "spelling-near")
    near = near.select("word", "n_near", F.col("form.near").alias("form"), (-F.col("form.less")).alias("form_n"))
    ends = roots(near.filter("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def variant_groups(variants: DataFrame) -> DataFrame:
    """(root, n, words, variants): per root how often its words occur together, how many they are, and the 20 most frequent of them."""
    best = Window.partitionBy("root").orderBy(F.desc("n"), "word")
    top = variants.withColumn("_rank", F.row_number().over(best)).filter("_rank <= 20").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("_rank", "word"))).alias("top"))
    sizes = variants.groupBy("root").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    return sizes.join(top, "root").select("root", "n", "words", F.col("top.word").alias("variants"))


def check_sql(letters: int = LETTERS, fewest: int = FEWEST, times: int = TIMES) -> str:
    """The same for DuckDB: pairs of words with an equal text left by dropping one letter, then a recursion along the forms."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        with recursive {CRC_TABLE},
        runs as (
            select coalesce(doc_id::varchar, '') doc, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-zÀ-ÿ]+')) run from documents),
        sums as (select doc, run, count(*) n, {crc32_of("encode(doc || ':' || run)")} h from (select doc, run, t from runs cross join crc) group by doc, run, t),
        kept as (
            select case when h % {DROP_EVERY} = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end word, n
            from sums),
        words as (select word, sum(n)::bigint n from kept where length(word) >= {letters} group by word having sum(n) >= {fewest}),
        cut as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) rest from words, unnest(range(length(word))) _(i)),
        pairs as (
            select distinct a.word, a.n, b.word near, b.n near_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
            union select a.word, a.n, b.word, b.n from words a join cut b on a.word = b.rest
            union select b.word, b.n, a.word, a.n from words a join cut b on a.word = b.rest),
        counted as (select word, n, count(*) n_near from pairs group by all),
        best as (select word, near form, near_n form_n from pairs where near_n >= {times} * n qualify row_number() over (partition by word order by near_n desc, near) = 1),
        chain as (
            select word, form as root, 1 steps from best
            union all select chain.word, best.form, steps + 1 from chain join best on best.word = chain.root),
        ends as (select word, arg_max(root, steps) root from chain group by word)
        select word, form, coalesce(root, word) root, words.n n, coalesce(n_near, 0)::bigint n_near, form_n
        from words left join (select word, n_near from counted) using (word) left join best using (word) left join ends using (word)"""
