"""Groups of spelling variants: words that differ by one inserted, deleted or replaced character.

Counting is plain Spark. Near words are found by Aho-Corasick halves. Cut a word w into two segments, the first of len(w) // 2
characters. One edit leaves one of them whole: a word v near w, of the same length or one character longer, begins with w's first
segment or ends in its second. (A shorter v finds w the other way round.) A segment with its side and its word's length is a key;
every word has two keys of its own length and two of the length below. Keys are dealt to shards by hash, a shard's automaton holds
all its segments, each word sent there is scanned once, and a hit counts where its offset is the side's, the lengths are compatible and
the edit distance of the two words is one. A pair is reported under the first segment alone where both are whole.

A segment that many words share (more than `HOT`) would make all pairs of its words, so what is left of these words is cut into
halves again, as often as needed: each round doubles the rows of such words and halves the length of what is left, down to one
character, where a group is bounded by the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import prepare, saved

#: The characters of a word.
WORD = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that may share a key before it is cut again, and rows of a shard.
HOT = 64
SHARD = 20_000
#: Characters between the parts of a key; a word that held them would only meet more words, whose distance is checked.
_END = "\x00"


def misspelt(word: Column, doc_id: Column, one_in: int) -> Column:
    """The word without one character, for about one of `one_in` pairs of document and word, by a checksum of both."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def count_words(docs: DataFrame, one_in: int = 199, least_length: int = 6, least_n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of whole texts with enough characters and occurrences. A null text has no words, a null id counts
    as an empty one, and repeated rows count each. Other columns are not read."""
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select(misspelt(F.col("run"), F.col("id"), one_in).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, parent, rest, own) with two keys each: `own` is the length of the shorter words' rest, and a row's rest has it or one more."""
    head = F.floor(F.col("own") / 2).cast("int")
    length = F.length("rest")
    tail = F.col("own") - head
    sides = F.array(
        F.struct(F.lit("P").alias("side"), F.substring("rest", F.lit(1), head).alias("segment"), F.substring(F.col("rest"), head + 1, length).alias("left"), tail.alias("next")),
        F.struct(F.lit("S").alias("side"), F.substring(F.col("rest"), length - tail + 1, tail).alias("segment"), F.substring(F.col("rest"), F.lit(1), length - tail).alias("left"), head.alias("next")),
    )
    keyed = rows.withColumn("k", F.explode(sides)).select("word", "n", "parent", "rest", "own", "k.*")
    return keyed.withColumn("key", F.concat_ws(_END, "parent", "own", "side", "segment"))


def within_one(a: str, b: str) -> bool:
    """Whether b, of the same length or one character longer, differs from a by exactly one edit."""
    if len(a) == len(b):
        at = next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), None)
        return at is not None and a[at + 1 :] == b[at + 1 :]
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at:] == b[at + 1 :]


def _scan(table: pa.Table) -> pa.Table:
    """Pairs (a, an, b, bn) of near words of one shard; a is the shorter, or the first of equal lengths."""
    automaton, owners, scanned = ahocorasick.Automaton(), {}, {}
    columns = (table[c].to_pylist() for c in ("word", "n", "parent", "rest", "own", "side", "segment"))
    for word, n, parent, rest, own, side, segment in zip(*columns, strict=True):
        if segment:
            automaton.add_word(segment, segment)
        if len(rest) == own:
            owners.setdefault((parent, own, side, segment), []).append((word, n, rest))
        scanned.setdefault((parent, rest), []).append((word, n, own, side, segment))
    automaton.make_automaton()
    out: list[tuple] = []
    for (parent, rest), rows in scanned.items():
        ends, hits = len(rest) - 1, {("P", ""), ("S", "")}
        if len(automaton):
            for end, segment in automaton.iter(rest):
                if end - len(segment) + 1 == 0:
                    hits.add(("P", segment))
                if end == ends:
                    hits.add(("S", segment))
        for word, n, own, side, segment in rows:
            if (side, segment) not in hits:
                continue
            head = rest[: own // 2]
            for a, an, left in owners.get((parent, own, side, segment), ()):
                if len(left) == len(rest) and a >= word or side == "S" and left.startswith(head):
                    continue
                if within_one(a, word):
                    out.append((a, an, word, n))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["a", "an", "b", "bn"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of near words of (word, n) once; words are distinct and not empty."""
    size = F.length("word")
    rows = words.select("word", "n", F.lit("").alias("parent"), F.col("word").alias("rest"), F.explode(F.array(size, size - 1)).alias("own")).where("own >= 1")
    settled, cut_again = None, False
    while True:
        keyed = saved(_keyed(rows))
        hot = keyed.where("next > 1").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select("key")
        hot = saved(hot)
        any_hot = bool(hot.take(1))
        small = keyed.join(hot, "key", "left_anti") if any_hot else keyed
        small = small.select("word", "n", "parent", "rest", "own", "side", "segment", "key")
        settled = small if settled is None else settled.unionByName(small)
        if not any_hot:
            break
        cut_again = True
        rows = keyed.join(hot, "key").select("word", "n", F.col("key").alias("parent"), F.col("left").alias("rest"), F.col("next").alias("own"))
    shards = max(1, -(-settled.count() // SHARD))
    settled = settled.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).drop("key")
    pairs = settled.groupBy("shard").applyInArrow(_scan, "a string, an long, b string, bn long")
    return pairs.distinct() if cut_again else pairs  # a pair may be under a segment that was cut again and under one that was not


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word with a form: chains are followed by doubling their steps. A form has more occurrences than its
    word, so chains end, and after log2 of the longest chain."""
    now = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = saved(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not step.where("moved").take(1):
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least `ratio` times the word's n;
    its root is the last of the words that forms lead to. Words are distinct; null and empty words go. An empty table gives no rows.
    """
    prepare(words.sparkSession)
    words = saved(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null and word <> ''"))
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), (-F.col("bn")).alias("less"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), (-F.col("an")).alias("less"), F.col("a").alias("near")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    found = saved(found)
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
