"""Spelling variants: words that are one edit apart, by merging light subtrees of a trie into heavy paths.

The trie of all words is a table with a row for each prefix; its heavy child is the one with the most
words below, and every other branch (a word that ends there counts as a branch) is light. A word
passes at most log2(words) light branches, so copying only light branches, with one character
skipped, replaced or put in, is small-to-large merging. Two words that are one edit apart part at
one node, where at most one of them goes on along the heavy path:

* a light word ``p c s`` with ``c`` skipped coincides with a word ``p s`` (in any branch but that of ``c``);
* a light word ``p s`` with the heavy character ``h`` put in coincides with a heavy word ``p h s``;
* a light word ``p c s`` with ``c`` replaced by ``h`` coincides with a heavy word ``p h s``;
* two light words ``p c s`` and ``p d s`` coincide in the merged light subtrees of ``p`` when their
  characters are skipped.

So each pair comes up once, and coinciding terminals are equi-joins of strings: no node, prefix or
subtree is held whole by a task. Words are compared as strings. A group of merged light words has one
word for each character of the alphabet at most; its members learn their number and best neighbour from
it, and never become pairs. Counts are summed map-side first, so a word that holds a third of all
occurrences is one row of each task.

Edge cases: a null text has no words; a null ``doc_id`` stands as an empty string before the colon; of
rows with equal ids each counts; very long texts are whole; words without near ones stay with null form,
themselves as root and ``n_near`` 0; ties between forms go to the smaller word in code-point order; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, table

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, RATIO, SLIP = 5, 3, 2, 97


def runs_of(docs: DataFrame, pattern: str = RUN, least_letters: int = 1) -> DataFrame:
    """(doc_id, run): the lower-cased runs of all texts that have the least number of code points."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(pattern), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("run")).filter(F.length("run") >= least_letters)


def slipped(doc_id: Column, run: Column, every: int = SLIP) -> Column:
    """``run``, with a code point left out of one in ``every`` by a checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of a table with a row for each occurrence of ``word``."""
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _tail(first: Column) -> Column:
    """``word`` from the 1-based place on."""
    return F.substring(F.col("word"), first, F.length("word") + 1)


def light_branches(words: DataFrame) -> DataFrame:
    """(word, n, p, c, h, s): the places where a word leaves the heavy path: prefix, own character (empty where the word ends), heavy character, rest."""
    i = F.col("i")
    paths = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i")).select("word", "n", F.substring(F.col("word"), F.lit(1), i).alias("p"), F.substring(F.col("word"), i + 1, F.lit(1)).alias("c"), _tail(i + 2).alias("s"))
    below = paths.filter("c != ''").groupBy("p", "c").agg(F.count(F.lit(1)).alias("words"))
    # a table of its own: the join below can then split short prefixes, which all words share
    heavy = materialize(below.groupBy("p").agg(F.max(F.struct("words", "c")).alias("most")).select("p", F.col("most.c").alias("h")), "spelling-heavy")
    return paths.join(heavy, "p").filter("c != h")


def coinciding(words: DataFrame) -> DataFrame:
    """(word, near, best): how many near words a word has by one way of merging, and the first of them as (-n, word)."""
    light = materialize(light_branches(words), "spelling-light")
    inner = F.col("c") != ""
    skipped = F.when(inner & ~F.startswith("s", "c"), F.concat("p", "s"))
    put_in = F.concat("p", "h", "c", "s")
    replaced = F.when(inner, F.concat("p", "h", "s"))
    tried = light.select("word", "n", F.explode(F.array_compact(F.array(skipped, put_in, replaced))).alias("other"))
    pairs = tried.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.array(F.struct(F.col("word"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("best")), F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word")).alias("best")))
    along = pairs.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")
    # as many members as characters at most
    merged = light.filter(inner).groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("g")).filter(F.size("g") > 1)
    beside = merged.select("g", F.explode("g").alias("x")).select("x.word", (F.size("g") - 1).cast("long").alias("near"), F.when(F.col("x") == F.col("g")[0], F.col("g")[1]).otherwise(F.col("g")[0]).alias("best"))
    return along.unionByName(beside)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by pointer jumping. A form is the more frequent word, so chains end; a round doubles what is followed."""
    held = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(held.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_scratch(held)
        held = longer
        if held.filter("moved").isEmpty():
            return held.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n) with distinct words.

    ``form`` is the near word of largest n (the smaller word of equals) if that is at least ``ratio`` times the word's; ``root`` ends the chain of forms.
    """
    words = materialize(words.select("word", "n"), "spelling-words")
    near = coinciding(words).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = -F.col("best.n")
    found = materialize(words.join(near, "word", "left").select("word", F.when(best >= ratio * F.col("n"), F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(best >= ratio * F.col("n"), best).alias("form_n")), "spelling-forms")
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_of(table(spark, sf_dir, "documents"), least_letters=LEAST_LETTERS)  # a slip makes no word longer
    return variants(count_words(runs.select(slipped(F.col("doc_id"), F.col("run")).alias("word"))))
