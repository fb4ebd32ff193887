"""Spelling variants: words that differ by one code point, by a rare-first prefix filter over positional bigrams.

Words and their numbers are counted by Spark, combined in each task before the shuffle.  Every word is the list of its
bigrams with their positions; bigrams are ordered by how many places of the vocabulary have them, the rarest first, equal
ones by their letters and then position.  One edit destroys two bigrams of a word at most and shifts those behind it
alike, so the first that it leaves alone is among the PREFIX = 3 rarest of both words: only those are joined.

A shared bigram says more than its name: the edit lies wholly right of it or wholly left.  If right, both words begin
alike up to the bigram, at the same position; if left, they end alike from the bigram on, at positions as far apart as
the lengths are.  Of the side with the edit, one of its two halves is left alone as well.  All this is part of the key of
the join, with the length of the shorter word; only a side of FREE letters is left free.  So a key fixes a bigram, its
place and at least half of the letters, no common bigram gathers a large part of the vocabulary, and no list of pairs is
ever made: the join itself verifies.  Keys go by a 64-bit hash; two that share one only meet in vain.

A word's form is the most frequent of the words near it, if it is FACTOR times as frequent; forms are followed to their
roots by doubling, in as many rounds as the logarithm of the longest chain, each with a checkpoint in the shared folder.

Cases: a null or empty text has no words; a null id counts as an empty one in the checksum that plants deletions; very
long words and texts are taken whole; of equally frequent near words the first by code points is the form; repeated rows
count again; other columns are ignored, whatever their names; an empty table, or one without words that are long and
frequent enough, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.texts import checkpoint, quoted

LETTERS = "[A-Za-zÀ-ÿ]"
#: Code points, and occurrences, that a word has at least.
LENGTH, OCCURRENCES = 7, 2
#: Rarest bigrams of a word that are joined: one edit destroys two.
PREFIX = 3
#: Letters on the side of the edit up to which the key of the join leaves them all free.
FREE = 2
#: How many times as frequent as a word its form is.
FACTOR = 10
#: A run of letters loses a code point where this divides its checksum.
PLANTED = 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of_letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, run): every maximal run of `length` letters or more of every text, A-Z lower-cased: shorter ones make no words."""
    found = F.explode(F.regexp_extract_all(F.col(quoted(text_col)), F.lit(f"{LETTERS}{{{length},}}"), F.lit(0)))
    return docs.select(F.col(quoted(id_col)).alias("id"), found.alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))


def planted(runs: DataFrame) -> DataFrame:
    """(word) of (id, run): of runs where PLANTED divides the checksum of `<id>:<run>`, one code point is left out."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % PLANTED == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def bigram_ranks(vocab: DataFrame) -> dict[str, int]:
    """Place of every bigram in the global order, the rarest first: of how many places of how many words have it.  An
    alphabet has a bounded number of bigrams: the words here are made of 90 letters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", k, F.lit(2)))
    count = vocab.where(F.length("word") > 1).select(F.explode(pairs).alias("b")).groupBy("b").count().collect()
    return {b: k for k, (_, b) in enumerate(sorted((r["count"], r["b"]) for r in count))}


def keys_of(word: str, rank: dict[str, int], own: bool) -> set[str]:
    """The keys under which a word meets others: as one of equal length or as the shorter one (own), or as the longer
    one of two, in which case it stands in with the keys of a word one shorter."""
    n = len(word)
    less = 0 if own else 1
    out = set()
    for p in sorted(range(n - 1), key=lambda p: (rank[word[p : p + 2]], p))[:PREFIX]:
        left, right = word[:p], word[p + 2 :]
        t = len(right) - less
        if t >= 0:  # the edit lies right of the bigram
            h = t // 2 if t > FREE else 0
            out.add(f"{n - less}>{p} {word[: p + 2 + h]}")
            if h:
                out.add(f"{n - less}>{p} {word[: p + 2]} {right[len(right) - (t - h) :]}")
        t = len(left) - less
        if t >= 0:  # left of it; positions are told from the end
            h = t // 2 if t > FREE else 0
            out.add(f"{n - less}<{n - p} {word[p:]} {left[:h]}")
            if h:
                out.add(f"{n - less}<{n - p} {word[len(left) - (t - h) :]}")
    return out


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, other, m): every word with every word that one insertion, deletion or replacement makes of it."""
    vocab = checkpoint(vocab.select("word", "n"))
    rank = vocab.sparkSession.sparkContext.broadcast(bigram_ranks(vocab))

    def keyed(own: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(k, at) for at, w in enumerate(b.column("word").to_pylist()) for k in sorted(keys_of(w, rank.value, own))]
                at = pa.array([a for _, a in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), b.column("word").take(at), b.column("n").take(at)], names=["key", "word", "n"])

        return vocab.mapInArrow(run, "key string, word string, n long").select(F.xxhash64("key").alias("key"), "word", "n")

    one = keyed(True)
    same, longer = (x.select("key", F.col("word").alias("other"), F.col("n").alias("m")) for x in (one, keyed(False)))
    # replacements differ in one code point of equally many; the longer word of two stands in with the length of the shorter
    met = one.join(same.unionByName(longer), "key")
    difference = F.length("other") - F.length("word")
    near = ((difference == 1) | ((difference == 0) & (F.col("word") < F.col("other")))) & (F.levenshtein("word", "other") == 1)
    found = checkpoint(met.where(near).select("word", "n", "other", "m").distinct())
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def forms(near: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, form_n, n_near) of every word that has near ones; form and form_n are null where none is frequent
    enough."""
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form")))
    out = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    return out.select("word", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"), "n_near")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms lead to.  Every form is more frequent than its word, so they end."""
    up = checkpoint(links.select("word", F.col("form").alias("root")))
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = checkpoint(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = after.select("word", "root")
        if after.where("moved").isEmpty():
            return up


def group_variants(vocab: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n)."""
    vocab = checkpoint(vocab)
    told = checkpoint(forms(near_words(vocab), factor))
    ends = roots(told.where("form IS NOT NULL"))
    out = vocab.join(told, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def variant_query(docs: DataFrame) -> DataFrame:
    return group_variants(vocabulary(planted(runs_of_letters(docs))))
