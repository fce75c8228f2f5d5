"""Spelling variants: words one edit apart, and the frequent form that a rare one is a variant of.

1. Every occurrence of a word is counted by partial aggregation; only distinct words go on.
2. A word's mask has a bit for each letter that it holds an odd number of times. One edit touches at most two letters, so it
   flips at most two bits, and of three bands of the mask one at least stays equal. Words meet on an equal band.
3. The length filter is part of that key: a pair meets under the length of its shorter word, so lengths differ by at most one.
   As an edit also leaves the first or the second half of a word as it is, the key takes one of the halves: a band that many
   words share is thereby cut, at every size alike, and no pair is lost.
4. Whatever meets is verified by its edit distance inside the join, so that only near pairs leave it.
5. Forms are followed to the last one by pointer doubling over the words that have a form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import read_table, readable_text, settle

#: The mask has three bands of 20 bits; a letter's bit is its code point modulo 60, and every third bit belongs to a band,
#: so that frequent letters are dealt evenly.
BITS, BANDS = 60, 3
BAND = [sum(1 << b for b in range(band, BITS, BANDS)) for band in range(BANDS)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, EVERY, RATIO = 7, 2, 31, 10


def corpus_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, every: int = EVERY) -> DataFrame:
    """(word, n): occurrences of words of at least ``least_letters`` letters in all whole texts.

    A word is a maximal run of Latin letters, A-Z lower-cased. Of an occurrence whose crc32 of ``<id>:<word>`` is divisible
    by ``every``, one letter is left out, as a slip of the pen would (the place is that crc32 modulo the length). Null texts
    hold no words; a null id counts as empty.
    """
    text = F.translate(readable_text(text_col), UPPER, LOWER)
    # A run that is too short cannot become long enough; a match of this pattern is a maximal run.
    runs = F.regexp_extract_all(text, F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_letters},}}"), F.lit(0))
    each = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    slip = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (slip % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = each.select(F.when(slip % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))


def parity_mask(word: Column) -> Column:
    """Bit ``code point modulo BITS`` is set if the word has an odd number of letters of that bit."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, letter: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(letter) % BITS)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn), each pair once: words of ``words`` (word, n; every word once) whose edit distance is exactly one."""
    sized = words.select("word", "n", F.char_length("word").alias("size"), parity_mask(F.col("word")).alias("mask"))

    def keyed(shorter: bool) -> DataFrame:
        """Rows under the length of the shorter word of a pair: their own, or one less for the longer word."""
        least = F.col("size") if shorter else F.col("size") - 1
        half = F.floor(least / 2).cast("int")
        head, tail = F.substr("word", F.lit(1), half), F.substr("word", F.col("size") - (least - half) + 1)
        kinds = [F.struct(F.xxhash64(F.lit(band), F.lit(side), least, F.col("mask").bitwiseAND(F.lit(bits)), piece).alias("key")) for band, bits in enumerate(BAND) for side, piece in enumerate((head, tail))]
        return sized.where(least >= 0).select("word", "n", F.lit(shorter).alias("same"), F.inline(F.array(*kinds)))

    left = keyed(True).select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    right = keyed(True).unionByName(keyed(False)).select("key", F.col("word").alias("b"), F.col("n").alias("bn"), "same")
    near = (~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, (left["key"] == right["key"]) & near).select("a", "an", "b", "bn").distinct()


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) for ``links`` (word, form) without circles: the end of each chain, by pointer doubling."""
    chain = settle(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = settle(chain.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        chain = step.select("word", "root")
        if step.where("moved").isEmpty():
            return chain


def spelling_variants(words: DataFrame, word_col: str = "word", count_col: str = "n", ratio: int = RATIO) -> DataFrame:
    """One row per distinct word: word, form, root, n, n_near, form_n.

    ``form`` is the near word (one edit away) of largest count, ties by code points, if its count is at least ``ratio``
    (over 1) times the word's, else null; ``root`` is the last form reached from the word, itself without one. Counts of
    repeated words are added, null ones count as 0; null words are left out; an empty table gives an empty result; other
    columns are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, so that no chain of forms can be a circle")
    once = settle(
        words.select(F.make_valid_utf8(F.col(f"`{word_col}`").cast("string")).alias("word"), F.coalesce(F.col(f"`{count_col}`").cast("long"), F.lit(0)).alias("n"))
        .where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    )
    pairs = settle(near_pairs(once))
    both = pairs.select(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("other"), F.col("an").alias("m"))
    )
    best = F.min_by(F.struct("other", "m"), F.struct((-F.col("m")).alias("m"), "other"))
    known = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    enough = (F.col("best.m") >= ratio * F.col("n")) & (F.col("best.m") > 0)
    formed = settle(known.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, F.col("best.m")).alias("form_n")))
    roots = last_forms(formed.where("form is not null"))
    return once.join(formed, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(read_table(spark, sf_dir, "documents")).where(F.col("n") >= LEAST_COUNT))
