"""Documents in revisions: their order, and what changed from one to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions.text import upper_each


def revision_key(c: Column) -> Column:
    """Sorts revision names: single letters first (A, B), then whole numbers by value (0, 1, 10), then others as text (1A, B2)."""
    name = upper_each(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    letter, number = name.rlike("^[A-Z]$"), name.rlike("^[0-9]+$")
    digits = F.regexp_replace(name, "^0+(?=.)", "")
    # Numbers of any length sort by their length and then as text.
    return F.struct(F.when(letter, 0).when(number, 1).otherwise(2).alias("kind"), F.when(number, F.length(digits)).otherwise(0).alias("size"), F.when(number, digits).otherwise(name).alias("name"))


def split_tags(*columns: Column) -> Column:
    """Distinct upper-case tags of one or more lists that are separated by commas, semicolons, slashes or blanks."""
    parts = F.split(upper_each(F.concat_ws(",", *columns)), r"[,\s;/]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def title_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def revision_timeline(df: DataFrame, doc: str, revision: str, tags: Sequence[str], status: str, title: str, tie: str) -> DataFrame:
    """One row for each revision of a document: its place, tags and words of the title that came and went since the one
    before, and a summary of it. Rows without a document are left out; ``tie`` orders rows of one revision."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = df.where(text(doc) != "").select(text(doc).alias("document"), text(revision).alias("revision"), revision_key(F.col(revision)).alias("_key"), F.col(tie).alias("_tie"), split_tags(*map(F.col, tags)).alias("_tags"), text(status).alias("status"), text(title).alias("_title"))
    line = W.partitionBy("document").orderBy("_key", "_tie")
    before = F.lag(F.struct("_tags", "status", "_title")).over(line)
    placed = rows.withColumns({"place": F.row_number().over(line), "_before": before})
    first = F.col("_before").isNull()
    none = F.array().cast("array<string>")
    fresh = lambda now, was: F.when(first, none).otherwise(F.array_except(now, was))
    words, old_words = title_words(F.col("_title")), title_words(F.col("_before._title"))
    out = placed.select(
        "document", "revision", "place", "status", "_title", "_before", F.size("_tags").alias("tag_count"),
        fresh(F.col("_tags"), F.col("_before._tags")).alias("added_tags"), fresh(F.col("_before._tags"), F.col("_tags")).alias("removed_tags"),
        fresh(words, old_words).alias("added_words"), fresh(old_words, words).alias("removed_words"),
    )
    changed = lambda now, was: ~first & (F.col(now) != "") & (F.col(was) != "") & (F.col(now) != F.col(was))
    added, removed = F.size("added_tags"), F.size("removed_tags")
    summary = F.concat_ws(
        "; ",
        F.when(added > 0, F.concat(F.lit("+"), added.cast("string"), F.when(added == 1, " new tag").otherwise(" new tags"))),
        F.when(removed > 0, F.concat(F.lit("-"), removed.cast("string"), F.lit(" removed"))),
        F.when(changed("status", "_before.status"), F.concat_ws(" ", F.lit("status"), "_before.status", F.lit("→"), "status")),
        F.when(changed("_title", "_before._title"), F.lit("title updated")),
    )
    return out.select("document", "revision", "place", "status", "tag_count", "added_tags", "removed_tags", "added_words", "removed_words", summary.alias("summary"))
