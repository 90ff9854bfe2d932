"""Proper nouns without a tagger: the corpus itself tells which words are written with a capital inside sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleframe.functions import text

SENTENCE = r"[.!?\n]+"
#: A proper noun has more letters than this, and this share of its uses inside sentences has a capital.
SHORT, SHARE = 2, 0.5
_REFERENCE = r"(?s)<gdo char\d+[^>]*>(.*?)</gdo>"


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))


def _capital(w: Column) -> Column:
    return F.rlike(w, F.lit(r"^\p{Lu}"))


def capital_shares(stories: DataFrame) -> DataFrame:
    """word, uses, share: of each word, lower-cased, how often it begins with a capital where no sentence begins (story_id, text)."""
    sentences = F.transform(F.split(text.strip_story_tags(F.col("text")), SENTENCE), words)
    inner = F.flatten(F.transform(sentences, lambda w: F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))))
    each = stories.select(F.explode_outer(inner).alias("w")).where("w is not null")  # explode would find the words twice, to ask for texts without
    return each.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("uses"), F.avg(_capital(F.col("w")).cast("double")).alias("share"))


def proper_nouns(stories: DataFrame) -> DataFrame:
    """story_id, word, total, grounded, ungrounded: the proper nouns of each text, and how many no character reference names.

    A word is a proper noun if it begins with a capital, is longer than two letters, and at least half of its uses inside
    sentences, over all texts, have a capital; a word that only ever begins sentences is none.  A noun that any character
    reference of the story holds is grounded wherever it stands.  This stands in for a tagger and is an approximation of one.
    Only counts by story and word meet the table of words, which Spark broadcasts while it is small.
    """
    listed = stories.select("story_id", words(text.strip_story_tags(F.col("text"))).alias("all"), words(F.array_join(F.regexp_extract_all("text", F.lit(_REFERENCE), F.lit(1)), " ")).alias("held"))
    long = lambda c: F.filter(c, lambda w: (F.length(w) > SHORT) & _capital(w))
    listed = listed.select("story_id", long(F.col("all")).alias("all"), F.transform(long(F.col("held")), F.lower).alias("held"))
    each = listed.select("story_id", "held", F.explode_outer(F.transform("all", F.lower)).alias("word")).where("word is not null")
    each = each.groupBy("story_id", "word").agg(F.count("*").alias("total"), F.max(F.array_contains("held", F.col("word"))).alias("named"))
    found = each.join(capital_shares(stories).where(F.col("share") >= SHARE).select("word"), "word")
    grounded = F.when(F.col("named"), F.col("total")).otherwise(0)
    return found.select("story_id", "word", "total", grounded.alias("grounded"), (F.col("total") - grounded).alias("ungrounded"))
