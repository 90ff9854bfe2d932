"""How phases of stories, and characters in them, are spoken of."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleframe.functions import text
from taleframe.functions.valence import Words, compound

#: A lexicon (a word and a number) is sent to every task; a larger one is refused.
LEXICON_ROWS = 200_000
#: Fixed value: characters before and after the start of a reference.
AROUND = 100
_REFERENCE = re.compile(r"<gdo char(\d+)[^>]*>.*?</gdo>", re.DOTALL)
#: ``text.strip_story_tags`` for a text in a task.
_IMAGE_TAG, _TAG, _BLANK = re.compile(r"<gdi image[0-9]+>|</gdi>"), re.compile(r"<gd[oal][^>]*>|</gd[oal]>"), re.compile(r"\n{3,}")
#: Texts of a reference's length that a task remembers the valence of.
HELD = 1 << 16
OVERALL = "overall"


def _lexicon(rows: DataFrame) -> dict[str, float]:
    """word to valence of ``rows``; at most LEXICON_ROWS words, the last valence of repeated ones by value."""
    found = rows.where("word is not null and valence is not null").groupBy(F.lower("word").alias("word")).agg(F.max("valence").cast("double").alias("valence")).limit(LEXICON_ROWS + 1).collect()
    if len(found) > LEXICON_ROWS:
        raise ValueError(f"a lexicon has at most {LEXICON_ROWS} words")
    return {r["word"]: r["valence"] for r in found}


def valence(c: Column, lexicon: DataFrame) -> Column:
    """The compound valence of a text under ``lexicon`` (word, valence); null for null."""
    held = lexicon.sparkSession.sparkContext.broadcast(_lexicon(lexicon))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        words = Words(held.value)
        return texts.map(lambda t: None if t is None else compound(t, words)).astype("float64")

    return score(c)


def _bare(t: str) -> str:
    if "<gdi" in t or "</gdi" in t:
        t = _IMAGE_TAG.sub("", t)
    if "<" in t:
        t = _TAG.sub("", t)
    return (_BLANK.sub("\n\n", t) if "\n\n\n" in t else t).strip(text.WHITE)


def _around(t: str) -> Iterator[tuple[str, str]]:
    """Number and surroundings of each reference to a character."""
    return ((m[1], t[max(0, m.start() - AROUND) : m.start() + AROUND]) for m in _REFERENCE.finditer(t))


def feelings(phases: DataFrame, lexicon: DataFrame) -> DataFrame:
    """narrative_phase, who, v: the valence of each text of ``phases`` as a whole, and the mean one of each character over its references there.

    Tags do not count.  A text goes to a task once, with all that is judged in it; short texts, such as what stands around
    references, repeat, so a task remembers the last HELD of them.
    """
    held = lexicon.sparkSession.sparkContext.broadcast(_lexicon(lexicon))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(held.value)
        near = lru_cache(maxsize=HELD)(lambda t: compound(_bare(t), words))
        for b in batches:
            at, who, v = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                if t is None:
                    continue
                by: dict[str, list[float]] = {OVERALL: [near(t) if len(t) <= 2 * AROUND else compound(_bare(t), words)]}
                for name, said in _around(t):
                    by.setdefault(name, []).append(near(said))
                at += [i] * len(by)
                who += by
                v += [x[0] if len(x) == 1 else sum(x) / len(x) for x in by.values()]
            phase = b.column("narrative_phase").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([phase, pa.array(who, pa.string()), pa.array(v, pa.float64())], ["narrative_phase", "who", "v"])

    return phases.select("narrative_phase", "text").mapInArrow(judged, "narrative_phase string, who string, v double")


def references(c: Column) -> Column:
    """Characters of a text by number (who), each with what stands around the start of its reference (text); tags may be cut."""

    @F.pandas_udf("array<struct<who:string,text:string>>")
    def found(texts: pd.Series) -> pd.Series:
        around = lambda t: [{"who": who, "text": near} for who, near in _around(t)]
        return texts.map(lambda t: [] if t is None else around(t))

    return found(c)


def phase_texts(phases: DataFrame, images: DataFrame) -> DataFrame:
    """story_id, narrative_phase, text: texts of the images that a phase lists, in that order, repeated ones too.

    ``phases`` has story_id, narrative_phase, images and place; of a phase's rows in a story the last place counts.  Phases and
    images meet by story only, so rows that are dealt by story already are not dealt again.
    """
    rows = phases.where("place is not null").groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("narrative_phase", "place", "images"))).alias("rows"))
    last = lambda p, i: ~F.coalesce(F.try_element_at("rows", i + 2)["narrative_phase"].eqNullSafe(p["narrative_phase"]) & (i + 1 < F.size("rows")), F.lit(False))
    number = lambda p: F.struct(p["narrative_phase"].alias("narrative_phase"), text.listed_images(p["images"]).alias("numbers"))
    listed = rows.select("story_id", F.transform(F.filter("rows", last), number).alias("phases"))
    shown = images.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("image_number", "text"))).alias("shown"))
    of = lambda n: F.transform(F.filter("shown", lambda i: i["image_number"] == n), lambda i: F.concat(i["text"], F.lit(" ")))
    whole = lambda p: F.struct(p["narrative_phase"].alias("narrative_phase"), F.array_join(F.flatten(F.transform(p["numbers"], of)), "").alias("text"))
    return listed.join(shown, "story_id").select("story_id", F.inline(F.transform("phases", whole))).where("text <> ''")


def phase_sentiment(phases: DataFrame, images: DataFrame, lexicon: DataFrame) -> DataFrame:
    """place, narrative_phase, who, sentiment, stories: means over stories, of a phase as a whole and of each character in it.

    A character's figure in a story is the mean over its references in the phase, each judged by the characters around it;
    characters go by their number across stories.  Every phase has an overall row, 0 where no story has it.
    """
    held = phase_texts(phases, images)
    means = feelings(held, lexicon).groupBy("narrative_phase", "who").agg(F.avg("v").alias("sentiment"), F.count("*").alias("stories"))
    order = phases.sparkSession.createDataFrame([(k, p) for k, p in enumerate(text.NARRATIVE_PHASES)], "place int, narrative_phase string")
    every = order.join(means, "narrative_phase", "left").withColumn("who", F.coalesce("who", F.lit(OVERALL)))  # who is spoken of is in a phase that has a text
    return every.select("place", "narrative_phase", "who", F.coalesce("sentiment", F.lit(0.0)).alias("sentiment"), F.coalesce("stories", F.lit(0)).alias("stories"))


def sentiment_split(phases: DataFrame) -> DataFrame:
    """place, narrative_phase, overall, positive, negative, positive_share, negative_share of the rows of ``phase_sentiment``.

    Means of the characters above and below 0 and their shares; who feels just like the phase as a whole counts for neither.
    """
    whole = F.max(F.when(F.col("who") == OVERALL, F.col("sentiment"))).over(Window.partitionBy("place"))  # one row a character, so phases are read once
    v, differs = F.col("sentiment"), F.col("sentiment") != F.col("overall")
    mean = lambda sign: F.coalesce(F.abs(F.avg(F.when(differs & sign, v))), F.lit(0.0))
    each = phases.withColumn("overall", whole).where("overall is not null").groupBy("place", "narrative_phase", "overall")
    split = each.agg(mean(v > 0).alias("positive"), mean(v < 0).alias("negative"), F.count_if(differs & (v > 0)).alias("p"), F.count_if(differs & (v < 0)).alias("n"))
    share = lambda c: F.coalesce(F.try_divide(c, F.col("p") + F.col("n")), F.lit(0.0))
    return split.select("place", "narrative_phase", "overall", "positive", "negative", share(F.col("p")).alias("positive_share"), share(F.col("n")).alias("negative_share"))
