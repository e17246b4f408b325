"""Lexicon scoring of texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import clean_text, sentiment_label
from tidewatch.session import BROADCAST_BYTES, is_small, lookup_side

#: Words a lexicon may have to be looked up within the row.
IN_ROW_WORDS = 20_000


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9]+"), F.lit(0))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, word)``: one row per word of the cleaned text, repeats kept.

    The runs of letters and digits are the words of the cleaned text, taken
    without building it. They are lower-cased one by one, after the choice of
    characters, as the cleaning does.
    """
    return (df.select(key, F.explode(_words(text)).alias("word"))
            .withColumn("word", F.lower("word")))


def word_scores(tokens: DataFrame, lexicon: DataFrame, *,
                limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``score`` to every word; words outside the lexicon score 0."""
    scored = tokens.join(lookup_side(lexicon, limit), "word", "left")
    return scored.withColumn("score", F.coalesce("score", F.lit(0)))


def _scored(df: DataFrame, text: str, lexicon: DataFrame, limit: int, in_row: int) -> DataFrame:
    """Add ``score`` to every row.

    A lexicon of at most ``in_row`` words is a constant of the plan. A larger one is
    joined word by word; a score depends on the text alone, so scores are summed and
    joined back by the text's digest, and rows need no key. Both give the same.
    """
    zero = F.lit(0).cast("long")
    if is_small(lexicon, in_row):
        return df.withColumn("score", F.coalesce(score_in_row(text, lexicon), zero))
    told = df.withColumn("_tw_text", F.md5(F.col(text)))
    hits = tokens(told, "_tw_text", text).join(lookup_side(lexicon, limit), "word")
    sums = hits.groupBy("_tw_text").agg(F.sum("score").cast("long").alias("score"))
    copies = told.groupBy("_tw_text").agg(F.count(F.lit(1)).alias("_tw_n"))
    each = sums.join(copies, "_tw_text").select(
        "_tw_text", F.expr("score div _tw_n").alias("score"))
    return (told.join(each, "_tw_text", "left")
            .select(*df.columns, F.coalesce("score", zero).alias("score")))


def document_score(df: DataFrame, key: str, text: str, lexicon: DataFrame, *,
                   limit: int = BROADCAST_BYTES, in_row: int = IN_ROW_WORDS) -> DataFrame:
    """``(key, score)`` for every row of ``df``, 0 for a text without lexicon words."""
    return _scored(df.select(key, text), text, lexicon, limit, in_row).select(key, "score")


def score_in_row(text: str, lexicon: DataFrame) -> Column:
    """Score of a text as a column expression, for a lexicon of few words.

    The lexicon becomes a constant: an array of small maps, picked by the hash of
    the word, since a lookup in one large map would read all of it.
    """
    size = F.lit(max(1, lexicon.count()))
    entries = (lexicon.groupBy("word").agg(F.sum("score").alias("score"))
               .withColumn("slot", F.pmod(F.hash("word"), size)).collect())
    slots: list[dict[str, int]] = [{} for _ in range(max(1, max(
        (e["slot"] for e in entries), default=0) + 1))]
    for e in entries:
        slots[e["slot"]][e["word"]] = e["score"]
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,bigint>>")

    def add(total: Column, word: Column) -> Column:
        word = F.lower(word)
        found = F.try_element_at(F.get(table, F.pmod(F.hash(word), size)), word)
        return total + F.coalesce(found, F.lit(0).cast("long"))

    return F.aggregate(_words(text), F.lit(0).cast("long"), add)


def classify(df: DataFrame, key: str, text: str, lexicon: DataFrame, *,
             limit: int = BROADCAST_BYTES, in_row: int = IN_ROW_WORDS) -> DataFrame:
    """Replace the text by its cleaned form and add ``score`` and ``sentiment``.

    Rows are scored one by one; ``key`` may be null or repeated.
    """
    scored = _scored(df, text, lexicon, limit, in_row)
    return (scored.withColumn(text, clean_text(F.col(text)))
            .withColumn("sentiment", sentiment_label(F.col("score"))))
