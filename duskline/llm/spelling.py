"""Spelling variants of the words of a corpus, by asymmetric chunks.

A word gives two disjoint chunks, its halves. Another word that is one edit away keeps one of
them: the first at the same place, the second at the same place or shifted by one. So the other
word gives those of its positional grams that can be such a chunk, and both meet by
place, length and gram. A shorter or equally long word gives the chunks, a longer or equally long
one the grams, so every pair is looked for in one direction only.

Where many words share a chunk, as all that begin alike, the half that is still open is cut
into two chunks again, and the words meet by the longer piece they then share. This goes on
until a group is small; where one place is left open, its words are near each other by
construction and not more than there are letters. No group gives all its pairs.

Defined cases: a null text has no words; a null document id counts as empty text; a text that
is one very long run of letters is one word; repeated rows count again; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.common import dropped, saved, splittable

LEAST_LETTERS = 7
LEAST_COUNT = 2
# A form is so many times as frequent as its variant.
FREQUENT = 10
# A group of more pairs of chunk and gram than this is cut further.
GROUP_PAIRS = 1024
# Every 31st run by its checksum loses a letter.
CUT = 31

KEY = ["longer", "size", "lo", "hi", "before", "after"]


def corpus_words(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT
) -> DataFrame:
    """``word, n``: runs of Latin letters with their occurrences, after the stated cut of letters.

    A cut only shortens a run, so shorter runs are left out before anything is computed of them.
    """
    runs = F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least_letters},}})"), F.lit(1))
    said = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("said")
    )
    lower = said.select("doc", F.translate("said", ascii_uppercase, ascii_lowercase).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    placed = hashed.withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    cut = F.expr("concat(substring(run, 1, at), substring(run, at + 2))")
    words = placed.select(F.when(F.col("h") % CUT == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= least_letters).groupBy("word")
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _open_words(words: DataFrame) -> DataFrame:
    """Every word in its parts: giving chunks or grams, to words as long or by one longer.

    ``lo`` and ``hi`` bound what is open of the chunks' word; ``size`` is that word's length.
    """
    sized = words.withColumn("letters", F.length("word"))
    parts = F.array(
        *[
            F.struct(
                F.lit(gives_grams).alias("gives_grams"),
                F.lit(longer).alias("longer"),
                (F.col("letters") - longer * gives_grams).alias("size"),
            )
            for longer in (0, 1)
            for gives_grams in (0, 1)
        ]
    )
    opened = sized.select("word", "n", F.inline(parts))
    return opened.withColumns({"lo": F.lit(0), "hi": F.col("size")})


def _halved(parts: DataFrame) -> DataFrame:
    """Each open part twice: with its first chunk found again, and with its second."""
    half = F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
    ends = F.array(
        F.struct((F.col("lo") + F.greatest(half, F.lit(1))).alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.col("lo").alias("lo"), (F.col("lo") + half).alias("hi")),
    )
    kept = ["word", "n", "gives_grams", "longer", "size"]
    cut = parts.select(*kept, F.inline(ends))
    # The second chunk of a word with a letter more is found one place further.
    return cut.withColumns(
        {
            "before": F.expr("substring(word, 1, lo)"),
            "after": F.expr("substring(word, hi + longer * gives_grams + 1)"),
        }
    )


def _can_be_cut() -> Column:
    return F.col("hi") - F.col("lo") > F.when(F.col("longer") == 1, 0).otherwise(1)


def near_words(words: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """``word, n, near, near_n`` for every two words one edit apart, in both directions."""
    parts, found = _open_words(words), []
    while True:
        halved = saved(_halved(parts), "chunks")
        sizes = halved.groupBy(*KEY).agg(
            F.count_if(F.col("gives_grams") == 0).alias("chunks"),
            F.count_if(F.col("gives_grams") == 1).alias("grams"),
        )
        many = (F.col("chunks") * F.col("grams") > group_pairs) & _can_be_cut()
        groups = sizes.where((F.col("chunks") > 0) & (F.col("grams") > 0))
        groups = saved(groups.select(*KEY, many.alias("many")), "groups")
        few = halved.join(splittable(groups.where(~F.col("many")).drop("many")), KEY)
        chunks = few.where("gives_grams = 0").drop("gives_grams")
        grams = few.where("gives_grams = 1").select(*KEY, F.col("word").alias("near"), F.col("n").alias("near_n"))
        pairs = chunks.join(grams, KEY).where((F.col("longer") == 1) | (F.col("word") < F.col("near")))
        pairs = pairs.where(F.levenshtein("word", "near", 1) == 1)
        found.append(saved(pairs.select("word", "n", "near", "near_n"), "pairs"))
        if groups.where("many").isEmpty():
            dropped(halved)
            dropped(groups)
            break
        parts = saved(
            halved.join(splittable(groups.where("many").drop("many")), KEY).drop("before", "after"), "open"
        )
        dropped(halved)
        dropped(groups)
    one = found[0]
    for more in found[1:]:
        one = one.union(more)
    # An inserted letter beside an equal one keeps both chunks, so such pairs are found twice.
    one = one.distinct()
    other = one.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
    )
    return one.union(other)


def last_forms(links: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the end of each chain, by doubling the pointers.

    A form is several times as frequent as its variant, so chains are short and have no circles.
    """
    roots = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        told = roots.join(ahead, "root", "left")
        further = saved(told.select("word", F.coalesce("further", "root").alias("root"), "further"), "roots")
        done = further.where(F.col("further").isNotNull()).isEmpty()
        dropped(roots)
        roots = further.drop("further")
        if done:
            return roots


def spelling_variants(
    docs: DataFrame,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of largest ``n``, the first in code-point order among equals, where it
    is ``frequent`` times as frequent; ``root`` is the last form that forms lead to, or the word.
    """
    words = saved(corpus_words(docs, least_letters, least_count), "words")
    # The order of Spark's strings is that of their UTF-8 bytes, which is that of code points.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    about = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    far = F.col("best.less") <= -frequent * F.col("n")
    joined = words.join(about, "word", "left").select(
        "word",
        F.when(far, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(far, -F.col("best.less")).alias("form_n"),
    )
    known = saved(joined, "variants")
    roots = last_forms(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
