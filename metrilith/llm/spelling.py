"""Spelling variants of a corpus's words: a prefix filter over positional bigrams, rarest first.

Words are ranked by how often their bigrams occur among all words. An edit touches two
bigrams at most, and those it leaves keep their order, so of the three rarest bigrams of a
word at least one is also among the three rarest of any word at one edit, at the same place
or one beside it. As only one edit is allowed, the letters before a shared bigram that the
edit leaves alone or those after it are the same in both words: candidates are joined on the
bigram with its place and what precedes it, or with its place from the end and what follows
it. A key whose words are many is told apart further by what is left of its words less one
letter each, which two words at one edit share too; no key is left out or cut. Distances are
then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrilith.llm.common import id_and_text
from metrilith.operators.tables import Scratch

RUN = "[A-Za-zÀ-ÿ]+"
#: Words of fewer code points, or that occur less often, aren't words of the result.
LENGTH, OCCURRENCES = 6, 5
#: A variant's form occurs at least so many times as often.
TIMES = 5
#: Bigrams that are joined for each word: two for the edit and one.
RAREST = 3
#: A key with more words than this is told apart further; it changes the work only.
CROWD = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(word: Column, at: Column) -> Column:
    """The word less its code point at `at`, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run): each maximal run of letters of each text, A-Z in lower case, once for each occurrence.

    Null and empty texts have none; the rest of a row's columns play no part.
    """
    rows = id_and_text(docs, id_col, text_col)
    found = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    return found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")))


def misspelt(found: DataFrame, one_in: int = 199) -> DataFrame:
    """`found` with one letter less in the runs whose CRC-32 with their document's id `one_in` divides. A null id reads as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    short = _without(F.col("run"), (h % F.length("run")).cast("int"))
    return found.withColumn("run", F.when(h % one_in == 0, short).otherwise(F.col("run")))


def vocabulary(found: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the distinct runs of at least `length` code points with at least so many occurrences."""
    counted = found.filter(F.length("run") >= length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= occurrences)


def _keyed(words: DataFrame) -> DataFrame:
    """(word, n, gram, side, place, rest, other): two rows for each of a word's rarest bigrams.

    `side` says whether `rest` is what stands before or after the bigram, `place` is counted
    from that side, and `other` is what stands on the other one.
    """
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("place", "gram")
    grams = words.select("word", "n", at)
    # letters come from a set of 90, so that there are 8,100 bigrams at most
    ranks = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = grams.join(F.broadcast(ranks), "gram").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "place"))).alias("grams"))
    rare = ranked.select("word", "n", F.explode(F.slice("grams", 1, RAREST)).alias("g")).select("word", "n", "g.gram", "g.place")
    before, after = F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 3, F.length("word"))
    side = lambda s, rest, other: F.struct(F.lit(s).alias("side"), F.length(rest).alias("place"), rest.alias("rest"), other.alias("other"))
    both = F.explode(F.array(side("before", before, after), side("after", after, before))).alias("s")
    return rare.select("word", "n", "gram", both).select("word", "n", "gram", "s.*")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n, near, near_n): the pairs of words at exactly one insertion, deletion or replacement, in both directions.

    `words` holds each word once, of RAREST + 1 code points or more; shorter ones and nulls
    take no part. An empty table gives no pairs.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    long = words.filter(F.length("word") > RAREST).select(F.col("word").cast("string").alias("word"), F.col("n").cast("bigint").alias("n"))
    keyed = scratch.write(_keyed(long), "keyed")
    key = ["gram", "side", "place", "rest"]
    crowds = keyed.groupBy(*key).agg(F.count("*").alias("members")).filter("members > 1")
    kept = scratch.write(keyed.join(crowds, key), "candidates")
    scratch.drop(keyed)
    few = kept.filter(F.col("members") <= crowd).withColumn("less", F.lit(""))
    # of both words' other sides, whole or less a letter, one is the same; a side as long as the other's loses one in both
    other = F.col("other")
    shorter = F.transform(F.sequence(F.lit(0), F.length(other) - 1), lambda i: _without(other, i))
    less = F.when(F.length(other) == 0, F.array(other)).otherwise(F.array_distinct(F.concat(F.array(other), shorter)))
    many = kept.filter(F.col("members") > crowd).withColumn("less", F.explode(less))
    sides = few.unionByName(many).select("word", "n", *key, "less")
    a = sides.select(*key, "less", "word", "n")
    b = sides.select(*key, "less", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = a.join(b, [*key, "less"]).filter("word < near").filter(F.abs(F.length("word") - F.length("near")) <= 1)
    pairs = pairs.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()
    pairs = scratch.write(pairs, "pairs")
    scratch.drop(kept)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def variants(words: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of `words` (word, n).

    A word's form is its near word of largest n, the smallest in code-point order of those
    that tie, if it occurs `times` times as often or more. Its root is where the forms lead:
    each step multiplies n, so that there are no circles and a chain's length goes by the
    logarithm of n; roots double their reach with every join.
    """
    scratch = Scratch(words.sparkSession, "forms")
    words = scratch.write(words.select("word", "n"), "words")
    best = F.min_by("near", F.struct((-F.col("near_n")).alias("n"), "near"))
    near = near_pairs(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("form"), F.max("near_n").alias("form_n"))
    enough = F.col("form_n") >= times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    found = scratch.write(found, "forms")
    roots = scratch.write(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = scratch.write(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        scratch.drop(roots)
        roots = after.select("word", "root")
        if after.filter("moved").isEmpty():
            break
        roots = scratch.write(roots, "roots")
        scratch.drop(after)
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
