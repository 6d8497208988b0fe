"""Grouping of spelling variants: words one edit apart, found by a rare-first q-gram prefix filter.

1. Words are runs of Latin letters, counted over all texts; a fixed share of occurrences loses one letter (``noise``).
2. A word is its positional bigrams, put in the order of how many words have the bigram, rarest first (ties by bigram, then
   place). One edit destroys at most two bigrams of a word. So of two words one edit apart, the first bigram that both keep
   stands among the three rarest of each: only these three are joined.
3. The edit lies on one side of that bigram, so the text from it to the other end is equal, and so is one half of the rest.
   The join is on this: bigram, place, the length (words of one length meet, and words that are one longer), the equal end
   and the equal half, as one hash. The second bigram needs only the side away from the first one, which was destroyed; the
   third is needed only if the first two are neighbours, as one edit must have hit both. Nothing that could be near is lost
   (tests compare with all pairs), and few pairs meet that are not: 42 million on the 0.5 GB table, 2.7 million of them near,
   where bigram, place and length alone gave 2500 million.
4. Met pairs are verified by their edit distance at once, so only true neighbours go on.
5. A word's form is its most frequent neighbour, if that is at least twice as frequent. Counts grow along forms, so there are
   no cycles, and chains are as long as the logarithm of the counts: roots are found by doubling.

The input is never gathered: words are counted with partial sums, the join is dealt by that hash (Spark splits
large partitions), and each step of the roots is a join of the words that have a form.

Defined cases: a null or empty text has no words; a null doc_id counts as the empty string where the noise is drawn; rows that
repeat count again. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

RUN = "[A-Za-zÀ-ÿ]+"
#: One occurrence in NOISE loses a letter; words have LETTERS and OCCURRENCES at least; a form is TIMES as frequent.
NOISE, LETTERS, OCCURRENCES, TIMES = 97, 5, 3, 2
#: Bigrams of a word that are joined: one more than an edit can destroy.
PREFIX = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(text: Column) -> Column:
    """The runs of letters of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(RUN), F.lit(0))


def noisy(doc_id: Column, run: Column) -> Column:
    """The run, or the run without one letter, as the checksum of document and run tells."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: the distinct words of enough letters and occurrences."""
    told = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run")).where(F.length("run") >= letters)
    told = told.select(noisy(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= letters)
    return told.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def prefixes(counted: DataFrame) -> DataFrame:
    """word, n, nth (1 to 3), at, first: the places of the rarest bigrams of each word, and of the first of them."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = counted.select("word", "n", F.explode(F.transform(places, lambda p: F.struct(p.alias("at"), F.substring(F.col("word"), p, F.lit(2)).alias("gram")))).alias("g"))
    # a bigram counts once for each word that has it; there are at most (26 + 64)^2 bigrams of such letters
    frequency = grams.groupBy("g.gram").agg(F.count_distinct("word").alias("df"))
    ranked = grams.join(F.broadcast(frequency), grams["g.gram"] == frequency["gram"]).select("word", "n", F.struct("df", "g.gram", "g.at").alias("g"))
    kept = ranked.groupBy("word", "n").agg(F.transform(F.slice(F.sort_array(F.collect_list("g")), 1, PREFIX), lambda g: g["at"]).alias("rarest"))
    rows = kept.select("word", "n", F.col("rarest")[0].alias("first"), (F.abs(F.col("rarest")[0] - F.col("rarest")[1]) == 1).alias("beside"), F.posexplode("rarest").alias("nth", "at"))
    return rows.where((F.col("nth") < 2) | F.col("beside")).select("word", "n", (F.col("nth") + 1).alias("nth"), "at", "first")


def meeting_keys(rows: DataFrame) -> DataFrame:
    """word, n, role, key. Words of one length meet in the role ``same``; a word in the role ``short`` meets those that are one
    longer in the role ``long``. ``rows`` as from ``prefixes``."""
    sides = F.when(F.col("nth") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("at") < F.col("first")))
    rows = rows.select("word", "n", "nth", "at", F.explode(sides).alias("ahead"))  # ahead: the equal end is the beginning
    size = F.length("word")
    equal = F.when(F.col("ahead"), F.col("at") + 1).otherwise(size - F.col("at") + 1)
    begin, end = (lambda k: F.substring(F.col("word"), F.lit(1), k)), (lambda k: F.when(k > 0, F.substring(F.col("word"), size - k + 1, k)).otherwise(""))
    told = []
    for role, short in (("same", size), ("short", size), ("long", size - 1)):
        rest = short - equal
        half = F.floor(rest / 2).cast("int")
        near = F.when(F.col("ahead"), begin(equal + half)).otherwise(end(equal + half))
        far = F.when(F.col("ahead"), F.concat(begin(equal), F.lit("|"), end(rest - half))).otherwise(F.concat(begin(rest - half), F.lit("|"), end(equal)))
        # the third bigram of the shorter word can't be the first that is kept: an insertion destroys one
        may = (rest > 0 if role == "same" else rest >= 0) & (F.col("nth") < 3 if role == "short" else F.lit(True))
        for text, ok, part in ((near, may, "near"), (far, may & (half > 0), "far")):
            told.append(F.when(ok, F.struct(F.lit(role).alias("role"), F.xxhash64(short, F.lit(role == "same"), "ahead", F.lit(part), text).alias("key"))))
    return rows.select("word", "n", F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("x")).select("word", "n", "x.role", "x.key")


def near_pairs(counted: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of words one edit apart, once."""
    rows = saved(meeting_keys(prefixes(counted)))
    a = rows.where("role <> 'long'").select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key", (F.col("role") == "same").alias("alike"))
    b = rows.where("role <> 'short'").select(F.col("word").alias("b"), F.col("n").alias("b_n"), "key", (F.col("role") == "same").alias("alike"))
    met = a.join(b, ["key", "alike"]).where((~F.col("alike") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).distinct()


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a ``form``: the last word that their forms lead to."""
    step = saved(formed.select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = saved(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text)."""
    counted = saved(words(docs))
    pairs = near_pairs(counted)
    both = pairs.union(pairs.select("other", "other_n", "word", "n")).toDF("word", "n", "other", "other_n")
    # of the most frequent neighbours the least in code-point order, which is the order of strings
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    told = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = counted.join(told, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= TIMES * F.col("n")
    rows = saved(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")))
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
