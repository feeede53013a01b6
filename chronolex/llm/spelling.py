"""Spelling variants: words one edit apart, found by writing out every word's neighbourhood and joining it to the vocabulary.

A word of 8 letters has some 16 neighbours for each letter of the alphabet.  Those that hold three letters in a row that no
word holds cannot be words, so the alphabet is taken where it was observed: between two letters stand those that some word
has there.  That table has a row for each pair of letters at most, whatever the corpus, and is broadcast.  So is a bitmap of the
words' hashes, of a bounded size: candidates whose bit is not set are no words and are not shuffled; those that are left
are joined to the vocabulary by themselves.  What the join finds is one edit away by the way it was made; nothing is measured.

Null texts have no words; a null doc_id counts as an empty one where it is hashed.  Repeated rows count again.  Ties of counts
go to the word that is first in code-point order.  Empty tables give empty tables, other columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks of a word's two ends in the table of letters; no letters themselves.
BEGIN, END = "^", "$"
#: Bits for each word in the bitmap of hashes, and the most bits that it has (128 MB); beyond, more candidates are shuffled.
BITS_PER_WORD, MOST_BITS = 16, 1 << 30
#: Bits in a row of the bitmap, as longs; words whose neighbourhoods are one task's work.
ROW_BITS, TASK_WORDS = 1 << 12, 20_000
#: A chain of forms doubles its count at each step, so 63 steps are the longest there can be.
MAX_ROUNDS = 8


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run: the runs of letters of whole texts, A-Z in lower case."""
    text = F.col("text")
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))


def cut_at(s: Column, k: Column) -> Column:
    """s without its code point k, counted from 0."""
    return F.concat(F.substring(s, F.lit(1), k), F.substring(s, k + 2, F.length(s)))


def vocabulary(docs: DataFrame, every: int = 97, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: distinct words of at least min_chars code points and min_count occurrences; a run whose hash with its document
    is divisible by `every` loses a letter first."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    hashed = runs(docs).where(F.length("run") >= min_chars).select("run", h.alias("h"))
    word = F.when(F.col("h") % every == 0, cut_at(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letters_between(words: DataFrame) -> DataFrame:
    """before, after, letters: those that some word has between the two, with its ends as BEGIN and END; at most one row for
    each pair of letters."""
    w = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    at = words.select(w.alias("w"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    seen = at.select(F.substring("w", F.col("i"), 1).alias("before"), F.substring("w", F.col("i") + 1, 1).alias("letter"), F.substring("w", F.col("i") + 2, 1).alias("after"))
    return seen.groupBy("before", "after").agg(F.collect_set("letter").alias("letters"))


def neighbourhood(words: DataFrame, letters: DataFrame) -> DataFrame:
    """word, n, candidate: all distinct strings one deletion, replacement or insertion away that words' letters allow.

    Of a run of equal letters only the first is deleted, a letter is inserted only before equal ones and never replaced by
    itself, so no candidate comes twice: the three kinds differ in length.
    """
    marked = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    letter = lambda k: F.substring(marked, F.col("i") + k, 1)
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    left, right = F.substring("word", F.lit(1), F.col("i") - 1), F.substring("word", F.col("i"), F.length("word"))
    insert = F.struct(left.alias("left"), right.alias("right"), letter(0).alias("before"), letter(1).alias("after"), letter(0).alias("avoid"), F.lit(False).alias("delete"))
    rest = F.substring("word", F.col("i") + 1, F.length("word"))
    replace = F.struct(left.alias("left"), rest.alias("right"), letter(0).alias("before"), letter(2).alias("after"), letter(1).alias("avoid"), (letter(0) != letter(1)).alias("delete"))
    cuts = at.select("word", "n", F.explode(F.when(F.col("i") <= F.length("word"), F.array(insert, replace)).otherwise(F.array(insert))).alias("cut")).select("word", "n", "cut.*")
    joined = cuts.join(F.broadcast(letters), ["before", "after"], "left")
    found = F.concat(F.coalesce("letters", F.array().cast("array<string>")), F.when(F.col("delete"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    each = joined.select("word", "n", "left", "right", "avoid", F.explode(found).alias("letter")).where("letter <> avoid")
    return each.select("word", "n", F.concat("left", "letter", "right").alias("candidate"))


def hashes_bitmap(words: DataFrame, bits: int) -> DataFrame:
    """row, set: the words' hashes modulo `bits`, a power of two, as a bitmap in rows of ROW_BITS."""
    h = F.xxhash64("word").bitwiseAND(bits - 1)
    longs = words.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))).alias("set"))
    per_row = ROW_BITS // 64
    in_row = F.struct(F.col("at").bitwiseAND(per_row - 1).cast("int").alias("i"), "set")
    rows = longs.groupBy(F.floor(F.col("at") / per_row).alias("row")).agg(F.map_from_entries(F.collect_list(in_row)).alias("m"))
    return rows.select("row", F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("set"))


def perhaps_words(candidates: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """Those candidates whose hash has its bit set."""
    h = F.xxhash64("candidate").bitwiseAND(bits - 1)
    hashed = candidates.withColumn("h", h).withColumn("row", F.shiftright("h", ROW_BITS.bit_length() - 1)).join(F.broadcast(bitmap), "row")
    long = F.get("set", F.shiftright("h", 6).bitwiseAND(ROW_BITS // 64 - 1).cast("int"))
    return hashed.where(F.call_function("shiftright", long, F.col("h").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1).select(candidates.columns)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every pair of words one edit apart, in both orders. words: a stored table."""
    n_words = words.count()
    bits = max(ROW_BITS, min(MOST_BITS, 1 << (BITS_PER_WORD * n_words).bit_length()))
    letters, bitmap = stored(letters_between(words), "letters"), stored(hashes_bitmap(words, bits), "bitmap")
    dealt = words.repartition(n_words // TASK_WORDS + 1, "word")
    known = words.select(F.col("word").alias("candidate"), F.col("n").alias("near_n"))
    pairs = perhaps_words(neighbourhood(dealt, letters), bitmap, bits).join(known, "candidate")
    return pairs.select("word", "n", F.col("candidate").alias("near"), "near_n")


def forms(words: DataFrame, at_least: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of the largest count, if that is at_least times the word's."""
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    both = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= at_least * F.col("n")
    return both.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))})


def roots(found: DataFrame) -> DataFrame:
    """word, root: where the forms of a word lead, for those that have one; each round doubles the steps that are taken."""
    steps = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps")
    for _ in range(MAX_ROUNDS):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nexts = stored(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "steps")
        steps = nexts.select("word", "root")
        if nexts.where("moved").isEmpty():
            return steps
    raise RuntimeError(f"forms are longer than {MAX_ROUNDS} rounds can follow")


def groups(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the documents."""
    words = stored(vocabulary(docs), "words")
    found = stored(forms(words), "forms")
    both = found.join(roots(found), "word", "left")
    return both.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
