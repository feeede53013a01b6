"""Licence scans by sentence rules: known sentences become identifiers, and ordered rules match their sequence.

A text is cut after `.`, `!` or `?` before white space and at line ends; a sentence is normalised to lower-case letters
and digits with single spaces; a normalised sentence that is known has an identifier.  A known sentence may also be
wrapped over several lines, with comment signs; it does not reach over a sentence's end or a line without letters and
digits, and the longest is taken.  The identifiers of a text, in
order, with one `-` for unknown sentences between two of them, are matched against the rules from the first to the
last; what a rule matches is not open to later ones.  Only column expressions are used.

Defined results: a null or empty text has no licence; every row gives a row; repeated sentences count each time;
column names other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm import licence_table

#: Known sentences, normalised, and their identifiers.
SENTENCES = {" ".join(re.findall("[a-z0-9]+", text.lower())): name for name, text in licence_table.SENTENCES}
RULES = licence_table.RULES
#: Words of which every known sentence has one; texts without any are not cut at all.
ANCHOR_WORDS = ("licen", "copyright", "permission", "redistribut", "rights", "warrant", "software", "mpl was")
ANCHORS = "(?i)" + "|".join(ANCHOR_WORDS)
SPACE = r"[ \t\n\r\f]"


def _runs() -> list[tuple[str, str]]:
    """(pattern, identifier) of the sentences, the longest first; one with a stop inside stands over several of the cuts."""
    made = {}
    for name, text in licence_table.SENTENCES:
        parts = [" ".join(re.findall("[a-z0-9]+", x.lower())) for x in re.split(r"(?<=[.!?])\s+", text)]
        made["(?m)^" + "\n+".join(x.replace(" ", "[ \n]") for x in parts if x) + "$"] = name
    return sorted(made.items(), key=lambda x: -len(x[0]))


def sentence_ids(text: Column) -> Column:
    """An array with the identifier of each sentence in order, `-` for an unknown one; empty sentences are left out.

    A sentence's first two words are looked for before its pattern is tried, in one pass over the text for all of them.
    """
    lines = F.regexp_replace(F.lower(F.regexp_replace(text, rf"([.!?]){SPACE}+", "$1\n\n")), "[^a-z0-9\n]+", " ")
    found = F.trim(F.regexp_replace(lines, " ?\n ?", "\n"))
    begins = sorted({" ".join(plain.split(" ")[:2]) for plain in SENTENCES})
    may = found.rlike("(?m)^(?:" + "|".join(x.replace(" ", "[ \n]") for x in begins) + ")\\b")
    marked = found
    for pattern, name in _runs():
        marked = F.regexp_replace(marked, pattern, f"={name}")
    marked = F.when(may, marked).otherwise(found)
    pieces = F.transform(F.filter(F.split(marked, "\n"), lambda s: s != ""), lambda s: F.when(s.startswith("="), F.substr(s, F.lit(2))).otherwise(F.lit("-")))
    return F.when(text.rlike(ANCHORS), pieces).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids and licences, both comma-joined in order of the text."""
    rows = df.select("doc_id", F.concat(F.lit(","), F.array_join(sentence_ids(F.col("text")), ","), F.lit(",")).alias("s"))
    rows = rows.withColumn("s", F.replace(F.regexp_replace("s", "(,-)+(?=,)", ",-"), F.lit(","), F.lit(",,")))
    found = F.col("s")
    for ids, licence in RULES:
        found = F.replace(found, F.lit(",".join(f",{x}," for x in ids).replace(",,,", ",,")), F.lit(f",={licence},"))
    names = F.regexp_extract_all(found, F.lit("=([^,]+)"), F.lit(1))
    ids = F.regexp_extract_all("s", F.lit(",([^,]*[a-z][^,]*),"), F.lit(1))
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_known"), F.array_join(ids, ",").alias("sentence_ids"), F.array_join(names, ",").alias("licences"))
