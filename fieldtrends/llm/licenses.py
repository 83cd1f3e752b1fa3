"""Licence scans by canonical digest: a text is normalised and its digest is joined with those of known licences.

DataFrame operations only. Normalising: lower case, copyright lines out, equivalent spellings made one, marks and
white space out. Whole texts are compared, so a licence with other words around it is not a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrends.llm.common import text_or_empty

# Equivalent spellings of the public matching guidelines for licence texts, variant to kept form.
SPELLINGS = {
    "acknowledgment": "acknowledgement", "analog": "analogue", "analyze": "analyse", "artifact": "artefact",
    "authorization": "authorisation", "authorized": "authorised", "caliber": "calibre", "canceled": "cancelled",
    "capitalizations": "capitalisations", "catalog": "catalogue", "categorize": "categorise", "center": "centre",
    "copyright holder": "copyright owner", "emphasized": "emphasised", "favor": "favour", "favorite": "favourite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialize": "initialise", "judgment": "judgement",
    "labeling": "labelling", "labor": "labour", "license": "licence", "maximize": "maximise", "modeled": "modelled",
    "modeling": "modelling", "noncommercial": "non commercial", "offense": "offence", "optimize": "optimise",
    "organization": "organisation", "organize": "organise", "per cent": "percent", "practice": "practise", "program": "programme",
    "realize": "realise", "recognize": "recognise", "signaling": "signalling", "sub license": "sublicence", "sublicense": "sublicence",
    "utilization": "utilisation", "while": "whilst", "wilful": "wilfull",
}

# Whole texts of short licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
KNOWN = {
    "MIT": MIT, "ISC": ISC, "0BSD": ZERO_BSD,
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}

TITLES = r"(?m)^\s*(the )?(mit|isc|bsd zero clause|zero-clause bsd) licen[cs]e( \((mit|isc|0bsd)\))?\s*$"


PHRASES = {v: k for v, k in SPELLINGS.items() if " " in v}
WORDS = {v + end: k + end for v, k in SPELLINGS.items() if " " not in v for end in ("", "s")}
ANY = r"\b(?:" + "|".join(sorted(SPELLINGS)) + r")s?\b"


#: Words after "copyright" at the start of a wrapped line that go on with a sentence: the line names no holder.
SENTENCE = r"(?:notices?|holders?|owners?|and|or|laws?|licen[cs]es?|statements?|interests?|as|is|in|to)\b"
COPYRIGHT_LINE = rf"(?m)^[ \t]*(?:©|\(c\)(?=[^\p{{L}}\p{{N}}\n]*(?:\d|copyright))|copyright(?=[^a-z])(?![^\p{{L}}\p{{N}}\n]+{SENTENCE})).*$"


def plain(text: Column) -> Column:
    """Words of letters and digits in lower case with one space between them, without copyright lines and titles.

    A copyright line starts with the sign, with (c) before a year, or with the word, unless a sentence goes on there.
    """
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, TITLES, " "), r"[^\p{L}\p{N}]+", " "))


def respelled(words: Column) -> Column:
    """Equivalent spellings made one; only texts that hold a variant are taken apart."""
    table = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    out = words
    for variant, kept in PHRASES.items():
        out = F.regexp_replace(out, rf"\b{variant}", kept)
    out = F.array_join(F.transform(F.split(out, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")
    return F.when(words.rlike(ANY), out).otherwise(words)


def with_digest(df: DataFrame, text: Column) -> DataFrame:
    """Adds license_digest, the digest of the canonical form."""
    return df.withColumn("__plain", plain(text)).withColumn("license_digest", F.sha2(respelled(F.col("__plain")), 256)).drop("__plain")


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """license_digest, license_id of the known texts; of names with equal digests the first in order is taken."""
    rows = spark.createDataFrame(sorted((known or KNOWN).items()), "license_id string, text string")
    return with_digest(rows, F.col("text")).groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document: doc_id, license_digest, license_id (null: no known licence).

    Null text counts as empty, and empty texts have the digest of the empty text, which is no licence. Repeated
    rows are returned as often as they occur; more columns are ignored; an empty table gives no rows. The known
    table has one row per digest, so the join adds no rows.
    """
    rows = with_digest(docs.select("doc_id", text_or_empty().alias("text")), F.col("text"))
    return rows.join(known.select("license_digest", "license_id"), "license_digest", "left").select("doc_id", "license_digest", "license_id")
