"""Whole texts looked up among known licences by the digest of a canonical form.

Canonical form: A-Z lower-cased; lines which begin with a copyright notice dropped; quotes,
dashes and all other punctuation turned to blanks; equivalent spellings made one; runs of
blanks made one. The SHA-256 of this form is joined to the digests of the known licences.

Defined results. NULL and empty texts, and texts with only punctuation, have the digest of
the empty form and no licence. Repeated rows are looked up one by one. Of several licences
with one canonical form the smallest name is reported. Without known licences all are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import stage

# Known digests are broadcast up to this count (about 100 bytes each).
MAX_BROADCAST_LICENSES = 200_000

# Equivalent spellings, after lower-casing and removal of punctuation.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("https", "http"),
]

COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, r"[\x00-/:-`{-\x7f ‐-―‘-‟•©]+", " ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def known_digests(licenses: DataFrame, name: str = "license_id", text: str = "text") -> DataFrame:
    rows = licenses.select(F.col(name).alias("_license"), canonical(F.col(text)).alias("_form"))
    rows = rows.where("_license IS NOT NULL AND _form <> ''")
    return rows.groupBy(F.sha2("_form", 256).alias("_digest")).agg(F.min("_license").alias("_license"))


def find_licenses(docs: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its key, canonical length and digest, and the licence it is, or NULL."""
    known = stage(known_digests(licenses), "license-digests")
    form = docs.select(F.col(key).alias("_key"), canonical(F.col(text)).alias("_form"))
    rows = form.select("_key", F.octet_length("_form").cast("long").alias("_bytes"), F.sha2("_form", 256).alias("_digest"))
    if known.count() <= MAX_BROADCAST_LICENSES:
        rows = rows.join(F.broadcast(known), "_digest", "left")
    else:
        rows = salted_join(rows, known, ["_digest"], "_key", "left")
    return rows.select(
        F.col("_key").alias(key),
        F.col("_bytes").alias("canonical_bytes"),
        F.col("_digest").alias("canonical_digest"),
        F.col("_license").alias("license_id"),
    )
