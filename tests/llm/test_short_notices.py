"""Notices of one shingle."""

from pyspark.sql import functions as F

from framelake.llm import license_scan


def test_short_notices_are_found_beside_any_word(spark):
    """100,000 neighbours of 'Released under the MIT License.', of which bands alone would miss about one in 1024."""
    n = 100_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" released under the mit license")).alias("text"))
    got = license_scan.scan(docs, {"mit-notice": license_scan.TEMPLATES["mit-notice"]})
    assert got.where("containment = 1 AND template = 'mit-notice'").count() == n
