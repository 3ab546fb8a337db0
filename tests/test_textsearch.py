"""The trigram index on keys that several rows share."""

from tetrad.operators import textsearch


def test_rows_that_share_a_key_are_found(spark):
    d = spark.createDataFrame([(1, "the office"), (1, "the office"), (1, "none"), (2, "of the"), (2, "a theft"), (3, "the offer")], "k long, t string")
    got = textsearch.search(textsearch.index(d, "k", "t"), d, "k", "t", "THE OFF").collect()
    assert sorted((r.k, r.t) for r in got) == [(1, "the office"), (1, "the office"), (3, "the offer")]
