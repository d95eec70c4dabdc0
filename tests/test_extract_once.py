"""Cheaper extractors of the page parse (F13 of FINDINGS_r03.md), on rows of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import any_contains, first_hit_by_position, holds_any
from dirsearch.operators import extract as X
from dirsearch.operators.criteria import valid_name


def test_texts_are_searched_once_for_a_dictionary(spark):
    """each dictionary was looked up twice, by characters."""
    rows = [(0, "Tax and Litigation"), (1, ""), (2, None), (3, "tax"), (4, "Litigation, é Tax")]
    df = spark.createDataFrame(rows, "i int, text string")
    found = df.select("i", X.dictionary_values("text", ["Litigation", "Tax", "M&A"]).alias("v"),
                      first_hit_by_position("text", ["Litigation", "Tax"]).alias("first"))
    plan = found.select("v")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(text") == 1 and "instr(text" not in plan
    assert {r.i: (r.v, r.first) for r in found.collect()} == {
        0: (["Litigation", "Tax"], "Tax"), 1: (None, None), 2: (None, None), 3: (None, None), 4: (["Litigation", "Tax"], "Litigation")}


def test_faster_extractors_keep_their_results(spark):
    domain = r"[a-zA-Z0-9.-]+\.[a-zA-Z]+"
    texts = ["a@b@c.com", "..x@y.org", "éa.b@d.de, z@z.zz", "a@b", "%@x.yz", "x" * 400 + " y@x", "@@", "a@-.b c+d@e.fr", "", None,
             "Jane Roe", "Jane  Roe", " Jane Roe ", "Jane Roe Partner", "J. X. Roe", "Jane", "Jane Roe?", "jane Roe", "J\tRoe", "New York Times",
             "A" * 30 + " " + "B" * 30, "Back to Top", "Education and Insights", "Clerkship"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = F.regexp_extract("t", r"[a-zA-Z0-9._%+-]+@" + domain, 0)
    r = df.select("i", "t", X.email("t", domain).alias("got"), F.lower(F.when(plain != "", plain)).alias("want"),
                  holds_any("t", L.EDUCATION_STOPS).eqNullSafe(any_contains("t", L.EDUCATION_STOPS)).alias("same"), holds_any("t", []).alias("none"),
                  valid_name(F.col("t"), L.NAME_BLACKLIST, L.NAME_SHAPE, L.NAME_BAD_CHARS).alias("valid")).collect()
    assert [x.got for x in r] == [x.want for x in r]
    assert all(x.same for x in r) and not any(x.none for x in r)
    assert {x.t for x in r if x.valid} == {"Jane Roe", "Jane  Roe", "J. X. Roe", "J\tRoe"} and all(x.valid is not None for x in r)
