"""The single-pass ingest plan against the per-field extractors on profile-like pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirsearch.functions import lexicons as L
from dirsearch.functions.text import any_contains
from dirsearch.operators import extract as X
from dirsearch.operators import lines as LN
from dirsearch.operators.criteria import valid_name
from dirsearch.plans import ingest as I

PAGE = """<html><head><title>x</title><script>var a="<p>";</script></head><body>
<nav><a>Lawyers</a><a>Capabilities</a><a>Experience</a><a>Offices</a></nav>
<h1>Jane Q. Doe</h1><p>Partner</p><p>jane.doe@example.com</p><p>+1 212 450 4000</p><p>New York</p>
<h2>Experience</h2>
<p>Represented Acme Corp in its $1 billion acquisition of Widget Co, a leading maker of widgets.</p>
<p>Advised a consortium of banks on a cross-border financing.</p><p>View more experience</p>
<h2>Education</h2><p>J.D., Yale Law School, magna cum laude</p><p>B.A., Economics, Tel Aviv University</p>
<h2>Clerkship</h2><p>Hon. Jane Roe, U.S. Court of Appeals</p><p>Law Clerk</p>
<h2>Capabilities</h2><p>Capital Markets</p><p>Asia</p><p>Latin America</p><p>Print</p>
<h2>Languages</h2><p>Spanish, French and some german</p><p>Qualifications</p>
<h2>Education</h2><p>LL.M., Tax, New York University School of Law</p>
<p>Back to top</p></body></html>"""

PAGE2 = """<html><body><p>Print this page</p><p>John Smith</p><p>Senior Counsel, Tax</p>
<p>john.smith@example.com</p><p>London</p><p>Experience</p><p>Offices</p>
<p>Capabilities</p><p>China</p><p>Japan</p><p>Education</p><p>Harvard University</p></body></html>"""


LEX = I.Lexicon(email_domain=r"example\.com")


def _pages(spark):
    return spark.createDataFrame([(1, "https://www.example.com/lawyers/jane-doe", PAGE),
                                  (2, "https://www.example.com/people/42", PAGE2),
                                  (3, "https://www.example.com/lawyers/empty", "<html><body></body></html>")],
                                 "page_id long, url string, html string")


def _modular(pages):
    lines = LN.page_lines(pages)
    ok = lambda c: valid_name(c, L.NAME_BLACKLIST, L.NAME_SHAPE, L.NAME_BAD_CHARS)
    mail = r"(?i)[a-zA-Z0-9._%+-]+@" + LEX.email_domain
    parts = [X.near_match(lines, "page_id", F.col("line").rlike(mail), ok(F.col("line")), out="near_name"),
             X.first_line_matching(lines, "page_id", F.col("line").rlike(L.NAME_LINE) & ok(F.col("line")), head=30,
                                   out="line_name"),
             X.line_before(lines, "page_id", any_contains("line", L.TITLE_KEYWORDS), ok, out="title_name"),
             X.title_of(lines, "page_id"), X.capability_values(lines, "page_id"), X.education_lines(lines, "page_id"),
             X.clerkship(lines, "page_id"), X.languages(lines, "page_id"), X.experience(lines, "page_id")]
    out = pages.select("page_id")
    for p in parts:
        out = out.join(p, "page_id", "left")
    return out


def test_single_pass_equals_extractors(spark):
    pages = _pages(spark)
    cols = ["page_id", "near_name", "line_name", "title_name", "title", "region", "school", "clerkship", "language",
            "experience"]
    lines = LN.page_lines(pages).withColumn("local", F.lit(None).cast("struct<url:string>"))
    single = I._line_fields(lines, I.Lexicon(email_domain=LEX.email_domain, head_lines=30)).select(*cols)
    modular = _modular(pages).select(*cols)
    a = {r["page_id"]: r.asDict() for r in single.collect()}
    b = {r["page_id"]: r.asDict() for r in modular.collect()}
    assert {k: v for k, v in b.items() if k in a} == a
    j = a[1]
    assert j["title"] == "Partner"
    assert j["region"] == ["Asia", "Latin America"]
    assert j["school"] == ["J.D., Yale Law School, magna cum laude", "B.A., Economics, Tel Aviv University",
                           "LL.M., Tax, New York University School of Law"]
    assert j["clerkship"] == "Hon. Jane Roe, U.S. Court of Appeals, Law Clerk"
    assert j["language"] == ["French", "German", "Spanish"]
    assert j["experience"].startswith("Represented Acme Corp") and "View more" not in j["experience"]
    assert a[2]["near_name"] == "John Smith" and a[2]["region"] == ["China", "Japan"]


def test_parse_pages_profiles(spark):
    parsed = I.parse_pages(_pages(spark), LEX)
    rows = {r["url"]: r for r in parsed.profiles.collect()}
    jane = rows["https://www.example.com/lawyers/jane-doe"]
    assert (jane["name"], jane["first_name"], jane["last_name"]) == ("Jane Doe", "Jane", "Doe")
    assert jane["email"] == "jane.doe@example.com" and jane["phone"] == "+1 212 450 4000"
    assert jane["office_location"] == "New York"
    john = rows["https://www.example.com/people/42"]
    assert john["name"] == "John Smith" and john["title"] == "Senior Counsel"
    facets = {(r["facet"], r["value"]) for r in parsed.facets.collect()}
    assert ("practice", "Capital Markets") in facets and ("practice", "Tax") in facets
    assert ("region", "Asia") in facets and ("language", "Spanish") in facets
    assert parsed.errors.count() == 1
    assert parsed.experience.count() == 1


def test_stream_store_keeps_name_index(spark):
    import os
    import uuid

    from dirsearch.session import shared_dir
    from dirsearch.streaming.ingest_stream import apply_batch, read_table

    root = os.path.join(shared_dir(spark), f"test-index-{uuid.uuid4().hex}")
    pages = _pages(spark)
    apply_batch(spark, pages, root, 0, LEX)
    ids = {r["url"]: r["id"] for r in read_table(spark, root, "profiles").collect()}
    jane, john = ids["https://www.example.com/lawyers/jane-doe"], ids["https://www.example.com/people/42"]
    idx0 = {(r["token"], r["profile_id"]) for r in read_table(spark, root, "name_index").collect()}
    assert {("jane", jane), ("doe", jane), ("john", john), ("smith", john)} <= idx0
    changed = spark.createDataFrame([(2, "https://www.example.com/people/42", PAGE2.replace("John Smith", "Jack Smith"))],
                                    "page_id long, url string, html string")
    apply_batch(spark, changed, root, 1, LEX, force=True)
    idx1 = {(r["token"], r["profile_id"]) for r in read_table(spark, root, "name_index").collect()}
    assert ("jack", john) in idx1 and ("john", john) not in idx1 and ("jane", jane) in idx1
    names = {r["url"]: r["name"] for r in read_table(spark, root, "profiles").collect()}
    assert names["https://www.example.com/people/42"] == "Jack Smith"


def test_pages_are_parsed_once_and_counted_in_flight(spark, tmp_path):
    pages = _pages(spark)
    known = spark.createDataFrame([("https://www.example.com/people/42",), (None,)], "url string")
    parsed, counters = I.ingest_pages(pages, str(tmp_path / "rows"), known, LEX)
    assert {r["metric"]: r["value"] for r in counters.collect()} == {"seen": 3, "skipped": 1, "processed": 1, "errors": 1, "with_experience": 1}
    lazy = I.parse_pages(pages.where("page_id <> 2"), LEX)
    for t in ("profiles", "facets", "schools", "educations", "experience", "errors"):
        a, b = getattr(parsed, t), getattr(lazy, t)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), t
        assert "html" not in a._jdf.queryExecution().optimizedPlan().toString()
    _, counters = I.ingest_pages(pages.where("false"), str(tmp_path / "none"), known, LEX)
    assert {r["metric"]: r["value"] for r in counters.collect()} == {"seen": 0, "skipped": 0, "processed": 0, "errors": 0, "with_experience": 0}


def test_one_page_of_a_url_is_chosen_without_its_html(spark):
    from dirsearch.streaming.ingest_stream import pages_to_parse

    rows = [(1, "a", "old"), (2, "a", "new"), (2, "a", "new"), (3, "b", "x"), (4, None, "n1"), (5, None, "n2"), (None, "c", "only"), (6, "d", "known"), (None, "a", "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = spark.createDataFrame([("d",), ("d",), (None,)], "url string")
    got = sorted(map(tuple, pages_to_parse(pages, known).collect()), key=str)
    assert got == sorted([(2, "a", "new"), (3, "b", "x"), (5, None, "n2"), (None, "c", "only")], key=str)
    assert pages_to_parse(pages.where("false")).count() == 0


def test_a_replayed_batch_writes_the_same_rows(spark, tmp_path):
    from dirsearch.streaming.ingest_stream import apply_batch, read_table, start_ingest

    source, root = str(tmp_path / "in dir"), str(tmp_path / "out")
    pages = _pages(spark)
    pages.where("page_id = 1").write.parquet(source)
    start_ingest(spark, source, pages.schema, root, lex=LEX).awaitTermination()
    pages.write.mode("append").parquet(source)
    start_ingest(spark, source, pages.schema, root, lex=LEX).awaitTermination()
    tables = ("profiles", "facets", "educations", "experience", "name_index")
    before = {t: sorted(map(str, read_table(spark, root, t).collect())) for t in tables}
    assert [r["first_epoch"] for r in read_table(spark, root, "profiles").orderBy("first_epoch").collect()] == [0, 1]
    apply_batch(spark, pages, root, 1, LEX)  # the same batch again
    assert {t: sorted(map(str, read_table(spark, root, t).collect())) for t in tables} == before
