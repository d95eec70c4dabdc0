"""Query strings to profiles, alias phrases, accents, character references."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dirsearch.operators import lines as LN
from dirsearch.operators import querylog as QL
from dirsearch.operators.aliases import alias_rows
from dirsearch.operators.criteria import name_tokens, search


@pytest.fixture(scope="module")
def directory(spark):
    profiles = spark.createDataFrame([(1, "Ann Lee", "Partner", "London"), (2, "Bo Lee", "Associate", "Paris"), (3, "José García", "Partner", None)],
                                     "id long, name string, title string, office_location string")
    facets = spark.createDataFrame([(2, "region", "Asia"), (3, "region", "Asia"), (1, "region", "Europe"), (1, "language", "French"), (3, "practice", "Tax")],
                                   "profile_id long, facet string, value string")
    educations = spark.createDataFrame([(1, "Yale University", "Yale", 1, 1999), (3, "Yale University", "Yale", 1, 2005), (2, "Oxford", "Oxford", 0, 2005), (2, None, None, 1, None)],
                                       "profile_id long, school_name string, school_normalized string, is_law_degree int, year int")
    return profiles, facets, educations


def _ask(spark, directory, *queries):
    log = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    crit = QL.extract_criteria(QL.split_clauses(log))
    got = {k: [] for k in range(len(queries))}
    for r in QL.batch_search(crit, *directory).orderBy("query_id", "id").collect():
        got[r["query_id"]].append(r["id"])
    return list(got.values())


def test_all_criteria_of_a_query_must_hold(spark, directory):
    assert _ask(spark, directory, "partners in asia", "partners in asia and speak french", "partners", "lawyers who speak french",
                "went to yale", "partners who graduated after 2000", "associates and went to yale") == [[3], [], [1, 3], [1], [1, 3], [3], []]


def test_every_field_of_the_batch_search_agrees_with_the_search_of_one(spark, directory):
    rows = [("name", "contains", "jose"), ("name", "eq", "ann lee"), ("title", "contains", "art"), ("title", "eq", "Partner"), ("office", "eq", "London"),
            ("office", "contains", "ar"), ("region", "contains", "si"), ("practice", "eq", "Tax"), ("language", "eq", "FRENCH"), ("school", "contains", "yal"),
            ("school", "eq", "Yale"), ("law_school_year", "gte", "1999"), ("undergrad_year", "eq", "2005"), ("law_school_year", "lt", "2005"), ("title", "contains", "x")]
    crit = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "query_id long, field string, op string, value string")
    got = {k: set() for k in range(len(rows))}
    for r in QL.batch_search(crit, *directory).collect():
        got[r["query_id"]].add(r["id"])
    profiles, facets, educations = directory
    for k, (f, op, v) in enumerate(rows):
        one = [{"field": f, "op": op, "value": int(v) if v.isdigit() else v}]
        want = search(profiles.withColumn("clerkship", F.lit(None).cast("string")), one, facets=facets, educations=educations, columns=("id", "name"))
        assert got[k] == {r["id"] for r in want.collect()}, rows[k]


def test_candidates_are_the_hits_of_the_rarest_criterion(spark):
    profiles = spark.createDataFrame([(i, f"Ann Number{i}", "Partner" if i % 2 else "Associate") for i in range(60)], "id long, name string, title string")
    facets = spark.createDataFrame([(i, "region", "Asia") for i in range(60)] + [(i, "practice", "Tax") for i in range(0, 60, 20)],
                                   "profile_id long, facet string, value string")
    rows = [(q, *c) for q in range(100) for c in (("region", "eq", "Asia"), ("name", "contains", "ann"), ("practice", "eq", "Tax"), ("title", "eq", "Associate"))]
    rows += [(500, "region", "eq", "Asia"), (500, "practice", "eq", "Sports"), (501, "title", "contains", "PART"), (501, "title", "contains", "PART"),
             (502, "title", "eq", None), (502, "region", "eq", "Asia"), (503, "name", "contains", "--")]
    crit = spark.createDataFrame(rows, "query_id long, field string, op string, value string")
    done = QL.batch_candidates(crit, profiles, facets)
    # 100 equal queries are one set with three candidates; 501 has 30; the others meet nothing with some criterion
    assert done.candidates.count() == 3 + 30
    got = QL.batch_search(crit, profiles, facets)
    assert {r["id"] for r in got.where("query_id = 42").collect()} == {0, 20, 40}
    assert got.where("query_id < 100").count() == 300 and got.where("query_id = 501").count() == 30
    assert got.where("query_id in (500, 502, 503)").count() == 0


def test_batch_search_against_brute_force(spark):
    import random

    rng = random.Random(3)
    words = ["ann", "lee", "bo", "garcía", "wu"]
    people = [(i, " ".join(rng.choices(words, k=2)).title(), rng.choice(["Partner", "Associate", None]), rng.choice(["London", "Paris", None])) for i in range(40)]
    facets = [(rng.randrange(40), rng.choice(QL.FACETS), rng.choice(["Tax", "Asia", "french", "French", None])) for _ in range(120)]
    schools = [(rng.randrange(40), rng.choice(["Yale University", "Oxford", None]), rng.choice(["Yale", "Oxford", None]), rng.choice([0, 1, None]), rng.choice([1999, 2005, None]))
               for _ in range(80)]
    makers = [lambda: ("name", rng.choice(["eq", "contains"]), " ".join(rng.choices(["Ann", "LEE", "garcia"], k=rng.choice([1, 2])))),
              lambda: ("title", rng.choice(["eq", "contains"]), rng.choice(["Partner", "part", "assoc"])), lambda: ("office", "contains", rng.choice(["on", "PARIS", ""])),
              lambda: (rng.choice(QL.FACETS), rng.choice(["eq", "contains"]), rng.choice(["Tax", "asia", "French", "fr"])),
              lambda: ("school", rng.choice(["eq", "contains"]), rng.choice(["Yale", "yale", "Oxford"])),
              lambda: (rng.choice(QL.YEARS), rng.choice(QL.YEAR_OPS), rng.choice(["1999", "2000", "2005", "no"]))]
    asked = [(q, *rng.choice(makers)()) for q in range(150) for _ in range(rng.choice([1, 2, 3]))]
    plain = lambda t: t.lower().replace("í", "i")
    inside = lambda text, v: text is not None and v != "" and v.lower() in text.lower()

    def meets(i, f, op, v):
        _, name, title, office = people[i]
        if f == "name":
            return set(plain(v).split()) <= set(plain(name).split()) and (op == "contains" or f" {plain(v)} " in f" {plain(name)} ")
        if f in ("title", "office"):
            text = title if f == "title" else office
            return text == v if op == "eq" else inside(text, v)
        if f == "school":
            return any((v in (a, b)) if op == "eq" else inside(a, v) or inside(b, v) for p, a, b, _, _ in schools if p == i)
        if f in QL.FACETS:
            return any((x == v or f == "language" and x is not None and x.lower() == v.lower()) if op == "eq" else inside(x, v) for p, k, x in facets if p == i and k == f)
        compare = {"gt": int.__gt__, "lt": int.__lt__, "gte": int.__ge__, "lte": int.__le__, "eq": int.__eq__}[op]
        return v != "no" and any(y is not None and law == (f == "law_school_year") and law is not None and compare(y, int(v)) for p, _, _, law, y in schools if p == i)

    want = {(q, i) for q in {a[0] for a in asked} for i in range(40) if all(meets(i, *a[1:]) for a in asked if a[0] == q)}
    got = QL.batch_search(spark.createDataFrame(asked, "query_id long, field string, op string, value string"),
                          spark.createDataFrame(people, "id long, name string, title string, office_location string"),
                          spark.createDataFrame(facets, "profile_id long, facet string, value string"),
                          spark.createDataFrame(schools, "profile_id long, school_name string, school_normalized string, is_law_degree int, year int"))
    assert sorted((r["query_id"], r["id"]) for r in got.collect()) == sorted(want) and len(want) > 50


def test_sets_of_one_lead_share_its_hits(spark, monkeypatch):
    profiles = spark.createDataFrame([(i, f"Ann Word{i % 4}", "Partner" if i < 6 else "Associate") for i in range(60)], "id long, name string, title string")
    crit = spark.createDataFrame([(q, *c) for q in range(4) for c in (("title", "eq", "Partner"), ("name", "contains", f"word{q}"))],
                                 "query_id long, field string, op string, value string")
    for checks in (QL.CHECKS, 5):  # whole, and dealt to slices
        monkeypatch.setattr(QL, "CHECKS", checks)
        done = QL.batch_candidates(crit, profiles)
        assert done.candidates.count() == 4 * 6 and done.led.count() == 6
        assert (done.led.agg(F.max("slice")).first()[0] > 0) == (checks == 5)
        assert sorted((r["set"], r["id"]) for r in done.found.collect()) == sorted((i % 4, i) for i in range(6))


def test_result_rows_of_large_sets_take_few_bytes(spark, tmp_path):
    n = 4001
    profiles = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "Ann Lee").otherwise("Bo Lee").alias("name"))
    crit = profiles.select((F.col("id") * 7919 % n).alias("query_id"), F.lit("name").alias("field"), F.lit("contains").alias("op"), "name")
    QL.batch_search(crit.toDF("query_id", "field", "op", "value"), profiles).write.parquet(str(tmp_path / "rows"))
    got = spark.read.parquet(str(tmp_path / "rows"))
    rows = 2001 * 2001 + 2000 * 2000
    asked = crit.select("query_id", F.col("name").alias("asked"))
    assert got.count() == rows == got.distinct().count()
    assert got.join(asked, "query_id").join(profiles, "id").where("name = asked").count() == rows
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < rows / 4


def test_null_and_repeated_keys_stay_in_the_result(spark):
    profiles = spark.createDataFrame([(1, "Ann", "Partner"), (1, "Ann", "Partner"), (None, "Ann", "Partner"), (2, "Bo", "Partner")], "id long, name string, title string")
    crit = spark.createDataFrame([(5, "name", "contains", "ann"), (None, "name", "contains", "ann"), (6, "name", "contains", "ann"), (6, "title", "eq", "Partner")],
                                 "query_id long, field string, op string, value string")
    got = sorted((str(r["query_id"]), str(r["id"])) for r in QL.batch_search(crit, profiles).collect())
    assert got == [("5", "1"), ("5", "None"), ("6", "1"), ("6", "1"), ("None", "1"), ("None", "None")]


def test_unsupported_criteria_are_refused(spark, directory):
    crit = spark.createDataFrame([(1, "shoe size", "eq", "9")], "query_id long, field string, op string, value string")
    with pytest.raises(PySparkException):
        QL.batch_search(crit, *directory).collect()


def test_alias_phrases_longest_first(spark):
    rows = alias_rows(spark.createDataFrame([("Mergers", "m and a", "m", 1), ("Tax Law", "tax", None, 2)], "c string, a string, b string, n long"), "c", ["a", "b"], "n")
    log = spark.createDataFrame([(1, "M and A tax taxes m"), (2, ""), (3, "nothing here")], "query_id long, query string")
    got = {r["query_id"]: r["normalized"] for r in QL.normalise_queries(log, rows).collect()}
    assert got == {1: "Mergers Tax Law taxes Mergers", 2: "", 3: "nothing here"}
    long = alias_rows(spark.createDataFrame([("School", "the very old  School of law by the river side", None, 1)], "c string, a string, b string, n long"), "c", ["a", "b"], "n")
    log = spark.createDataFrame([(1, "at The Very Old school of law by the river  side now")], "query_id long, query string")
    assert QL.normalise_queries(log, long).first()["normalized"] == "at School now"


def test_names_are_folded(spark):
    df = spark.createDataFrame([("José Ångström-Çelik Ñandú",), ("José",)], "n string").select(name_tokens(F.col("n")).alias("t"))
    assert [r["t"] for r in df.collect()] == [["jose", "angstrom", "celik", "nandu"], ["jose"]]


def test_page_text_keeps_lines_and_decodes_references(spark):
    html = "<body><p>Jos&eacute; <b>Garc&#237;a</b>&ndash;Ruiz</p><div><i>Capital</i> Markets<br>a &amp;amp; b &#x41;&bogus; &lt;x&gt; AT&T</div></body>"
    df = spark.createDataFrame([(html,)], "h string").select(LN.html_to_text("h").alias("t"))
    assert [x.strip() for x in df.first()["t"].split("\n") if x.strip()] == ["José García–Ruiz", "Capital Markets", "a &amp; b A&bogus; <x> AT&T"]
