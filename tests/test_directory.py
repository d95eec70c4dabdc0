"""The stored directory: plans without a shuffle of stored tables, pruned partitions, and results of the plain tables."""

from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from dirsearch.operators.criteria import name_index_search, search
from dirsearch.operators.upsert import name_index
from dirsearch.sources.directory import token_part, write_directory
from dirsearch.suite.criteria import STORED_MIX


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(i, f"Ann Lee{i % 7}" if i % 3 else f"Bo Number{i}", f"u/{i}", "Partner" if i % 2 else None) for i in range(300)]
    profiles = spark.createDataFrame(rows, "id long, name string, url string, title string")
    facets = spark.createDataFrame([(i, f, v) for i in range(0, 290) for f, v in (("practice", ["1-URGENT", "5-LOW", None][i % 3]), ("industry", "FOP"[i % 3]),
                                                                                  ("region", "NAR"[i % 4 % 3]))] + [(7, "practice", "1-URGENT")] * 300,
                                   "profile_id long, facet string, value string")
    educations = spark.createDataFrame([(i, "Yale", "Yale", i % 2, 1990 + i % 12 if i % 5 else None) for i in range(280)],
                                       "profile_id long, school_name string, school_normalized string, is_law_degree int, year int")
    name = f"t_{uuid.uuid4().hex}"
    return (profiles, facets, educations), write_directory(name, str(tmp_path_factory.mktemp("d") / name), profiles, facets, educations, buckets=4)


def _plan(df):
    df.collect()
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


AND = [{"field": "practice", "op": "eq", "value": "1-URGENT"}, {"field": "industry", "op": "eq", "value": "F"}, {"op": "NOT"}, {"field": "region", "op": "eq", "value": "R"}]
NOTS = [{"op": "NOT"}, {"field": "practice", "op": "eq", "value": "1-URGENT"}, {"op": "NOT"}, {"field": "region", "op": "contains", "value": "n"}]


@pytest.mark.parametrize("criteria,children", [(AND, 1), (NOTS, 1), (STORED_MIX, 2)])
def test_one_scan_a_table_and_no_shuffle(spark, tables, criteria, children):
    (profiles, facets, educations), d = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = search(d.profiles, criteria, facets=d.facets, educations=d.educations, order_by_name=False)
        plan = _plan(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[0]
    assert "Exchange" not in final and final.count("FileScan parquet") == 1 + children
    want = search(profiles, criteria, facets=facets, educations=educations, order_by_name=False)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0


def test_conditions_agree_with_single_searches(spark, tables):
    (profiles, facets, educations), _ = tables
    ids = lambda criteria: {r["id"] for r in search(profiles, criteria, facets=facets, educations=educations).collect()}
    everyone, one = ids([]), [ids([c]) for c in AND if "field" in c]
    assert ids(AND) == one[0] & one[1] - one[2]
    assert ids(NOTS) == everyone - ids([NOTS[1]]) - ids([NOTS[3]])
    assert ids([AND[0], {"op": "OR"}, AND[1]]) == one[0] | one[1]


def test_a_facet_condition_reads_its_partition(spark, tables):
    _, d = tables
    plan = _plan(search(d.profiles, [{"field": "region", "op": "eq", "value": "N"}], facets=d.facets, order_by_name=False))
    assert re.search(r"PartitionFilters: \[isnotnull\(facet\), \(facet = region\)\]", plan)


def test_a_name_search_reads_the_partitions_of_its_words(spark, tables):
    (profiles, *_), d = tables
    found = name_index_search(d.profiles, d.name_index, "lee3 ANN")
    plan = _plan(found)
    parts = {spark.range(1).select(token_part(F.lit(w))).first()[0] for w in ("ann", "lee3")}
    shown = re.search(r"PartitionFilters: \[([^\]]*part[^\]]*)\]", plan).group(1)
    assert all(str(p) in shown for p in parts)
    want = name_index_search(profiles, name_index(profiles), "lee3 ANN")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() > 0
