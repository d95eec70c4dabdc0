"""Judging candidates against a query.

A judge sees ``(query_id, id, query, text)`` rows and returns
``(query_id, id, passes, reasoning)``.  The default judge is a Column
expression (keyword coverage), so nothing leaves the JVM.  A caller may
supply a Python judge ``fn(pandas.DataFrame) -> pandas.DataFrame``; it runs
batch-wise through ``mapInPandas`` (Arrow).  A batch in which it raises is
judged again row by row, so that only the failing rows get the error message.
Judges see whole texts; one that wants less cuts for itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirsearch.functions.text import col_of, strip, words_in_text



def default_judge(rows: DataFrame, min_hits: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pass when the candidate's text contains at least ``min_hits`` of the
    query keywords; no keywords -> pass.  Missing text fails with an error
    message, like a failed call.  ``keep`` columns pass through unchanged.

    Rows either carry ``hits`` (the query's keywords found in the text, null
    when there is no text, see :func:`dirsearch.operators.keywords.keyword_hits`)
    or the ``text`` itself.
    """
    if "hits" in rows.columns:
        no_text = F.col("hits").isNull()
        hits = F.col("hits")
    else:
        no_text = F.col("text").isNull()
        hits = words_in_text("text", "keywords")
    passes = F.when(no_text, F.lit(False)).when(F.size("keywords") == 0, F.lit(True)) \
        .otherwise(F.size(hits) >= min_hits)
    reasoning = F.when(no_text, F.lit("Error: no profile text")) \
        .otherwise(F.concat(F.lit("matched: "), F.array_join(hits, ", ")))
    return rows.select("query_id", "id", *keep, passes.alias("passes"), reasoning.alias("reasoning"))


def python_judge(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], keep: tuple[str, ...] = ()) -> DataFrame:
    """Run a caller-supplied judge over Arrow batches of (query_id, id, query, text).

    ``fn`` returns one row per input row, in input order, with ``passes`` and
    ``reasoning``; ``keep`` columns pass through from the input batch.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["query_id long", "id long"] + [f"{c} {fields[c]}" for c in keep]
                       + ["passes boolean", "reasoning string"])

    def judged(pdf):
        out = fn(pdf[["query_id", "id", "query", "text"]]).reset_index(drop=True)
        if len(out) != len(pdf):
            raise ValueError(f"judge returned {len(out)} rows for {len(pdf)}")
        return pd.DataFrame({"passes": out["passes"].astype(bool), "reasoning": out["reasoning"].astype(str)})

    def one(pdf):
        try:
            return judged(pdf)
        except Exception as e:  # noqa: BLE001 - a failed call fails its row
            return pd.DataFrame({"passes": [False], "reasoning": [f"Error: {e}"]})

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            try:
                out = judged(pdf)
            except Exception:  # noqa: BLE001 - find the rows that fail
                rows_ = [one(pdf.iloc[i:i + 1].reset_index(drop=True)) for i in range(len(pdf))]
                out = pd.concat(rows_, ignore_index=True)
            yield pd.concat([pdf[["query_id", "id", *keep]], out], axis=1)

    return rows.select("query_id", "id", "query", "text", *keep).mapInPandas(run, schema)


def parse_response(resp: Column | str, strict: bool = False) -> Column:
    """struct(passes, reasoning) from ``<thinking>..</thinking><answer>..</answer>``.

    Missing answer tag -> Fail.  ``strict`` compares the answer to 'Pass'
    exactly; the default accepts any case.
    """
    r = col_of(resp)
    think = F.regexp_extract(r, r"(?s)<thinking>(.*?)</thinking>", 1)
    ans = strip(F.regexp_extract(r, r"(?s)<answer>(.*?)</answer>", 1))
    has_ans = r.rlike(r"(?s)<answer>.*?</answer>")
    ok = (ans == F.lit("Pass")) if strict else (F.lower(ans) == F.lit("pass"))
    return F.struct(F.coalesce(has_ans & ok, F.lit(False)).alias("passes"), strip(think).alias("reasoning"))
