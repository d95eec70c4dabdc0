"""Criteria search: a flat list of ``{field, op, value}`` conditions and bare
``{op: AND|OR|NOT}`` items, evaluated against a profile table and its child
tables.

Two modes:

* ``entity`` (default) — a child condition holds when *some* child row of the
  profile matches it.  All conditions on a child table become flags of one
  grouped pass over it; pure conjunctions run as one ``left_semi`` or
  ``left_anti`` join a table, anything with OR joins the flags.  No fan-out, no
  DISTINCT.  On tables written by :mod:`dirsearch.sources.directory` neither
  the grouping nor the joins shuffle a stored table.
* ``row`` — the original row-level meaning: every child table the criteria
  touch is LEFT-joined once, the WHERE is evaluated on each joined row, then
  ``(id, name, url)`` is de-duplicated.  ``practice = A AND practice = B`` is
  therefore always empty and ``NOT practice = A`` means "has some other
  practice row".

Inputs (all optional except ``profiles``):
  profiles  (id, name, url, title, office_location, clerkship, ...)
  facets    (profile_id, facet, value) with facet in practice/industry/region/language
  educations(profile_id, school_name, school_normalized, is_law_degree, year)
  aliases   long alias rows (normalized, alias, ord, pos) for school values
"""

from __future__ import annotations

import logging
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirsearch.operators.aliases import resolve_scalar

log = logging.getLogger(__name__)

FACET_FIELDS = ("practice", "industry", "region", "language")
YEAR_FIELDS = ("law_school_year", "undergrad_year", "graduated")
PROFILE_FIELDS = {"title": "title", "office": "office_location", "office_location": "office_location",
                  "clerkship": "clerkship"}
YEAR_OPS = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<=", "eq": "="}
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


@dataclass
class Cond:
    field: str
    op: str
    value: object


# ------------------------------------------------------------------ structure
def to_dnf(criteria: Sequence[dict]) -> list[list[tuple[bool, Cond]]]:
    """Flat criteria list -> OR of ANDs of (negated?, condition).

    SQL precedence (NOT > AND > OR); adjacent conditions without an operator
    are joined by AND; unknown fields and items without an op are skipped.
    """
    terms: list[list[tuple[bool, Cond]]] = [[]]
    negate = False
    for node in criteria:
        op = node.get("op")
        field = node.get("field")
        if field is None and op in ("AND", "OR", "NOT"):
            if op == "OR":
                if terms[-1]:
                    terms.append([])
            elif op == "NOT":
                negate = not negate
            continue
        if not field or not op or not _known(field, op):
            log.warning("criteria item skipped: %r", node)
            continue
        terms[-1].append((negate, Cond(field, op, node.get("value"))))
        negate = False
    return [t for t in terms if t]


def _known(field: str, op: str) -> bool:
    if field == "name" or field == "school" or field in FACET_FIELDS or field in PROFILE_FIELDS:
        return op in ("eq", "contains")
    if field in YEAR_FIELDS:
        return op in YEAR_OPS
    return False


def like_pattern(value: str, literal: bool = False) -> str:
    v = str(value)
    if literal:
        v = v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{v}%"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, and their base letters, by the Unicode decompositions."""
    both = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)])
            if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(c for c, _ in both), "".join(b for _, b in both)


ACCENTED, PLAIN = _accents()


def fold(c: Column) -> Column:
    """Lower case without diacritics (marks that stand alone go, letters with one become their base)."""
    return F.translate(F.regexp_replace(F.lower(c), "[\\u0300-\\u036F]", ""), ACCENTED, PLAIN)


def name_tokens(c: Column) -> Column:
    """Word tokens of a name (letters and digits), in lower case and without diacritics."""
    return F.filter(F.split(fold(c), TOKEN_SPLIT, -1), lambda t: t != F.lit(""))


def value_tokens(value: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", str(value).lower()) if not unicodedata.combining(c))
    return [t for t in re.split(r"[^\w]+|_", plain) if t]


# ------------------------------------------------------------ row predicates
def _name_pred(c: Cond, name: Column) -> Column:
    words = value_tokens(c.value)
    toks = name_tokens(name)
    if not words:
        return F.lit(False)
    if c.op == "contains":
        out = None
        for w in words:
            t = F.array_contains(toks, F.lit(w))
            out = t if out is None else (out & t)
        return out
    phrase = " " + " ".join(words) + " "
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")).contains(phrase)


def _text_pred(op: str, col: Column, value, literal: bool, fold: bool = False) -> Column:
    if op == "eq":
        return (F.lower(col) == F.lower(F.lit(value))) if fold else (col == F.lit(value))
    return col.ilike(like_pattern(value, literal))


def _child_pred(c: Cond, aliases: DataFrame | None, literal: bool) -> tuple[str, Column]:
    """(child table, predicate on that table's row)."""
    if c.field in FACET_FIELDS:
        v = F.col("value")
        return c.field, _text_pred(c.op, v, c.value, literal, fold=(c.field == "language"))
    if c.field == "school":
        norm = resolve_scalar(str(c.value), aliases) if aliases is not None else F.lit(str(c.value))
        if c.op == "contains":
            pat = like_pattern(c.value, literal)
            return "educations", (F.col("school_name").ilike(pat)
                                  | F.ilike(F.col("school_normalized"), F.concat(F.lit("%"), norm, F.lit("%"))))
        return "educations", (F.col("school_name") == F.lit(c.value)) | (F.col("school_normalized") == norm)
    # graduation year: comparison and degree flag on the same education row
    flag = 0 if c.field == "undergrad_year" else 1
    y = F.col("year")
    cmp = {"gt": y > c.value, "lt": y < c.value, "gte": y >= c.value, "lte": y <= c.value, "eq": y == c.value}[c.op]
    return "educations", (cmp & (F.col("is_law_degree") == F.lit(flag)))


def _is_child(c: Cond) -> bool:
    return c.field in FACET_FIELDS or c.field == "school" or c.field in YEAR_FIELDS


def _profile_pred(c: Cond, literal: bool) -> Column:
    if c.field == "name":
        return _name_pred(c, F.col("name"))
    return _text_pred(c.op, F.col(PROFILE_FIELDS[c.field]), c.value, literal)


def _child_table(kind: str, facets: DataFrame | None, educations: DataFrame | None) -> DataFrame:
    if kind == "educations":
        if educations is None:
            raise ValueError("criteria need an educations table")
        return educations
    if facets is None:
        raise ValueError("criteria need a facets table")
    return facets.where(F.col("facet") == F.lit(kind))


# --------------------------------------------------------------------- search
def search(profiles: DataFrame, criteria: Sequence[dict], *, facets: DataFrame | None = None,
           educations: DataFrame | None = None, aliases: DataFrame | None = None, mode: str = "entity",
           limit: int | None = None, order_by_name: bool = True, literal: bool = False,
           columns: Sequence[str] = ("id", "name", "url")) -> DataFrame:
    """Profiles matching ``criteria`` projected to ``columns``.

    ``limit`` (0/None = all) keeps the first n by (name, id); ordering by name
    is applied only when asked for or when a limit needs it.
    """
    dnf = to_dnf(criteria)
    if not dnf:
        out = profiles.select(*columns).distinct()
    elif mode == "row":
        out = _search_rows(profiles, dnf, facets, educations, aliases, literal, columns)
    elif mode == "entity":
        out = _search_entities(profiles, dnf, facets, educations, aliases, literal, columns)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if limit:
        return out.orderBy(F.col("name").asc_nulls_first(), "id").limit(int(limit))
    if order_by_name:
        return out.orderBy(F.col("name").asc_nulls_first(), "id")
    return out


def _combine(dnf, pred_of) -> Column:
    ors = None
    for term in dnf:
        ands = None
        for neg, c in term:
            p = pred_of(c)
            p = ~p if neg else p
            ands = p if ands is None else (ands & p)
        ors = ands if ors is None else (ors | ands)
    return ors


def _search_rows(profiles, dnf, facets, educations, aliases, literal, columns):
    kinds: list[str] = []
    for term in dnf:
        for _, c in term:
            if _is_child(c):
                k = _child_pred(c, aliases, literal)[0]
                if k not in kinds:
                    kinds.append(k)
    joined = profiles
    for k in kinds:
        child = _child_table(k, facets, educations)
        cols = [F.col(x).alias(f"{k}__{x}") for x in child.columns if x != "profile_id"]
        joined = joined.join(child.select(F.col("profile_id").alias(f"{k}__pid"), *cols),
                             F.col("id") == F.col(f"{k}__pid"), "left")

    def pred(c: Cond) -> Column:
        if not _is_child(c):
            return _profile_pred(c, literal)
        k, _ = _child_pred(c, aliases, literal)
        return _rebind(c, k, aliases, literal)

    return joined.where(_combine(dnf, pred)).select(*columns).distinct()


def _rebind(c: Cond, kind: str, aliases, literal) -> Column:
    """Child predicate written against prefixed columns of the joined row."""
    p = f"{kind}__"
    if c.field in FACET_FIELDS:
        return _text_pred(c.op, F.col(p + "value"), c.value, literal, fold=(c.field == "language"))
    if c.field == "school":
        norm = resolve_scalar(str(c.value), aliases) if aliases is not None else F.lit(str(c.value))
        if c.op == "contains":
            return (F.col(p + "school_name").ilike(like_pattern(c.value, literal))
                    | F.ilike(F.col(p + "school_normalized"), F.concat(F.lit("%"), norm, F.lit("%"))))
        return (F.col(p + "school_name") == F.lit(c.value)) | (F.col(p + "school_normalized") == norm)
    flag = 0 if c.field == "undergrad_year" else 1
    y = F.col(p + "year")
    cmp = {"gt": y > c.value, "lt": y < c.value, "gte": y >= c.value, "lte": y <= c.value, "eq": y == c.value}[c.op]
    return cmp & (F.col(p + "is_law_degree") == F.lit(flag))


def _flag_rows(conds: dict[str, Cond], facets, educations, aliases, literal) -> dict[str, tuple[DataFrame, list[str]]]:
    """For each child table that the conditions touch: one row a profile with a flag for each of its conditions.

    The table is read once, whatever the number of conditions; rows that meet
    none of them go before the grouping.
    """
    by_table: dict[str, dict[str, Column]] = {}
    for name, c in conds.items():
        kind, p = _child_pred(c, aliases, literal)
        _child_table(kind, facets, educations)
        if kind != "educations":
            kind, p = "facets", (F.col("facet") == F.lit(kind)) & p
        by_table.setdefault(kind, {})[name] = p
    out = {}
    for kind, preds in by_table.items():
        child = facets if kind == "facets" else educations
        met = None
        for p in preds.values():
            met = p if met is None else met | p
        rows = child.where(met).select(F.col("profile_id").alias("id"), *[F.coalesce(p, F.lit(False)).alias(n) for n, p in preds.items()])
        out[kind] = rows.groupBy("id").agg(*[F.bool_or(n).alias(n) for n in preds]), list(preds)
    return out


def _search_entities(profiles, dnf, facets, educations, aliases, literal, columns):
    names: dict[int, str] = {}
    conds: dict[str, Cond] = {}
    for term in dnf:
        for _, c in term:
            if _is_child(c) and id(c) not in names:
                names[id(c)] = f"_c{len(names)}"
                conds[names[id(c)]] = c
    base = profiles
    flagged = _flag_rows(conds, facets, educations, aliases, literal)
    if len(dnf) == 1:
        # Pure conjunction: a semi join (or, if all its conditions are negated, an anti join) for each child table.
        negated = {names[id(c)]: neg for neg, c in dnf[0] if _is_child(c)}
        for rows, flags in flagged.values():
            if all(negated[f] for f in flags):
                base = base.join(rows.select("id"), "id", "left_anti")
                continue
            for f in flags:
                rows = rows.where(~F.col(f) if negated[f] else F.col(f))
            base = base.join(rows.select("id"), "id", "left_semi")
        for neg, c in dnf[0]:
            if not _is_child(c):
                p = _profile_pred(c, literal)
                base = base.where(~p if neg else p)
        return base.select(*columns)
    for rows, flags in flagged.values():
        base = base.join(rows, "id", "left").withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})

    def pred(c: Cond) -> Column:
        return F.col(names[id(c)]) if _is_child(c) else _profile_pred(c, literal)

    return base.where(_combine(dnf, pred)).select(*columns)


# ----------------------------------------------------------- name validity
def valid_name(c: Column, blacklist: Sequence[str], shape: str, bad_chars: Sequence[str]) -> Column:
    """Boolean Column: the value looks like a person's name."""
    low = F.lower(strip_col(c))
    black = None
    for b in blacklist:
        t = low.contains(b)
        black = t if black is None else (black | t)
    bad = None
    for ch in bad_chars:
        t = c.contains(ch)
        bad = t if bad is None else (bad | t)
    words = F.split(strip_col(c), r"(?U)\s+", -1)
    words_ok = F.forall(words, lambda w: (F.length(w) <= 1) | F.regexp_replace(w, r"\.", "").rlike(r"^\p{L}+$"))
    # length and shape first: most lines of a text go no further
    shaped = c.isNotNull() & F.length(c).between(3, 50) & c.rlike("(?U)" + shape)
    return F.when(shaped, ~black & ~bad & (F.size(words) >= 2) & words_ok).otherwise(F.lit(False))


def strip_col(c: Column) -> Column:
    from dirsearch.functions.text import strip

    return strip(c)


def name_index_search(profiles: DataFrame, index: DataFrame, value: str, columns: Sequence[str] = ("id", "name", "url"),
                      id_col: str = "id") -> DataFrame:
    """J1/P10 through a token index ``(token, profile_id, pos)``: profiles having
    every word of ``value`` as a name token.  The index is filtered to the
    query words (a literal IN list), counted per profile with partial
    aggregation, and semi-joined back.  Of an index stored by token partition
    (:mod:`dirsearch.sources.directory`) only the words' partitions are read."""
    words = sorted(set(value_tokens(value)))
    if not words:
        return profiles.limit(0).select(*columns)
    if "part" in index.columns:
        from dirsearch.sources.directory import token_part

        index = index.where(F.col("part").isin([token_part(F.lit(w)) for w in words]))
    hits = (index.where(F.col("token").isin(words)).groupBy("profile_id")
            .agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(words)))
    return profiles.join(hits, profiles[id_col] == hits["profile_id"], "left_semi").select(*columns)
