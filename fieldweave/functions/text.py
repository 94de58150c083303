"""Normalisers and scores of field values, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered vocabulary of type statuses; the first that occurs as a word counts.
TYPE_STATUSES = ["holotype", "isotype", "lectotype", "isolectotype", "neotype", "isoneotype", "syntype", "isosyntype", "paratype", "isoparatype", "type"]


# Fixed value: what \s matches. Trimming costs a fraction of a pattern, and most values pass through here several times.
_SPACE = " \t\n\x0b\f\r"


def clean(c: Column) -> Column:
    """Null, nan, none and null (any case) are blank; outer white space goes."""
    stripped = F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(_SPACE))
    return F.when(F.lower(stripped).isin("nan", "none", "null"), "").otherwise(stripped)


def _plain(c: Column, cleaned: bool) -> Column:
    """What clean() gives; `cleaned`: the value has been through it already, and cleaning again would change nothing."""
    return c if cleaned else clean(c)


def normalize_eval(c: Column, cleaned: bool = False) -> Column:
    kept = F.regexp_replace(F.lower(_plain(c, cleaned)), r"[^\p{L}\p{N}_\s.\-]", "")
    return F.btrim(F.regexp_replace(kept, r"\s+", " "), F.lit(" "))


def identifier_key(c: Column, cleaned: bool = False) -> Column:
    return F.upper(F.regexp_replace(_plain(c, cleaned), "[^A-Za-z0-9]+", ""))


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def person_key(c: Column, cleaned: bool = False) -> Column:
    """Name parts in alphabetical order."""
    parts = F.regexp_extract_all(F.lower(_plain(c, cleaned)), F.lit("([a-zà-öø-ÿ0-9]+)"), 1)
    return F.array_join(F.sort_array(parts), " ")


def type_status(c: Column, cleaned: bool = False) -> Column:
    low = F.lower(_plain(c, cleaned))
    found = F.lit(None).cast("string")
    for status in reversed(TYPE_STATUSES):
        found = F.when(low.rlike(rf"\b{status}\b"), status).otherwise(found)
    return F.coalesce(found, normalize_eval(c, cleaned))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def words(c: Column) -> Column:
    return F.filter(F.split(normalize_eval(c), " "), lambda w: w != "")


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize_eval(pred) == normalize_eval(gold)).cast("int")


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the overlap of two bags of words; both empty 1, one empty 0."""
    p, g = words(pred), words(gold)
    many = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(many(p, w), many(g, w)))
    f1 = 2.0 * common / (F.size(p) + F.size(g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(f1)


def evidence_proxy(value: Column, text: Column) -> Column:
    """Null for a blank value, 1 if the text holds it, else the share of its distinct words that the text has."""
    v, t = normalize_eval(value), normalize_eval(text)
    own = F.array_distinct(words(value))
    share = F.size(F.array_intersect(own, words(text))) / F.size(own)
    return F.when(v == "", None).when(t == "", 0.0).when(F.contains(t, v), 1.0).otherwise(share)


def first_match(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, case aside; blank if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, f"(?i){p}", 1), F.lit("")) for p in patterns], F.lit(""))


# The date forms, in the order in which they are tried, each with the shape a value must have.
DATE_FORMS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2} \p{L}{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} \p{L}+ \d{4}$", "d MMMM yyyy"), (r"^\p{L}{3} \d{1,2} \d{4}$", "MMM d yyyy"), (r"^\p{L}+ \d{1,2} \d{4}$", "MMMM d yyyy"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A year, or year and month: no date form has this shape.
_YEAR = r"^\d{4}(-\d{2})?$"


def date_part(c: Column, cleaned: bool = False) -> Column:
    """A date as yyyy-MM-dd by the first form that fits; a year or year and month stay; other values are normalised text."""
    plain = F.regexp_replace(F.regexp_replace(_plain(c, cleaned), r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"\s+", " ")
    plain = F.regexp_replace(F.replace(plain, F.lit(","), F.lit("")), r"^[ .]+|[ .]+$", "")

    def known(p: Column) -> Column:
        tried = [F.when(p.rlike(shape), F.date_format(F.try_to_timestamp(F.initcap(p), F.lit(form)), "yyyy-MM-dd")) for shape, form in DATE_FORMS]
        return F.coalesce(*tried, F.when(p.rlike(_YEAR), p))

    return F.coalesce(let(plain, known), normalize_eval(c, cleaned))


def event_date(c: Column, cleaned: bool = False) -> Column:
    """A date, or an interval of two dates that each hold a year."""
    value = _plain(c, cleaned)

    def joined(parts: Column) -> Column:
        """One date, or both of an interval, through the same expression."""
        both = (F.size(parts) == 2) & F.forall(parts, lambda p: p.rlike(r"\b\d{4}\b"))
        return F.array_join(F.transform(F.when(both, parts).otherwise(F.array(value)), lambda p: date_part(p, True)), "/")

    # What stays as it is needs none of the forms.
    return F.when((value == "") | value.rlike(_YEAR), value).otherwise(let(F.transform(F.split(value, "/"), lambda p: clean(p)), joined))


def json_body(c: Column) -> Column:
    """The JSON object of a model's answer: without fences, from the first opening to the last closing brace; null if there is none."""
    bare = F.regexp_replace(clean(c), r"(?i)^```(?:json)?\s*|\s*```$", "")
    found = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(found).isNotNull(), found)
