"""Answers of language and vision models as typed records: containers unwrapped, fields under their usual names, items and lists coerced; all by VARIANT paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields as R
from . import text as T

# Keys that wrap a record, other names of fields, and other names of an item's value, in the order in which they are tried.
CONTAINERS = ["record", "fields", "extraction", "extracted_record", "data", "result"]
ALIASES = {
    "catalog_number": "catalogNumber", "catalog_no": "catalogNumber", "barcode": "catalogNumber", "scientific_name": "scientificName", "taxon": "scientificName", "recorded_by": "recordedBy", "collector": "recordedBy",
    "event_date": "eventDate", "collection_date": "eventDate", "state_province": "stateProvince", "state": "stateProvince", "province": "stateProvince", "decimal_latitude": "decimalLatitude", "latitude": "decimalLatitude",
    "decimal_longitude": "decimalLongitude", "longitude": "decimalLongitude", "type_status": "typeStatus",
}
VALUE_NAMES = ["text", "answer", "extracted_value", "verbatim", "prediction"]
#: Confidence of a value that is given without one.
UNSTATED = 0.5


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("NONE"))


def _is(v: Column, kind: str) -> Column:
    return F.startswith(_kind(v), F.lit(kind))


def _at(v: Column, key: str) -> Column:
    """What an object holds under a key: a variant (also for a JSON null), or null if it hasn't the key."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def plain(v: Column) -> Column:
    """A value as clean text: numbers and texts as they are, nested ones as JSON, null as blank."""
    said = F.try_variant_get(v, "$", "string")
    return T.clean(F.when(_is(v, "BOOLEAN"), F.initcap(said)).otherwise(said))


def json_value(c: Column, fallback: Column) -> Column:
    """A JSON text as a variant; the fallback where it is none."""
    return F.coalesce(F.try_parse_json(T.clean(c)), fallback)


def _item(v: Column) -> Column:
    """(value, confidence, evidence_span, coerced, stated): stated is false where a confidence is given that is no number."""
    empty = F.lit("")

    def known(x: Column) -> Column:
        # A value under another name brings a confidence and a span of its own, or the usual ones.
        other = F.coalesce(*(F.when(_at(x, n).isNotNull(), F.struct(_at(x, n).alias("v"))) for n in VALUE_NAMES))
        own = _at(x, "value").isNotNull() | other.isNull()
        sure = _at(x, "confidence")
        value = F.when(own, plain(_at(x, "value"))).otherwise(plain(other["v"]))
        span = F.when(own | _at(x, "evidence_span").isNotNull(), plain(_at(x, "evidence_span"))).otherwise(plain(other["v"]))
        number = F.when(sure.isNull(), F.when(own, 0.0).otherwise(UNSTATED)).otherwise(F.try_variant_get(sure, "$", "double"))
        return F.struct(value.alias("value"), number.alias("confidence"), span.alias("evidence_span"), F.lit(False).alias("coerced"))

    bare = F.struct(plain(v).alias("value"), F.lit(UNSTATED).alias("confidence"), plain(v).alias("evidence_span"), F.lit(True).alias("coerced"))
    none = F.struct(empty.alias("value"), F.lit(0.0).alias("confidence"), empty.alias("evidence_span"), F.lit(False).alias("coerced"))
    return F.when(v.isNull(), none).when(_is(v, "OBJECT"), known(v)).otherwise(bare)


def validated(items: Column) -> Column:
    """record and warnings of an array of (field, item) in the order of the fields; confidences are kept within 0 and 1."""

    def warned(x: Column) -> Column:
        sure = x["item"]["confidence"]
        return F.filter(
            F.array(
                F.when(x["item"]["coerced"], F.concat(F.lit("coerced_field:"), x["field"])),
                F.when(sure.isNull() | F.isnan(sure), F.concat(F.lit("bad_confidence:"), x["field"])),
                F.when((sure < 0) | (sure > 1), F.concat(F.lit("confidence_out_of_range:"), x["field"])),
            ),
            lambda w: w.isNotNull(),
        )

    def within(x: Column) -> Column:
        sure = F.when(F.isnan(x["item"]["confidence"]), 0.0).otherwise(F.coalesce(x["item"]["confidence"], F.lit(0.0)))
        return F.struct(x["field"].alias("field"), x["item"]["value"].alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), x["item"]["evidence_span"].alias("evidence_span"))

    def place(x: Column) -> Column:
        number, limit = R.number(x["item"]["value"]), F.when(x["field"] == "decimalLatitude", 90).otherwise(180)
        wrong = F.when(number.isNull(), F.concat(x["field"], F.lit("_not_numeric"))).when(F.abs(number) > limit, F.concat(x["field"], F.lit("_out_of_range")))
        return F.when(x["field"].isin(R.COORDINATES) & (x["item"]["value"] != ""), wrong)

    warnings = F.concat(F.flatten(F.transform(items, warned)), F.filter(F.transform(items, place), lambda w: w.isNotNull()))
    return F.struct(F.transform(items, within).alias("fields"), warnings.alias("warnings"))


def _items(entries: Column, fields: list[str]) -> Column:
    """(field, item) for every field; of several entries for one field the last counts."""
    held = F.array(*(F.struct(F.lit(f).alias("field")) for f in fields))
    last = lambda x: F.try_element_at(F.filter(entries, lambda e: e["key"] == x["field"]), F.lit(-1))["value"]
    return F.transform(held, lambda x: F.struct(x["field"].alias("field"), T.let(last(x), _item).alias("item")))


def _entries(body: Column) -> Column:
    return F.map_entries(F.from_json(body, "map<string,variant>"))


def llm_record(raw: Column, fields: list[str] = R.FIELDS) -> Column:
    """(fields, warnings) of a model's answer; null if it holds no JSON object with a known field.

    Fences and what stands around the outermost braces go; a list of one is its element; the first container that holds an
    object is unwrapped; fields and values count under their other names too. `fields` is an array of (field, value,
    confidence, evidence_span) in the order of the names.
    """
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))

    def of_body(body: Column) -> Column:
        listed = F.coalesce(F.json_array_length(body) == 1, F.lit(False))
        return T.let(F.when(listed, F.get_json_object(body, "$[0]")).otherwise(body), of_object)

    def of_object(body: Column) -> Column:
        def of_whole(whole: Column) -> Column:
            inner = F.coalesce(*(F.when(_is(_at(whole, c), "OBJECT"), F.get_json_object(body, f"$.{c}")) for c in CONTAINERS), body)
            return T.let(F.when(_is(whole, "OBJECT"), F.transform(_entries(inner), named)), of_entries)

        return T.let(F.try_parse_json(body), of_whole)

    def named(e: Column) -> Column:
        return F.struct(F.coalesce(F.try_element_at(names, e["key"]), F.try_element_at(names, F.lower(e["key"])), e["key"]).alias("key"), e["value"].alias("value"))

    def of_entries(entries: Column) -> Column:
        known = F.exists(entries, lambda e: e["key"].isin(fields))
        return F.when(known, T.let(_items(entries, fields), validated))

    return T.let(answer_body(raw), of_body)


def answer_body(raw: Column) -> Column:
    """The JSON of an answer as text: all of it without fences, or from the first opening to the last closing brace; null if neither is JSON."""

    def of_bare(bare: Column) -> Column:
        braces = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
        return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(braces).isNotNull(), braces)

    return T.let(F.regexp_replace(T.clean(raw), r"(?i)^```[a-z]*\s*|\s*```$", ""), of_bare)


def _texts(v: Column) -> Column:
    """A list's items as clean texts, blanks left out; a text counts as a list of one, other values as none."""
    listed = F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(_is(v, "STRING"), F.array(v))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<variant>")), plain), lambda x: x != "")


def vision_answer(raw: Column, fields: list[str] = R.FIELDS) -> Column:
    """(transcriptions, full_transcription, fields, warnings, observations) of a vision model's answer; null without a JSON object.

    A lone transcription counts as a list of one, a text as one without uncertain spans; other items are left out, but count
    in the numbering. `transcriptions` is an array of (image_index, text, uncertain_spans).
    """

    def one(x: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        whole = F.struct(F.coalesce(plain(F.when(_at(x, "image_index").isNotNull(), _at(x, "image_index"))), number).alias("image_index"), plain(_at(x, "text")).alias("text"), _texts(_at(x, "uncertain_spans")).alias("uncertain_spans"))
        indexed = F.struct(F.when(_at(x, "image_index").isNull(), number).otherwise(whole["image_index"]).alias("image_index"), whole["text"].alias("text"), whole["uncertain_spans"].alias("uncertain_spans"))
        bare = F.struct(number.alias("image_index"), plain(x).alias("text"), F.array().cast("array<string>").alias("uncertain_spans"))
        return F.when(_is(x, "OBJECT"), indexed).when(_is(x, "STRING"), bare)

    def of_body(body: Column) -> Column:
        return T.let(F.try_parse_json(body), lambda v: F.when(_is(v, "OBJECT"), of_object(v, body)))

    def of_object(v: Column, body: Column) -> Column:
        said = _at(v, "transcriptions")
        listed = F.coalesce(F.when(_is(said, "ARRAY"), F.try_variant_get(said, "$", "array<variant>")).when(_is(said, "OBJECT"), F.array(said)), F.array().cast("array<variant>"))
        parts = F.filter(F.transform(listed, one), lambda x: x.isNotNull())
        entries = F.when(_is(_at(v, "fields"), "OBJECT"), _entries(F.get_json_object(body, "$.fields")))
        items = T.let(F.coalesce(entries, F.map_entries(F.create_map().cast("map<string,variant>"))), lambda e: _items(e, fields))
        made = T.let(F.struct(parts.alias("parts"), items.alias("items")), lambda m: F.struct(m["parts"].alias("parts"), validated(m["items"]).alias("record")))

        def out(m: Column) -> Column:
            text = F.array_join(F.filter(F.transform(m["parts"], lambda x: x["text"]), lambda x: x != ""), "\n\n")
            return F.struct(m["parts"].alias("transcriptions"), text.alias("full_transcription"), m["record"]["fields"].alias("fields"), m["record"]["warnings"].alias("warnings"), _texts(_at(v, "observations")).alias("observations"))

        return T.let(made, out)

    return T.let(answer_body(raw), of_body)


def flat(record: Column, fields: list[str] = R.FIELDS) -> list[Column]:
    """A record as columns: value, confidence and evidence of each field, and its warnings joined; blanks and 0 without a record."""
    at = lambda i, name, none: F.coalesce(F.get(record["fields"], F.lit(i))[name], none)
    blank, zero = F.lit(""), F.lit(0.0)
    columns = [c for i, f in enumerate(fields) for c in (at(i, "value", blank).alias(f), at(i, "confidence", zero).alias(f"{f}_confidence"), at(i, "evidence_span", blank).alias(f"{f}_evidence_span"))]
    return [*columns, F.coalesce(F.array_join(record["warnings"], ";"), blank).alias("validation_warnings")]


def flat_reconciled(fields: Column, names: list[str] = R.FIELDS) -> list[Column]:
    """Seven columns a field from a map of name to (value, source, span, supporting, alternatives, confidence, review); lists as JSON."""

    def of(f: str) -> list[Column]:
        at = lambda name: F.try_element_at(fields, F.lit(f))[name]
        listed = lambda name: F.coalesce(F.to_json(at(name)), F.lit("[]"))
        return [
            T.clean(at("value")).alias(f), T.clean(at("source")).alias(f"{f}_evidence_source"), T.clean(at("span")).alias(f"{f}_evidence_span"), listed("supporting").alias(f"{f}_supporting_sources"),
            listed("alternatives").alias(f"{f}_alternative_candidates"), F.coalesce(at("confidence"), F.lit(0.0)).alias(f"{f}_model_reported_confidence"), F.coalesce(at("review"), F.lit(False)).alias(f"{f}_review_required"),
        ]

    return [c for f in names for c in of(f)]


def parsed_box(c: Column) -> Column:
    """Four whole corners from a text like [x0, y0, x1, y1], halves to even; zeros for anything else."""
    numbers = F.from_json(c, "array<double>")
    good = (F.size(numbers) == 4) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(F.coalesce(good, F.lit(False)), F.transform(numbers, lambda x: F.bround(x, 0).cast("int"))).otherwise(F.array(*[F.lit(0)] * 4))


def detections(c: Column) -> Column:
    """The boxes of a detector's JSON (boxes, scores, labels: lists of one length), the surest first, as (label, confidence, box)."""
    v = F.from_json(c, "boxes array<array<double>>, scores array<double>, labels array<string>")
    rows = F.transform(F.arrays_zip(v["boxes"], v["scores"], v["labels"]), lambda x: F.struct((-F.coalesce(x["scores"], F.lit(0.0))).alias("order"), F.coalesce(x["labels"], F.lit("")).alias("label"), F.coalesce(x["scores"], F.lit(0.0)).alias("confidence"), F.transform(x["boxes"], lambda n: F.bround(n, 0).cast("int")).alias("box")))
    return F.transform(F.array_sort(F.coalesce(rows, F.array().cast("array<struct<order:double,label:string,confidence:double,box:array<int>>>"))), lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence"), x["box"].alias("box")))
