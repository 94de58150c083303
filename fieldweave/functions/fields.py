"""Rules by field: normal forms, scores, evidence variants, identifier shapes, gates and record structs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Field names, words for true and false, labels, roles, thresholds, patterns and shapes, and months.
FIELDS = ["catalogNumber", "scientificName", "recordedBy", "eventDate", "country", "stateProvince", "decimalLatitude", "decimalLongitude", "typeStatus"]
COORDINATES = ["decimalLatitude", "decimalLongitude"]
FALSE_WORDS = ["", "0", "false", "f", "no", "n", "none", "nan"]
LABEL_ALIASES = {
    "full_database_label": "database_label", "partial_database_label": "database_label", "database_number": "number",
    "specimen_label": "primary_specimen_label", "primary_label": "primary_specimen_label", "type": "type_label",
}
ROLES = {
    "primary_specimen_label": "primary_label", "printed_label": "primary_label", "database_label": "identifier_parent", "barcode": "identifier_child", "number": "identifier_child",
    "annotation_label": "annotation", "handwritten_data": "annotation", "type_label": "annotation", "stamp": "annotation",
}
THRESHOLDS = {
    "primary_specimen_label": 0.08, "printed_label": 0.10, "database_label": 0.10, "barcode": 0.08, "number": 0.05,
    "annotation_label": 0.10, "handwritten_data": 0.08, "type_label": 0.08, "stamp": 0.08,
}
ROLE_BONUS = {"identifier_child": 18.0, "identifier_parent": 12.0, "primary_label": 15.0, "annotation": 8.0}
IDENTIFIER_PATTERNS = [r"\b([A-Z]{1,5}\d{5,})\b", r"\b([A-Z]{1,4}[- ]?\d{5,})\b"]
DATE_PATTERNS = [r"\b(\d{4}-\d{2}-\d{2})\b", r"\b(\d{4}-\d{2})\b", r"\b(18\d{2}|19\d{2}|20\d{2})\b"]
LATITUDE_PATTERNS = [r"lat(?:itude)?\s*[:=]?\s*(-?\d{1,2}\.\d+)", r"\b(-?\d{1,2}\.\d+)\s*,\s*-?\d{1,3}\.\d+"]
LONGITUDE_PATTERNS = [r"lon(?:gitude)?\s*[:=]?\s*(-?\d{1,3}\.\d+)", r"\b-?\d{1,2}\.\d+\s*,\s*(-?\d{1,3}\.\d+)"]
STRICT_IDENTIFIER, LOOSE_IDENTIFIER = r"[A-Z]{1,4}\d{5,12}", "[A-Z0-9]{6,16}"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "sept"]


def truthy(c: Column, strict_words: list[str] | None = None) -> Column:
    """A textual flag: false for null and FALSE_WORDS, else true; with `strict_words`, true for those words only."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return low.isin(strict_words) if strict_words else ~low.isin(FALSE_WORDS)


def number(c: Column, cleaned: bool = False) -> Column:
    return (c if cleaned else T.clean(c)).try_cast("double")


def normal_value(field: Column, value: Column, cleaned: bool = False) -> Column:
    """The normal form of a value, by its field; `cleaned`: the value has been through clean() already."""
    decimal = F.regexp_replace(F.format_string("%.8f", number(value, cleaned)), r"\.?0+$", "")
    return (
        F.when(field == "catalogNumber", T.identifier_key(value, cleaned))
        .when(field == "eventDate", T.event_date(value, cleaned))
        .when(field == "recordedBy", T.person_key(value, cleaned))
        .when(field == "typeStatus", T.type_status(value, cleaned))
        .when(field.isin(COORDINATES) & number(value, cleaned).isNotNull(), decimal)
        .otherwise(T.normalize_eval(value, cleaned))
    )


def exact_of(field: Column, pred: Column, gold: Column, p: Column, g: Column, tolerance: float = 1e-4) -> Column:
    """1 if the normal forms `p` and `g` are equal; coordinates may differ by `tolerance`."""
    # The field is asked first: a text that is no number costs more to cast than all else here.
    both = field.isin(COORDINATES) & number(pred).isNotNull() & number(gold).isNotNull()
    return F.when(both, F.abs(number(pred) - number(gold)) <= tolerance).otherwise(p == g).cast("int")


def f1_of(field: Column, exact: Column, p: Column, g: Column) -> Column:
    """Exact match for identifiers, coordinates and type status; else F1 of the words of the normal forms."""
    # Bags are made once a pair, and only of forms that differ: inside bag_f1 they would be made again for each word.
    words = T.let(F.struct(bag(p).alias("p"), bag(g).alias("g")), lambda s: bag_f1(s["p"], s["g"]))
    return F.when(field.isin("catalogNumber", "typeStatus", *COORDINATES), exact.cast("double")).when(p == g, 1.0).otherwise(words)


def field_exact(field: Column, pred: Column, gold: Column) -> Column:
    return exact_of(field, pred, gold, normal_value(field, pred), normal_value(field, gold))


def bag_f1(p: Column, g: Column) -> Column:
    """F1 of the overlap of two bags of words; both empty 1, one empty 0."""
    many = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(many(p, w), many(g, w)))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def bag(normal: Column) -> Column:
    """Words of a normal form; the parts of an interval are words of their own."""
    return F.filter(F.split(F.replace(normal, F.lit("/"), F.lit(" ")), " "), lambda w: w != "")


def _looked_up(table: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), default)


def component_type(label: Column) -> Column:
    """A label in snake case, by its usual name."""
    flat = F.btrim(F.translate(F.lower(T.clean(label)), ":\t\n\x0b\f\r", " " * 6), F.lit(" "))
    # A pattern costs more than all else here, and few labels have two blanks in a row.
    single = F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat)
    snake = F.replace(single, F.lit(" "), F.lit("_"))
    return _looked_up(LABEL_ALIASES, snake, snake)


def component_role(label: Column) -> Column:
    return role_of(component_type(label))


def role_of(kind: Column) -> Column:
    """The role of a component_type()."""
    return _looked_up(ROLES, kind, F.lit("other"))


def plausible_identifier(c: Column) -> Column:
    key = T.identifier_key(c)
    return F.length(key).between(5, 24) & key.rlike("[A-Z]") & key.rlike("[0-9]")


def shape_score(c: Column, prefixes: list[str]) -> Column:
    """How much a value looks like an identifier, of an institution with `prefixes` if there are any."""
    key = T.identifier_key(c)
    shape = F.when(key.rlike(f"^{STRICT_IDENTIFIER}$"), 35.0).when(key.rlike(f"^{LOOSE_IDENTIFIER}$"), 10.0).otherwise(-20.0)
    own = F.lit(0.0)
    if prefixes:
        any_of = "|".join(prefixes)
        own = F.when(key.rlike(rf"^(?:{any_of})\d{{5,12}}$"), 80.0).when(key.rlike(f"^(?:{any_of})"), 25.0).otherwise(-25.0)
    wordy = F.when(F.size(F.split(F.regexp_replace(T.clean(c), r"\s+", " "), " ")) > 2, -30.0).otherwise(0.0)
    return F.when(plausible_identifier(c), shape + own + wordy).otherwise(-100.0)


def identifier_lines(text: Column) -> Column:
    """The different lines that may be identifiers, in order: squeezed, without outer punctuation, of 5 to 24 letters and digits with a digit."""
    squeezed = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(T.clean(x), r"\s+", " "), r"^[ .,:;|_\-]+|[ .,:;|_\-]+$", ""))
    key = lambda x: T.identifier_key(x)
    return F.array_distinct(F.filter(squeezed, lambda x: F.length(key(x)).between(5, 24) & key(x).rlike("[0-9]")))


def pattern_score(key: Column) -> Column:
    mixed = F.when(key.rlike("[A-Z]") & key.rlike("[0-9]"), 2).otherwise(0)
    return mixed + F.when(F.length(key).between(7, 16), 1).otherwise(0) + F.when(key.rlike("^[A-Z]"), 1).otherwise(0) - F.when(key.rlike("^[0-9]+$"), 2).otherwise(0)


def looks_like_binomial(c: Column) -> Column:
    return T.clean(c).rlike(r"^[A-Z][a-zA-Z\-]+\s+[a-z][a-zA-Z\-]+(?:\s|$)")


def evidence_variants(field: Column, value: Column) -> Column:
    """Ways in which a value may stand in evidence, as keys of letters and digits; of a date also by day, month and year."""
    plain = T.clean(value)
    part = lambda k: F.regexp_extract(plain, r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?$", k)
    year, month, day = part(1), part(2), part(3)
    name = F.coalesce(F.get(F.array(*map(F.lit, MONTHS)), month.try_cast("int") - 1), F.lit(""))
    dated = F.when(day != "", F.array(F.concat(day, month, year), F.concat(day, name, year), F.concat(name, day, year))).otherwise(F.array(F.concat(name, year)))
    own = F.array(T.alnum_key(plain))
    known = (field == "eventDate") & (month != "") & (name != "")
    return F.filter(F.array_distinct(F.when(known, F.concat(own, dated)).otherwise(own)), lambda x: x != "")


def evidence_hit(field: Column, value: Column, evidence: Column) -> Column:
    key = T.alnum_key(T.clean(evidence))
    return (key != "") & F.exists(evidence_variants(field, value), lambda v: F.contains(key, v))


def date_part_hit(part: str, text: Column, iso: Column) -> Column:
    """Whether the words of the text hold the year, month or day of an ISO date; null without one."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+|[0-9]+)"), 1)
    at = lambda k: F.regexp_extract(F.coalesce(iso, F.lit("")), r"^(\d{4})-(\d{2})-(\d{2})$", k)
    name = F.get(F.array(*map(F.lit, MONTHS)), at(2).try_cast("int") - 1)
    plain = lambda k: at(k).try_cast("int").cast("string")
    found = {
        "year": F.array_contains(tokens, at(1)),
        "month": F.exists(tokens, lambda x: (x == at(2)) | (x == plain(2)) | F.coalesce(F.substring(x, 1, 3) == name, F.lit(False)) & x.isin(MONTHS + MONTH_NAMES)),
        "day": F.array_contains(tokens, at(3)) | F.array_contains(tokens, plain(3)),
    }[part]
    return F.when(at(1) != "", found)


def region_reading(region: Column, text: Column, source: Column) -> Column:
    """Verdict on the reading of a day, month or year region; a year must agree with those of the source, if it has any."""
    tokens = F.regexp_extract_all(T.clean(text), F.lit(r"([A-Za-z]+|\d+)"), 1)
    numbers = F.transform(F.filter(tokens, lambda x: x.rlike("^[0-9]+$")), lambda x: x.try_cast("long"))
    years = F.filter(tokens, lambda x: x.rlike("^[0-9]{4}$"))
    in_range = lambda x: x.try_cast("int").between(1500, 2100)
    others = F.filter(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(r"(\d{4})"), 1), in_range)
    months = [*MONTHS, *MONTH_NAMES, *map(str, range(1, 13)), *(f"{m:02d}" for m in range(1, 10))]
    year = F.when((F.size(years) != 1) | ~F.coalesce(in_range(F.get(years, F.lit(0))), F.lit(False)), "implausible_year").when((F.size(others) > 0) & ~F.array_contains(others, F.get(years, F.lit(0))), "year_conflicts_with_tesseract")
    return (
        F.when(T.clean(text) == "", "empty_output")
        .when(region == "day", F.when((F.size(numbers) == 1) & F.coalesce(F.get(numbers, F.lit(0)).between(1, 31), F.lit(False)), "plausible_day").otherwise("implausible_day"))
        .when(region == "month", F.when((F.size(tokens) == 1) & F.coalesce(F.lower(F.get(tokens, F.lit(0))).isin(months), F.lit(False)), "plausible_month").otherwise("implausible_month"))
        .when(region == "year", year.otherwise("plausible_year"))
        .otherwise("unsupported_region_type")
    )


def gate_reason(image_path: Column, eligible: Column, prompt: Column, minimum: int = 1) -> Column:
    """Why a record isn't sent to a model; blank if it is."""
    return (
        F.when(T.clean(image_path) == "", "image_unavailable")
        .when(F.lower(F.coalesce(eligible, F.lit("true"))).isin("false", "0", "no"), "image_not_paired_eligible")
        .when(T.clean(prompt) == "", "empty_ocr_evidence")
        .when(F.length(F.regexp_replace(T.clean(prompt), "[^A-Za-z0-9]+", "")) < minimum, "insufficient_ocr_evidence")
        .otherwise("")
    )


def evidence_gate(label: Column, confidence: Column, text: Column, decoded: Column, vision_only: float = 0.20) -> Column:
    """Why a region is taken or left out."""
    return gate_of(component_type(label), component_role(label), confidence, text, decoded, vision_only)


def gate_of(kind: Column, role: Column, confidence: Column, text: Column, decoded: Column, vision_only: float = 0.20) -> Column:
    """evidence_gate() of a region whose kind and role are known."""
    sure = F.coalesce(confidence, F.lit(0.0))
    return (
        F.when(role == "other", "unsupported_component_type")
        .when(sure < _looked_up(THRESHOLDS, kind, F.lit(0.10)), "below_class_threshold")
        .when((T.clean(text) != "") | (T.clean(decoded) != ""), "direct_text_evidence")
        .when(role.isin("primary_label", "annotation") & (sure >= vision_only), "vision_only_high_confidence")
        .otherwise("empty_evidence")
    )


def utility(label: Column, detector: Column, confidence: Column, text: Column, decoded: Column, sharpness: Column, area: Column) -> Column:
    """What a region is worth to a packet of evidence."""
    role, plain, code = component_role(label), T.clean(text), T.clean(decoded)
    gain = lambda when, x: F.when(when, x).otherwise(0.0)
    score = F.coalesce(confidence, F.lit(0.0)) * 100 + F.least(F.length(plain), F.lit(160)) / 8.0 + F.least(F.coalesce(sharpness, F.lit(0.0)) / 250.0, F.lit(12.0))
    score = score + gain(plain != "", 18.0) + gain(code != "", 70.0) + gain(plausible_identifier(F.when(code != "", code).otherwise(plain)), 35.0) + _looked_up(ROLE_BONUS, role, F.lit(0.0))
    score = score + gain((detector == "hespi") & role.isin("primary_label", "annotation"), 12.0) + gain((detector == "yoloe26") & role.startswith("identifier"), 8.0)
    return F.round(score - F.when(area > 0.60, 35.0).when((area > 0.40) & (role != "primary_label"), 20.0).otherwise(0.0), 6)


def make_field(value: Column, confidence: Column, span: Column | None = None) -> Column:
    """A field struct: clean value, confidence between 0 and 1, and the evidence, by default the value."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.try_cast("double"), F.lit(0.0))))
    return F.struct(T.clean(value).alias("value"), sure.alias("confidence"), T.clean(F.coalesce(span, value) if span is not None else value).alias("evidence_span"))


def record_warnings(confidences: dict[str, Column], latitude: Column, longitude: Column) -> Column:
    """Warnings on a record, joined by semicolons: bad confidences by field, then coordinates."""
    found = []
    for field, c in confidences.items():
        value = c.try_cast("double")
        found += [F.when(c.isNotNull() & value.isNull(), f"bad_confidence:{field}"), F.when((value < 0) | (value > 1), f"confidence_out_of_range:{field}")]
    for field, c, limit in (("decimalLatitude", latitude, 90), ("decimalLongitude", longitude, 180)):
        found += [F.when((T.clean(c) != "") & number(c).isNull(), f"{field}_not_numeric"), F.when(F.abs(number(c)) > limit, f"{field}_out_of_range")]
    return F.concat_ws(";", *found)


def node_id(kind: str, value: Column) -> Column:
    """A node's name: its kind and twelve digits of a digest of kind and clean lower-case value."""
    return F.concat(F.lit(f"{kind.lower()}_"), F.substring(F.md5(F.concat(F.lit(f"{kind}:"), F.lower(T.clean(value)))), 1, 12))


def clamped_box(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> Column:
    """A box within the image, of one pixel at least, as fractions of its sides."""
    left, top = F.greatest(F.lit(0), F.least(x0, F.lit(width - 1))), F.greatest(F.lit(0), F.least(y0, F.lit(height - 1)))
    right, bottom = F.greatest(left + 1, F.least(x1, F.lit(width))), F.greatest(top + 1, F.least(y1, F.lit(height)))
    return F.array(*(F.round(c / n, 6) for c, n in ((left, width), (top, height), (right, width), (bottom, height))))


def tile_starts(length: Column, tile: int, overlap: float) -> Column:
    """Where the tiles along a side start; the last one is flush with the edge."""
    stride = max(1, int(round(tile * (1 - overlap))))
    last = length - tile
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long"), F.lit(stride).cast("long"))
    return F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(steps, F.array(last.cast("long")))))


def identifier_in(text: Column) -> Column:
    """The first identifier of a text without blanks and hyphens; blank if there is none."""
    return F.regexp_replace(T.first_match(text, IDENTIFIER_PATTERNS), "[ -]", "")


def date_in(text: Column) -> Column:
    """The first date, month or year of a text; blank if there is none."""
    return T.first_match(text, DATE_PATTERNS)


def coordinates(text: Column) -> Column:
    """(latitude, longitude) of a text: named ones, a pair with a comma, or the first two neighbouring numbers in range."""
    first = lambda patterns: T.first_match(text, patterns)
    lat, lon = first(LATITUDE_PATTERNS), first(LONGITUDE_PATTERNS)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d{1,3}\.\d+)"), 1), lambda x: x.cast("double"))
    pairs = F.zip_with(numbers, F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.get(F.filter(pairs, lambda p: p["a"].between(-90, 90) & p["b"].between(-180, 180)), F.lit(0))
    use = ((lat == "") | (lon == "")) & found.isNotNull()
    return F.struct(F.when(use, found["a"].cast("string")).otherwise(lat).alias("latitude"), F.when(use, found["b"].cast("string")).otherwise(lon).alias("longitude"))


def canonical_country(text: Column, countries: list[str]) -> Column:
    """The first of the countries that stands in the text as a word; blank if none does."""
    return F.coalesce(*(F.when(text.rlike(rf"(?i)\b{c}\b"), c) for c in countries), F.lit(""))
