"""Choice of a record's regions for a packet of evidence: gate, duplicates, quotas, and the tables that compare ways of choosing.

Regions have record, id, label, text, decoded, x0, y0, x1, y1 (whole corners), utility and, if they have masks, overlaps
(map of region id to mask overlap). The regions of one record meet in one row when duplicates are settled: a record is a
sheet with some hundred regions at most. All else is joins by record and partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as R
from ..functions import similarity
from ..functions import text as T
from . import geometry

# Thresholds of duplicates, quotas by role in the order of choice, and fields whose evidence is counted.
IOU, CONTAINED, ALIKE, TOUCHING, SAME_PLACE = 0.45, 0.85, 0.85, 0.25, 0.75
QUOTAS = {"primary_label": 2, "identifier_child": 3, "identifier_parent": 2, "annotation": 2}
TOTAL = 8
EVIDENCE_FIELDS = R.FIELDS
BOX = ["x0", "y0", "x1", "y1"]


def reading(decoded: Column, text: Column) -> Column:
    """What a region says: its decoded code, else its text."""
    return F.when(T.clean(decoded) != "", T.clean(decoded)).otherwise(T.clean(text))


def _order(regions: DataFrame) -> list[Column | str]:
    """By utility, then id; equal ones by all else that decides on them, so that every run has one order."""
    rest = [c for c in ("confidence", "masks") if c in regions.columns]
    # Overlaps are read from masks where both are there.
    overlaps = [F.array_sort(F.map_entries("overlaps"))] if "overlaps" in regions.columns and "masks" not in regions.columns else []
    return [F.desc("utility"), "id", *BOX, "label", "text", "decoded", *rest, *overlaps]


def placed(regions: DataFrame, *by: str) -> DataFrame:
    """Regions with their place in a record (and value of `by`)."""
    return regions.withColumn("place", F.row_number().over(Window.partitionBy("record", *by).orderBy(*_order(regions))))


def _roles(regions: DataFrame) -> DataFrame:
    """Regions with kind and role, worked out once a region."""
    return regions.withColumn("kind", R.component_type(F.col("label"))).withColumn("role", R.role_of(F.col("kind")))


def _overlapping(regions: DataFrame, order: list[Column | str], *by: str, of: Column | None = None) -> DataFrame:
    """record, *by, a, b, at: the regions (of those that `of` holds for) with each of those before them that they overlap, or whose masks do by name.

    A region meets those before it in its own row, by one pass over the ordered regions of a record.
    """
    key = T.alnum_key(reading(F.col("decoded"), F.col("text")))
    overlaps = F.col("overlaps") if "overlaps" in regions.columns else F.lit(None).cast("map<string,double>")
    rows = regions.withColumns({"key": key, "overlaps": overlaps, "area": geometry.area({c: F.col(c) for c in BOX})})
    window = Window.partitionBy("record", *by).orderBy(*order)
    one = ["id", "role", "key", *BOX, "area", "overlaps"]
    met = rows.withColumn("place", F.row_number().over(window)).withColumn("before", F.collect_list(F.struct(*one)).over(window.rowsBetween(Window.unboundedPreceding, -1)))
    before = F.col("before") if of is None else F.when(of, F.col("before"))
    pairs = met.select("record", *by, F.struct("place", *one).alias("a"), F.posexplode(before).alias("at", "b"))
    return pairs.filter(geometry.touching(F.col("a"), F.col("b")) | (_mask(F.col("a"), F.col("b")) > 0))


def _mask(a: Column, b: Column) -> Column:
    of = lambda x, y: F.coalesce(F.try_element_at(x["overlaps"], y["id"]).try_cast("double"), F.lit(0.0))
    return F.greatest(of(a, b), of(b, a))


def _only(rows: DataFrame, when: Column, *columns: str) -> DataFrame:
    """The columns of the rows that `when` holds for: as a generator, since a filter is pushed below, where all it asks for is
    worked out again, in a method too long for the JVM to compile."""
    return rows.select(F.inline(F.when(when, F.array(F.struct(*columns)))))


def duplicate_pairs(regions: DataFrame, order: list[Column | str] | None = None, *by: str, of: Column | None = None) -> DataFrame:
    """record, *by, place, earlier (place), earlier_id, reason, turned: pairs of a record's regions one of which duplicates the other.

    `reason` is why the later one would go for the earlier one (null if it would not), `turned` whether the earlier one would
    if they came the other way round: texts are compared in order. Regions have their role. Texts are compared only where
    boxes and lengths leave it open.
    """
    a, b = F.col("a"), F.col("b")
    pairs = _overlapping(regions, order or _order(regions), *by, of=of)
    pairs = pairs.select(
        "record", *by, a["place"].alias("place"), (F.col("at") + 1).alias("earlier"), b["id"].alias("earlier_id"), a["role"].alias("role"), b["role"].alias("role_before"), a["key"].alias("key"), b["key"].alias("key_before"),
        geometry.intersection(a, b).alias("shared"), F.least(a["area"], b["area"]).alias("smaller"), (a["area"] + b["area"]).alias("areas"), _mask(a, b).alias("mask"),
    )
    roles = lambda x, y: (F.col("role") == x) & (F.col("role_before") == y)
    same_role = F.col("role") == F.col("role_before")
    family = roles("identifier_parent", "identifier_child") | roles("identifier_child", "identifier_parent")
    label = ~same_role & ((F.col("role") == "primary_label") | (F.col("role_before") == "primary_label"))
    part = lambda n: F.when(n > 0, F.col("shared") / n).otherwise(0.0)
    pairs = pairs.withColumns({"iou": part(F.col("areas") - F.col("shared")), "contained": part(F.col("smaller")), "apart": F.coalesce(family | label, F.lit(False)), "same_role": same_role})
    one_place = F.col("same_role") & ((F.col("iou") >= IOU) | (F.col("contained") >= CONTAINED) | (F.col("mask") >= IOU))
    pairs = pairs.withColumns({"one_place": one_place, "near": (F.col("contained") >= CONTAINED) | (F.col("iou") >= TOUCHING), "on_top": F.col("iou") >= SAME_PLACE})
    compare = ~F.col("one_place") & F.col("near") & (F.col("key") != "") & (F.col("key_before") != "")
    pairs = pairs.withColumn("compare", compare)
    pairs = _only(pairs, ~F.col("apart") & (F.col("one_place") | F.col("compare") | F.col("on_top")), "record", *by, "place", "earlier", "earlier_id", "key", "key_before", "one_place", "compare", "on_top")
    size, size_before = F.length("key"), F.length("key_before")
    # Equal short texts are alike; where one is much longer, no blocks make them so.
    pairs = pairs.withColumn("equal", (F.col("key") == F.col("key_before")) & (size < similarity.POPULAR_FROM))
    open_ = F.col("compare") & ~F.col("equal") & (2.0 * F.least(size, size_before) / (size + size_before) >= ALIKE)
    pairs = pairs.withColumn("open", open_)
    x, y = F.when(F.col("open"), F.col("key")), F.when(F.col("open"), F.col("key_before"))
    pairs = pairs.withColumns({"ratio": similarity.matching_ratio(x, y), "ratio_turned": similarity.matching_ratio(y, x)})
    alike = lambda ratio: F.col("compare") & (F.col("equal") | (F.coalesce(ratio, F.lit(0.0)) >= ALIKE))
    reason = F.when(F.col("one_place"), "same_role_geometry_duplicate").when(alike(F.col("ratio")), "same_text_cross_class_duplicate").when(F.col("on_top"), "high_iou_class_conflict")
    pairs = pairs.select("record", *by, "place", "earlier", "earlier_id", reason.alias("reason"), (F.col("one_place") | F.col("on_top") | alike(F.col("ratio_turned"))).alias("turned"))
    return pairs.filter(F.col("reason").isNotNull() | F.col("turned"))


def settled(pairs: DataFrame) -> DataFrame:
    """record, pairs, gone (map of place to reason and of): the regions that go. In order of place, a region goes if it duplicates one that stayed; the first such one is named."""
    held = pairs.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("place", "earlier", "reason", "earlier_id", "turned"))).alias("pairs"))
    start = F.create_map().cast("map<int,struct<reason:string,of:string>>")

    def settle(out: Column, p: Column) -> Column:
        stays = p["reason"].isNull() | F.map_contains_key(out, p["place"]) | F.map_contains_key(out, p["earlier"])
        return F.when(stays, out).otherwise(F.map_concat(out, F.create_map(p["place"], F.struct(p["reason"].alias("reason"), p["earlier_id"].alias("of")))))

    return held.select("record", "pairs", F.aggregate("pairs", start, settle).alias("gone"))


def deduplicated(regions: DataFrame) -> DataFrame:
    """The regions with `place`, `duplicate_reason` and `duplicate_of`; the last two are blank for those that stay."""
    # Joined by record alone, by which both sides are dealt already.
    done = placed(regions).join(settled(duplicate_pairs(_roles(regions), _order(regions))).drop("pairs"), "record", "left")
    why = done.withColumn("why", F.try_element_at("gone", F.col("place"))).drop("gone")
    return why.withColumn("duplicate_reason", F.coalesce("why.reason", F.lit(""))).withColumn("duplicate_of", F.coalesce("why.of", F.lit(""))).drop("why")


def choose(regions: DataFrame, branch: str, deduplicate: bool, quotas: dict[str, int] | None = None, total: int = TOTAL, vision_only: float = 0.20) -> DataFrame:
    """Every region with what a branch decides on it: branch, selection_status, selection_reason, duplicate_of, input_order (null unless selected).

    First the evidence gate, then duplicates (if asked for), then the best of each role and the best of the rest within quotas.
    """
    return choose_each(regions, {branch: deduplicate}, quotas, total, vision_only)


def choose_each(regions: DataFrame, branches: dict[str, bool], quotas: dict[str, int] | None = None, total: int = TOTAL, vision_only: float = 0.20, with_pairs: bool = False) -> DataFrame:
    """choose() for several branches at once (name: deduplicate or not). Regions dealt by record travel no more.

    `with_pairs` adds what tables() else finds again: place, and pairs, the record's duplicates among the regions that pass.
    """
    quotas = quotas or QUOTAS
    judged = _roles(regions)
    judged = judged.withColumn("gate", R.gate_of(F.col("kind"), F.col("role"), F.col("confidence"), F.col("text"), F.col("decoded"), vision_only)).drop("kind")
    judged = judged.withColumn("passes", F.col("gate").isin("direct_text_evidence", "vision_only_high_confidence"))
    order = _order(regions)
    # Places count those that pass apart from those that don't.
    done = judged.withColumn("place", F.row_number().over(Window.partitionBy("record", "passes").orderBy(*order)))
    # Branches without duplicates settled keep them all.
    if with_pairs or any(branches.values()):
        done = done.join(settled(duplicate_pairs(judged, order, "passes", of=F.col("passes"))), "record", "left")
        done = done.withColumn("why", F.when(F.col("passes"), F.try_element_at("gone", F.col("place")))).drop("gone")
    else:
        done = done.withColumn("why", F.lit(None).cast("struct<reason:string,of:string>"))
    # By utility and place is by place; running counts along it do for every role and branch, without another order.
    along = Window.partitionBy("record", "passes").orderBy("place")
    so_far, whole = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = {r: n for r, n in quotas.items() if n > 0}
    ways = sorted(set(branches.values()))
    name = lambda c, way: f"_{c}_{int(way)}"
    at = lambda c, way: F.col(name(c, way))
    single = {w: (F.col("passes") & F.col("why").isNull()) if w else F.col("passes") for w in ways}
    done = done.withColumns({name("single", w): single[w] for w in ways})
    is_role = lambda w, r: at("single", w) & (F.col("role") == r)
    counts = {name(f"n{i}", w): F.count_if(is_role(w, r)).over(so_far) for w in ways for i, r in enumerate(wanted)}
    held = {name(f"has{i}", w): F.count_if(is_role(w, r)).over(whole) > 0 for w in ways for i, r in enumerate(wanted)}
    done = done.withColumns(counts | held)
    one_of = lambda xs: F.coalesce(*(F.when(F.col("role") == r, x) for r, x in zip(wanted, xs, strict=True)), F.lit(0))
    in_role = {w: one_of([at(f"n{i}", w) for i in range(len(wanted))]) for w in ways}
    done = done.withColumns({name("in_role", w): F.when(at("single", w), in_role[w]).otherwise(0) for w in ways})
    within = {w: (at("in_role", w) > 0) & (at("in_role", w) <= one_of([F.lit(n) for n in wanted.values()])) for w in ways}
    done = done.withColumns({name("within", w): within[w] for w in ways})
    done = done.withColumns({name("more", w): F.count_if(at("within", w) & (at("in_role", w) > 1)).over(so_far) for w in ways})
    # The best of each role come first, in the order of the roles, then all others.
    roles_before = lambda w, i: sum((at(f"has{j}", w).cast("int") for j in range(i)), F.lit(0))
    first = {w: one_of([roles_before(w, i) + 1 for i in range(len(wanted))]) for w in ways}
    number = {w: F.when(at("in_role", w) == 1, first[w]).otherwise(roles_before(w, len(wanted)) + at("more", w)).cast("int") for w in ways}
    done = done.withColumns({name("order", w): F.when(at("within", w), F.when(number[w] <= max(total, 0), number[w])) for w in ways})

    def decision(w: bool) -> list[Column]:
        chosen = at("order", w).isNotNull()
        status = F.when(~F.col("passes"), "rejected_evidence").when(~at("single", w), "rejected_duplicate").when(chosen, "selected").otherwise("rejected_quota")
        reason = F.when(~F.col("passes"), F.col("gate")).when(~at("single", w), F.col("why.reason")).when(chosen, "diverse_role_utility").otherwise("role_or_total_quota")
        of = F.coalesce("why.of", F.lit("")) if w else F.lit("")
        return [status.alias("selection_status"), reason.alias("selection_reason"), of.alias("duplicate_of"), at("order", w).alias("input_order")]

    each = F.array(*(F.struct(F.lit(b).alias("branch"), *decision(w)) for b, w in branches.items()))
    return done.select(*regions.columns, "role", "gate", *(["place", "pairs"] if with_pairs else []), F.inline(each))


def _rate(n: Column, of: Column, digits: int) -> Column:
    return F.when(of > 0, F.round(n / of, digits)).otherwise(0.0)


def tables(decisions: DataFrame, references: DataFrame, fields: list[str] = EVIDENCE_FIELDS, branches: list[str] | None = None) -> dict[str, DataFrame]:
    """records, branches, fields, field_summary: how well the branches' selected regions cover what is known of each record.

    `references` has record and a column for each field; every branch counts every record of it, chosen from or not.
    Branches are those named, else all that decisions have. Decisions dealt by record travel no more; those with pairs
    (choose_each) are not compared again.
    """
    names = branches if branches is not None else [r["branch"] for r in decisions.select("branch").distinct().collect()]  # a handful
    chosen, paired = F.col("selection_status") == "selected", "pairs" in decisions.columns
    # Texts are worked out in a generator: inside an aggregate they would be interpreted, row by row.
    said = decisions.withColumn("said", F.when(chosen, reading(F.col("decoded"), F.col("text"))))
    one = F.struct(F.col("input_order").alias("order"), (F.col("place") if paired else F.lit(0)).alias("place"), F.when(F.col("said") != "", T.alnum_key(F.col("said"))).alias("key"))
    slim = said.select("record", "branch", "selection_status", *(["pairs"] if paired else []), F.inline(F.array(F.struct(F.when(chosen, one).alias("one"), (F.col("said") != "").alias("usable")))))
    refusals = ["rejected_evidence_count", "rejected_duplicate_count", "rejected_quota_count"]
    held = ["candidate_count", "evidence_accepted_count", *refusals, "input_image_count", "ocr_usable_crop_count"]
    packets = slim.groupBy("record").agg(
        *(F.count_if((F.col("branch") == b) & x).alias(f"{c}_{i}") for i, b in enumerate(names) for c, x in zip(held, (F.lit(True), F.col("selection_status") != "rejected_evidence", *(F.col("selection_status") == c.removesuffix("_count") for c in refusals), chosen, F.col("usable")), strict=True)),
        *(F.collect_list(F.when(F.col("branch") == b, F.col("one"))).alias(f"all_{i}") for i, b in enumerate(names)), *([F.first("pairs").alias("pairs")] if paired else []),
    )
    if not paired:
        twins = duplicate_pairs(decisions.filter(chosen), ["input_order"], "branch").filter("reason is not null")
        packets = packets.join(twins.groupBy("record").agg(*(F.count_if(F.col("branch") == b).alias(f"twins_{i}") for i, b in enumerate(names))), "record", "left")

    def twins_of(i: int) -> Column:
        """Of the record's pairs, those with both in the packet, judged in its order."""
        order = F.map_from_entries(F.transform(f"all_{i}", lambda x: F.struct(x["place"], x["order"])))

        def both(order: Column) -> Column:
            def held_by(p: Column) -> Column:
                later, earlier = F.try_element_at(order, p["place"]), F.try_element_at(order, p["earlier"])
                return F.coalesce(F.when(later > earlier, p["reason"].isNotNull()).when(later < earlier, p["turned"]), F.lit(False))

            return F.size(F.filter("pairs", held_by)).cast("long")

        return F.when(F.size("pairs") > 0, T.let(order, both))

    texts = lambda i: F.sort_array(F.col(f"all_{i}"))["key"]
    none = F.array(F.lit(""), F.lit(None).cast("string"))
    packet = lambda i, b: F.struct(
        F.lit(b).alias("branch"), *(F.coalesce(f"{c}_{i}", F.lit(0).cast("long")).alias(c) for c in held), F.greatest(F.size(F.array_except(texts(i), none)), F.lit(0)).cast("long").alias("unique_text_count"),
        F.coalesce(twins_of(i) if paired else F.col(f"twins_{i}"), F.lit(0).cast("long")).alias("selected_duplicate_pair_count"), F.coalesce(F.array_join(texts(i), "evidenceboundary"), F.lit("")).alias("evidence"),
    )
    # What a value may look like is worked out once a record; only dates have several forms.
    value = lambda f: f"value_{f}"
    form = lambda f: R.evidence_variants(F.lit(f), F.col(f)) if f == "eventDate" else T.alnum_key(T.clean(F.col(f)))
    wanted = references.select("record", *(T.clean(F.col(f)).alias(value(f)) for f in fields), *(form(f).alias(f"form_{f}") for f in fields))
    # By record alone, by which both sides are dealt.
    joined = wanted.join(packets, "record", "left")
    joined = joined.select(*wanted.columns, F.inline(F.array(*(packet(i, b) for i, b in enumerate(names))))) if names else joined.select(*wanted.columns, F.lit(None).cast("string").alias("branch")).limit(0)

    def looked_for(f: str) -> Column:
        own = F.col(f"form_{f}")
        hit = F.exists(own, lambda v: F.contains(F.col("evidence"), v)) if f == "eventDate" else (own != "") & F.contains(F.col("evidence"), own)
        return F.struct(F.lit(f).alias("field"), F.col(value(f)).alias("reference_value"), (F.col(value(f)) != "").alias("reference_available"), ((F.col(value(f)) != "") & hit).alias("evidence_hit"))

    numbers = ["candidate_count", "evidence_accepted_count", "input_image_count", "ocr_usable_crop_count", "unique_text_count", "selected_duplicate_pair_count"]
    known = [f"known_{f}" for f in fields]
    wide = joined.select("branch", "record", *numbers, *refusals, *(looked_for(f).alias(k) for f, k in zip(fields, known, strict=True)))
    several = lambda part: sum((F.col(k)[part].cast("long") for k in known), F.lit(0).cast("long"))
    wide = wide.withColumn("reference_field_count", several("reference_available")).withColumn("field_evidence_hit_count", several("evidence_hit"))
    wide = wide.withColumn("catalog_number_evidence_hit", F.col("known_catalogNumber.evidence_hit") if "catalogNumber" in fields else F.lit(False))
    rate = lambda n, of, digits=6: _rate(F.col(n), F.col(of), digits)
    records = wide.select("branch", "record", *numbers, rate("ocr_usable_crop_count", "input_image_count").alias("ocr_usable_rate"), rate("unique_text_count", "ocr_usable_crop_count").alias("text_uniqueness_rate"), "reference_field_count", "field_evidence_hit_count", rate("field_evidence_hit_count", "reference_field_count").alias("field_evidence_hit_rate"), "catalog_number_evidence_hit")
    per_field = wide.select("branch", "record", F.inline(F.array(*known)))
    summary = per_field.groupBy("branch", "field").agg(F.count_if("reference_available").alias("reference_available_count"), F.count_if("evidence_hit").alias("evidence_hit_count"))
    summary = summary.withColumn("evidence_hit_rate", rate("evidence_hit_count", "reference_available_count", 4))
    unique = rate("unique_text_count", "ocr_usable_crop_count")
    totals = wide.groupBy("branch").agg(
        F.count("*").alias("record_count"), *(F.sum(c).alias(c) for c in numbers + refusals + ["reference_field_count", "field_evidence_hit_count"]), F.count_if(F.col("input_image_count") == 0).alias("records_without_input"),
        F.round(F.avg(F.col("catalog_number_evidence_hit").cast("double")), 4).alias("catalog_number_evidence_hit_rate"), F.round(F.avg(unique), 4).alias("mean_text_uniqueness_rate"),
    )
    by_branch = totals.select(
        "branch", "record_count", "candidate_count", F.col("input_image_count").alias("selected_crop_count"), F.round(F.col("input_image_count") / F.col("record_count"), 4).alias("mean_input_images_per_record"), "records_without_input", "catalog_number_evidence_hit_rate",
        F.col("reference_field_count").alias("field_reference_count"), "field_evidence_hit_count", rate("field_evidence_hit_count", "reference_field_count", 4).alias("field_evidence_hit_rate"), rate("ocr_usable_crop_count", "input_image_count", 4).alias("selected_crop_ocr_usable_rate"),
        "mean_text_uniqueness_rate", "selected_duplicate_pair_count", F.col("rejected_evidence_count").alias("evidence_rejection_count"), F.col("rejected_duplicate_count").alias("dedup_rejection_count"), F.col("rejected_quota_count").alias("quota_rejection_count"),
    )
    return {"records": records, "branches": by_branch, "fields": per_field, "field_summary": summary}
