"""Boxes (x0, y0, x1, y1): overlap, containment, and greedy suppression inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0)) * F.greatest(b["y1"] - b["y0"], F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def iou_millionths(a: Column, b: Column) -> Column:
    """Overlap of boxes with whole corners, rounded to the sixth place by whole numbers, so that engines agree."""
    both = intersection(a, b).cast("long")
    union = area(a).cast("long") + area(b).cast("long") - both
    return F.when(union > 0, F.floor((2 * both * 1_000_000 + union) / (2 * union)) / 1e6).otherwise(0.0)


def touching(a: Column, b: Column) -> Column:
    """Whether boxes share a point inside both."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def reaches_millionth(a: Column, b: Column) -> Column:
    """Whether iou_millionths() is over 0, without a division."""
    both = intersection(a, b).cast("long")
    return (both > 0) & (both * 2_000_001 >= area(a).cast("long") + area(b).cast("long"))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller box that lies in the other; 0 for an empty box."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(0.0)


def suppress(rows: DataFrame, key: str, threshold: float = 0.45) -> DataFrame:
    """Boxes (key, id, label, confidence, x0..y1) that survive: in order of confidence, none overlaps a kept one of its label.

    The boxes of one record meet in one row; a record is a sheet, with some hundred boxes at most.
    """
    box = F.struct((-F.col("confidence")).alias("order"), "id", "label", "confidence", "x0", "y0", "x1", "y1")
    boxes = F.array_sort(F.collect_list(box))
    grouped = rows.groupBy(key).agg(boxes.alias("boxes"))

    def keep(kept: Column, b: Column) -> Column:
        hit = F.exists(kept, lambda k: (k["label"] == b["label"]) & (iou(k, b) >= threshold))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), keep)
    return grouped.select(key, F.explode(kept).alias("b")).select(key, "b.id", "b.label", "b.confidence")


def mask_shares(a: Column, b: Column) -> Column:
    """(left, right, both): pixels of two masks and of what they share; a mask is an array of (start, stop) runs of pixel numbers.

    One sweep over the runs' edges in order. Runs may come in any order and overlap; null masks, null and empty runs hold no pixels.
    """
    kind = "array<struct<start:bigint,stop:bigint>>"

    def edges(mask: Column, left: int, right: int) -> Column:
        runs = F.filter(F.coalesce(mask.cast(kind), F.array().cast(kind)), lambda r: r["stop"] > r["start"])
        edge = lambda at, sign: F.struct(at.alias("at"), F.lit(sign * left).alias("a"), F.lit(sign * right).alias("b"))
        return F.flatten(F.transform(runs, lambda r: F.array(edge(r["start"], 1), edge(r["stop"], -1))))

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.lit(0).alias("a"), F.lit(0).alias("b"), zero.alias("left"), zero.alias("right"), zero.alias("both"))

    def step(s: Column, e: Column) -> Column:
        n = e["at"] - s["at"]
        add = lambda name, when: (s[name] + F.when(when, n).otherwise(0)).alias(name)
        return F.struct(e["at"].alias("at"), (s["a"] + e["a"]).alias("a"), (s["b"] + e["b"]).alias("b"), add("left", s["a"] > 0), add("right", s["b"] > 0), add("both", (s["a"] > 0) & (s["b"] > 0)))

    ordered = F.array_sort(F.concat(edges(a, 1, 0), edges(b, 0, 1)))
    return F.aggregate(ordered, start, step, lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right"), s["both"].alias("both")))


def mask_runs(mask: Column) -> Column:
    """The runs of a mask in order, without empty ones, each run apart from the next."""
    kind = "array<struct<start:bigint,stop:bigint>>"
    runs = F.array_sort(F.filter(F.coalesce(mask.cast(kind), F.array().cast(kind)), lambda r: r["stop"] > r["start"]))

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], r["stop"]).alias("stop"))
        return F.when(r["start"] <= last["stop"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs, F.array().cast(kind), step)


def run_shares(a: Column, b: Column, left: Column, right: Column, few: int = 256) -> Column:
    """mask_shares() of masks as mask_runs() with their numbers of pixels, which are worked out once a mask; masks of many runs are swept."""
    zero = F.lit(0).cast("bigint")
    one = lambda x, y: F.greatest(F.least(x["stop"], y["stop"]) - F.greatest(x["start"], y["start"]), zero)
    both = F.aggregate(a, zero, lambda n, x: F.aggregate(b, n, lambda m, y: m + one(x, y)))
    both = F.when(F.size(a).cast("long") * F.size(b) <= few, both).otherwise(mask_shares(a, b)["both"])
    return F.struct(left.alias("left"), right.alias("right"), both.alias("both"))


def run_pixels(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["stop"] - r["start"])


def mask_iou(shares: Column) -> Column:
    union = shares["left"] + shares["right"] - shares["both"]
    return F.when(union > 0, shares["both"] / union).otherwise(0.0)


def mask_containment(shares: Column) -> Column:
    smaller = F.least(shares["left"], shares["right"])
    return F.when(smaller > 0, shares["both"] / smaller).otherwise(0.0)


def overlap_texts(c: Column) -> Column:
    """Overlaps by region id from a JSON text, as texts that are cast where they are asked for; null where it is no JSON object."""
    return F.when(F.contains(c, F.lit("{")), F.from_json(c, "map<string,string>"))


def overlap_map(c: Column) -> Column:
    """Overlaps by region id from a JSON text; none where it is no JSON object, and 0 for what is no number."""
    return F.coalesce(F.transform_values(overlap_texts(c), lambda _, v: F.coalesce(v.try_cast("double"), F.lit(0.0))), F.create_map().cast("map<string,double>"))
