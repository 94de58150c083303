"""Texts of prompts: headed readings, numbered context, packets of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def headed(text: Column, header: Column, region: Column, labelled: bool = True) -> Column:
    """A reading under its header in brackets, else under its region if `labelled`; a blank reading stays bare."""
    plain, own = F.coalesce(text, F.lit("")), T.clean(header)
    under = lambda h: F.concat(F.lit("["), h, F.lit("]\n"), plain)
    return F.when((own != "") & (plain != ""), under(own)).when((plain != "") & F.lit(labelled), under(T.clean(region))).otherwise(plain)


def hypotheses_header(candidates: Column) -> Column:
    """The header of a reading that several readings of one crop agree or disagree on; its wording is a fixed value."""
    many = F.when(F.size(candidates) > 1, "true").otherwise("false")
    return F.concat(F.lit("FIELD=catalog_number; SOURCE=tesseract_crop_ensemble; candidate_count="), F.size(candidates).cast("string"), F.lit("; ambiguous="), many, F.lit("; ranked_hypotheses=true"))


def context(items: Column) -> Column:
    """Numbered lines "[1] source: text" of an array of (source, text)."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["source"], F.lit("None")), F.lit(": "), F.coalesce(x["text"], F.lit("None")))), "\n")


def packet(components: Column) -> Column:
    """The readings with text of an array of components (region_id, component_type, readings: array of (engine, raw_text)), each under what it is of."""

    def blocks(c: Column) -> Column:
        held = F.filter(c["readings"], lambda r: T.clean(r["raw_text"]) != "")
        head = lambda r: F.concat(F.lit("[region_id="), c["region_id"], F.lit("; component_type="), c["component_type"], F.lit("; engine="), r["engine"], F.lit("]\n"))
        return F.transform(held, lambda r: F.concat(head(r), T.clean(r["raw_text"])))

    return F.array_join(F.flatten(F.transform(components, blocks)), "\n\n")
