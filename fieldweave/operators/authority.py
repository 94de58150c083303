"""Names against a table of accepted names, likeness by letter groups, and clusters of like names; candidates come from indexes, never from all pairs."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sinks.places import new_path
from . import resolve

# Likeness from which a name is taken over, from which it is shown for review, and from which two names are one person's.
TAKE_OVER, REVIEW, SAME_PERSON = 0.92, 0.75, 0.92
#: Edits up to which a name is a misspelling of another, letters of a group, and the least confidence of an identifier that was completed.
MOST_EDITS, GROUP, FLOOR = 2, 3, 0.85
#: Letter groups of a key up to which keys meet by equal parts of their sets.
FEW = 64


def name_key(c: Column) -> Column:
    """Lower case with single blanks; blank for null, nan and none."""
    return F.lower(F.regexp_replace(T.clean(c), r"\s+", " "))


def deletions(c: Column, most: int = MOST_EDITS) -> Column:
    """The text and all that deleting up to `most` of its characters leaves."""
    words = F.array(c)
    for _ in range(most):
        one_less = lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i > 0), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        words = F.array_distinct(F.concat(words, F.flatten(F.transform(words, one_less))))
    return words


def misspelt(names: DataFrame, known: DataFrame, most: int = MOST_EDITS) -> DataFrame:
    """(key, of, edits): pairs of a key of `names` and one of `known` within `most` edits, all of them.

    Two texts within k edits share a text that up to k deletions leave of either, so an equi-join on such texts misses none;
    the edit distance confirms. A key has about length**most / 2 of them.
    """
    side = lambda f: f.select("key").distinct().select("key", F.explode(deletions(F.col("key"), most)).alias("left_over"))
    met = side(names).join(side(known).withColumnRenamed("key", "of"), "left_over").select("key", "of").distinct()
    return met.withColumn("edits", F.levenshtein("key", "of", most)).filter("edits >= 0")


def letter_groups(c: Column) -> Column:
    """The different groups of three characters of a text, with a blank at either end."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - GROUP + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(GROUP))))


def like(left: DataFrame, right: DataFrame, threshold: float, within: str | None = None) -> DataFrame:
    """(key, of, cosine): pairs of keys whose letter groups have a cosine of `threshold` at least; with `within`, of the same value there.

    Groups are put in order of rarity. A pair that reaches the threshold shares at least threshold**2 of either side's groups,
    so it shares one of the n - ceil(threshold**2 * n) + 1 rarest of each: only these are joined, within the bounds on sizes
    and on what can still be shared after the places where they meet (a pair's first meeting is within them); the full sets
    confirm. Only the keys travel: their groups are taken from them again.
    """
    block = F.col(within) if within else F.lit("")
    keyed = lambda f: f.select("key", block.alias("block")).distinct().withColumn("groups", letter_groups(F.col("key")))
    a, b = keyed(left), keyed(right)
    seen = a.select("groups").unionByName(b.select("groups")).select(F.explode("groups").alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def rarest(f: DataFrame, name: str) -> DataFrame:
        ranked = f.select("key", "block", F.size("groups").alias("size"), F.explode("groups").alias("g")).join(seen, "g").groupBy("key", "block", "size").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("order"))
        first = F.slice("order", F.lit(1), (F.col("size") - F.ceil(F.col("size") * threshold * threshold - 1e-9) + 1).cast("int"))
        return ranked.select(F.col("key").alias(name), "block", F.col("size").alias(f"size_{name}"), F.posexplode(first).alias(f"at_{name}", "rare")).select(name, "block", f"size_{name}", f"at_{name}", F.col("rare.g").alias("g"))

    least = threshold * threshold
    sizes = (F.col("size_of") >= F.col("size_key") * least - 1e-9) & (F.col("size_key") >= F.col("size_of") * least - 1e-9)
    root = F.sqrt(F.col("size_key").cast("double") * F.col("size_of"))
    shareable = F.least(F.col("size_key") - F.col("at_key"), F.col("size_of") - F.col("at_of"))
    met = rarest(a, "key").join(rarest(b, "of"), ["block", "g"]).filter(sizes & (shareable >= root * threshold - 1e-6)).select("key", "of", "block", "size_key", "size_of").distinct()
    cosine = F.size(F.array_intersect(letter_groups(F.col("key")), letter_groups(F.col("of")))) / root
    return met.select("key", "of", *([F.col("block").alias(within)] if within else []), F.round(cosine, 9).alias("cosine")).filter(F.col("cosine") >= threshold)


def _meetings(threshold: float) -> list[tuple[int, list[tuple[int, int, int, list[int]]]]]:
    """For each size of a set, up to FEW: (side, number, parts, chosen parts) of the ways in which it meets sets that reach the threshold.

    Sets of s and t members whose cosine reaches the threshold differ in k members at most. Dealt to k + m parts by a hash,
    m of the parts at least are equal: so two such sets have one choice of m parts in common that holds the same members.
    """
    ways: dict[int, list[tuple[int, int, int, list[int]]]] = {n: [] for n in range(1, FEW + 1)}
    number = itertools.count()
    for s in range(1, FEW + 1):
        for t in range(s, FEW + 1):
            common = math.ceil(threshold * math.sqrt(s * t) - 1e-6)
            if common <= s:
                k = s + t - 2 * common
                m = 2 if 1 < k < 6 else 1
                for chosen in itertools.combinations(range(k + m), m):
                    n = next(number)
                    ways[s].append((0, n, k + m, list(chosen)))
                    ways[t].append((1, n, k + m, list(chosen)))
    return list(ways.items())


def like_one_another(names: DataFrame, threshold: float) -> DataFrame:
    """(key, of): like() of a table of different keys with itself, without (key, key), and each pair once: for high thresholds and many keys.

    Keys meet by what equal parts of their sets of letter groups hold (_meetings), not by single groups, which ever more keys
    share as the table grows; sets of over FEW groups meet by their rarest ones. The full sets confirm.
    """
    sized = names.select("key", letter_groups(F.col("key")).alias("groups")).withColumn("size", F.size("groups"))
    own, other = letter_groups(F.col("key")), letter_groups(F.col("of"))
    cosine = F.size(F.array_intersect(own, other)) / F.sqrt(F.size(own).cast("double") * F.size(other))
    few = met_by_parts(sized, threshold).filter(F.round(cosine, 9) >= threshold)
    # A set of over FEW groups is like none of fewer than this.
    large = sized.filter(F.col("size") >= math.floor(FEW * threshold * threshold)).select("key")
    many = like(large, large, threshold).filter("key < of").select("key", "of")
    return few.unionByName(many).distinct()


def met_by_parts(sized: DataFrame, threshold: float) -> DataFrame:
    """(key, of): the pairs of keys (with groups and size, up to FEW) that share what equal parts hold, key before of; few of them are not alike."""
    spark = sized.sparkSession
    ways = spark.createDataFrame(_meetings(threshold), "size int, ways array<struct<side:int,number:int,parts:int,chosen:array<int>>>")
    hashed = sized.select("key", "size", F.transform("groups", lambda g: F.xxhash64(g)).alias("members")).join(F.broadcast(ways), "size")
    met_by = hashed.select("key", "members", F.explode("ways").alias("way"))
    held = F.aggregate("members", F.lit(0).cast("long"), lambda x, g: F.when(F.array_contains("way.chosen", F.pmod(g, F.col("way.parts")).cast("int")), x.bitwiseXOR(g)).otherwise(x))
    met_by = met_by.select("key", "way.side", F.xxhash64("way.number", held).alias("meeting"))
    side = lambda n, name: met_by.filter(F.col("side") == n).select(F.col("key").alias(name), "meeting")
    return side(0, "key").join(side(1, "of"), "meeting").filter("key <> of").select(F.least("key", "of").alias("key"), F.greatest("key", "of").alias("of")).distinct()


def clusters(names: DataFrame, name: str, threshold: float = SAME_PERSON) -> DataFrame:
    """(name, canonical): every different non-blank name with the longest of itself and the names like it; of equally long ones itself, else the first by order."""
    # Written, since several joins read them: a name may be what a pattern finds in a long text.
    at = new_path(names.sparkSession, "names")
    names.select(F.col(name).alias("key")).distinct().write.parquet(at)
    all_names = names.sparkSession.read.parquet(at).select(T.clean(F.col("key")).alias("key")).filter("key <> ''").distinct()
    pairs = like_one_another(all_names, threshold)
    longer = F.when(F.length("of") > F.length("key"), F.struct("key", "of")).when(F.length("of") < F.length("key"), F.struct(F.col("of").alias("key"), F.col("key").alias("of")))
    better = pairs.select(longer.alias("pair")).filter("pair is not null").select("pair.*").groupBy("key").agg(F.min(F.struct((-F.length("of")).alias("order"), "of")).alias("best"))
    joined = all_names.join(better, "key", "left")
    return joined.select(F.col("key").alias("name"), F.coalesce("best.of", "key").alias("canonical"))


def matched(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """One row for each different value of a name: canonical, match_type, confidence, synonym, warning.

    `known` has name and accepted (the name in use; null where it is the name itself). In this order: the name itself (EXACT),
    one within two edits (FUZZY, the nearest), the genus alone (HIGHERRANK), the most alike by letter groups (COSINE_HIGH, or
    COSINE_FLAG for review), NONE; blank names are EMPTY. Nothing is written over: the value asked for stays beside it.
    """
    asked = names.select(F.col(name).alias("verbatim")).distinct().withColumn("key", name_key(F.col("verbatim")))
    table = known.select(name_key(F.col("name")).alias("key"), F.col("name").alias("canonical"), "accepted").filter("key <> ''").groupBy("key").agg(F.min_by(F.struct("canonical", "accepted"), F.struct("canonical", F.coalesce("accepted", F.lit("")))).alias("entry"))
    keys = asked.filter("key <> ''")
    near = misspelt(keys, table).groupBy("key").agg(F.min(F.struct("edits", "of")).alias("near"))
    genus = table.select(F.substring_index("key", " ", 1).alias("genus")).distinct().withColumn("has_genus", F.lit(True))
    left = keys.select("key").distinct().join(near.select("key"), "key", "left_anti")
    no_genus = left.withColumn("genus", F.substring_index("key", " ", 1)).join(genus, "genus", "left_anti")
    most_alike = like(no_genus, table, REVIEW).groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "of", "cosine")).alias("alike"))
    joined = asked.join(near, "key", "left").withColumn("genus", F.substring_index("key", " ", 1)).join(genus, "genus", "left").join(most_alike, "key", "left")
    entries = table.select(F.col("key").alias("found"), "entry")
    joined = joined.withColumn("found", F.coalesce("near.of", F.when(F.col("has_genus").isNull(), F.col("alike.of")))).join(entries, "found", "left")
    kind = (
        F.when(F.col("key") == "", "EMPTY").when(F.col("near.edits") == 0, "EXACT").when(F.col("near.edits") > 0, "FUZZY").when(F.col("has_genus"), "HIGHERRANK")
        .when(F.col("alike.cosine") >= TAKE_OVER, "COSINE_HIGH").when(F.col("alike.cosine") >= REVIEW, "COSINE_FLAG").otherwise("NONE")
    )
    synonym = kind.isin("EXACT", "FUZZY") & F.col("entry.accepted").isNotNull() & (F.col("entry.accepted") != F.col("entry.canonical"))
    sure = F.when(kind == "EXACT", 1.0).when(kind == "FUZZY", 1.0 - F.col("near.edits") / F.greatest(F.length("key"), F.length("found"))).when(kind == "HIGHERRANK", 0.5).otherwise(F.coalesce("alike.cosine", F.lit(0.0)))
    warning = F.when(synonym, "synonym_match").when(kind == "HIGHERRANK", "only_higherrank_match").when(kind == "COSINE_HIGH", "fallback_cosine_auto").when(kind == "COSINE_FLAG", "fallback_cosine_flag_for_review").when(kind == "NONE", "no_match").otherwise("")
    canonical = F.when(kind == "HIGHERRANK", F.initcap("genus")).otherwise(F.coalesce("entry.canonical", F.lit("")))
    return joined.select("verbatim", canonical.alias("canonical"), kind.alias("match_type"), F.round(sure, 6).alias("confidence"), F.coalesce(synonym, F.lit(False)).alias("synonym"), F.coalesce("entry.accepted", canonical).alias("accepted"), warning.alias("warning"))


def safe_name(verbatim: Column, matched_name: Column, confidence: Column, least: float = 0.9) -> Column:
    """The matched name if it is sure enough and has the same genus and species; else the name as given."""
    same = F.lower(resolve.binomial(T.clean(verbatim))) == F.lower(resolve.binomial(T.clean(matched_name)))
    return F.when((T.clean(matched_name) != "") & (confidence >= least) & same, T.clean(matched_name)).otherwise(T.clean(verbatim))


def reconciled(rows: DataFrame, known: DataFrame, extensions: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Rows (record, method, catalogNumber, catalogNumber_confidence, scientificName, country, stateProvince) with what the tables make of them.

    `extensions` is resolve.safe_extension() (record, value, status) for the rows' identifiers; `known` has name and accepted,
    and is asked for names that look like genus and species, of `methods` only if given. Every value stays in a column
    *_verbatim. A completed identifier takes the place of the value, with a confidence of 0.85 at least.
    """
    # fmt: off
    squeezed = F.regexp_replace(T.clean(F.col("scientificName")), r"\s+", " ")
    binomial = T.clean(F.col("scientificName")).rlike(r"^[A-Z][a-zA-Z\-]+\s+[a-z][a-zA-Z\-]+(?:\s|$)")
    allowed = F.col("method").isin(methods) if methods else F.lit(True)
    # Authorities know names by genus and species; authorship comes from them.
    by_two = known.select(F.lower(resolve.binomial(T.clean(F.col("name")))).alias("two"), F.col("name").alias("listed")).filter("two <> ''").groupBy("two").agg(F.min("listed").alias("listed"))
    asked = rows.withColumn("two", F.when(binomial & allowed, F.lower(resolve.binomial(squeezed))))
    joined = asked.join(by_two, "two", "left").join(extensions.select("record", F.col("value").alias("extension"), F.col("status").alias("extension_status")), "record", "left")
    verbatim, catalog = T.clean(F.col("scientificName")), T.clean(F.col("catalogNumber"))
    name = safe_name(F.col("scientificName"), F.coalesce("listed", F.lit("")), F.when(F.col("listed").isNotNull(), 1.0).otherwise(0.0))
    done = F.coalesce(F.col("extension_status") == "strict_extension_applied", F.lit(False))
    sure = F.coalesce(F.col("catalogNumber_confidence").try_cast("double"), F.lit(0.0))
    status = F.when(verbatim == "", "not_provided").when(name != verbatim, "authority_authorship_corrected").when(F.col("listed").isNotNull(), "authority_checked_unchanged").otherwise(F.when(resolve.binomial(verbatim) != "", "local_canonical").otherwise("unmatched"))
    return joined.select(
        "record", "method", F.when(done, F.col("extension")).otherwise(catalog).alias("catalogNumber"), catalog.alias("catalogNumber_verbatim"), F.coalesce("extension_status", F.lit("disabled")).alias("catalog_number_resolution_status"),
        F.when(done, F.greatest(sure, F.lit(FLOOR))).otherwise(sure).alias("catalogNumber_confidence"), name.alias("scientificName"), verbatim.alias("scientificName_verbatim"), resolve.binomial(name).alias("scientificName_canonical"),
        status.alias("taxonomy_match_status"), (name != verbatim).alias("taxonomy_correction_applied"), T.clean(F.col("country")).alias("country_verbatim"), resolve.country(T.clean(F.col("country"))).alias("country_normalised"), T.clean(F.col("stateProvince")).alias("stateProvince_normalised"),
    )
    # fmt: on


def placed(values: DataFrame, places: DataFrame) -> DataFrame:
    """(country, state) values with the places they name: country first, then the state among that country's.

    `places` has kind (country or state), name and code (of the country). A country is known by its name or code, by a name
    that stands in the value as words, or by likeness; a state by likeness, within the country's code if one is known.
    """
    asked = values.select("country", "state").distinct().withColumn("country_key", name_key(F.col("country"))).withColumn("state_key", name_key(F.col("state")))
    countries = places.filter("kind = 'country'").select(name_key(F.col("name")).alias("key"), "name", "code").groupBy("key").agg(F.min(F.struct("name", "code")).alias("entry"))
    by_code = places.filter("kind = 'country'").select(F.lower("code").alias("key"), "name", "code").groupBy("key").agg(F.min(F.struct("name", "code")).alias("entry"))
    exact = countries.unionByName(by_code).groupBy("key").agg(F.min("entry").alias("exact"))
    words = F.split(F.regexp_replace("country_key", r"[^\p{L}\p{N} ]+", " "), " +")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.least(F.size(words), i + 3)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    keys = asked.filter("country_key <> ''").select("country_key").distinct()
    inside = keys.select("country_key", F.explode(F.array_distinct(spans)).alias("key")).join(countries, "key").groupBy("country_key").agg(F.min(F.struct((-F.length("key")).alias("order"), "entry")).alias("inside"))
    alike = like(keys.select(F.col("country_key").alias("key")), countries, REVIEW).groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "of", "cosine")).alias("alike")).withColumnRenamed("key", "country_key")
    known = asked.join(exact.withColumnRenamed("key", "country_key"), "country_key", "left").join(inside, "country_key", "left").join(alike, "country_key", "left").join(countries.select(F.col("key").alias("of"), F.col("entry").alias("alike_entry")), F.col("alike.of") == F.col("of"), "left").drop("of")
    method = F.when(F.col("country_key") == "", "EMPTY").when(F.col("exact").isNotNull(), "exact").when(F.col("inside").isNotNull(), "substring").when(F.col("alike.cosine") >= TAKE_OVER, "cosine").when(F.col("alike").isNotNull(), "cosine_flag").otherwise("no_match")
    entry = F.coalesce("exact", "inside.entry", "alike_entry")
    found = known.select("country", "state", "state_key", F.coalesce(entry["name"], F.lit("")).alias("country_canonical"), method.alias("country_method"), F.coalesce(entry["code"], F.lit("")).alias("code"))
    states = places.filter("kind = 'state'").select(name_key(F.col("name")).alias("key"), "name", "code")
    # Each state twice: under its country's code, and for values without a known country.
    open_states = states.unionByName(states.withColumn("code", F.lit(""))).groupBy("key", "code").agg(F.min("name").alias("name"))
    best = like(found.filter("state_key <> ''").select(F.col("state_key").alias("key"), "code"), open_states, REVIEW, within="code").groupBy("key", "code").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "of", "cosine")).alias("best"))
    named = best.select(F.col("key").alias("state_key"), "code", "best.of", "best.cosine").join(open_states.select(F.col("key").alias("of"), "code", F.col("name").alias("state_name")), ["of", "code"]).drop("of")
    joined = found.join(named, ["state_key", "code"], "left")
    state_method = F.when(F.col("state_key") == "", "EMPTY").when(F.col("cosine") >= TAKE_OVER, "cosine").when(F.col("cosine").isNotNull(), "cosine_flag").otherwise("no_match")
    return joined.select("country", "state", "country_canonical", "country_method", F.coalesce("state_name", F.lit("")).alias("state_canonical"), state_method.alias("state_method"))


def proper_nouns(text: Column, noise: list[str] | None = None, most: int = 8) -> Column:
    """The first `most` runs of one to four capitalised words, without those that are only a heading's word."""
    # Words of headings.
    heading = noise or ["HERBARIUM", "MUSEUM", "NATURAL", "HISTORY", "TYPE", "HOLOTYPE", "ISOTYPE", "LECTOTYPE", "DET", "LEG", "COLLECTOR", "COLL", "LOCALITY"]
    word = r"[\p{L}\p{N}_]"
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<!{word})([A-Z][a-zA-Z\-]+(?:\s+[A-Z][a-zA-Z\-]+){{0,3}})(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"), 1)
    return F.slice(F.filter(runs, lambda r: ~F.upper(r).isin(heading)), 1, most)
