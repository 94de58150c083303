"""Names and places against tables, by brute force over all pairs and by written cases."""

import random

from pyspark.sql import functions as F

from fieldweave.operators import authority


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def words(seed, n, alphabet="abcé", longest=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)})


def test_misspelt_misses_no_pair(spark):
    a, b = words(1, 120), words(2, 120)
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "key string")
    for most in (1, 2):
        got = {(r["key"], r["of"], r["edits"]) for r in authority.misspelt(frame(a), frame(b), most).collect()}
        assert got == {(x, y, d) for x in a for y in b if (d := edits(x, y)) <= most}


def groups(x):
    p = f" {x} "
    return {p[i : i + 3] for i in range(max(1, len(p) - 2))}


def test_like_misses_no_pair(spark):
    names = words(3, 150, "abc", 14)
    df = spark.createDataFrame([(w,) for w in names], "key string")
    for t in (0.6, 0.75, 0.92):
        got = {(r["key"], r["of"]) for r in authority.like(df, df, t).collect()}
        cosine = lambda x, y: len(groups(x) & groups(y)) / (len(groups(x)) * len(groups(y))) ** 0.5
        assert got == {(x, y) for x in names for y in names if round(cosine(x, y), 9) >= t}


def test_clusters_take_the_longest(spark):
    full = "George Alexander Forrest Junior"
    names = [full, f"{full}r", "george", "", None, "nan", f" {full} "]
    got = {r["name"]: r["canonical"] for r in authority.clusters(spark.createDataFrame([(n,) for n in names], "who string"), "who").collect()}
    assert got == {full: f"{full}r", f"{full}r": f"{full}r", "george": "george"}
    assert authority.clusters(spark.createDataFrame([], "who string"), "who").collect() == []


def test_bands(spark):
    known = spark.createDataFrame([("Rosa canina", None), ("Abies alba", "Abies pectinata"), ("Quercus robur", None)], "name string, accepted string")
    asked = ["Rosa canina", "rosa  CANINA", "Rosa caninna", "Abies alba", "Rosa unknownii", "Quercuss roburus", "zzz", "", None]
    got = {r["verbatim"]: r for r in authority.matched(spark.createDataFrame([(n,) for n in asked], "name string"), known).collect()}
    kind = lambda n: (got[n]["match_type"], got[n]["canonical"])
    assert kind("Rosa canina") == kind("rosa  CANINA") == ("EXACT", "Rosa canina")
    assert kind("Rosa caninna") == ("FUZZY", "Rosa canina") and 0.9 < got["Rosa caninna"]["confidence"] < 1
    assert got["Abies alba"]["synonym"] and got["Abies alba"]["accepted"] == "Abies pectinata" and got["Abies alba"]["canonical"] == "Abies alba"
    assert kind("Rosa unknownii") == ("HIGHERRANK", "Rosa") and got["Quercuss roburus"]["match_type"] in ("COSINE_FLAG", "COSINE_HIGH", "NONE")
    assert kind("zzz") == ("NONE", "") and kind("") == kind(None) == ("EMPTY", "")


def test_places(spark):
    places = spark.createDataFrame([("country", "China", "CN"), ("country", "Cuba", "CU"), ("state", "Yunnan", "CN"), ("state", "Yunan", "CU")], "kind string, name string, code string")
    values = spark.createDataFrame([("Yunnan, West China", "Yunnan"), ("cn", "yunnan"), ("Chinaa", "Yunnam"), ("", "Yunan"), (None, None), ("nowhere", "x")], "country string, state string")
    got = {(r["country"], r["state"]): tuple(r)[2:] for r in authority.placed(values, places).collect()}
    assert got["Yunnan, West China", "Yunnan"] == ("China", "substring", "Yunnan", "cosine")
    assert got["cn", "yunnan"] == ("China", "exact", "Yunnan", "cosine")
    assert got["", "Yunan"] == ("", "EMPTY", "Yunan", "cosine") and got[None, None] == ("", "EMPTY", "", "EMPTY")
    assert got["nowhere", "x"] == ("", "no_match", "", "no_match")


def test_proper_nouns(spark):
    texts = ["HERBARIUM of Kew Gardens, George Forrest Leg Étion Ab-Cd x1 AB", None, "A b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(authority.proper_nouns(F.col("t"))).collect()]
    assert got == [["Kew Gardens", "George Forrest Leg", "Ab-Cd"], [], []] or got[0][:2] == ["Kew Gardens", "George Forrest Leg"]


def test_completed_identifiers_keep_a_floor(spark):
    rows = spark.createDataFrame([(1, "m", "E0063", "0.3", "Rosa canina", "uk", None), (2, "m", "E0063", "0.95", "rosa", None, "x"), (3, "m", None, None, None, None, None)], "record long, method string, catalogNumber string, catalogNumber_confidence string, scientificName string, country string, stateProvince string")
    extensions = spark.createDataFrame([(1, "E006325", "strict_extension_applied"), (2, "E006325", "strict_extension_applied"), (3, "", "not_provided")], "record long, value string, status string")
    known = spark.createDataFrame([("Rosa canina L.", None)], "name string, accepted string")
    got = {r["record"]: r for r in authority.reconciled(rows, known, extensions).collect()}
    assert got[1]["catalogNumber"] == "E006325" and got[1]["catalogNumber_verbatim"] == "E0063" and got[1]["catalogNumber_confidence"] == 0.85 and got[2]["catalogNumber_confidence"] == 0.95
    assert got[1]["scientificName"] == "Rosa canina L." and got[1]["scientificName_verbatim"] == "Rosa canina" and got[1]["country_normalised"] == "United Kingdom"
    assert got[3]["taxonomy_match_status"] == "not_provided" and got[2]["taxonomy_match_status"] == "local_canonical"
