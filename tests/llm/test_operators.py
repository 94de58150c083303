"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from fieldweave.llm import bpe, decontaminate, exact_dup, idfile, langid, near_dup, pieces, quality, queries, suffix_array, tokens, toxicity, url_filter

SF = "/root/testdata/sf0.001"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(120), [word() for _ in range(80)]
    near = [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in (3, 40, 79)]
    texts = [None, "", "   \n", "one two", "one two", prose(30), passage, f"{prose(50)} {passage} {prose(20)}", f"{passage} {passage}", *near, " ".join(base), "x" * 3000,
             "it's we'll <|endoftext|> 漢字 ¿qué?\u0085  !!", "a b c d e " * 30, "line here\nline here\n\nline here", prose(6000), "ABC Def\tGHI"]
    return [(i, t, "keep", i) for i, t in enumerate(texts)] + [(3, "one two", "keep", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, ids string, n_words long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_split_is_the_pattern():
    rng = random.Random(1)
    alphabet = [*"ab's'tredvelmlS \n\t  '1²½!-_\x85\xa0é\x1c\x1dª漢", "'ll", "'re", " '", "  "]
    find = pieces.compiled(P.PATTERN).findall
    for _ in range(500):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        distinct, codes, at = pieces.split(texts, P.PATTERN)
        distinct = distinct.to_pylist()
        assert [[distinct[k] for k in codes[at[i] : at[i + 1]]] for i in range(len(texts))] == [find(t) for t in texts]


def test_bpe(docs, empty):
    import tiktoken

    by_bytes = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=by_bytes, special_tokens={})
    ranks = bpe.RankMap(by_bytes)
    assert bpe.heap_merge(b"  hello----- aaaa", by_bytes) == library._encode_single_piece("  hello----- aaaa")
    got = bpe.encode(docs, ranks, P.PATTERN, max_hot=50)
    rows = bpe.decode(got, ranks).withColumnRenamed("decoded", "raw").collect()
    want = sorted((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in corpus())
    assert sorted((r.doc_id, list(r.ids), bytes(r.raw)) for r in rows) == want
    fused = bpe.encode(docs, ranks, P.PATTERN, max_hot=50, decoded=True).collect()
    assert sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in fused) == want
    assert bpe.encode(empty, ranks, P.PATTERN, decoded=True).count() == 0


def _library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_token_counts(docs, empty):
    ids = _library_ids()
    want = sorted((i, len((t or "").encode()), len(ids(t))) for i, t, *_ in corpus())
    for step, overlap in ((16384, 512), (500, 80), (200, 40)):  # small chunks: splicing and widening
        got = tokens.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN, step, overlap)
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert tokens.count_tokens(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_id_file(spark, docs, empty):
    ids = _library_ids()
    path = idfile.new_path(spark)
    idfile.write(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    start, want = 0, []
    for i, t in sorted((i, t or "") for i, t, *_ in corpus()):
        own = np.array([*ids(t), 0], "<u4")
        want.append((i, start, own.tobytes()))
        start += len(own)
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in idfile.read(spark, path).collect()) == sorted(want)
    path = idfile.new_path(spark)
    idfile.write(empty, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert idfile.read(spark, path).count() == 0


def test_code_is_optimal_under_its_limit():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    lengths = idfile.code_lengths(counts, 18)
    heap, cost = sorted(counts[counts > 0].tolist()), 0  # Huffman's cost: the sum of all merged weights
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert sum(0.5 ** int(n) for n in lengths if n) == 1 and (counts * lengths).sum() == cost
    assert idfile.code_lengths(counts, 4).max() == 4


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_decontaminate(spark, docs, empty):
    texts = dict((i, t) for i, t, *_ in corpus())
    items = [("7", " ".join(texts[6].split()[20:45])), ("8", "One, TWO"), ("9", None), ("10", "!!"), ("8b", "one two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, t in items:
        own = word.findall(_lower(t))
        for k in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[k : k + 10]), set()).add(item)
    want = []
    for i, t, *_ in corpus():
        own, hit, found = word.findall(_lower(t)), set(), set()
        for w, names in windows.items():
            for k in range(len(own) - len(w) + 1):
                if tuple(own[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found |= names
        want.append((i, len(own), len(hit), sorted(found)))
    for limit in (16 << 20, 900):  # one automaton, and several
        got = decontaminate.scan(docs, bench, max_block_bytes=limit).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)
    spans = {r.doc_id: r.spans for r in got}
    raw = texts[6].encode()
    assert [raw[s.start : s.end].decode() for s in spans[6]] == [items[0][1]]
    assert decontaminate.scan(docs, empty.withColumnRenamed("doc_id", "item_id")).filter("n_hit > 0").count() == 0


def test_decontaminate_without_item_id(spark):
    """An item without an id hits like any other; only its name isn't listed."""
    own = "a b c d e f g h i j k l".split()
    docs = spark.createDataFrame([(1, " ".join(["x", *own, "y"])), (2, "x y z"), (None, " ".join(own))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(own)), (None, "p q r"), ("7", " ".join(own[1:]))], "item_id string, text string")
    for limit in (16 << 20, 60):
        got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.scan(docs, bench, max_block_bytes=limit).collect()}
        assert got == {1: (12, ["7"]), 2: (0, []), None: (12, ["7"])}
        got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.scan(docs, bench.filter("item_id is null"), max_block_bytes=limit).collect()}
        assert got == {1: (12, []), 2: (0, []), None: (12, [])}


def _components(rows, n, percent=80):
    sets = {}
    for i, t, *_ in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        sets[i] = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if len(own) >= n else ({tuple(own)} if own else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(docs, empty):
    want = _components(corpus(), 4)
    got = near_dup.group(docs, words=4).collect()
    assert len(got) == len(corpus()) and all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.group(empty).count() == 0


def test_near_duplicates_chain(spark):
    """Neighbours are linked, ends are not; the smallest id lies in the middle."""
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(100)]
    rows = [(order, " ".join(words[k : k + 60])) for order, k in zip([5, 3, 1, 2, 4, 6, 7, 8], range(0, 32, 4), strict=True)]
    want = _components(rows, 4)
    got = near_dup.group(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_share_a_doc_id(spark):
    """Rows of one doc_id are in one component, and so are the documents alike to any of them."""
    rng = random.Random(8)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    one, two, three = own(60), own(60), own(60)
    rows = [(5, one), (5, two), (2, two), (7, f"{two} end"), (8, three), (9, own(60)), (None, one)]
    got = near_dup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 2, False), (2, 2, True), (7, 2, False), (8, 8, True), (9, 9, True), (None, None, True)}


def test_merged_postings(spark, monkeypatch):
    """A family of texts around the threshold: the links within tiles join what brute force joins, in whatever tiles."""
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    near = lambda: " ".join(rng.choice(["x", "y"]) + w if rng.random() < 0.022 else w for w in base)
    rows = [(i, near()) for i in range(120)]
    want = {i: c for i, (_, c) in _components(rows, 4).items()}
    assert 5 < len(set(want.values())) < 115
    for members in (4096, 20):
        monkeypatch.setattr(near_dup, "TILE_MEMBERS", members)
        got = near_dup.group(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_quality_counts(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs).collect()}
    for i, t, *_ in corpus():
        own, seen, again = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        n = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
        covered = {j for k in range(len(own) - 4) if n[tuple(own[k : k + 5])] > 1 for j in range(k, k + 5)}
        r = got[i, len(own)]
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, own)), symbols, again, len(covered))
        assert r.base_failed == (len(own) < 10 or 100 * len(covered) > 20 * len(own)) and not (r.kept and r.base_failed)
    assert quality.judge(empty).count() == 0


def _planted_votes(rng, hits, alarms, repeats, n_good=9000, n_bad=1000, abstain=0.2):
    truth = np.arange(n_good + n_bad) < n_good
    votes = np.where(rng.random((len(truth), len(hits))) < np.where(truth[:, None], alarms, hits), 0, 1)
    votes[:, 1] = np.where(rng.random(len(truth)) < repeats, votes[:, 0], votes[:, 1])  # rule 1 often repeats rule 0
    return truth, np.where(rng.random(votes.shape) < abstain, 2, votes)


def _by_hand(votes, rounds=500):
    """The estimation text by text: probability of each to be good."""
    good = [0.0 if sum(x == 0 for x in v) >= 2 else 1.0 for v in votes]
    k = len(votes[0])
    for _ in range(rounds):
        chance = []
        for j in range(k):
            for side, expected in ((0, 0.5), (1, 0.05)):
                w = [g if side else 1 - g for g in good]
                bad = sum(x for x, v in zip(w, votes, strict=True) if v[j] == 0)
                voted = sum(x for x, v in zip(w, votes, strict=True) if v[j] < 2)
                chance.append((bad + 20 * expected) / (voted + 20))
        share, before = (sum(good) + 10) / (len(good) + 20), good
        good = []
        for v in votes:
            up, down = share, 1 - share
            for j, x in enumerate(v):
                if x < 2:
                    down *= chance[2 * j] if x == 0 else 1 - chance[2 * j]
                    up *= chance[2 * j + 1] if x == 0 else 1 - chance[2 * j + 1]
            good.append(up / (up + down))
        if max(abs(a - b) for a, b in zip(good, before, strict=True)) < 1e-9:
            break
    return good


def test_estimated_accuracies():
    hits, alarms = np.array([0.8, 0.7, 0.6, 0.9, 0.12]), np.array([0.02, 0.03, 0.05, 0.01, 0.12])  # the last rule tells nothing
    for repeats, off in ((0.0, 0.06), (0.5, 0.15)):  # rules that depend on one another bend the estimate, no more
        truth, votes = _planted_votes(np.random.default_rng(1), hits, alarms, repeats)
        found = quality.estimate(dict(Counter((votes * 3 ** np.arange(5)).sum(1).tolist())), 5)
        kept = found.odds(votes) >= 0
        assert kept[truth].mean() > 0.98 and kept[~truth].mean() < 0.15 and abs(found.share - 0.9) < 0.03
        assert np.abs(found.chance[[0, 2, 3, 4], 0] - hits[[0, 2, 3, 4]]).max() < off and np.abs(found.chance[[0, 2, 3, 4], 1] - alarms[[0, 2, 3, 4]]).max() < 0.03
    one = (votes == 0).sum(1) == 1  # of texts with a single vote for bad some stay and some go
    assert 0 < kept[one].mean() < 1 and kept[one & (votes[:, 4] == 0)].mean() > 0.95
    some = votes[::40].tolist()
    by_pattern = quality.estimate(dict(Counter((votes[::40] * 3 ** np.arange(5)).sum(1).tolist())), 5)
    assert np.allclose(1 / (1 + np.exp(-by_pattern.odds(votes[::40]))), _by_hand(some), atol=1e-6)
    nothing = quality.estimate({}, 3)
    assert np.allclose(nothing.chance, [[0.5, 0.05]] * 3) and nothing.share == 0.5


def test_quality_verdicts(spark):
    """The query's probabilities are those of the estimation by hand; neither all-must-pass nor its opposite."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = quality.statistics(quality.id_text(docs))
    votes = {r.doc_id: list(r.votes) for r in counts.select("doc_id", F.array(*quality.rules()).alias("votes")).collect()}
    want = dict(zip(votes, _by_hand(list(votes.values())), strict=True))
    got = quality.judge(docs).collect()
    assert len(got) == len(want) and all(abs(r.quality - want[r.doc_id]) < 1e-6 and r.kept == (not r.base_failed and r.quality >= 0.5) for r in got)
    doubted = [r.kept for r in got if 0 in votes[r.doc_id]]
    assert 0 < sum(doubted) < len(doubted)
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}  # only here
    right = [(r.quality >= 0.5) == (label[r.doc_id] == 1) for r in got if r.doc_id in label]
    all_must_pass = [(0 not in votes[r.doc_id]) == (label[r.doc_id] == 1) for r in got if r.doc_id in label]
    assert sum(right) > sum(all_must_pass)


def test_suffix_sort():
    rng = np.random.default_rng(1)
    for _ in range(200):
        buf = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 60)).astype(np.uint8)
        text = buf.tobytes()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array.sort(buf, len(buf) + 1).tolist() == want
        wanted = rng.random(len(buf)) < 0.3
        some = suffix_array.sort(buf, len(buf) + 1, wanted)
        assert [i for i in some.tolist() if wanted[i]] == [i for i in want if wanted[i]]


@pytest.mark.parametrize("members", [1000, 2])
def test_exact_duplicates(docs, empty, members, monkeypatch):
    monkeypatch.setattr(exact_dup, "BUCKET_MEMBERS", members)  # 2: anchors dealt to several buckets
    n = Counter((t or "").encode()[k : k + 400] for _, t, *_ in corpus() for k in range(len((t or "").encode()) - 399))
    want = []
    for i, t, *_ in corpus():
        raw = (t or "").encode()
        mark = np.zeros(len(raw), bool)
        for k in range(len(raw) - 399):
            if n[raw[k : k + 400]] > 1:
                mark[k : k + 400] = True
        want.append((i, len(raw), int(mark.sum()), np.frombuffer(raw, np.uint8)[~mark].tobytes()))
    got = exact_dup.remove(docs, carry=("n_words",)).collect()
    assert sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 0 and exact_dup.remove(empty).count() == 0


def _without_repeats(rows, length=400, words=51):
    """Bytes that stay: neither in a repeated string of `length` bytes nor in one of `words` whole words."""
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    marks = [np.zeros(len(raw), bool) for _, raw in raws]

    def strings(raw, by_words):
        own = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        return [(own[k][0], own[k + words - 1][1]) for k in range(len(own) - words + 1)] if by_words else [(k, k + length) for k in range(len(raw) - length + 1)]

    for by_words in (False, True):
        n = Counter(raw[a:b] for _, raw in raws for a, b in strings(raw, by_words))
        for (_, raw), mark in zip(raws, marks, strict=True):
            for a, b in strings(raw, by_words):
                if n[raw[a:b]] > 1:
                    mark[a:b] = True
    return sorted((i, np.frombuffer(raw, np.uint8)[~mark].tobytes()) for (i, raw), mark in zip(raws, marks, strict=True))


def test_passages_of_words(spark, docs, empty):
    """Passages of 51 words go whatever their bytes: of 101, and of about 300; of 50 words they stay."""
    rng = random.Random(11)
    own = lambda n, most=9: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, most))) for _ in range(n))
    short, long, fifty, blank = own(51, 1), own(51), own(50), own(60).replace(" ", "\n\t")
    rows = [(k, f"{own(30)} {p} {own(rng.randint(1, 40))}") for k, p in enumerate([short, long, fifty, blank] * 3)]
    rows += [(20, long), (21, f"{own(60)} {long[:-1]}é"), (22, f"x{short}"), (None, f"{long} {own(9)}"), (23, f"{own(5)} {short} {short}"), (24, "a " * 400)]
    got = exact_dup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words=51).collect()
    order = lambda rows: sorted(rows, key=str)
    want = _without_repeats([(str(i), t) for i, t in rows])
    assert order((str(r.doc_id), bytes(r.kept)) for r in got) == order(want)
    kept = {r.doc_id: bytes(r.kept).decode() for r in got}
    assert len(short) == 101 and 200 < len(long) < 400 and short not in kept[0] and long not in kept[1] and fifty in kept[2] and kept[20] == ""
    got = exact_dup.remove(docs, words=51).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == _without_repeats(corpus())
    assert exact_dup.remove(empty, words=51).count() == 0


def test_pipeline_drops_short_passages(spark):
    import corpus_pipeline

    rng = random.Random(12)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))
    passage, a, b = own(51), own(90), own(70)
    rows = [(1, f"{a} {passage}"), (2, f"{passage} {b}"), (3, own(80))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert 250 < len(passage) < 400 and got == {1: f"{a} ", 2: f" {b}", 3: rows[2][1]}


def test_language(spark, empty):
    full = queries.op9_langid(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in full.collect() if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string")
    nothing = langid.fit(empty.selectExpr("doc_id", "text", "text as lang"))
    assert [(r.lang_pred, r.score) for r in langid.predict(odd, nothing).collect()] == [("und", 0.0)] * 3


def test_toxicity(spark, empty):
    machine = toxicity.grammar()
    known = toxicity.symbols({"idiot": 4.0})
    score = lambda t: toxicity.clause_score(t.split(), known, machine)
    assert score("you idiot") > score("an idiot") > score("they said an idiot") > 0
    assert score("an idiot") > score("not an idiot") > 0 and score("kill you") < score("you kill") and score("nothing here") == 0
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.01").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    right = [r.predicted == toxic[r.doc_id] for r in got if r.held_out and r.doc_id in toxic]
    assert np.mean(right) > 0.95
    assert toxicity.score(empty, empty.selectExpr("doc_id", "0 as toxic")).count() == 0


def test_url_filter(spark):
    import datetime as dt

    day = lambda d: dt.date(2024, 1, d)
    pages = spark.createDataFrame([(1, "http://a.b.com/x", day(5)), (2, "https://U:p@B.com:80", day(20)), (3, None, day(5)), (4, "nothing", day(5)), (5, "http://a.b.com/y", day(1)), (6, "http://a.b.com", None)], "page_id long, url string, day date")
    entries = spark.createDataFrame([("b.com", day(3), "block"), ("b.com", day(10), "allow"), ("b.com", day(10), "allow"), (None, day(1), "block"), ("com", day(1), "block")], "domain string, day date, action string")
    assert {r.page_id: r.blocked for r in url_filter.judge(pages, entries).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(queries.oracle_sql()["op10_url_filter"])
    got = queries.op10_url_filter(spark, SF).select(*want.columns).collect()
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got)


def test_url_filter_odd_entries(spark):
    """A final dot is no part of a domain; an entry of one label covers only that host; extra columns and no entries."""
    import datetime as dt

    day = dt.date(2024, 1, 5)
    pages = spark.createDataFrame([(1, "http://a.b.com", day, "x"), (2, "http://com/", day, "x"), (3, "http://a_b.org", day, "x"), (4, "http://axb.org", day, "x")], "page_id long, url string, day date, domain string")
    entries = spark.createDataFrame([("b.com.", day, "block"), ("com", day, "block"), ("a_b.org", day, "block")], "domain string, day date, action string")
    assert {r.page_id: r.rule for r in url_filter.judge(pages, entries).collect()} == {1: "b.com", 2: "com", 3: "a_b.org", 4: None}
    assert {r.blocked for r in url_filter.judge(pages, entries.limit(0)).collect()} == {False}
    assert url_filter.judge(pages.limit(0), entries).count() == 0


def test_language_odd_texts(spark):
    """Tiny tables teach without a crash; numerals are no letters; null, empty and long texts, repeats and extra columns."""
    docs = spark.createDataFrame([(1, "the cat", "en", 1), (1, "the cat", "en", 1), (2, None, "en", 1), (3, "½ ² Ⅷ 12", "de", 1), (4, "", None, 1), (None, "der hund " * 200_000, "de", 1)], "doc_id long, text string, lang string, score int")
    for many in (0, 1, 2, 6):
        got = langid.predict(docs, langid.fit(langid.learnable(docs.limit(many), F.lit(False)))).collect()
        assert len(got) == 6 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 4)) and all(0 <= r.score <= 1 for r in got)


def test_removed_edges_keep_other_broken_characters(spark):
    import corpus_pipeline

    shared = "é" + " ".join(f"wort{k}" for k in range(80))
    rows = [(1, f"kept � one {shared}ü end"), (2, f"two {shared}ö end"), (3, "� alone")]
    docs = spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert got[3] == "� alone" and got[1].startswith("kept � one") and got[1].endswith(" end") and "wort5" not in got[1] and got[1].count("�") == 1


def test_digests(spark):
    """The thin queries carry what the contracts name."""
    got = queries.op2_idfile(spark, SF).collect()
    ids = _library_ids()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got[:20]:
        own = np.array([*ids(texts[r.doc_id]), 0], "<u4").tobytes()
        assert (r.n_tokens, r.ids_crc32) == (len(own) // 4, zlib.crc32(own))
    r = queries.op8_exact_dup(spark, SF).filter("n_removed = 0").first()
    assert r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert regex.__name__ == "regex"


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_pipeline_tells_rows_apart(spark):
    """Verdicts hold for rows without a doc_id, and for each text of a doc_id; of repeated rows one stays."""
    import corpus_pipeline

    rng = random.Random(31)
    own = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 7))) for _ in range(n))
    same, good = own(90), own(90)
    rows = [(1, good), (None, "too short"), (1, "too short"), (2, same), (2, same), (3, f"{own(2)} {same}"), (3, own(80)), (None, f"{same} {own(2)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    judged = corpus_pipeline.quality_rules(spark, docs, SF)
    assert sorted(map(str, ((r.doc_id, r.text) for r in judged.collect()))) == sorted(str(r) for r in rows if r[1] != "too short")
    left = corpus_pipeline.near_duplicates(spark, judged, SF).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, good), (2, same), rows[6]]


def _whole_pipeline(rows, items, judged):
    """The five stages in plain Python, on (doc_id, text): what stays, with its ids by the library."""
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = [(i, t) for i, t in rows if judged(t)]
    rows = list(dict.fromkeys(rows))
    found = _components(list(enumerate(t for _, t in rows)), 5)
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(found[k][1], []).append(row)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    raw = _without_repeats([(str(k), t) for k, (_, t) in enumerate(rows)])
    rows = [(rows[int(k)][0], b.decode()) for k, b in raw]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t, n: {tuple(w[k : k + n]) for w in [word.findall(_lower(t))] for k in range(max(1, len(w) - n + 1))}
    leaks = set().union(*(cut(t, 10) for t in items))
    rows = [(i, t) for i, t in rows if not cut(t, 10) & leaks]
    ids = lambda t: np.array(library.encode_ordinary(t), "<u4")
    return sorted(((i, len(ids(t)), hashlib.sha256(ids(t).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str)


def test_pipeline_run(spark, tmp_path):
    """run() against plain Python: junk, near and exact copies, passages, leaks, rows without a doc_id and rows that share one."""
    import corpus_pipeline

    rng = random.Random(21)
    own = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 7))) for _ in range(n))
    leak, passage, base, twin = own(30), own(51), own(120), own(90)
    junk = " ".join(["buy now"] * 60)
    rows = [(k, own(90)) for k in range(20)]
    rows += [(30, f"{own(60)} {passage}"), (31, f"{passage} {own(70)}"), (32, f"{own(40)} {passage} {own(60)}")]
    rows += [(41, base), (40, f"{base} {own(3)}"), (42, base), (None, f"{own(2)} {base}")]
    rows += [(50, junk), (None, junk), (None, "too short"), (None, None), (51, "")]
    rows += [(60, f"{own(50)} {leak[:150]} {own(20)}"), (None, f"{leak} {own(60)}"), (61, own(80))]
    rows += [(70, twin), (70, twin), (71, own(90)), (71, own(90)), (72, f"{own(2)} {twin}"), (72, own(100)), (None, own(85)), (5, junk)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("1", leak), (None, rows[3][1])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Clean prose and the two kinds of junk are plain to tell; the estimation has tests of its own.
    want = _whole_pipeline(rows, [leak, rows[3][1]], lambda t: t and len(t.split()) >= 10 and t != junk)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    ids = [r.doc_id for r in got]
    assert 3 not in ids and 60 not in ids and 50 not in ids and ids.count(70) == 1 and ids.count(71) == 2 and ids.count(40) == 1 and ids.count(None) == 1
