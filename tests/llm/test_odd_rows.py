"""Rows without an id, texts of over a megabyte, repeated rows and clashing columns, for the operators that take whole documents."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from fieldweave.llm import alignment, bpe, conversation_trie, decontaminate, exact_dup, idfile, ngram_lm, quality, tokens

rng = random.Random(8)
WORDS = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(4000)]
LONG = " ".join(rng.choice(WORDS) for _ in range(230_000))
ROWS = [(1, LONG), (None, "one two three"), (None, None), (2, "one two three"), (2, "one two three"), (3, ""), (None, f"x {LONG[500_000:501_000]} y")]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG.encode()) > 1 << 20
    return spark.createDataFrame([(i, t, "own", 7) for i, t in ROWS], "doc_id long, text string, row string, k long").repartition(2)


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_bpe(docs):
    import tiktoken

    by_bytes = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=by_bytes, special_tokens={})
    got = bpe.encode(docs, bpe.RankMap(by_bytes), P.PATTERN, decoded=True).collect()
    digest = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert ordered((r.doc_id, digest(r.ids), bytes(r.decoded)) for r in got) == ordered((i, digest(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)


def test_token_counts(docs):
    ids = library()
    got = tokens.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert ordered((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == ordered((i, len((t or "").encode()), len(ids(t))) for i, t in ROWS)


def test_id_file(spark, docs):
    ids, path = library(), idfile.new_path(spark)
    idfile.write(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    back = sorted(idfile.read(spark, path).collect(), key=lambda r: r.start)
    assert ordered((r.doc_id, zlib.crc32(bytes(r.ids))) for r in back) == ordered((i, zlib.crc32(np.array([*ids(t), 0], "<u4").tobytes())) for i, t in ROWS)
    assert [r.start for r in back] == np.cumsum([0, *(len(r.ids) // 4 for r in back)])[:-1].tolist()


def test_decontaminate(spark, docs):
    item = " ".join(LONG.split()[100_000:100_012])
    bench = spark.createDataFrame([("7", item), ("8", "one two")], "item_id string, text string")
    got = ordered((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.scan(docs, bench).collect())
    assert (1, 230_000, 12, "7") in got and got.count((2, 3, 2, "8")) == 2 and (None, 3, 2, "8") in got and (None, 0, 0, "") in got


def test_quality_counts(docs):
    got = ordered((r.doc_id, r.n_words) for r in quality.judge(docs).collect())
    assert got == ordered((i, len((t or "").split())) for i, t in ROWS)


def test_exact_duplicates(docs):
    got = {(r.doc_id, r.n_bytes): sum(s.end - s.start for s in r.spans) for r in exact_dup.remove(docs).collect()}
    passage = len(LONG[500_000:501_000].encode())
    assert got[None, passage + 4] >= passage and got[1, len(LONG.encode())] >= passage and got[2, 13] == 0


def test_alignment(docs):
    got = alignment.link(docs, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model")).collect()
    import sentencepiece

    ids, pieces = library(), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = ordered((i, len(ids(f" {t}")) if t else 0, len(pieces.encode(t)) if t else 0) for i, t in ROWS)
    assert ordered((r.doc_id, r.n_a, r.n_b) for r in got) == want
    assert all(r.n_groups <= min(r.n_a, r.n_b) and r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= max(r.count_sum, r.n_links) for r in got)


def test_language_model(docs):
    got = ngram_lm.score(docs, docs["doc_id"] == 1).collect()
    assert ordered((r.doc_id, r.n_tokens) for r in got) == ordered((i, len((t or "").split()) + 1) for i, t in ROWS)
    by = {(r.doc_id, r.n_tokens): r for r in got}
    assert by[1, 230_001].score > by[1, 230_001].base_score and {r.train_tokens for r in got} == {230_001}


def test_one_very_long_turn(spark):
    rows = [(5, 0, "user", LONG), (6, 0, "user", LONG), (6, 1, None, None)]
    made = conversation_trie.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r.depth == 0 for r in made) == 1 and all(r.n_leaves >= 1 for r in made)
