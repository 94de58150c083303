"""Alignment of two tokenizers against token-by-token brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from fieldweave.llm import alignment, blocks

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    return [None, "", " ", "   \n", "one two", "one two", prose(40), "<|endoftext|> <s> </s> <unk> <0x41>", "has ▁ inside", "漢字 ¿qué?\u0085  !!　", "a\n\n  b\r\n\tc\x00d",
             "﻿é ﬁ ①", "it's we'll  ", "line here\nline here\n", "x" * 3000, prose(30000)]


def by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    known = alignment.byte_of_character()
    out, linked, count = [], [], Counter()
    for i, t in rows:
        ids_a = ids_b = []
        if t:
            ids_a, ids_b = a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)
            spelt_a = [bytes(known[c] for c in a.id_to_token(x)) for x in ids_a]
            pieces = [b.id_to_piece(x) for x in ids_b]
            spelt_b = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(ids_b, pieces)]
            if not b"".join(spelt_a) == b"".join(spelt_b) == f" {t}".encode():
                ids_a = ids_b = []
        pairs, groups = [], []
        if ids_a:
            x = y = end_a = end_b = 0
            group = ([ids_a[0]], [ids_b[0]])
            end_a, end_b = len(spelt_a[0]), len(spelt_b[0])
            while True:
                pairs.append((ids_a[x], ids_b[y]))
                go_a, go_b = end_a <= end_b, end_b <= end_a
                if go_a and go_b:
                    groups.append(group)
                    group = ([], [])
                x, y = x + go_a, y + go_b
                if x == len(ids_a):
                    break
                if go_a:
                    end_a += len(spelt_a[x])
                    group[0].append(ids_a[x])
                if go_b:
                    end_b += len(spelt_b[y])
                    group[1].append(ids_b[y])
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append([i, len(ids_a), len(ids_b), len(groups), len(pairs), hashlib.sha256(said.encode()).hexdigest() if ids_a else ""])
        linked.append(pairs)
        count.update(set(pairs))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted((*o[:5], sum(count[p] == best[p[0]] for p in ps), sum(count[p] for p in ps), o[5]) for o, ps in zip(out, linked))


def test_alignment(spark, monkeypatch):
    rows = list(enumerate(texts())) + [(4, "one two")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, n_a string, block long").repartition(3)
    got = sorted(tuple(r) for r in alignment.link(docs, A, P.PATTERN, B).collect())
    assert got == by_hand(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link(empty, A, P.PATTERN, B).collect() == []
    nulls = spark.createDataFrame([(None, "one two"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_a"] for r in alignment.link(nulls, A, P.PATTERN, B).collect()) == [0, 2]


def test_blocks_of_any_size(monkeypatch):
    a, b = alignment.ByteLevel(A, P.PATTERN), alignment.SentencePieces(B)
    one = [t or "" for t in texts()]
    whole = alignment.align(one, a, b)
    for i, t in enumerate(one):
        alone = alignment.align([t], a, b)
        assert alone["n_links"][0] == whole["n_links"][i] and alone["groups_sha256"][0] == whole["groups_sha256"][i]
    b.cuts = False  # a vocabulary whose pieces span words gets whole texts
    again = alignment.align(one, a, b)
    assert again["groups_sha256"] == whole["groups_sha256"]


@pytest.mark.parametrize("values", [[], [0], [5, 5, 1 << 40, (1 << 64) - 1], list(range(1000))])
def test_pack(values):
    import numpy as np

    x = np.array(values, np.uint64)
    assert blocks.unpack(blocks.pack(x)).tolist() == values
    assert blocks.unpack(blocks.pack(np.sort(x), True)).tolist() == sorted(values)


def test_bits():
    import numpy as np

    for size in (1, 63, 64, 65, 128):
        bits = blocks.Bits.at(np.array([0, size - 1]), size)
        assert bits.rank(np.array([0, size])).tolist() == [0, min(size, 2)]
        assert bits.select().tolist() == sorted({0, size - 1})
