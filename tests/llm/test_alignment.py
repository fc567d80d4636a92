"""Alignment of two tokenizers against the libraries on whole texts and plain Python counts."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from treecensus.llm import alignment, hashing, queries
from treecensus.llm.common import importable
from treecensus.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, key string, part string, slice string, copies string, n_a string, keys string, times string"
BASE = "The quick brown fox doesn't jump over 12345 lazy dogs; naïve façade (2024-01-02) "
TEXTS = [
    (1, BASE), (1, BASE), (1, BASE + "x"), (None, BASE), (None, None), (2, None), (3, ""), (4, " "), (5, "   \n\t "), (6, "a  b   c\n d \te"),
    (7, "<|endoftext|> <s> </s> <unk> <0x0A>"), (8, "U+2581 ▁ is a space"), (9, "▁"), (10, "日本語 テキスト ｆｕｌｌ é   x y 🙂🙃"),
    (11, "x" * 3000 + "=" * 700), (12, "".join(chr(97 + i * i % 26) for i in range(5000))), (13, " lead and trail  "), (14, "\x00\x01 nul"),
    (15, "á ệ ​ ﻿"), (16, BASE * 60), (17, "It's we'll 'tis ' s \n\n's"),
]


def pieces():
    letters = {c: b for b, c in byte_letters().items()}
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True

    def both(text):
        a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        raw_a = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (a, raw_a, b, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else ([], [], [], [])

    return both


def groups(a, raw_a, b, raw_b):
    ends_a, ends_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
    out, before = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        out.append(([i for i, e in zip(a, ends_a) if before < e <= end], [j for j, e in zip(b, ends_b) if before < e <= end]))
        before = end
    return out


def brute(rows):
    both = pieces()
    cut = [groups(*both(text)) if text else [] for _, text in rows]
    links = [Counter((i, j) for x, y in g for i in x for j in y) for g in cut]
    counts = Counter(pair for own in links for pair in own)
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (name, _), g, own in zip(rows, cut, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        out.append((name, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
                    sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()),
                    sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def made(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("known,slice_,branch,held", [(2_000_000, 1 << 16, 1 << 18, 1 << 20), (0, 40, 100, 30), (2_000_000, 50, 9, 20)])
def test_equals_plain_python(spark, monkeypatch, known, slice_, branch, held):
    for name, value in (("SLICE", slice_), ("BRANCH", branch), ("HELD", held)):
        monkeypatch.setattr(alignment, name, value)
    importable(spark)
    found = alignment.align(made(spark, TEXTS), A, B, known).select(*alignment.RESULT).collect()
    assert sorted(map(tuple, found), key=repr) == brute(TEXTS)


def test_the_query(spark, tmp_path):
    made(spark, TEXTS[5:]).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op11_alignment"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == brute(TEXTS[5:])
    made(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op11_alignment"](spark, f"{tmp_path}/none").count() == 0


def test_parts_are_encoded_like_whole_texts():
    draw, both, own = random.Random(4), pieces(), alignment.Aligner(A, B)
    bits = [" ", "  ", "\n", "\t", " ", "　", "a", "the", "'s", "12", "é", "日", "🙂", "-", "_", ".", "́", "\x85", " ", "<s>"]
    for n in range(400):
        text = "".join(draw.choices(bits, k=draw.randrange(1, 40)))
        found = own.documents([text])
        a, raw_a, b, raw_b = both(text)
        assert (found.a.tolist(), found.b.tolist()) == (a, b), text
        assert list(zip(found.x.tolist(), found.y.tolist())) == [(len(x), len(y)) for x, y in groups(a, raw_a, b, raw_b)]


def test_a_worker_forgets(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_KEPT", 3)
    own = alignment.Aligner(A, B)
    for _ in range(3):
        assert own.documents(["one two three four five", None, "one six"]).n_b.tolist()[1:] == [0, 2]
        assert len(own.index) == 6


@pytest.mark.parametrize("large", [0, 2])
def test_large_groups_are_counted_by_their_distinct_tokens(monkeypatch, large):
    own = alignment.Aligner(A, B)
    found = own.documents([t for _, t in TEXTS])
    want = [x.tolist() for x in found.pairs()]
    monkeypatch.setattr(alignment, "LARGE", large)
    assert [x.tolist() for x in found.pairs()] == want


def test_a_perfect_hash_has_no_gaps():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(draw.integers(0, 1 << 32, n))
        perfect = hashing.PerfectHash.of(keys)
        for each in (perfect, hashing.PerfectHash.loaded(perfect.stored())):
            assert each.size == len(keys)
            assert sorted(each.find(keys).tolist()) == list(range(len(keys)))
    dense = np.arange(5000) << 16
    assert sorted(hashing.PerfectHash.of(dense).find(dense).tolist()) == list(range(5000))


def test_texts_are_read_once(spark, tmp_path):
    importable(spark)
    where = str(tmp_path / "documents")
    spark.createDataFrame([(i, BASE + str(i)) for i in range(4)], "doc_id bigint, text string").write.parquet(where)
    for known in (alignment.KNOWN, 0):
        found = alignment.align(spark.read.parquet(where), A, B, known)
        assert found.count() == 4
        assert not any("/documents/part-" in f and str(tmp_path) in f for f in found.inputFiles())
