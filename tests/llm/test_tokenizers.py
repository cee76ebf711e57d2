"""Token counts and piece codes against the libraries that define them."""

import hashlib
import random

import pytest
import sentencepiece
import tokenizers

from spokewise.llm import piece_codec, queries, token_counts
from spokewise.llm.common import tokenizer_path

ODD = [
    None, "", " ", "\n\t ", "  two  spaces ", "Ünïcödé ÉÀ ﬁ Å é é", "I'm you're he'll THEY'VE", "emoji 😀😀 🏳️‍🌈", "a" * 3000, "the " * 2000,
    "<|startoftext|>x<|endoftext|>", "<s> </s> <unk>", "▁x ▁▁ y", "x▁", "123 4567 ٣٤ ²", "ΑΣ ΑΣ. Σ", "İstanbul ǅ", "中文字 かな 한글", "\x00\x01 ​﻿", "à́ x y", "qu'il l'été", "…—“”", "!!??..,,;;",
]


def noise(n):
    r = random.Random(9)
    signs = "abcdeéü ßñ .,'!0123456789\n\t▁Σ中😀ABC"
    return ["".join(r.choice(signs) for _ in range(r.randrange(1, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark, sf_more):
    return ODD + noise(400) + [r.text for r in queries.table(spark, sf_more, "documents").select("text").collect()]


def test_token_counts(spark, texts):
    lib = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048), repr((t or "")[:80])


def test_piece_codes(spark, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(4)
    path = tokenizer_path("piece_bpe_32k.model")
    coded = piece_codec.encode(docs, path)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in coded.collect()}
    again = {r.doc_id: r.decoded for r in piece_codec.decode(coded, path).collect()}
    digest = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.code_digest(docs, path).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_eos=True)
        text = lib.decode(ids)
        assert got[i] == (ids, text) and again[i] == text, repr((t or "")[:80])
        assert digest[i] == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_empty_and_repeated_rows(spark):
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()) == [(0, 0), (1, 2), (1, 2)]
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
    path = tokenizer_path("piece_bpe_32k.model")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in piece_codec.encode(docs, path).collect()) == [(0, 1), (1, 3), (1, 3)]
    assert piece_codec.code_digest(docs.limit(0), path).count() == 0


def test_decoded_text_is_made_of_the_ids(monkeypatch):
    """A wrong id shows in the decoded text."""
    table = piece_codec.PieceTable(tokenizer_path("piece_bpe_32k.model"))
    right = table.split(piece_codec.MARK + "tree")
    assert table.coded_chunk(piece_codec.MARK + "tree")[1] == " tree"
    wrong = [*right[:-1], table.split(piece_codec.MARK + "stone")[-1]]
    monkeypatch.setattr(table, "split", lambda chunk: wrong)
    ids, text = table.coded_chunk(piece_codec.MARK + "tree")
    assert ids == " ".join(map(str, wrong)) and text == table.text(wrong, first=False) != " tree"


def test_letters_new_to_unicode():
    """Case and class of every kind of letter are the library's, alone and among others."""
    import tokenizers

    from spokewise.llm import token_counts

    path = tokenizer_path("word_bpe_49k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), token_counts.WordBpe(path)
    odd = sorted(token_counts.changed_classes())
    points = [*odd[:: max(1, len(odd) // 400)], 0xA7CB, 0xA7DC, 0x1C89, 0x10D50, 0x32808, *range(0x80, 0x3000, 17)]
    texts = [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)}" for c in points]
    assert own.count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    # blocks that don't take this way are alike in both
    plain = [chr(c) for c in range(0x80, 0xE000) if not 0xD800 <= c and not token_counts._CHANGING.match(chr(c))]
    assert len(plain) > 30_000 and not any(ord(c) in token_counts.changed_classes() for c in plain)
    assert [c for c in plain if tokenizers.normalizers.Lowercase().normalize_str(c) != c.lower()] == []
