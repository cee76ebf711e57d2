"""The pipeline against the plain versions of its stages, one after another."""

import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece

from spokewise.llm import queries, toxicity
from spokewise.llm.common import tokenizer_path
from spokewise.llm.windows import flat_bytes

from .test_decontaminate import hits
from .test_line_dedup import brute as line_brute
from .test_near_dedup import brute as near_brute


def test_run(spark, sf):
    docs = queries.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = toxicity.train(docs, queries.table(spark, sf, "labels"), queries.is_held_out())
    scores = model.scores(*flat_bytes(pa.array([t for _, t in rows])))
    rows = [r for r, s in zip(rows, scores) if s < 0.7]
    lined = line_brute(rows)
    rows = [(i, lined[i][2]) for i, _ in rows if not lined[i][1] or lined[i][2].strip()]
    near = near_brute(rows, 5)
    rows = [(i, t) for i, t in rows if near[i][2]]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    found = hits(rows, items)
    rows = [(i, t) for i, t in rows if not found[i][1]]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = {i: lib.encode(t or "", add_eos=True) for i, t in rows}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and len(got) == len(want)
    assert all(r.decoded == lib.decode(list(r.ids)) for r in got)


def test_stages_keep_the_columns(spark, sf):
    docs = queries.table(spark, sf, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


LIB = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
#: Columns named like those that the stages make for themselves.
CLASHING = ("v", "key", "gone", "n_lines", "score", "kept", "component_id", "partner", "id", "n")


def folder(tmp_path, rows, items=(), labels=()):
    """Tables of the given documents, benchmark items and labels."""
    docs = {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}
    docs |= {c: pa.array([None if k % 3 else f"{c} {k}" for k in range(len(rows))], pa.string()) for c in CLASHING}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, *_ in labels], pa.int64()), "quality": pa.array([0] * len(labels), pa.int32()), "toxic": pa.array([y for _, y in labels], pa.int32())}), tmp_path / "labels.parquet")
    return str(tmp_path)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9))) for _ in range(n))


def rows_of(df):
    return sorted(((r.doc_id, list(r.ids), r.decoded) for r in df.collect()), key=str)


def encoded(*rows):
    return sorted(((i, LIB.encode(t or "", add_eos=True), LIB.decode(LIB.encode(t or "", add_eos=True))) for i, t in rows), key=str)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, clashing columns."""
    item, long = prose(1, 14), prose(2, 150_000)
    words = long.split(" ")
    near = " ".join([*words[:70_000], "another", *words[70_001:]])
    first, other = "\n".join(prose(k, 12) for k in (3, 4)), prose(5, 30)
    rows = [
        (1, first), (1, other), (2, first), (3, None), (4, ""), (None, prose(6, 40)), (None, None), (None, prose(6, 40)),
        (5, f"{prose(7, 60_000)} {item} the end"), (6, long), (7, near), (8, "\n \n"), (9, f"{first}\nof its own"), (10, item[:-1].rsplit(" ", 6)[0]), (4, ""),
    ]
    folder(tmp_path, rows, [(1, item), (2, None), (None, ""), (1, item)], [(1, None), (None, 1), (2, 0), (2, 1)])
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    # 2 is lines of 1, 5 holds an item, 7 is nearly 6, 10 is too short for a window; versions of one id stay or go together
    assert got == encoded((1, first), (1, other), (3, None), (4, ""), (4, ""), (None, prose(6, 40)), (None, prose(6, 40)), (None, None), (6, long), (8, "\n \n"), (9, "of its own"), (10, item[:-1].rsplit(" ", 6)[0]))


def test_stages_on_odd_rows_keep_the_columns(spark, tmp_path):
    folder(tmp_path, [(1, "a b c"), (None, None), (1, "a b c"), (2, "")])
    docs = queries.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name


def test_empty_tables(spark, tmp_path):
    folder(tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
