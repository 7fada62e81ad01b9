import random

import numpy as np
import pytest

pytest.importorskip("factloom.llm")
import public_tokenizers as P
from tokenizers import Tokenizer

from factloom.llm import packing

PATH = P.path("byte_bpe_50k.json")


def plain_best_fit(sizes, width):
    rows, room = [], []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(r, k) for k, r in enumerate(room) if r and r >= sizes[item]]
        least = min((r for r, _ in fits), default=None)
        if least is None:
            rows.append([item])
            room.append(width - sizes[item])
        else:
            k = next(k for r, k in fits if r == least)
            rows[k].append(item)
            room[k] -= sizes[item]
    return [sum(sizes[i] for i in r) for r in rows]


def test_best_fit_fills_rows_like_a_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        width = rng.randint(1, 60)
        sizes = [rng.randint(0, width) for _ in range(rng.randint(0, 80))]
        rows = packing.best_fit(sizes, width)
        assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in r) for r in rows) == sorted(plain_best_fit(sizes, width))


@pytest.mark.parametrize("group", [20_000, 30])
def test_documents_come_back_whole(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["alpha", "béta", "gamma ray", "12.5"]) for _ in range(rng.choice([0, 3, 30, 300])))) for k in range(120)] + [(500, None), (501, "z" * 3000)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, width=64, pad=9).cache()
    library = Tokenizer.from_file(PATH)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in packing.unpack(packed).collect()}
    assert got == want
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and (ids[r.n_tokens :] == 9).all()
        assert r.resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.chunks) == len(r.resets)
    assert sum(r.n_tokens for r in packed.collect()) == sum(map(len, want.values()))


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, "a b", 1), (1, "a b", 1), (2, None, 1)], "doc_id long, text string, ids int")
    held = sorted((d for r in packing.pack(df, PATH).collect() for d in r.doc_ids), key=str)
    assert held == [1, 1, 2, None]
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_written_rows_are_padded_and_not_replaced_unasked(spark, tmp_path):
    df, to = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string"), str(tmp_path / "packed")
    packing.write(df, PATH, to, width=16, pad=7)
    rows = spark.read.parquet(to).collect()
    assert all((np.frombuffer(r.ids, "<u2")[r.n_tokens :] == 7).all() and r.n_tokens < 16 for r in rows)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        packing.write(df, PATH, to)
    packing.write(df.limit(1), PATH, to, overwrite=True)
    assert sum(len(r.doc_ids) for r in spark.read.parquet(to).collect()) == 1
