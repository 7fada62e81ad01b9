import random
import re

import pytest

pytest.importorskip("factloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers
from factloom.llm import toxicity
from tokenizers import Tokenizer

BAD = ("vile", "nasty", "grim")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioubcdfgst") for _ in range(6)) for _ in range(600)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    docs, labels = [], []
    for k in range(300):
        own = prose(80)
        if k % 5 == 0:
            for _ in range(4):
                own.insert(rng.randrange(80), rng.choice(BAD))
        docs.append([k, " ".join(own)])
        labels.append((k, 1, int(k % 5 == 0)))
    copies = {}
    for k in range(1, 40, 5):
        own = docs[k][1].split()
        own[rng.randrange(80)] = "zzzz"
        docs.append([len(docs), " ".join(own)])
        copies[docs[-1][0]] = k
    question = "a train leaves at 40 km per hour and travels for 3 hours how far does it go before it stops at the next town"
    docs[2][1] += " " + question.replace("40", "55").replace("3", "7")
    docs[3][1] += ' token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" end'
    docs += [[400, None], [401, ""], [402, docs[4][1]]]
    out = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en", "web", len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), dict(docs), copies


def test_whole_pipeline_against_brute_force(spark, tables):
    folder, docs, _ = tables
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    scorer = toxicity.Scorer(toxicity.fit(read("documents"), read("labels")))
    toxic = {k for k, t in docs.items() if scorer.scores([t or ""])[0] >= toxicity.THRESHOLD}
    assert len(toxic ^ {k for k, t in docs.items() if set((t or "").split()) & set(BAD)}) <= 12
    left = {k: t for k, t in docs.items() if k not in toxic}
    sets, least = {k: shingles(t) for k, t in left.items()}, {}
    for k in sorted(left):
        near = [j for j in least if sets[k] and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])]
        least[k] = min((least[j] for j in near), default=k)
    left = {k: t for k, t in left.items() if least[k] == k and k != 2}
    assert 402 not in left
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for k, t in left.items():
        text = re.sub(r'token = "[0-9a-f]+', "[SECRET]", t or "")
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        want[k] = (len(ids), b"".join(i.to_bytes(4, "little") for i in ids))
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want


def test_stages_return_documents_and_bear_edges(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id in (1, 3, 400, 401)")
    from pyspark.sql import functions as F

    odd = docs.withColumns({"node": F.lit("n"), "spans": F.lit(1), "mark": F.lit(2.0), "row": F.lit("r")})
    odd = odd.unionByName(odd.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.where("doc_id = 3"))
    for frame in (docs, docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, folder)
            assert out.columns == frame.columns, name
            assert out.count() == frame.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, frame, folder).count() == frame.count()
    clean = corpus_pipeline.redact_secrets(spark, odd.where("doc_id = 3"), folder).first()
    assert "[SECRET]" in clean.text and clean.n_chars == len(clean.text)
