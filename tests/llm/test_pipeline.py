import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from folioflow.llm import op10_toxicity
from tests.llm import test_near_copies, test_op4, test_op7, test_op9, test_op10


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng, rows = random.Random(4), test_op10.corpus(500, 9)
    texts = [t for _, t, _ in rows]
    shared = " ".join(f"shared{i}" for i in range(60))
    for i in range(0, 500, 7):
        texts[i] += f"\nThe same footer on many pages\nunique line {i} here\n" + (shared if i % 2 else "")
    for i in range(100, 140):
        texts[i] = texts[i - 100]
    for i in range(140, 160):  # near copies
        words = (texts[i - 100] + " " + " ".join(f"x{rng.randrange(999)}" for _ in range(300))).split(" ")
        texts[i - 100], words[50] = " ".join(words), "changed"
        texts[i] = " ".join(words)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_stages_against_brute_force(spark, corpus, tmp_path):
    folder, docs = corpus
    now = {d[0]: d[1] for d in docs}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, folder)
        if name == "toxicity":
            machine = op10_toxicity.train(frame, spark.read.parquet(f"{folder}/labels.parquet"))
            now = {i: t for i, t in now.items() if machine.score(machine.worst([t])[0]) < 0.5}
            assert 300 < len(now) < 420
        elif name == "line_dedup":
            now = {i: None if t is None and now[i] is None else t for i, _, _, t in test_op9.brute(sorted(now.items())) for _ in [0] if i in now}
            now = {i: (None if i == 900 else t) for i, t in now.items()}
        elif name == "simhash_dedup":
            group = test_near_copies.brute(now)
            now = {i: t for i, t in now.items() if group[i] == i}
        elif name == "suffix_dedup":
            raw = {i: (t or "").encode() for i, t in now.items()}
            for (i, r), (_, _, _, _, spans) in zip(list(raw.items()), test_op4.brute(list(raw.values()))):
                for a, b in reversed(spans):
                    r = r[:a] + r[b:]
                now[i] = None if now[i] is None else r.decode()  # the texts are ASCII
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            got = {r.doc_id: r for r in out.collect()}
            assert {i: r.text for i, r in got.items()} == now
            if name != "toxicity":
                assert all(r.n_chars == len(r.text or "") for r in got.values())
        else:
            tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            sizes = {i: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in now.items()}
            order = {i: k for k, i in enumerate(sizes)}
            test_op7.check([(order[r.doc_id], r.start, r.length, r.sequence_id, r.offset) for r in out.collect()], list(sizes.values()), 4096)
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")


def test_run_is_the_stages(spark, corpus):
    folder, docs = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    by_doc = defaultdict(int)
    for r in rows:
        by_doc[r.doc_id] += r.length
    assert set(by_doc) <= {d[0] for d in docs} and 200 < len(by_doc) < 420
    assert np.sum(list(by_doc.values())) > 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null rows, repeated rows, empty and very long texts, clashing columns; then an empty table."""
    long = " ".join(f"word{i}" for i in range(60_000))
    own = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, "one text of five words here", "en", "s", 27), (1, "one text of five words here", "en", "s", 27), (2, long, "en", "s", len(long)), (3, None, "de", "s", None), (4, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tk string, key long, text_key int, ids string, component long"
    docs = spark.createDataFrame([(*r, "x", 7, 8, "y", 9) for r in own], schema)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = {name: stage(spark, docs, str(tmp_path)).collect() for name, stage in corpus_pipeline.STAGES}
    show = lambda rows: sorted((str(r.doc_id), len(r.text or "")) for r in rows)
    every = sorted((str(r[0]), len(r[1] or "")) for r in own)
    assert show(texts["toxicity"]) == show(texts["line_dedup"]) == every
    # one of the repeated rows, and one of the two texts without words that have an id; rows without an id stay
    assert show(texts["simhash_dedup"]) == [("1", 27), ("2", len(long)), ("3", 0), ("None", 0), ("None", 0)]
    assert show(texts["suffix_dedup"]) == every  # repeated rows are shorter than a repeated string has to be
    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert sum(r.length for r in texts["packing"]) == sum(len(tokens.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in own)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), str(tmp_path))
        assert none.collect() == [] and (name == "packing" or none.columns == list(corpus_pipeline.COLUMNS))
