"""Each stage of the pipeline on its own input against brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from test_decontam import plain as plain_hits
from test_line_dedup import plain as plain_lines
from test_ngram_join import closure, linked, shingles
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    fill = [f"wort{i}" for i in range(300)]
    body = lambda n: "\n".join(" ".join(rng.choices(fill, k=9)) for _ in range(n))
    bench = [(i, " ".join(rng.choices(fill, k=25))) for i in range(5)]
    texts = [body(rng.randrange(1, 12)) for _ in range(120)]
    toxic = set()
    for i in range(0, 120, 4):
        texts[i] += " grobnik " + rng.choice(fill) + " snarfel"
        toxic.add(i)
    for i in range(1, 120, 12):
        texts[i] += "\n" + bench[i % 5][1]
    texts += [texts[5], texts[6] + " one more", texts[7].replace(" ", "  "), body(3) + "\n" + texts[9], None, "", " "]
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "de", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, toxic, bench


def test_stages(spark, sf_dir):
    path, toxic, bench = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "bpe"]

    def step(name, df):
        out = steps[name](spark, df, path)
        if name != "bpe":
            assert out.columns == df.columns
        rows = out.collect()
        return rows, spark.createDataFrame(rows, out.schema)

    before = docs.collect()
    rows, df = step("toxicity", docs)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before if r.doc_id not in toxic)

    want = plain_lines([(r.doc_id, r.text) for r in rows])
    kept = {i: text for (i, t), (text, gone) in want.items() if not gone or gone < len(t.split("\n"))}
    rows, df = step("line_dedup", df)
    assert {r.doc_id: r.text for r in rows} == kept and all(r.n_chars == len(r.text) for r in rows if r.text is not None)

    sets = [shingles(r.text, 5) for r in rows]
    label = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j], 80)])
    first = {}
    for r, v in zip(rows, label):
        first[v] = min(first.get(v, r.doc_id), r.doc_id)
    want = sorted(first.values())
    rows, df = step("ngram_join", df)
    assert sorted(r.doc_id for r in rows) == want

    want = sorted(r.doc_id for r in rows if not plain_hits(r.text, bench, 10)[1])
    rows, df = step("decontamination", df)
    assert sorted(r.doc_id for r in rows) == want

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in rows}
    rows, _ = step("bpe", df)
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).select("doc_id", "n_tokens").collect())) == sorted((r.doc_id, r.n_tokens) for r in rows)


def test_repeated_rows_clashing_columns_and_empty_tables(spark, sf_dir, tmp_path):
    path, _, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(30)
    more = docs.unionByName(docs.limit(3)).selectExpr("*", "'x' as _lines", "1 as _score", "2 as _gone", "3 as _contamination", "'y' as k1")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        once, twice = stage(spark, docs, path), stage(spark, more, path)
        assert twice.columns == more.columns
        ids = [r.doc_id for r in once.collect()]
        assert {r.doc_id for r in twice.collect()} == set(ids) or name == "line_dedup"  # there, repeated lines go with their texts
        assert stage(spark, more.limit(0), path).count() == 0
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
