import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from test_near_copies import plain_fingerprint, plain_groups, plain_removal

from sparkstrata.llm import quality_knn


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(20)
    stock = "the river moves over stone and light under an old bridge near some quiet town while people walk home".split()
    text = lambda n: " ".join(r.choice(stock) + str(r.randrange(99)) for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for d in range(160):
        good = r.random() < 0.7
        t = text(r.randint(30, 90))
        rows.append((d, t if good else t.upper() + " !!" * 20))
        labels.append((d, int(good), 0))
    passage = text(55)
    rows += [(200 + k, rows[k][1]) for k in range(10)] + [(300 + k, f"{text(20)}\n{passage}\n{text(20)}") for k in range(5)] + [(400, None), (401, "")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(docs)
        assert name == "pack" or docs.columns == columns
    q = {x.doc_id for x in outs[0].collect()}
    scored = quality_knn.quality_scores(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert q == {x.doc_id for x in scored if x.score >= 0.5}
    assert np.mean([(d in q) == bool(g) for d, g, _ in labels]) > 0.95
    own = [(x.doc_id, x.text) for x in outs[0].collect()]
    label = plain_groups([(d, plain_fingerprint(t, 5)) for d, t in own])
    near = {x.doc_id for x in outs[1].collect()}
    assert near == {d for k, (d, _) in enumerate(own) if label[k] == d}
    kept = {x.doc_id: x.text for x in outs[2].collect()}
    want = {d: (n, gone, h) for d, n, gone, h in plain_removal([x for x in own if x[0] in near])}
    assert set(kept) == {d for d, (n, gone, _) in want.items() if not n or gone < n}
    assert all(hashlib.sha256(b" ".join(t.encode().split())).hexdigest() == want[d][2] for d, t in kept.items())
    pieces = outs[3].collect()
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert set(total) == set(kept) and all(total[p.doc_id] == p.doc_tokens for p in pieces)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in again.collect()) == Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces)
    assert zlib.crc32(b"") == 0
