import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from lexweave.llm import bpe_codec, importance, mixing, queries, secrets
from lexweave.llm.common import table
from tests.llm.cases import frame
from tests.llm.test_bottomk import plain


def test_stages(spark, sf):
    """Each stage against brute force on what the stage before it returned."""
    docs = table(spark, sf, "documents")
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(spark.createDataFrame(stage(spark, seen[-1], sf).toPandas(), seen[0].schema) if len(seen) < 5 else stage(spark, seen[-1], sf))
    assert all(d.columns == docs.columns for d in seen[:5])
    rows = [d.collect() for d in seen]
    # quality: the rows that importance.resample marks, unchanged
    marked = {r.doc_id for r in importance.resample(docs, table(spark, sf, "labels")).collect() if r.kept}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r.doc_id in marked)
    good = [r.doc_id in marked for r in rows[0] if r.doc_id in labels and labels[r.doc_id].quality == 1]
    bad = [r.doc_id in marked for r in rows[0] if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    # near-duplicates: the least id of each group by all pairs
    kept = {i for i, _, _, k in plain([(r.doc_id, r.text) for r in rows[1]]) if k}
    assert sorted(rows[2]) == sorted(r for r in rows[1] if r.doc_id in kept)
    # secrets: no base span is left, texts without spans are as before
    found = {r.doc_id: r.found for r in secrets.find(seen[2]).collect()}
    after = {r.doc_id: r for r in rows[3]}
    assert len(after) == len(rows[2])
    for r in rows[2]:
        new, cut, at = after[r.doc_id], "", 0
        for x in found[r.doc_id]:
            if x.start > at or not cut and x.start == 0:
                cut += r.text[at : x.start] + "[SECRET]"
            at = max(at, x.end)
        assert new.text == cut + r.text[at:] and (new.n_chars == len(new.text) if found[r.doc_id] else new == r)
    # mixing: each row as often as its copies say
    copies = {r.doc_id: r.copies for r in mixing.rates(seen[3], table(spark, sf, "labels"), queries.domain(), queries.TARGET, queries.HOLD)[0].collect()}
    assert sorted(rows[4]) == sorted(r for r in rows[3] for _ in range(copies[r.doc_id]))
    # encoding: as the library would
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.load_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    text = {r.doc_id: r.text for r in rows[4]}
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        ids = np.array(library.encode_ordinary(text[r.doc_id]), dtype="<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4 and r.round_trip and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_stages_on_edge_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns: no stage fails, and each leaves what it says."""
    docs = frame(spark)
    marked = sorted(map(repr, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0
        assert {r._slot for r in out.collect()} <= {"clash"} and {r["_m"] for r in out.collect()} <= {"clash"}
        if name == "near-duplicates":
            rows = [(r.doc_id, r.text) for r in out.collect()]
            assert sum(i == 6 for i, _ in rows) == 2 and not any(i == 7 for i, _ in rows) and (None, "no id here, but words") in rows and {2, 3, 8} <= {i for i, _ in rows}
        if name == "secrets":
            assert sorted(map(repr, out.collect())) == marked  # none of these texts holds a secret
    out = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert out.count() == docs.count() and out.where("NOT round_trip").count() == 0
    assert {bytes(r.ids) for r in out.where("doc_id IN (2, 3)").collect()} == {b""}
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.where("NOT round_trip").count() == 0 and out.count() > 100
