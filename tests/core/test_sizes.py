"""Results and memory at sizes beyond those of the small tables."""

import duckdb
import pytest

from lexweave import catalog


def against_sql(spark, name, folder, *tables):
    """Rows of a registered query and of its SQL, both sorted."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, str(folder))
    assert got.columns == columns
    return sorted(tuple(r) for r in got.collect()), sorted(want.fetchall())


@pytest.mark.parametrize("n", [1, 70, 10_256])
def test_weight_checksum_of_any_number_of_keys(spark, tmp_path, n):
    """Two levels of digests below a hundred keys and beyond ten thousand, as in the SQL."""
    spark.range(n).selectExpr("id AS vec_id", "array(CAST(id AS float), 0.5f) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = against_sql(spark, "weight_checksum", tmp_path, "embeddings")
    assert got == want


def test_words_are_counted_without_listing_them(spark):
    """By white space of every kind; a pattern that matches once a word took most of the time of long tables."""
    from lexweave.functions.text import SPACES
    from lexweave.operators import quality

    texts = [None, "", " ", SPACES, "a", f" {SPACES}a　b\x1c\x1dc\n\nd ", "x y  z\t\tw", "\U0001f600 é 中文  1", *(f"{c}a{c}{c}b1{c}" for c in SPACES)]
    df = quality.with_metrics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string"))
    for r in df.collect():
        t = r.text
        if t is None:
            assert r.n_words is None and r.symbol_ratio is None
            continue
        dense = [c for c in t if c not in SPACES]
        assert (r.n_words, r.n_chars) == (len("".join(" " if c in SPACES else c for c in t).split()), len(t)), t
        assert r.alpha_ratio == (sum(c.isalpha() for c in dense) / len(dense) if dense else None), t
        assert r.symbol_ratio == (sum(not (c.isalpha() or c in "0123456789") for c in dense) / len(dense) if dense else None), t
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan


def test_texts_are_encoded_and_decoded_in_bounded_parts(spark, monkeypatch):
    """A batch of texts goes to the tokenizer in parts of some bytes, not as a whole; results stay the same."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from lexweave.operators import tokenizer

    texts = ["a" * 5, None, "", "é b" * 100_000, *("cd ef" * 20_000 for _ in range(9))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string").coalesce(1)
    spec = tokenizer.train(df, 270)
    library = Tokenizer.from_str(spec)
    got = df.select("k", "text", tokenizer.encode(F.col("text"), spec).alias("ids")).withColumn("back", tokenizer.decode(F.col("ids"), spec)).orderBy("k").collect()
    assert [r.ids for r in got] == [None if t is None else library.encode(t).ids for t in texts] and [r.back for r in got] == texts
    parts = []
    monkeypatch.setattr(Tokenizer, "from_str", staticmethod(lambda _: Counting(library, parts)))
    run = []
    monkeypatch.setattr(tokenizer.F, "arrow_udf", lambda kind: lambda f: lambda c: run.append(f))
    tokenizer.encode(None, spec)
    assert sum(len(x) for x in run[0](iter([pa.array(texts, pa.string())]))) == len(texts)
    assert len(parts) > 3 and max(parts) <= 400_000


class Counting:
    def __init__(self, library, parts):
        self.library, self.parts = library, parts

    def encode_batch(self, texts, **more):
        self.parts.append(sum(len(t.encode()) for t in texts))
        return self.library.encode_batch(texts, **more)


def test_ids_by_words_move_nothing(spark):
    """Encoding by distinct words shuffled every word of every text before."""
    from lexweave.operators import tokenizer

    df = spark.createDataFrame([(1, "the cat the cat"), (2, None), (3, "")], "k int, text string")
    out = tokenizer.encode_distinct(df, tokenizer.train(df, 265))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.ids is None for r in out.orderBy("k").collect()] == [False, True, False]


def test_a_store_is_written_in_bounded_batches(spark, tmp_path, monkeypatch):
    """Shards went to the writer in batches of up to ten thousand."""
    from pyspark.sql import functions as F

    from lexweave.sources import sinks

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(12).select(F.col("id").alias("shard"), (F.col("id") * 500_000).alias("start_offset"), F.expr("sequence(id, id + 499999)").alias("tokens"))
    manifest = sinks.write_shards(rows, str(tmp_path / "bin"), "uint32")
    assert manifest["total_tokens"] == 6_000_000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
    assert sinks.read_shards(spark, str(tmp_path / "bin")).selectExpr("shard", "tokens[499999] - tokens[0] AS n", "size(tokens) AS m").distinct().count() == 12


def test_collected_files_have_a_bounded_size(spark, sf, monkeypatch):
    """There were four files at any size, and a task read each."""
    monkeypatch.setattr(catalog, "FILE_BYTES", 20_000, raising=False)
    rows = catalog._in_order(spark, sf, "documents", "doc_id")
    sizes = rows.selectExpr("spark_partition_id() AS p", "octet_length(text) AS n").groupBy("p").sum("n").collect()
    assert len(sizes) > 8
    assert [r.doc_id for r in rows.select("doc_id").collect()] == sorted(r.doc_id for r in rows.select("doc_id").collect())


@pytest.mark.parametrize("common", [64, 2])
def test_components_that_are_no_cliques(spark, tmp_path, monkeypatch, common):
    """Chains of texts, copies of some, a passage that all share, texts of few or no words: pairs and the kept rows as the SQL has them."""
    import random

    from lexweave.operators import dedup

    monkeypatch.setattr(dedup, "COMMON", common)
    r, texts = random.Random(5), ["", None, "  ", "one two", "One  two", "one two three"]
    for c in range(4):
        words = [f"w{c}x{i}" for i in range(60)] + [f"shared{i}" for i in range(20)]
        for k in range(9):
            texts += [" ".join(words)] * (3 if k == 4 else 1)
            words = list(words)
            for _ in range(r.choice([1, 1, 2])):
                words[r.randrange(60)] = f"n{r.randint(0, 10**6)}"
    r.shuffle(texts)
    spark.createDataFrame([(i, t or "", "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("jaccard_pairs", "near_dedup"):
        got, want = against_sql(spark, name, tmp_path, "documents")
        assert got == want and 3 < len(got), name
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("doc_id", "pos")
    assert dedup.near_dedup(docs).count() > dedup.component_dedup(docs).count()


def test_runs_of_white_space_by_translation(spark):
    """A class of 29 characters was tried at each place of each text."""
    from pyspark.sql import functions as F

    from lexweave.functions.text import SPACES, collapse

    df = spark.createDataFrame([(f"a{c}b{c}{c}c {c}",) for c in SPACES] + [("",), (None,), ("a  b",)], "t string").select("t", collapse(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["a b c "] * len(SPACES) + ["", None, "a b"]
    assert "translate" in df._jdf.queryExecution().optimizedPlan().toString()


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_similar_pairs_move_few_shingles(spark):
    """Every shingle was moved to be counted, and the sets of all rows were moved to meet the pairs: 8.1 MB here."""
    from lexweave.operators import dedup

    texts = [" ".join(f"t{k}x{i}" for i in range(300)) for k in range(400)]
    texts += [t.replace("x7 ", "y7 ") for t in texts[:200]]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string").repartition(3)
    before = shuffled(spark)
    got = {(r.a, r.b) for r in dedup.all_similar_pairs(df).collect()}
    assert got == {(k, 400 + k) for k in range(200)} and shuffled(spark) - before < 5_500_000


@pytest.mark.parametrize("block", [512, 6])
def test_similar_pairs_of_a_large_group(spark, monkeypatch, block):
    """Values that many rows share are dealt in blocks, and sums of pairs are given out in parts."""
    from lexweave.operators import dedup

    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "LISTED", 1000, raising=False)
    texts = [" ".join([f"w{i}" for i in range(100)] + [f"own{k}x{i}" for i in range(2 if k < 60 else 4)]) for k in range(61)] + [" ".join(f"t{k}x{i}" for i in range(100)) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string").repartition(3)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    got = sorted(map(tuple, dedup.all_similar_pairs(df).collect()))
    assert got == [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(61) for b in range(a + 1, 61)]


def test_open_rows_are_scored_in_bounded_parts(spark, monkeypatch):
    """Rows stayed in the few partitions that narrow rows take, however many logits each became."""
    from pyspark.sql import functions as F

    from lexweave.operators import generate

    monkeypatch.setattr(generate, "ROWS", 10, raising=False)
    parts = []

    def scorer(rows):
        parts.append(rows.rdd.getNumPartitions())
        return rows.select("row_id", F.explode(F.expr("sequence(0L, 3L)")).alias("token_id")).withColumn("logit", F.when(F.col("token_id") == F.col("row_id") % 4, 1.0).otherwise(0.0))

    prompts = spark.range(95).select(F.col("id").alias("row_id"), F.array(F.lit(9)).alias("tokens"))
    out = generate.generate(prompts, scorer, 2, eos=3)
    assert {r.row_id: r.tokens for r in out.collect()} == {k: [9, 3] if k % 4 == 3 else [9, k % 4, k % 4] for k in range(95)}
    assert parts == [10, 8]


def test_stream_deduplicates_without_a_call_for_each_text(spark, tmp_path):
    """Two batches from many files, the first rows not first in their files, with a restart between them; no Python state is asked for each text."""
    from pyspark.sql import functions as F

    from lexweave.operators.dedup import exact_dedup
    from lexweave.streaming import text_streams

    kind = "pos long, text string, more struct<a: int, b: array<string>>"
    made = [(k, None if k % 97 == 5 else "" if k % 97 == 6 else "the same" if k % 3 == 0 else f"Text {k % 400}", (k, [str(k), None])) for k in range(1000)]
    halves = made[:600], made[600:]
    text_streams.keep_state_on_disk(spark)
    for half in halves:
        for part in range(3):
            rows = spark.createDataFrame(half[part::3][::-1], kind).coalesce(1)
            rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = text_streams.deduplicated_for_good(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        states = [o for p in run.recentProgress for o in p["stateOperators"]]
        assert {o["operatorName"] for o in states} == {"dedupe"}
    got = spark.read.schema(kind).parquet(f"{tmp_path}/out")
    want = exact_dedup(spark.createDataFrame(made, kind))
    assert sorted(got.collect(), key=lambda r: r.pos) == sorted(want.collect(), key=lambda r: r.pos)
    assert got.where(F.col("text") == "the same").count() == 1


def test_first_rows_of_keys_in_any_batches():
    """Least order, nulls last, over batches; no rows, no batches."""
    import random

    import pyarrow as pa

    from lexweave.streaming.text_streams import _first_rows

    r = random.Random(4)
    rows = [{"k": r.choice("abcde"), "o": r.choice([None, *range(100)]), "t": str(i)} for i in range(300)] + [{"k": "f", "o": None, "t": "only"}]
    kind = pa.schema([("k", pa.string()), ("o", pa.int64()), ("t", pa.string())])
    parts = [pa.RecordBatch.from_pylist(rows[a : a + 37], kind) for a in range(0, len(rows), 37)] + [pa.RecordBatch.from_pylist([], kind)]
    out = [x for b in _first_rows("k", "o")(iter(parts)) for x in b.to_pylist()]
    order = lambda x: (x["o"] is None, x["o"] or 0)
    assert sorted((x["k"], order(x)) for x in out) == sorted((k, min(order(x) for x in rows if x["k"] == k)) for k in "abcdef")
    assert all(x in rows for x in out)
    assert list(_first_rows("k", "o")(iter([]))) == []
