"""Files, stores, streams, tokenizers, numbers of losses and the teacher cache: round trips and brute force."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numeric
from corpusloom.operators import dedup, evals, governance, packing, prompts, provenance, runs, teacher, tokenizers
from corpusloom.sources import files, tables
from corpusloom.streaming import streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


# --- sources -------------------------------------------------------------------------------------------------------


def test_packed_corpus_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([(i, [i * 8 + k for k in range(8)]) for i in range(5)], "sequence_id long, tokens array<bigint>")
    rows = [(i, s, i * 10 + k, a, b, 2 * i + k) for i in range(5) for k, (s, a, b) in enumerate([("x", 0, 3), ("y" if i % 2 else "x", 3, 8)])]
    spans = spark.createDataFrame(rows, "sequence_id long, source string, doc_id long, token_start int, token_end int, doc_span_id long")
    root = str(tmp_path / "c")
    files.write_shards(seqs, root, 2, 8, spans, "sha")
    assert [r.tokens[0] for r in files.iterate_from(spark, f"{root}/tokens", 3, 2).collect()] == [24, 32]
    meta = {r.sequence_id: r for r in spark.read.parquet(f"{root}/seq_meta").collect()}
    assert meta[1].source_mix == {"x": 3, "y": 5} and meta[2].source_mix == {"x": 8}
    assert (meta[3].doc_span_start_id, meta[3].doc_span_count, meta[3].token_start_global, meta[3].token_end_global) == (6, 2, 24, 32)
    assert spark.read.parquet(f"{root}/doc_meta").count() == 10
    manifest = spark.read.schema(files.MANIFEST).json(f"{root}/manifest")
    assert sorted((r.shard_id, r.n_sequences, r.first_id, r.last_id, r.n_spans) for r in manifest.collect()) == [(0, 2, 0, 1, 4), (1, 2, 2, 3, 4), (2, 1, 4, 4, 2)]
    assert tuple(files.corpus_summary(manifest).first()) == (3, 5, 40, 0, 4)
    assert tuple(files.corpus_summary(manifest.where("false")).first()) == (0, 0, 0, -1, -1)
    with pytest.raises(Exception, match="tokenizers"):
        files.corpus_summary(manifest.withColumn("tokenizer_sha256", F.col("shard_id").cast("string"))).collect()
    with pytest.raises(ValueError):
        files.write_shards(seqs, str(tmp_path / "d"), 2, 8, spans.withColumn("token_end", F.lit(9)), "sha")


def test_stores(spark, tmp_path):
    store = files.ManifestStore(spark, f"file://{tmp_path}/m")
    assert not store.has("org/set", "s1")
    store.write("org/set", "s1", {"n": 3})
    store.write("org/set", "s1", {"n": 4})
    store.write("org/set", "s2", {"n": 5})
    assert store.has("org/set", "s1") and {(r.shard, r.n) for r in store.read("org/set", "n int").collect()} == {("s1", 4), ("s2", 5)}
    work = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "shard string")
    assert [r.shard for r in files.pending(work, store.read("org/set", "n int"), ["shard"]).collect()] == ["s3"]
    assert files.mirror(spark, f"file://{tmp_path}/m", f"file://{tmp_path}/n") == 2
    assert json.loads((tmp_path / "n" / "org__set" / "s2.json").read_text()) == {"n": 5}
    rows = spark.createDataFrame([("t", 1, 2, "r", 0.5)], "ts string, step long, data_position long, reason string, loss double")
    files.append_json(rows, str(tmp_path / "q"))
    files.append_json(rows.withColumn("step", F.lit(2)), str(tmp_path / "q"))
    assert sorted(r.step for r in files.read_incidents(spark, str(tmp_path / "q")).collect()) == [1, 2]
    docs = spark.createDataFrame([("a", "x" * 60), ("a", "short"), ("b", "y\n" * 40), ("b", "z" * 90)], "source string, text string")
    assert {r.source: r.n_lines for r in files.write_lines(docs, str(tmp_path / "l"), most=70).collect()} == {"a": 1, "b": 2}
    assert sorted(len(r.value) for r in spark.read.text(str(tmp_path / "l")).collect()) == [60, 70, 70]


def test_numbered_and_cut(spark):
    rows = spark.createDataFrame([(f"k{i:03d}", f"t{i}") for i in random.Random(1).sample(range(200), 200)], "k string, t string")
    got = files.read_documents(rows, "d", ["t"], order_by="k", skip_first=5, sample_limit=90).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((f"d#{i}", f"t{i}") for i in range(5, 95))
    with pytest.raises(ValueError):
        files.read_documents(rows, "d", ["t"])
    with pytest.raises(ValueError):
        files.read_documents(rows, "d", ["none"], order_by="k")


def test_small_tables_are_spread(spark):
    assert tables.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    big = spark.range(10**9).coalesce(1)  # its plan says 8 GB
    assert tables.spread(big) is big


# --- streams -------------------------------------------------------------------------------------------------------


def run_stream(spark, tmp_path, schema, batches, start):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={k}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = start(s).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)


def test_near_duplicates_of_a_stream(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    batches = [[(1, "a", base), (2, "a", base + " x"), (3, "b", base)], [(4, "a", base + " y"), (5, "a", other), (6, "a", other + " z")]]
    f = streams.near_batch(str(tmp_path / "seen"), str(tmp_path / "out"))
    run_stream(spark, tmp_path, "doc_id long, source string, text string", batches, lambda s: s.writeStream.foreachBatch(f))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 5]


def test_filter_streams(spark, tmp_path, monkeypatch):
    from corpusloom.operators import decontam

    body = " ".join(f"word{i}" for i in range(60))
    rows = [[(1, f"{body} some test prompt here"), (2, body)], [(3, "short"), (4, f"{body} me@x.org")]]
    index = decontam.build_index(spark.createDataFrame([("b", "some test prompt here")], "benchmark_id string, prompt string"), 4)
    run_stream(spark, tmp_path / "a", "doc_id long, text string", rows, lambda s: streams.filter_stream(s, index, 4).writeStream.format("memory").queryName("kept"))
    got = {r.doc_id: r.text for r in spark.table("kept").collect()}
    assert set(got) == {2, 4} and got[4].endswith("<EMAIL>")
    f = streams.clean_batch(index, str(tmp_path / "out"), 4)
    run_stream(spark, tmp_path / "b", "doc_id long, text string", rows, lambda s: s.writeStream.foreachBatch(f))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4]
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    with pytest.raises(ValueError):
        streams.filter_stream(spark.createDataFrame([], "doc_id long, text string"), index, 4)


def test_monitor_stream(spark, tmp_path):
    rows = [[(f"2024-01-01 00:{m:02d}:00", "s", 10) for m in (1, 5, 12)]]
    schema = "t string, source string, tokens long"
    start = lambda s: streams.monitor_stream(s.withColumn("ts", F.to_timestamp("t"))).writeStream.outputMode("complete").format("memory").queryName("mon")
    run_stream(spark, tmp_path, schema, rows, start)
    assert sorted((r.start.minute, r.n, r.tokens) for r in spark.table("mon").collect()) == [(0, 2, 20), (10, 1, 10)]


# --- numbers -------------------------------------------------------------------------------------------------------


def test_losses_equal_numpy(spark):
    rng = np.random.default_rng(0)
    z, t = rng.normal(size=12), rng.normal(size=4)
    lse = math.log(np.exp(z).sum())
    assert one(spark, numeric.cross_entropy(F.col("z"), F.lit(3), 0.01), z=z.tolist()) == pytest.approx(lse - z[3] + 0.01 * lse * lse)
    at = [1, 5, 7, 11]
    p, q = np.exp(t) / np.exp(t).sum(), np.exp(z[at]) / np.exp(z[at]).sum()
    got = one(spark, numeric.top_k_divergence(F.col("z"), F.col("t"), F.col("i")), z=z.tolist(), t=t.tolist(), i=at)
    assert got == pytest.approx((p * np.log(p / q)).sum())
    assert one(spark, numeric.distilled(F.lit(2.0), [F.lit(1.0), F.lit(3.0)], [1, 3], F.lit(0.25)), x=1) == pytest.approx(0.25 * 2 + 0.75 * 2.5)


def test_bf16_cuts_off(spark):
    x = np.array([1.0, -2.5, 3.14159, 1e-8, 65504.9], np.float32)
    assert (numeric.from_bf16(numeric.to_bf16(x)).view(np.uint32) == x.view(np.uint32) & 0xFFFF0000).all()
    back = numeric.with_bf16(spark.createDataFrame([(1, x.tolist()), (2, None)], "k int, v array<float>"), "v").orderBy("k").collect()
    assert np.allclose(back[0].v, numeric.from_bf16(numeric.to_bf16(x))) and back[1].v is None


def test_synthetic_rows_depend_on_seed_and_step_alone(spark):
    a = numeric.synthetic_batches(spark, 4, 2, 5, 100, seed=7)
    b = numeric.synthetic_batches(spark, 2, 2, 5, 100, seed=7, start=2)
    assert a.count() == 8 and {(r.step, r.row): r.tokens for r in b.collect()}.items() <= {(r.step, r.row): r.tokens for r in a.collect()}.items()
    logits = numeric.synthetic_logits(a, "big", 16).collect()
    base = int.from_bytes(hashlib.sha256(b"big").digest()[:8], "little")
    r = logits[0]
    assert np.allclose(r.logits, np.random.default_rng((base + sum(r.tokens)) % 2**64).standard_normal(16).astype(np.float32))


def test_table_hash(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert numeric.table_hash(df) == numeric.table_hash(df.repartition(7)) != numeric.table_hash(df.where("id < 49"))


# --- tokenizers ----------------------------------------------------------------------------------------------------


def test_tokenizer_file(spark, tmp_path):
    tk = pytest.importorskip("tokenizers")
    vocab = {**{t: i for t, i in tokenizers.REQUIRED.items()}, "one": 4, "two": 5, " ": 6}
    model = tk.Tokenizer(tk.models.WordLevel(vocab, unk_token="<unk>"))
    model.pre_tokenizer = tk.pre_tokenizers.Split(tk.Regex(r"\s"), "isolated")
    model.decoder = tk.decoders.Fuse()
    spec = model.to_str()
    docs = spark.createDataFrame([(1, "one two"), (2, ""), (3, "two"), (4, "one other"), (5, None)], "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in tokenizers.tokenize(docs, spec, batch=2).collect()}
    assert got == {1: [4, 6, 5], 3: [5], 4: [4, 6, 3]}
    assert [r.doc_id for r in tokenizers.round_trip(docs, spec).collect()] == [4]
    rate = tokenizers.compression(tokenizers.tokenize(docs.withColumn("lang", F.lit("en")), spec)).first()
    assert rate.bytes_per_token == pytest.approx((7 + 3 + 9) / 7)
    assert [r.text for r in tokenizers.canary(spark, spec, n=5).collect()] and len(tokenizers.canary_texts()) == 208 and tokenizers.canary_texts() == tokenizers.canary_texts()

    class OneByOne:
        """An encoder without batches: the text's length, and its spec's; local, so that workers get it with the call."""

        def __init__(self, spec):
            self.n = len(spec)

        def encode(self, text):
            return [len(text), self.n]

    short = {r.doc_id: r.tokens for r in tokenizers.tokenize(docs, "abc", batch=2, chars=3, make=OneByOne).collect()}
    assert short == {1: [7, 3], 3: [3, 3], 4: [9, 3]}
    seen = spark.createDataFrame([(9, [([4, 6], [5]), ([5], []), ([3], []), ([3], []), ([4], [])])], "step long, input_ids_preview array<struct<head:array<int>,tail:array<int>>>")
    got = {(r.row, r.end): r.decoded for r in tokenizers.decode_previews(seen, spec, chars=3).collect()}
    assert len(got) == 8 and got[0, "head"] == "one" and got[0, "tail"] == "two" and got[1, "tail"] == ""
    tokenizers.check_special(vocab)
    with pytest.raises(ValueError):
        tokenizers.check_special({**vocab, "<pad>": 9})
    assert tokenizers.special_tokens(2) == ["<s>", "</s>", "<pad>", "<unk>", "<reserved_0>", "<reserved_1>"]
    (tmp_path / "t.json").write_text(spec)
    assert tokenizers.file_sha256(str(tmp_path / "t.json")) == hashlib.sha256(spec.encode()).hexdigest()


# --- teacher cache -------------------------------------------------------------------------------------------------


def test_shard_files(spark, tmp_path):
    key = lambda s: one(spark, teacher.shard_key(F.lit("t"), F.lit(2), F.lit("ab" * 32), F.col("a"), F.col("b")), a=s * 3, b=s * 3 + 3)
    assert key(1) == "distillation_cache/t/k2/corpus_abababababababab/tokens_0000000000003_0000000000006.arrow"
    rows = [(key(p // 3), p, [p + 0.5, -1.0], [p, 7]) for p in range(9)]
    df = spark.createDataFrame(rows, "key string, pos long, logits array<float>, indices array<bigint>")
    done = teacher.write_shards(df, str(tmp_path / "s"), {"teacher_id": "t"}).collect()
    assert all(hashlib.sha256((tmp_path / "s" / r.key).read_bytes()).hexdigest() == r.sha256 and r.n == 3 for r in done) and len(done) == 3
    back = teacher.read_shards(spark, str(tmp_path / "s")).orderBy("pos").collect()
    assert [(r.pos, r.logits, r.indices) for r in back] == [(p, x, i) for _, p, x, i in rows]
    import pyarrow as pa

    with pa.ipc.new_file(str(tmp_path / "s" / "old.arrow"), pa.schema([("pos", pa.int64())], {"format_version": "0"})):
        pass
    with pytest.raises(Exception, match="format version"):
        teacher.read_shards(spark, str(tmp_path / "s")).collect()


def test_cache_faults(spark):
    rows = [("a", p, [1.0, 2.0], [0, 1]) for p in range(4)] + [("b", p, [1.0] * (1 if p == 3 else 2), [0, 1]) for p in range(1, 4)]
    cache = spark.createDataFrame(rows, "teacher_id string, pos long, logits array<float>, indices array<bigint>")
    assert teacher.stack(cache.where("pos IN (1, 2)"), ["b", "a"]).count() == 2
    for where, text in (("pos = 0", "without all teachers"), ("pos = 3", "different top_k")):
        with pytest.raises(Exception, match=text):
            teacher.stack(cache.where(where), ["a", "b"]).collect()
    batches = teacher.batch_positions(spark.createDataFrame([(0, 1, 1), (1, 2, 1)], "batch long, n_rows int, width int"), 1).withColumn("step", F.col("batch"))
    assert [tuple(r) for r in batches.select("first", "last_excl").orderBy("first").collect()] == [(1, 2), (2, 4)]
    good = cache.where("pos IN (1, 2)")
    assert teacher.attach(batches.where("batch = 0"), good, ["a", "b"], 0).first().pos == 1
    with pytest.raises(Exception, match="no teacher logits at 3"):
        teacher.attach(batches, good, ["a", "b"], 0).collect()
    with pytest.raises(ValueError):
        teacher.plan_shards(spark, "x", 2, "ab", 0, 9, 2, 4, spark.createDataFrame([("y", 0, 4)], "teacher_id string, start long, end long"))
    plan = teacher.plan_shards(spark, "x", 2, "ab", 0, 17, 4, 6).collect()
    assert [(r.start, r.end) for r in plan] == [(0, 8), (8, 16), (16, 17)]


# --- provenance, prompts, scorecards -------------------------------------------------------------------------------


def test_places_with_gaps(spark):
    spans = spark.createDataFrame([(0, "a", 1, 3), (0, "b", 4, 6), (1, "c", 0, 8)], "sequence_id long, source string, token_start int, token_end int")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "source string, source_int int")
    got = {r.sequence_id: r.sources for r in provenance.token_sources(spans, vocab, 8).collect()}
    assert got == {0: [-1, 0, 0, -1, 1, 1, -1, -1], 1: [-1] * 8}
    labels = provenance.label_sources(provenance.token_sources(spans, vocab, 8), 3, 2).orderBy("row").collect()
    assert [(r.batch, r.row, r.label_sources) for r in labels] == [(0, 0, got[0][1:]), (0, 1, got[1][1:])]
    mix = spark.createDataFrame([(0, "a", 2), (0, "b", 2), (1, "c", 8), (2, "", 1)], "sequence_id long, source string, n_tokens long")
    named = {r.sequence_id: (r.label, r.dominant) for r in provenance.mix_labels(mix).collect()}
    assert named == {0: ("a [mix: a=2,b=2]", "a"), 1: ("c", "c"), 2: ("<empty>", "<empty>")}
    bad = spark.createDataFrame([(1, 16), (2, None), (3, 700)], "step long, data_position long")
    rows = provenance.attribute(provenance.incident_sequences(bad, 8, rows=2), provenance.mix_labels(mix)).collect()
    assert sorted((r.step, r.sequence_id, r.dominant) for r in rows) == [(1, 0, "a"), (1, 1, "c"), (3, 98, "<unmapped>"), (3, 99, "<unmapped>")]


def test_prompts_and_epochs(spark):
    with pytest.raises(ValueError):
        prompts.loader("none")
    rows = spark.createDataFrame([(1, " q ", ["a", "b"]), (2, "  ", ["a"]), (3, "r" * 9000, None)], "id int, question string, options array<string>")
    got = {r.id: r.prompt for r in prompts.load_prompts("mmlu-pro", rows).collect()}
    assert got == {1: "q a b", 3: "r" * 8000}
    five = spark.range(5).withColumnRenamed("id", "sequence_id")
    assert [r.sequence_id for r in packing.epochs(five, 3, None, steps=9).orderBy("position").collect()] == [3, 4, 0, 1, 2, 3, 4, 0, 1]
    with pytest.raises(ValueError):
        packing.epochs(five, 3, None)
    with pytest.raises(Exception, match="negative sequence"):
        packing.seek(spark.createDataFrame([(-1,)], "sequence_id long"), 8, 2).collect()


def test_scorecard_files(spark, tmp_path):
    rows = [("b", 0.5, 4, None, {"de": 0.25, "en": 0.75}), ("a", None, 0, "lost", {})]
    scores = spark.createDataFrame(rows, governance.SCORE)
    governance.write_scorecard(spark, scores, "m", f"file://{tmp_path}/card")
    text = (tmp_path / "card.md").read_text()
    assert "| b | 50.00% | 4 | de=25.0%  en=75.0% |" in text and "| a | — | 0 | FAILED: lost |" in text
    assert json.loads((tmp_path / "card.json").read_text())[1]["accuracy"] == 0.5
    wanted = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "source string, share double")
    present = spark.createDataFrame([("x",)], "source string")
    assert [tuple(r) for r in governance.resolve_config(wanted, present).collect()] == [("x", 1.0)]
    with pytest.raises(ValueError):
        governance.resolve_config(wanted, present, strict=True)
    with pytest.raises(KeyError):
        runs.resume_position({}, strict=True)
    assert runs.resume_position({}) == 0 and runs.resume_position({"data_position": 7}, strict=True) == 7
    named = spark.createDataFrame([("Org/Set-A", "en", "train"), ("x/y", None, "test")], "dataset string, config string, split string")
    assert {r.unique_id for r in governance.unique_source_ids(named).collect()} == {"set_a_en_train", "y_test"}
    with pytest.raises(ValueError):
        governance.unique_source_ids(named.unionByName(named))
    texts = spark.createDataFrame([("abcd",), ("ab",)], "text string")
    seen = {r.source: (r.n, r.mean_chars, r.passed, r.error) for r in governance.smoke(spark, {"a": lambda: texts, "b": lambda: texts.where("false"), "c": lambda: spark.read.parquet("/no/such")}).collect()}
    assert seen["a"] == (2, 3, True, None) and seen["b"] == (0, 0, False, "no rows") and not seen["c"][2] and "PATH_NOT_FOUND" in seen["c"][3]
    assert runs.incident_rate_high(spark.createDataFrame([("r", 6.0), ("s", 1.0)], "reason string, per_1000 double")).where("warn").count() == 1


def test_nucleus_equals_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(20, 9)) * 2
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(z)], "k long, z array<double>")
    kept = evals.nucleus(df, "z", "k", 0.6, temperature=0.5)
    got = {i: {} for i in range(20)}
    for r in kept.collect():
        got[r.k][r["index"]] = r.p
    for i, row in enumerate(z):
        p = np.exp(row / 0.5) / np.exp(row / 0.5).sum()
        order = np.argsort(-p)
        keep = order[: max(1, int((np.cumsum(p[order]) <= 0.6).sum()))]
        assert got[i] == pytest.approx({int(j): p[j] / p[keep].sum() for j in keep})
    drawn = {r.k: r["index"] for r in evals.draw(kept, "k", 3).collect()}
    assert len(drawn) == 20 and all(drawn[i] in got[i] for i in range(20)) and drawn == {r.k: r["index"] for r in evals.draw(kept, "k", 3).collect()}


def test_sequence_samples():
    assert evals.sequence_sample(100, 5) == sorted(random.Random(0).sample(range(100), 5)) and evals.sequence_sample(3, 9) == [0, 1, 2]


def test_exact_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, "g", " ".join(rng.choice(words) if rng.random() < 0.05 else w for w in words)) for i in range(30)] + [(99, "h", " ".join(words)), (100, "g", "")]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, _, t in rows}
    want = {}
    for i, g, _ in rows:
        for j, h, _ in rows:
            if i < j and g == h and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j]):
                want[i, j] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    got = dedup.exact_pairs(spark.createDataFrame(rows, "doc_id long, source string, text string"), 60, group="source")
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == pytest.approx(want) and want
