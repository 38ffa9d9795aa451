"""Literal cases and brute force for the document, packing, mixture and evaluation operators."""

import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import decontam, dedup, evals, filters, mixture, packing, runs
from corpusloom.sources import files
from corpusloom.streaming import streams


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f,text,keep,reason",
    [
        (filters.LengthFilter(10, 100), "nine char", False, "too_short"),
        (filters.LengthFilter(1, 5), "sixsix", False, "too_long"),
        (filters.LengthFilter(2, 6), "sixsix", True, "ok"),
        (filters.RepetitionFilter(), "buy " * 21 + " ".join(f"w{i}" for i in range(79)), False, "top_word_repeated"),
        (filters.RepetitionFilter(), " ".join(f"buy w{i} x{i} y{i} z{i}" for i in range(20)), True, "ok"),
        (filters.RepetitionFilter(), "a b c d e " * 3 + " ".join(f"w{i}" for i in range(5)), False, "top_ngram_repeated"),
        (filters.RepetitionFilter(), " \n ", False, "empty"),
        (filters.SymbolFilter(), "a;;b--c??" * 7, False, "too_symbolic"),
        (filters.SymbolFilter(), "commas, and (brackets), but mostly letters", True, "ok"),
        (filters.SymbolFilter(), "abcdefg!!!", True, "ok"),
        (filters.SymbolFilter(), "", False, "empty"),
    ],
)
def test_filters(spark, f, text, keep, reason):
    d = one(spark, f(F.col("t")), t=text)
    assert (d.keep, d.reason) == (keep, reason)


def test_bounds_are_checked():
    for bad in (lambda: filters.LengthFilter(10, 5), lambda: filters.RepetitionFilter(0, 1), lambda: filters.RepetitionFilter(n=1), lambda: filters.SymbolFilter(1.0), lambda: dedup.MinHashConfig(128, 33), lambda: filters.chain([], F.lit(""))):
        with pytest.raises(ValueError):
            bad()


def test_redaction(spark):
    r = filters.PiiRedactor(("email", "phone", "ipv4"))
    assert one(spark, r.redact(F.col("t")), t="to alice@example.com or 555-123-4567 at 10.0.0.1") == "to <EMAIL> or <PHONE> at <IPV4>"
    assert one(spark, r.redact(F.col("t")), t="+1 555-123-4567") == "+<PHONE>"
    df = spark.createDataFrame([("hi alice@x.com",), (None,)], "text string")
    assert [(x.text, x.reason) for x in filters.filter_documents(df, [filters.LengthFilter(100, 200)]).collect()] == [("hi alice@x.com", "too_short"), ("", "too_short")]


def test_text_functions(spark):
    assert one(spark, T.words(F.col("t")), t="a b\x1cc　 d") == ["a", "b", "c", "d"]
    assert one(spark, T.normalise(F.col("t")), t="  Straße,  FOO_bar… नमस्ते ") == "strasse foo_bar नमस त"
    for seed in (0, 42, 0xDECAF, 2**63 + 5):
        for s in ("", "x", "é" * 40):
            assert one(spark, T.xxh64(F.col("t"), seed), t=s) == T.signed(xxhash.xxh64_intdigest(s, seed=seed))


def test_decontamination(spark):
    prompts = spark.createDataFrame([("a", "Which River Crosses The Old Town"), ("b", "river crosses the old mill"), ("c", " ")], "benchmark_id string, prompt string")
    rows = [(1, "They asked: which river crosses THE old, town? Nobody knew."), (2, "river crosses the... OLD"), (3, "too short"), (4, None), (5, "crosses the old town, crosses the old town")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = decontam.build_index(prompts, 4)
    want = {(1, "a"): 3, (1, "b"): 1, (2, "a"): 1, (2, "b"): 1, (5, "a"): 2}
    m = decontam.scan(docs, index, 4)
    assert {(r.doc_id, r.benchmark_id): r.n_matches for r in m.collect()} == want
    rep = {r.benchmark_id: (r.n_examples, r.matched_docs, r.rate, r.any_docs, r.example_ids) for r in decontam.report(docs, prompts, m).collect()}
    assert rep == {"a": (1, 3, 0.6, 3, [1, 2, 5]), "b": (1, 2, 0.4, 3, [1, 2]), "c": (1, 0, 0.0, 3, None)}
    assert [r.doc_id for r in decontam.keep_clean(docs, m).orderBy("doc_id").collect()] == [3, 4]
    again = decontam.replace_benchmark(index, decontam.build_index(prompts.where("benchmark_id = 'b'").withColumn("prompt", F.lit("one two three four")), 4))
    assert {r.gram for r in again.where("benchmark_id = 'b'").collect()} == {"one two three four"} and again.where("benchmark_id = 'a'").count() == 3
    sizes = {r.benchmark_id: (r.n_examples, r.n_ngrams) for r in decontam.index_sizes(prompts, index).collect()}
    assert sizes == {"a": (1, 3), "b": (1, 2), "c": (1, 0)}


def test_large_index_is_joined(spark, monkeypatch, tmp_path):
    """Beyond the size whose hashes are sent to workers, the join alone gives the same matches; an index survives its file."""
    prompts = spark.createDataFrame([("a", "one two three four five")], "benchmark_id string, prompt string")
    docs = spark.createDataFrame([(1, "zero one two three four"), (2, "two three four")], "doc_id long, text string")
    decontam.save_index(decontam.build_index(prompts, 3), 3, str(tmp_path / "i"))
    index = decontam.load_index(spark, str(tmp_path / "i"), 3)
    want = [tuple(r) for r in decontam.scan(docs, index, 3).orderBy("doc_id").collect()]
    assert want == [(1, "a", 2), (2, "a", 1)]
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    assert [tuple(r) for r in decontam.scan(docs, index, 3).orderBy("doc_id").collect()] == want
    with pytest.raises(Exception, match="other n-grams"):
        decontam.load_index(spark, str(tmp_path / "i"), 4).collect()


def test_live_order_sees_personal_data(spark):
    """A prompt with an address in it matches the raw text, not the redacted one."""
    prompts = spark.createDataFrame([("a", "write to ann at bo@cy.org today please")], "benchmark_id string, prompt string")
    body = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{body} write to ann at bo@cy.org today please"), (2, f"{body} bo@cy.org"), (3, "short bo@cy.org")], "doc_id long, text string")
    index = decontam.build_index(prompts, 6)
    live = {r.doc_id: (r.reason, r.score) for r in filters.filter_live(docs, index, 6).collect()}
    assert live[1] == ("contaminated", 4.0) and live[2] == ("ok", None) and live[3][0] == "too_short"
    texts = {r.doc_id: r.text for r in filters.filter_live(docs, index, 6).collect()}
    assert "bo@cy.org" in texts[1] and texts[2].endswith("<EMAIL>") and "bo@cy.org" in texts[3]
    assert decontam.scan(filters.filter_documents(docs), index, 6).count() == 0


def naive_pack(docs, length, drop):
    stream = []
    for i, toks in docs:
        if toks:
            stream += [(i, t) for t in toks] + [(i, packing.EOS)]
    n = len(stream) // length if drop else -(-len(stream) // length)
    return [[t for _, t in stream[k * length : (k + 1) * length]] + [packing.PAD] * max(0, (k + 1) * length - len(stream)) for k in range(n)]


@pytest.mark.parametrize("drop", [True, False])
def test_packing_equals_naive(spark, drop):
    rng = random.Random(5)
    docs = [(i, [rng.randrange(10, 99) for _ in range(rng.choice([0, 1, 3, 7, 40]))]) for i in range(60)]
    df = spark.createDataFrame([("s", i, t) for i, t in docs], "source string, doc_id long, tokens array<int>")
    got = [r.tokens for r in packing.pack_sequences(df, 8, drop).orderBy("seq").collect()]
    assert got == naive_pack(docs, 8, drop)


def test_spans_and_segments(spark):
    df = spark.createDataFrame([("s", 1, 12), ("s", 2, 4), ("s", 3, 0)], "source string, doc_id long, n_tokens int")
    spans = packing.pack_spans(df, 8, drop_last=False)
    assert sorted((r.seq, r.doc_id, r.token_start, r.token_end) for r in spans.collect()) == [(0, 1, 0, 8), (1, 1, 0, 5), (1, 2, 5, 8), (2, 2, 0, 2)]
    seg = {r.sequence_id: r.segments for r in packing.segment_ids(packing.number_sequences(spans), 8).collect()}
    assert seg == {0: [0] * 8, 1: [0] * 5 + [1] * 3, 2: [0, 0] + [-1] * 6}
    s = spark.createDataFrame([([10, 11, 99, 20, 21, 22, 99], [0, 0, 0, 1, 1, 1, 1]), ([10, 11, 99, 0, 0], [0, 0, 0, -1, -1])], "tokens array<int>, segments array<int>")
    assert [r.loss_mask for r in packing.input_label_pairs(s).collect()] == [[1, 1, 0, 1, 1, 1], [1, 1, 0, 0]]


def test_epochs(spark):
    five = spark.range(5).withColumnRenamed("id", "sequence_id")
    assert [r.sequence_id for r in packing.epochs(five, 3, 1).orderBy("position").collect()] == [3, 4]
    assert [r.sequence_id for r in packing.epochs(five, 3, 2).orderBy("position").collect()] == [3, 4, 0, 1, 2] * 2
    with pytest.raises(ValueError):
        packing.epochs(five, 0, 0)
    assert packing.epochs(five.where("false"), 0, 3).count() == 0


def test_greedy_dedup(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a", base), (2, "a", base), (3, "b", base), (4, "a", "other " * 3 + " ".join(f"z{i}" for i in range(40))), (5, "a", base + " tail"), (6, "a", ""), (7, "a", "")]
    out = {r.doc_id: (r.kept, r.dup_of) for r in dedup.greedy_keep(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert out == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None), 5: (False, 1), 6: (True, None), 7: (False, 6)}


def test_schedules():
    counts = {"a": 700, "b": 900}
    picks = list(mixture.compose_schedule(counts, {"a": 0.3, "b": 0.7}, total=500))
    assert abs(sum(s == "a" for _, s, _ in picks) / 500 - 0.3) < 0.02
    assert len(list(mixture.compose_schedule(counts, {"a": 0.3, "b": 0.7}))) == 1600
    for bad in ({}, {"a": 1.0}, {"a": 0.5, "b": 0.6}):
        with pytest.raises(ValueError):
            list(mixture.compose_schedule(counts, bad))
    sizes = {"x": [1] * 9000, "y": [100] * 200}
    of = lambda d: {s: lambda v=v: iter(v) for s, v in d.items()}
    done = {"x": 0, "y": 0}
    for _, s, k in mixture.mixture_schedule(of(sizes), {"x": 1, "y": 1}, on_exhaust="stop"):
        done[s] += sizes[s][k]
    assert 0.45 < done["x"] / sum(done.values()) < 0.55
    assert len(list(mixture.mixture_schedule(of({"x": [1] * 5, "y": [1] * 100}), {"x": 1, "y": 1}))) == 105
    assert len(list(mixture.mixture_schedule(of({"x": [1] * 5}), {"x": 1}, on_exhaust="cycle", limit=12))) == 12
    assert list(mixture.mixture_schedule(of({"x": []}), {"x": 1}, on_exhaust="cycle", limit=12)) == []
    with pytest.raises(ValueError):
        mixture.check_manifests([{"tokenizer_sha256": "a", "sequence_length": 8}, {"tokenizer_sha256": "b", "sequence_length": 8}])


def test_schedule_is_written_in_chunks(spark):
    counts = {"a": 70, "b": 90}
    picks = list(mixture.compose_schedule(counts, {"a": 0.3, "b": 0.7}))
    rows = mixture.write_schedule(spark, iter(picks), chunk=37).collect()
    assert sorted(map(tuple, rows)) == picks
    taken = {"a": 0, "b": 0}
    for position, source, local in picks:  # a pick after the first is of a source that is furthest behind, if any is
        lag = {s: share * position - taken[s] for s, share in (("a", 0.3), ("b", 0.7)) if taken[s] < counts[s]}
        assert local == taken[source] and (position < 16 or max(lag.values()) <= 0 or lag[source] == max(lag.values()))
        taken[source] += 1


@pytest.mark.parametrize("text,right", [(" d ", True), ("D", True), ("the final answer is: d, surely", True), ("[D] since", True), ("Choice is D", True), ("well, D", False), ("E or D", False), ("Dunno? no: E", True), ("9", False), ("", False)])
def test_letters(spark, text, right):
    assert one(spark, evals.letter_score(F.col("t"), F.lit("D")), t=text) is right


def test_numbers(spark):
    assert one(spark, evals.gold_number(F.col("t")), t="so 8 of 9\n#### 17\nor rather\n####  -3.5") == "17"
    for text, want in (("#### 6, no: #### 7", "7"), ("that makes 12 or 31", "31"), ("no idea", None), ("#### 8.0", "8"), ("2.25", "2.25"), ("-9", "-9")):
        assert one(spark, evals.predicted_number(F.col("t")), t=text) == want


def test_source_loss(spark):
    rows = [(0, s, float(v), 1.0) for s, vs in (("a", (1, 1, 2, 2)), ("b", (3, 3, 4, 4))) for v in vs] + [(1, "c", 9.0, 0.0), (2, "a", float("nan"), 1.0)]
    out = {r.source: (r.n_tokens, r.loss, r.ppl) for r in evals.source_loss(spark.createDataFrame(rows, "batch int, source string, nll double, weight double")).collect()}
    assert out["a"][:2] == (4, 1.5) and out["b"][:2] == (4, 3.5) and out[None][:2] == (8, 2.5) and "c" not in out
    assert out["a"][2] == pytest.approx(math.exp(1.5))


def test_top_k(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0, 2.0],)], "z array<double>")
    assert [(x.value, x["index"]) for x in df.select(evals.top_k(F.col("z"), 3).alias("t")).first().t] == [(5.0, 1), (5.0, 2), (2.0, 3)]


def test_schedule_values(spark):
    got = [one(spark, runs.wsd_rate(F.col("s"), 2.0, 100, 150, 1000), s=s) for s in (850, 925, 1000)]
    assert got == pytest.approx([2.0, 1.1, 0.2])


def test_watchdog_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(r, s, rng.gauss(3, 0.1) + (5 if s % 71 == 70 else 0) if s % 50 != 49 else float("nan")) for r in range(2) for s in range(150)]
    df = spark.createDataFrame(rows, "run long, step long, loss double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.watchdog_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("dog").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.run, r.step): r.verdict for r in runs.loss_watchdog(df, by="run").collect()}
    assert {(r.run, r.step): r.verdict for r in spark.table("dog").collect()} == want
    assert {"hard", "ok"} <= set(want.values())


def test_dedup_stream(spark, tmp_path):
    for k, rows in enumerate([[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={k}"))
    f = streams.dedup_batch(str(tmp_path / "seen"), str(tmp_path / "out"))
    s = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s.writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_files(spark, tmp_path):
    import pyarrow as pa

    seqs = spark.createDataFrame([(i // 3, i % 3, [i * 8 + k for k in range(8)]) for i in range(8)], "shard_id long, local_id long, tokens array<bigint>")
    done = files.write_token_files(seqs, f"file://{tmp_path}/t", 8).collect()
    assert sorted((r.file, r.n_sequences, r.bytes) for r in done) == [(f"shard-{s:06d}/tokens.bin", n, n * 32) for s, n in ((0, 3), (1, 3), (2, 2))]
    (tmp_path / "t" / "shard-000002" / "tokens.bin").open("ab").write(b"\0" * 20)  # a short tail
    back = files.read_token_files(spark, str(tmp_path / "t"), 8, rows_each=2).orderBy("path", "local_id").collect()
    assert [r.tokens for r in back] == [r.tokens for r in seqs.orderBy("shard_id", "local_id").collect()]
    with pytest.raises(ValueError):
        files.write_token_files(seqs, "s3a://x/y", 8)
    seqs = spark.createDataFrame([(0, i, [i * 8 + k for k in range(8)]) for i in range(5)], "shard_id long, local_id long, tokens array<bigint>")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.arrow").write_bytes(files.arrow_file(pa.table({"x": [1, 2]})))
    assert [r.x for r in files.read_arrow_files(spark, str(tmp_path / "a"), "x long").collect()] == [1, 2]
    (tmp_path / "run.log").write_text('junk\n{"event":"step","loss":1.5}{"event":"step","loss":2.5}\n{"event":\n')
    assert sorted(r.loss for r in files.read_log(spark, str(tmp_path / "run.log"), "event string, loss double").collect()) == [1.5, 2.5]
    packed = seqs.withColumn("sequence_id", F.col("local_id"))
    files.write_shards(packed.select("sequence_id", "tokens"), str(tmp_path / "p"), 2, 8)
    assert files.get_sequence(spark, str(tmp_path / "p"), 3, 2).first().tokens[0] == 24
    assert [r.sequence_id for r in files.iterate_from(spark, str(tmp_path / "p"), 2, 2).collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        files.write_shards(packed.select("sequence_id", "tokens"), str(tmp_path / "q"), 2, 7)
    rows = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "k int, t string, u string")
    assert [(r.doc_id, r.text) for r in files.read_documents(rows, "d", ["t", "u"], order_by="k").orderBy("doc_id").collect()] == [("d#0", "a\n\nx"), ("d#1", "b")]


def test_prompts_are_whole(spark):
    long = "why " * 5000
    q = {"q": long, "p": long + "p", "a": "x", "b": "y" * 300}
    options = F.array("a", "b")
    tail = f"A. x\nB. {'y' * 300}\nAnswer:"
    assert one(spark, evals.choice_block(F.col("q"), options), **q) == f"Q: {long}\n{tail}"
    assert one(spark, evals.choice_block(F.col("q"), options, F.lit("B")), **q) == f"Q: {long}\n{tail} B"
    assert one(spark, evals.passage_prompt(F.col("p"), F.col("q"), options), **q) == f"Passage: {long}p\nQuestion: {long}\n{tail}"
    shots = F.array(evals.worked_block(F.lit("1+1?"), F.lit("#### 2")), evals.worked_block(F.lit("2+2?"), F.lit("#### 4")))
    want = f"Q: 1+1?\nA: #### 2\n\nQ: 2+2?\nA: #### 4\n\nQ: {long}\nA:"
    assert one(spark, evals.few_shot_prompt(shots, evals.worked_block(F.col("q"))), **q) == want


def test_prompt_query_cuts_nothing(spark):
    from corpusloom.plans import evals as plans

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in plans.prompt_template(spark, sf).collect():
        assert r.prompt is None if text[r.doc_id] is None else r.prompt.startswith(f"Q: {text[r.doc_id]}\nA. ")


def test_retention_keeps_the_last_of_each_run(spark):
    rows = [(r, s * 100, s != 4) for r in (1, 2) for s in range(1, 5 + r)]
    out = runs.retention(spark.createDataFrame(rows, "run int, step int, complete boolean"), 2, 300, by="run").collect()
    got = {(r.run, r.step): (r.kept, r.is_latest) for r in out}
    assert {k[0]: k[1] for k, v in got.items() if v[1]} == {1: 500, 2: 600}
    assert {k for k, v in got.items() if v[0]} == {(1, 300), (1, 500), (2, 300), (2, 500), (2, 600)}


def test_retention_query_judges_every_event(spark):
    from corpusloom.plans import runs as plans

    sf = "/root/testdata/sf0.001"
    complete = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 7 <> 3").count()
    assert plans.checkpoint_retention(spark, sf).count() == complete


def test_resume_leaves_half_the_shards_at_any_size(spark):
    from corpusloom.plans import corpus, runs as plans

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        shards = {r.shard_id for r in corpus.shard_manifest(spark, sf).collect()}
        left = {r.shard_id for r in plans.manifest_resume_antijoin(spark, sf).collect()}
        assert left == {s for s in shards if s >= len(shards) // 2} and left


def brute_greedy(rows, cfg):
    """Sequential greedy removal by its rule: (doc_id -> earliest similar kept one of its group, or None)."""
    sig = {i: dedup.signature(t or "", cfg.seeds(), cfg.ngram) for i, _, t in rows}
    kept, out = {}, {}
    for i, g, _ in sorted(rows):
        near = lambda j: any(sig[i][k : k + cfg.rows] == sig[j][k : k + cfg.rows] for k in range(0, cfg.permutations, cfg.rows))  # noqa: B023, E731
        same = [j for j in kept.setdefault(g, []) if near(j) and sum(p == q for p, q in zip(sig[i], sig[j])) >= cfg.threshold * cfg.permutations]
        out[i] = same[0] if same else None
        if not same:
            kept[g].append(i)
    return out


def test_signatures_are_least_seeded_hashes():
    cfg = dedup.MinHashConfig(permutations=6, bands=2)
    text = "one two three four five six seven"
    grams = ["one two three four five", "two three four five six", "three four five six seven"]
    master = xxhash.xxh64((0xC0FFEE).to_bytes(8, "little")).intdigest().to_bytes(8, "little")
    seeds = [int.from_bytes(xxhash.xxh64(master + i.to_bytes(8, "little")).digest(), "little") for i in range(6)]
    assert cfg.seeds() == seeds
    assert dedup.signature(text, seeds, 5) == [T.signed(min(xxhash.xxh64(g, seed=s).intdigest() for g in grams)) for s in seeds]
    assert dedup.signature(" \n", seeds, 5) == [0] * 6


def test_greedy_dedup_of_large_groups(spark):
    """Near copies, chains and a group that shares a passage: rounds and pairs both decide as one pass in order does."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(500)]
    rows = []
    for _ in range(3):
        words = [rng.choice(vocab) for _ in range(80)]
        for _ in range(30):
            words = [rng.choice(vocab) if rng.random() < 0.01 else w for w in words]
            rows.append(" ".join(words))
    passage = [rng.choice(vocab) for _ in range(60)]
    rows += [" ".join(passage + [rng.choice(vocab) for _ in range(12)]) for _ in range(40)] + ["", None, "x y"]
    rng.shuffle(rows)
    rows = [(i, "ab"[i % 2], t) for i, t in enumerate(rows)]
    cfg = dedup.MinHashConfig()
    got = {r.doc_id: r.dup_of for r in dedup.greedy_keep(spark.createDataFrame(rows, "doc_id long, source string, text string"), cfg).collect()}
    assert got == brute_greedy(rows, cfg)


def test_dedup_queries_equal_brute_force(spark):
    from corpusloom.plans import corpus

    sf, cfg = "/root/testdata/sf0.001", dedup.MinHashConfig()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    sig = {i: dedup.signature(t or "", cfg.seeds(), cfg.ngram) for i, _, t in rows}
    assert {r.doc_id: r.signature for r in corpus.minhash_signature(spark, sf).collect()} == {i: ",".join(map(str, s)) for i, s in sig.items()}
    assert {r.doc_id: r.dup_of for r in corpus.minhash_dedup(spark, sf).collect()} == brute_greedy(rows, cfg)
    agree = lambda i, j: sum(p == q for p, q in zip(sig[i], sig[j])) / cfg.permutations
    want = {(i, j): agree(i, j) for i, g, _ in rows for j, h, _ in rows if i < j and g == h and agree(i, j) >= cfg.threshold}
    got = {(r.a, r.b): r.estimate for r in corpus.lsh_candidates(spark, sf).collect()}
    assert got.items() <= want.items() and len(got) >= 0.9 * len(want)


def test_ledger_is_exact_and_ties_share_a_total(spark):
    from decimal import Decimal

    from corpusloom.operators import runs

    rows = [("a", i, round(i % 5 * 0.5 * (i % 600) / 3600, 9)) for i in range(3000)] + [("t", 0, 0.1)] * 8 + [("t", 1, 0.8), ("t", 2, None), ("n", 0, None)]
    got = runs.ledger(spark.createDataFrame(rows, "pod string, i int, delta_usd double"), 2.0, "pod", ["i"]).collect()
    total = {}
    for p, i, _ in rows:
        known = [Decimal(str(d)) for q, j, d in rows if q == p and j <= i and d is not None] if p != "a" else None
        total[p, i] = float(sum(known)) if known else None
    run = Decimal(0)
    for p, i, d in rows[:3000]:
        run += Decimal(str(d))
        total[p, i] = float(run)
    assert {(r.pod, r.i): r.total_usd for r in got} == total and len(got) == len(rows)
    assert [(r.near_ceiling, r.blocked) for r in got if r.pod == "t" and r.i == 1] == [(True, False)]  # 1.6 to the cent


def test_range_of(spark):
    from corpusloom.functions.ranges import range_of

    cuts = [-5, 0, 3, 3_000_000_000, 3_000_000_007]
    keys = [-9, -5, -1, 0, 2, 3, 4, 3_000_000_006, 3_000_000_007, 10**12]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", range_of(F.col("k"), cuts).alias("r")).collect()
    assert {r.k: r.r for r in got} == {k: sum(c <= k for c in cuts) for k in keys}


def test_range_of_parses_its_cuts_once(spark):
    from corpusloom.functions.ranges import constants, range_of

    out = spark.range(4).select(range_of(F.col("id"), [1, 3]).alias("r"), constants([7, None, 9], "int").alias("c"), constants([0.5, None], "double").alias("d"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "split(" not in plan  # folded, so no row parses the cuts
    assert [r.r for r in out.collect()] == [0, 1, 1, 2]
    assert out.first().c == [7, None, 9] and out.first().d == [0.5, None]


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from corpusloom.sources import scratch

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError):
        scratch.shared_root(cluster)


def test_build_with_dedup_equals_brute_force(spark):
    """Stages exclude one another: near-duplicates are sought among clean redacted texts, source by source, in order."""
    from corpusloom.plans import corpus

    sf, cfg = "/root/testdata/sf0.001", dedup.MinHashConfig()
    docs = filters.filter_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    dirty = {r.doc_id for r in corpus.filter_decontam(spark, sf).where("NOT keep").collect()}
    clean = [(r.doc_id, r.source, r.text) for r in docs if r.reason == "ok" and r.doc_id not in dirty]
    twin = {i for i, j in brute_greedy(clean, cfg).items() if j is not None}
    want = {}
    for r in docs:
        row = want.setdefault(r.source, [0] * 6)
        stage = 1 if r.reason != "ok" else 2 if r.doc_id in dirty else 3 if r.doc_id in twin else 4
        row[0] += 1
        row[stage] += 1
        row[5] += len(r.text.split()) + 1 if stage == 4 else 0
    got = {r.source: r for r in corpus.build_stats_dedup(spark, sf).collect()}
    assert {s: [r.docs_seen, r.docs_filtered, r.docs_contaminated, r.docs_deduped, r.docs_kept, r.n_tokens] for s, r in got.items()} == want
    assert all(r.n_sequences == r.n_tokens // corpus.L for r in got.values())


def test_composed_corpus_is_the_schedule_of_all_spans(spark):
    from corpusloom.plans import corpus
    from corpusloom.plans import runs as plans

    sf = "/root/testdata/sf0.001"
    out = plans.compose_mixed_corpus(spark, sf).collect()
    spans = {tuple(r) for r in corpus._spans(spark, sf).collect()}
    assert {(r.source, r.seq, r.doc_id, r.token_start, r.token_end) for r in out} == spans and len(out) == len(spans)
    places = {r.position: (r.source, r.seq) for r in out}
    assert sorted(places) == list(range(len(places))) and len(set(places.values())) == len(places)
