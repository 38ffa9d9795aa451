"""The ten operators against brute force, exact round trips, held-out accuracy and their SQL."""

import hashlib
import itertools
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import difference  # noqa: E402

from corpusloom.llm import bpe, chat, graph, imatch, jpeg, media, minhash, mixing, neighbours, quality, queries, secrets, urls, warc  # noqa: E402
from corpusloom.llm.oracles import ORACLES  # noqa: E402
from corpusloom.sources import scratch  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, set_key string, label long"


def docs_of(spark, rows):
    """Rows (doc_id, text) with null and clashing further columns."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "k", 1) for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one"), (5, "one"), (None, "one two"), (6, "längér " * 30_000), (7, "a b c d e f"), (8, "A b c d e f")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(spark, SF, queries.QUERIES[name], ORACLES[name]) == ""


def test_pieces_hold_all_rows():
    import pyarrow as pa

    from corpusloom.llm.batches import pieces

    texts = ["a" * n for n in (5, 0, 30, 4, 4, 4, 100, 1)] + [None, "é" * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["i", "t"])
    got = list(pieces(iter([batch, batch.slice(0, 0)]), "t", most=12))
    assert [x for p in got for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= 12 for p in got) and len(got) < 8


# --- near-duplicates -----------------------------------------------------------------------------------------------


def brute_components(rows, k=5):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [(i, grams(t)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(30)]  # a passage that many documents hold
    rows = []
    for base in range(6):
        words = [rng.choice(vocab) for _ in range(60)]
        for _ in range(25):
            w = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    rows += [" ".join(shared + [rng.choice(vocab) for _ in range(20)]) for _ in range(60)]
    rows += ["short text", "short text", "Short Text", "", None]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicate_edges(spark):
    out = minhash.near_duplicates(docs_of(spark, EDGES)).collect()
    assert len(out) == len(EDGES)
    by = {(r.doc_id, r.n_shingles): r for r in out}
    assert by[1, 0].kept and by[2, 0].component_id == 2 and by[3, 0].kept
    assert by[5, 1].component_id == 4 and not by[5, 1].kept
    assert by[None, 1].component_id is None and by[None, 1].kept
    assert by[8, 2].component_id == 7
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_repeated_ids_with_other_texts(spark):
    """Rows of one id are what their texts are: each is linked by its own, and none is lost or left twice."""
    t, u, v = (" ".join(f"{x}{i}" for i in range(30)) for x in "tuv")
    rows = [(2, t), (2, t), (5, u), (5, t), (5, v), (9, v + " z"), (7, None), (7, None), (None, t)]
    out = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (2, 2), (2, 2), (5, 2), (5, 5), (5, 5), (7, 7), (7, 7), (9, 5)]
    left = minhash.survivors(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(0, t), (2, t), (5, u), (5, v), (7, ""), (7, "")])
    assert minhash.survivors(docs_of(spark, rows)).columns == docs_of(spark, rows).columns
    assert minhash.survivors(docs_of(spark, [])).count() == 0


def test_shared_passage_links_nothing(spark):
    """Documents that share 63 of some 72 words are all alike at 75 to 80 %: none is linked, and few pairs are made."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(63)]
    rows = [(i, " ".join(passage + [f"x{rng.randrange(10**9)}" for _ in range(8 + i % 3)])) for i in range(300)]
    docs = docs_of(spark, rows)
    assert all(r.kept for r in minhash.near_duplicates(docs).collect())
    s = scratch.Scratch(spark, "test")
    everyone = s.save(docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("label")))
    assert minhash._completing_pairs(everyone, docs.select("doc_id", "text"), minhash.NearDupConfig(), s).count() == 0


def test_signature_minima_and_maxima():
    h = minhash.MinMaxHasher(8, 1)
    s = minhash.shingle_hashes(b"a b c d e f g h i j", 3)
    x = (s[None, :].astype(object) * h.a.astype(object) + h.b.astype(object)) % (1 << 64)
    assert h.signature(s).tolist() == [*x.min(1).tolist(), *x.max(1).tolist()]


def test_components_of_chains(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    s = scratch.Scratch(spark, "test")
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long"), s).collect())
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(x, x) == label[x] for x in label)


# --- quality -------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    out = queries.op2_quality(spark, "/root/testdata/sf0.1").where("held_out")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([(np.array(bad) < g).mean() + (np.array(bad) == g).mean() / 2 for g in good])
    assert auc > 0.95
    assert np.mean([r.predicted == 1 for r in rows if r.quality == 1]) > 0.98


def auc(out):
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    return np.mean([(np.array(bad) < g).mean() + (np.array(bad) == g).mean() / 2 for g in good])


@pytest.mark.parametrize("sf,least", [("sf0.001", 0.7), ("sf0.01", 0.97)])
def test_quality_of_small_tables(spark, sf, least):
    """Too little text to train a dictionary on still gives scores that tell documents apart."""
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    out = queries.op2_quality(spark, f"/root/testdata/{sf}")
    assert out.select("score").distinct().count() > 100
    assert auc(out.where("held_out").join(labels, "doc_id").select("score", "quality").collect()) >= least


def test_quality_scores_equal_brute_force(spark):
    """The whole of each text is compressed with either dictionary, block by block."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, queries.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT
    by = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d, kind), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        b = (r.text or "").encode()
        good, bad = (sum(len(c.compress(b[i : i + model.block])) for i in range(0, len(b), model.block)) for c in by)
        x = (bad - good) / (bad + good) if b else 0.0
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(model.slope * x + model.offset))), abs=0.02)


def test_quality_sample_reads_whole_texts(spark):
    """A byte bound thins the blocks all over the texts; what stands at the end of a long one still counts."""
    rows = [(i, f"plain filler line {i % 7} " * 2000 + ("tail of gold " if i % 2 else "tail of lead ") * 300) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    cfg = quality.QualityConfig(sample_bytes=200_000)
    picked, _ = quality._sample(docs_of(spark, rows), labels, cfg, scratch.Scratch(spark, "test"))
    blocks = [b for part in (0, 1) for _, b in quality._blocks(picked, cfg)[1, part]]
    assert 100_000 < sum(map(len, blocks)) < 300_000 and any(b"gold" in b for b in blocks) and any(b"filler" in b for b in blocks)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, text int")
    model = quality.fit(docs_of(spark, EDGES), labels)
    out = quality.score(docs_of(spark, EDGES), model).collect()
    assert len(out) == len(EDGES) and len({r.score for r in out}) == 1  # one class alone: the prior, and nothing else
    assert out[0].score == pytest.approx(2 / 3)
    assert quality.keep_good(docs_of(spark, EDGES), model).columns == docs_of(spark, EDGES).columns
    assert quality.score(docs_of(spark, []), model).count() == 0
    both = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (7, 0, 0), (8, 0, 0), (99, 0, 0)], "doc_id long, quality int, text int")
    model = quality.fit(docs_of(spark, EDGES), both)
    out = quality.score(docs_of(spark, EDGES), model).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert quality.fit(docs_of(spark, []), both).good == b"" and quality.fit(docs_of(spark, EDGES), both.where("false")).good == b""


# --- media ---------------------------------------------------------------------------------------------------------


def test_lossless_frames_and_files():
    rng = np.random.default_rng(0)
    for n in (64, 64 * 31, 64 * 32, 64 * 97):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        data = media.payload_to_avi(payload)
        info = media.parse_avi(data)
        assert media.avi_to_payload(data, info, media.decode_frames(data, info)) == payload
        bare = data[: data.index(b"idx1")]  # without an index the movi list is walked
        bare = bare[:4] + (len(bare) - 8).to_bytes(4, "little") + bare[8:]
        assert media.parse_avi(bare)["frames"] == info["frames"]
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF0000WAVE")


def baseline_frame():
    """An 8 x 8 grey block of one DC value, coded by hand with the standard table (category 7, +64)."""
    bits = "11110" + "1000000" + "1010"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    quant = b"\xff\xdb\x00\x43\x00" + bytes([8] * 64)
    head = b"\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"
    return b"\xff\xd8" + quant + head + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + scan + b"\xff\xd9"


def test_baseline_frame():
    assert (jpeg.decode(baseline_frame()) == 128 + 64).all()
    with pytest.raises(ValueError):  # a table that isn't there
        jpeg.decode(baseline_frame().replace(b"\x08\x01\x01\x11\x00", b"\x08\x01\x01\x11\x03"))


def test_shots(spark):
    x = np.concatenate([np.full((10, 16, 64), 30), np.full((12, 16, 64), 200)]).astype(np.uint8)
    data = media.write_avi(jpeg.encode_lossless(x), 64, 16, 40_000)
    rows = media.clip_rows(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no")), (3, None)], "id long, content binary")).collect()
    assert [(r.id, r.clip, r.first_frame, r.frames) for r in rows if r.error is None] == [(1, 0, 0, 10), (1, 1, 10, 12)]
    assert rows[1].start_s == pytest.approx(0.4) and sorted(r.id for r in rows if r.error) == [2, 3]


def test_broken_files_are_reported(spark):
    """Each of 2,000 damaged files, lossless and baseline, gives clips or one row that says why not."""
    rng = random.Random(4)
    frames = [(np.full((16, 64), 30 + 20 * i) + np.arange(64)).astype(np.uint8) for i in range(4)]
    plain = media.write_avi(jpeg.encode_lossless(np.stack(frames)), 64, 16, 40_000)
    base = media.write_avi([baseline_frame()] * 3, 8, 8, 40_000)
    files = []
    for i in range(2000):
        data = bytearray(plain if i % 2 else base)
        for _ in range(rng.choice([1, 1, 2, 8])):
            data[rng.randrange(len(data))] = rng.randrange(256)
        files.append(bytes(data[: rng.randrange(len(data))] if i % 5 == 0 else data))
    broken = 0
    for data in files:
        try:
            media.clips(data)
        except ValueError:
            broken += 1
    assert 200 < broken < 2000
    rows = media.clip_rows(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "id long, content binary")).collect()
    assert sum(r.error is not None for r in rows) == broken


def test_stored_texts_equal_their_files(spark):
    """Every text of the table: its payload, the last bytes' checksum, the file and the shots, from files written apart."""
    import zlib

    cfg = media.MediaConfig()
    out = {r.doc_id: r for r in queries.op3_media(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        b = (d.text or "").encode()
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        height = min(len(payload) // 64, cfg.rows)
        grid = np.frombuffer(payload + b"\0" * (-len(payload) % (64 * height)), np.uint8).reshape(-1, height, 64)
        data = media.write_avi(jpeg.encode_lossless(grid), 64, height, cfg.micros, str(len(payload)).encode())
        r = out[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(b), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest())
        shots = [f"{a}+{n}:{grid[a : a + n].mean(axis=(1, 2)).mean():.3f}" for _, a, n, _, _, _ in media.clips(data)]
        assert r.feature == f"frames={len(grid)};seconds={len(grid) * 0.04:.2f};" + ",".join(shots)


def test_media_edges(spark):
    out = {(r.doc_id, r.n_bytes): r for r in media.store_texts(docs_of(spark, EDGES)).collect()}
    for i, t in EDGES:
        b = (t or "").encode()
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        r = out[i, len(b)]
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert out[4, 3].media_sha256 == out[5, 3].media_sha256
    assert media.store_texts(docs_of(spark, [])).count() == 0


# --- urls ----------------------------------------------------------------------------------------------------------


def test_url_rules_and_graph(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/p">x</a>' for x in h)
    pages = [
        (1, "http://Good.org/ok/1", link("fine.net")),
        (2, "http://bad.org/spam/1?x", link("bad.org")),
        (3, "http://farm.net/a#b", link("bad.org")),
        (4, "http://fine.net/", None),
        (5, None, "x"),
        (6, "mailto:x", ""),
        (6, "mailto:x", ""),
    ]
    df = spark.createDataFrame([(*p, "h", "v") for p in pages], "page_id long, url string, html string, host string, verdict string")
    rules = [urls.Rule("allow", "good.org", "/ok/"), urls.Rule("block", "org", "/spam/"), urls.Rule("block", "org", "/ok/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rules).collect()}
    assert got[1] == ("good.org", "/ok/1", "good.org/ok/", "allow")
    assert got[2] == ("bad.org", "/spam/1", "org/spam/", "block")
    assert got[3][3] == "block" and got[4][3] == "allow"  # it links to a blocked host; a trusted host links to it
    assert got[5] == ("", "", None, "allow") == got[6]
    assert urls.judge(df, rules).count() == 7 and urls.judge(df.where("false"), rules).count() == 0


def test_query_over_a_host_graph_equals_sql(spark, tmp_path):
    """A table of 3,000 pages of 300 hosts that link to one another, a few of them hot, so that every round moves rank."""
    rng = random.Random(7)
    ends = ["com", "net", "org", "example.com", "example.net", "info"]
    hosts = [f"h{i}.{ends[i % 6]}" for i in range(300)]
    pages = []
    for i in range(3000):
        to = [hosts[min(299, int(rng.paretovariate(0.6)) - 1)] if rng.random() < 0.5 else rng.choice(hosts) for _ in range(rng.randrange(6))]
        links = "".join(rng.choice(['<a href="http://{}/x">', "<a HREF='//{}'>", '<a href="/y">{}']).format(h) for h in to)
        pages.append((i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'en/7', 'fr'])}/{i}?q", links))
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "s"))
    next((tmp_path / "s").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert difference(spark, str(tmp_path), queries.QUERIES["op4_urls"], ORACLES["op4_urls"]) == ""
    judged = queries.op4_urls(spark, str(tmp_path)).where("rule IS NULL").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in judged} == {"allow", "block"}  # the graph says something of pages without a rule


def test_pagerank_equals_dense(spark):
    rng = np.random.default_rng(2)
    n = 12
    a = (rng.random((n, n)) < 0.25) & ~np.eye(n, dtype=bool)
    w = a / np.maximum(a.sum(1, keepdims=True), 1)
    seed = rng.random(n)
    seed /= seed.sum()
    cfg = urls.GraphConfig()
    r = seed.copy()
    for _ in range(cfg.iterations):
        r = seed * (1 - cfg.damping) + cfg.damping * (r @ w)
    nodes = spark.createDataFrame([(str(i), float(s)) for i, s in enumerate(seed)], "host string, seed double")
    edges = spark.createDataFrame([(str(i), str(j), float(w[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "src string, dst string, w double")
    got = {h: x for h, x in urls.propagate(nodes, edges, cfg, scratch.Scratch(spark, "test")).collect()}
    assert np.allclose([got[str(i)] for i in range(n)], r)


# --- mixing --------------------------------------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tok = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tok, p, strict=True)], "n_tokens long, posterior array<double>")
    for shares in ([0.4, 0.3, 0.3], [0.75, 0.15, 0.1]):  # the second holds rates at 0
        target = mixing.target_tokens(members, np.array(shares))
        history, totals = mixing.fit_rates(members, target)
        assert np.allclose(totals, target, rtol=1e-4)
        rates = [r[0] for r in members.select(mixing.rate_column(history)).collect()]
        assert min(rates) >= 0


def test_rate_does_not_grow_with_its_steps(spark):
    rng = np.random.default_rng(6)
    p, history, keep = rng.dirichlet([0.3, 0.3, 0.3], 50), list(rng.normal(0, 0.2, (40, 3))), [None, 0.75, 0.75]
    rows = spark.createDataFrame([(q.tolist(),) for q in p], "posterior array<double>")
    out = rows.select("posterior", mixing.rate_column(history, mixing.whole_floor(keep)).alias("r"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("greatest(") == 1
    for q, r in out.collect():
        floor, want = float(np.argmax(q) == 0), 1.0
        for step in history:
            want = max(floor, want - float(np.dot(q, step)))
        assert abs(r - want) < 1e-12


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(4, "a"), (7, "b"), (8, None), (None, "a")], "doc_id long, domain string")
    out = mixing.mix_rates(docs_of(spark, EDGES), labels, {"a": 0.5, "b": 0.3, "none": 0.2}).collect()
    assert len(out) == len(EDGES) and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in out)
    mixed = mixing.mix(docs_of(spark, EDGES), labels, {"a": 0.5, "b": 0.5})
    assert mixed.columns == docs_of(spark, EDGES).columns
    assert mixing.mix(docs_of(spark, []), labels, {"a": 0.5, "b": 0.5}).count() == 0


def test_mixing_of_clashing_names(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} words {i}", 7, "p", 1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, Posterior string, copy int, __n int")
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(30)], "doc_id long, domain string")
    out = mixing.mix(df, labels, {"a": 1.0, "b": 0.0}, mixing.MixConfig(iterations=6))
    assert out.columns == df.columns and {r.doc_id % 2 for r in out.collect()} == {1} and all(r.n_tokens == 7 for r in out.collect())


def test_mixing_query_meets_targets(spark):
    """Posteriors equal a dense restatement over whole texts, and expected totals the targets."""
    import zlib

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.fit_domains(docs, queries.domain_labels(labels), tuple(queries.MIX_SHARES))
    out = {r.doc_id: r for r in queries.op5_mixing(spark, SF).collect()}
    totals, every = np.zeros(3), 0
    for d in docs.collect():
        words = (d.text or "").encode().lower().split()
        cells = sorted({zlib.crc32(w) % mixing.MixConfig().features for w in words})
        z = model.weights[-1] + (model.weights[cells].sum(0) / np.sqrt(len(cells)) if cells else 0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        r = out[d.doc_id]
        assert r.n_tokens == len(words) and np.allclose([r.p_clean, r.p_junk, r.p_toxic], p, atol=1e-6)
        assert r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1
        totals += r.rate * len(words) * p
        every += len(words)
    assert np.allclose(totals / every, list(queries.MIX_SHARES.values()), rtol=1e-4)


def test_kept_parts_leave_clean_whole(spark):
    """Whatever the composition, rates of likely clean documents stay at 1 or more and the others' fall."""
    rng = np.random.default_rng(6)
    for alpha in ([0.3, 0.05, 0.05], [0.5, 3, 3]):
        p = rng.dirichlet(alpha, 300)
        tok = rng.integers(1, 500, 300)
        rows = [(int(t), [float(v) for v in q]) for t, q in zip(tok, p, strict=True)]
        members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
        own = (tok[:, None] * p).sum(0)
        target = mixing.kept_tokens(members, [None, 0.75, 0.75])
        assert np.allclose(target, [own.sum() - 0.75 * own[1:].sum(), *(0.75 * own[1:])])
        rate = mixing.fitted_rate(members, [None, 0.75, 0.75], mixing.MixConfig(iterations=8), True)
        r = np.array([x[0] for x in members.select(rate).collect()])
        clean = p.argmax(1) == 0
        assert r[clean].min() >= 1 and r.min() >= 0
        reached = (r[:, None] * tok[:, None] * p).sum(0)
        assert reached[0] >= own[0] * (1 - 1e-9)


def test_pipeline_mixing_drops_no_clean_document(spark):
    """Clean documents that are more than 0.9 of the stage's tokens are all written."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    labels = queries.domain_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    few = docs.join(labels.where("domain = 'toxic' AND doc_id % 4 <> 0").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    model = mixing.fit_domains(few, labels, ("clean", "junk", "toxic"))
    likely = mixing.with_posteriors(few, model).where("posterior[0] = array_max(posterior)")
    out = corpus_pipeline.mix_to_targets(spark, few, SF)
    assert likely.join(out, "doc_id", "left_anti").count() == 0


def test_labels_of_absent_documents_change_nothing(spark):
    docs = docs_of(spark, [(i, f"{'good' if i % 2 else 'bad'} words {i}") for i in range(40)])
    present = [(i, "a" if i % 2 else "b") for i in range(40)]
    absent = [(i, "b") for i in range(1000, 1400)]
    cfg = mixing.MixConfig(sample_docs=10, epochs=5)
    fits = [mixing.fit_domains(docs, spark.createDataFrame(x, "doc_id long, domain string"), ("a", "b"), cfg) for x in (present, present + absent)]
    assert np.allclose(fits[0].weights, fits[1].weights) and fits[0].weights.any()


# --- secrets -------------------------------------------------------------------------------------------------------


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query("(foo|bar)x") == ("or", (("and", ("bar", "arx")), ("and", ("foo", "oox"))))
    assert secrets.trigram_query("(abc)?z+") is True
    assert secrets.query_grams(secrets.trigram_query("hello|a")) == set()


def test_case_flags_lose_nothing():
    """Letters that match beyond ASCII under (?i) are in no trigram."""
    for flag in ("(?i)secret", "(?i:sec)ret", "se(?i:cre)t"):
        scanner = secrets.SecretScanner((secrets.SecretRule("x", flag + "=[a-z]+"),))
        texts = ["secret=a", "SECret=a", "\u017fecret=a", "seCREt=a", "none"]
        assert [bool(f) for f in scanner.spans(texts)] == [re.search(flag, t) is not None and "=" in t for t in texts]
    assert secrets.trigram_query("(?ia)key") == "key" and secrets.trigram_query("(?i)key") is True


def test_runs_are_read_once():
    import time

    scanner, spent = secrets.SecretScanner(secrets.BASE_RULES + secrets.MORE_RULES), []
    for n in (50_000, 800_000):
        start = time.perf_counter()
        assert scanner.spans(["eyJ" * n]) == [[]]
        spent.append(time.perf_counter() - start)
    assert spent[1] < 64 * max(spent[0], 0.01)
    (found,) = scanner.spans(["a eyJ" + "x" * 20 + ".eyJ" + "y" * 20 + ".z, xeyJa.b.c"])
    assert found == [(2, 6, 51)]


def test_scan_equals_plain_regex(spark):
    rng = random.Random(8)
    bits = ["token=", "Api_Key: ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "secret: token: ", "abcdef", " ", "é", "passwd = ", "x", "-----BEGIN RSA PRIVATE KEY-----", "ſecret=zzzzzzz"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(400)]
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    plain = [("assign", re.compile(assign, re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in secrets.scan(docs_of(spark, rows), secrets.BASE_RULES).collect()}
    for i, t in rows:
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(plain) for m in p.finditer(t) if len(m[g]) >= least)
        assert got[i] == [(plain[k][0], a, b) for a, k, b in want], t


def test_redaction_edges(spark):
    rows = [*EDGES, (9, "x token = abcdefgh y"), (10, "token=deadbeefdeadbeefdeadbeefdeadbeef")]
    out = secrets.redact(docs_of(spark, rows))
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[9] == "x <SECRET> y" and texts[10] == "<SECRET>" and texts[1] is None and out.count() == len(rows)
    assert secrets.scan(docs_of(spark, [])).count() == 0


# --- WARC ----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/\r\nX: y", "ü\r\n\r\nWARC/1.1\r\n"), (4, "u", None), (5, "u", ""), (6, "u", "z" * 300_000), (7, "u", "same")]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string")
    archives, _ = warc.archive_pages(df)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("revisit", 4), 6: ("response", None), 7: ("revisit", 1)
    }
    for i, _, html in pages:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), warc.payload_digest(b))
    empty, _ = warc.archive_pages(df.where("false"))
    assert warc.read_archives(empty).count() == 0


def test_warc_edges(spark):
    """Repeated rows, null ids and a long payload."""
    long = "<p>" + "z" * 6_000_000
    pages = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", "x"), (3, "u", long), (4, "u", long)]
    archives, _ = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(archives).collect())
    assert got == [(0, "response", None, 1), (1, "response", None, 1), (1, "response", None, 1), (2, "revisit", 1, 1), (3, "response", None, len(long)), (4, "revisit", 3, len(long))]


def test_warc_files_and_sidecars(spark, tmp_path):
    import gzip
    import json

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 5} ü" * 50) for i in range(40)], "page_id long, url string, html string")
    archives, _ = warc.archive_pages(pages, warc.WarcConfig(archive_bytes=4000))
    want = sorted(map(tuple, warc.read_archives(archives).collect()), key=repr)
    done = warc.write_files(archives, f"file://{tmp_path}/w").collect()
    assert sum(r.records for r in done) == 40 and sorted(map(tuple, warc.read_files(spark, f"{tmp_path}/w").collect()), key=repr) == want
    for r in done:
        data = (tmp_path / "w" / f"{r.archive}.warc.gz").read_bytes()
        plain = gzip.decompress(data)
        assert len(data) == r.bytes and plain.count(b"WARC/1.1\r\n") == r.records and b"application/http; msgtype=response" in plain
        for line in (tmp_path / "w" / f"{r.archive}.warc.idx").read_text().splitlines():
            e = json.loads(line)
            assert gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1")
    (tmp_path / "mono.warc.gz").write_bytes(gzip.compress(plain) + b"\0" * 99)
    again = warc.normalise_files(spark, f"{tmp_path}/mono.warc.gz").first()
    assert gzip.decompress(bytes(again.content)) == plain and len(again["index"]) == done[-1].records
    with pytest.raises(ValueError):
        warc.write_files(archives, "viewfs://x/y")
    with pytest.raises(ValueError):
        list(warc.inflate(gzip.compress(plain)[:-9]))
    with pytest.raises(ValueError):
        list(warc.inflate(b"no gzip at all"))


def test_normalise_monolith():
    import gzip

    cfg = warc.WarcConfig()
    records = [warc.record(i, f"http://x/{i}", bytes([i]) * (i * 5000), None, cfg) for i in range(12)]
    data, index = warc.normalise(gzip.compress(b"".join(records[:7])) + gzip.compress(b"".join(records[7:])))
    assert gzip.decompress(data) == b"".join(records)
    for (name, offset, size), r in zip(index, records, strict=True):
        assert warc.read_member(data, offset, size)[0]["warc-record-id"] == name
        assert gzip.decompress(data[offset : offset + size]) == r
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(records[0][:-3]))


# --- BPE -----------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.load_ranks(path)
    own = bpe.Encoder(tokens, public.PATTERN)
    assert (own.hashed.find(tokens) == np.arange(len(tokens))).all() and sorted(own.hashed.value.tolist()) == list(range(len(tokens)))
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(0)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", "a" * 2000, "\x1c x\x1f", "नमस्ते 你好 🙂", "x²½ ١٢٣", "it's I'LL", "  \n\t a", "<|endoftext|>"]
    texts += ["".join(chr(rng.choice([32, 10, 39, rng.randrange(128), rng.randrange(0x250), rng.randrange(0x3000)])) for _ in range(60)) for _ in range(300)]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == other.encode_ordinary(t), t[:80]
        assert own.decode(ids) == t.encode()
    encoded = bpe.encode_texts(docs_of(spark, EDGES), path, public.PATTERN)
    back = bpe.decode_ids(encoded, path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in EDGES)
    small = bpe.Encoder(tokens, public.PATTERN, own.hashed, memory=3)
    assert all(small.encode(t).tolist() == other.encode_ordinary(t) for t in texts[:40])


def test_bpe_query_equals_tiktoken(spark):
    """All digests of the query, for every text of the table."""
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    tokens = bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    out = {r.doc_id: r for r in queries.op8_bpe(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = other.encode_ordinary(d.text or "")
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()
        assert (out[d.doc_id].n_tokens, out[d.doc_id].ids_sha256, out[d.doc_id].decoded_sha256) == want


# --- fingerprints --------------------------------------------------------------------------------------------------


def own_fingerprint(text, lexicon, cfg):
    found = sorted({t for t in re.split(r"[\W_]+", (text or "").lower()) if t})
    bar = "0123456789abcdef"[: cfg.sixteenths]
    parts = []
    for k in range(cfg.subsets):
        kept = [t for t in found if t in lexicon and hashlib.md5(f"{cfg.seed}:{t}".encode()).hexdigest()[k] in bar]
        parts.append(hashlib.md5(" ".join(kept).encode()).hexdigest()[:8] if kept else "")
    if not any(parts):
        parts = [hashlib.md5((" ".join(found) or text or "").encode()).hexdigest()[:8]] * cfg.subsets
    return "-".join(parts)


@pytest.mark.parametrize("subsets,sixteenths", [(32, 1), (5, 6)])
def test_fingerprints_equal_brute_force(spark, subsets, sixteenths):
    rows = [(i, " ".join(["common"] + [f"t{(i * j) % 41}" for j in range(8)])) for i in range(100)]
    rows += [(200, "common t1 T1, t2"), (201, "t2 t1 common"), (202, None), (203, ""), (204, "!!"), (205, "rare"), (206, "other rare"), (206, "other rare"), (207, "t3 " * 30_000)]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, __kept string, __TERMS string, fp string")
    cfg = imatch.IMatchConfig(low=0.03, high=0.5, subsets=subsets, sixteenths=sixteenths)
    seen = [{t for t in re.split(r"[\W_]+", (x or "").lower()) if t} for _, x in rows]
    df_of = {t: sum(t in s for s in seen) for t in set().union(*seen)}
    lexicon = {t for t, n in df_of.items() if 0.03 * len(rows) <= n <= 0.5 * len(rows)}
    want = {i: own_fingerprint(t, lexicon, cfg) for i, t in rows}
    inline = imatch.Fingerprinter(df, cfg).add(df, "text", "fp")
    assert inline.columns == df.columns and {r.doc_id: r.fp for r in inline.collect()} == want
    joined = imatch.Fingerprinter(df, imatch.IMatchConfig(low=0.03, high=0.5, subsets=subsets, sixteenths=sixteenths, inline=0))
    assert {r.doc_id: r.fp for r in joined.add(df, "text", "fp").collect()} == want
    like = spark.createDataFrame([(want[a], want[b]) for a, b in ((202, 203), (203, 204), (205, 206), (206, 206))], "a string, b string")
    assert [r[0] for r in like.select(imatch.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 1.0]
    none = imatch.Fingerprinter(df.where("false"), cfg).add(df.where("false"), "text", "fp")
    assert none.count() == 0


def test_subsets_are_checked():
    for bad in ({"subsets": 0}, {"subsets": 33}, {"sixteenths": 17}):
        with pytest.raises(ValueError):
            imatch.IMatchConfig(**bad)


def test_next_row(spark):
    rows = [(i, f"t{i}") for i in range(0, 200, 3)] + [(6, "t6b"), (None, "n")]
    got = neighbours.with_next(docs_of(spark, rows).select("doc_id", "text"), "doc_id", ["text"], {"next_text": "text"})
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {order[i]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    assert {(r.doc_id, r.text): r.next_text for r in got.collect()} == want
    one = neighbours.with_next(docs_of(spark, [(1, "x")]).select("doc_id", "text"), "doc_id", ["text"], {"next_text": "text"}).collect()
    assert one[0].next_text == "x"
    assert neighbours.with_next(docs_of(spark, []).select("doc_id", "text"), "doc_id", ["text"], {"next_text": "text"}).count() == 0


# --- chat ----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["\\", "<", "|>", "<|user|>", "</turn>\n", "<+>", "\\s", "a", "é", "\n", "|", ">"]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "a|>b"]), "".join(rng.choice(bits) for _ in range(rng.randrange(7)))))
    rows += [(None, 0, None, None), (70, None, "assistant", "x"), (70, None, "assistant", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    read = out.select("conv_id", chat.parse_formatted(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in read:
        turns = sorted((t if t is not None else -1, role or "", x or "") for c, t, role, x in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.t] == [(role, x) for _, role, x in turns]
        assert r.loss == "".join(x for _, role, x in turns if role == "assistant")
    assert len(read) == len({r[0] for r in rows})
    assert chat.format_conversations(df.where("false")).count() == 0


def test_long_conversation(spark):
    """Thousands of turns in one conversation: the same text and spans as one pass gives, in time that grows with the turns."""
    import time

    spent = []
    for n in (2000, 16_000):
        roles = [("user", "assistant", "assistant")[(i * 7) % 3] for i in range(n)]
        rows = [(1, i, r, f"<t{i}> |> \\ é") for i, r in enumerate(roles)]
        start = time.perf_counter()
        out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = out.select("formatted", "loss_spans", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
        spent.append(time.perf_counter() - start)
        text, spans = "", []
        for i, (_, _, role, x) in enumerate(rows):
            x = x.replace("\\", "\\s").replace("<", "\\l").replace("|>", "\\p")
            text += "<+>" if i and roles[i - 1] == role else ("</turn>\n" if i else "") + f"<|{role}|>"
            if role == "assistant":
                spans.append((len(text), len(x)))
            text += x
        assert got.formatted == text + "</turn>\n" and [(s.start, s.length) for s in got.loss_spans] == spans
        assert got.loss == "".join(x for _, _, role, x in rows if role == "assistant")
    assert spent[1] < 24 * max(spent[0], 0.5)


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    """Each stage against a restatement of its rule over what the stage before it kept."""
    import corpus_pipeline
    import tiktoken

    public = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "tokens"]
    s = scratch.Scratch(spark, "test")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 9 == 4, F.concat("text", F.lit(" token = abcdef123456"))).otherwise(F.col("text")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r for r in docs.collect()}
        after = s.save(stage(spark, docs, SF))
        assert after.columns == corpus_pipeline.COLUMNS
        kept = {r.doc_id: r for r in after.collect()}
        if name == "quality":
            model = quality.fit(docs, queries.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
            scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
            assert len(set(scores.values())) > 100  # no constant model
            assert set(kept) == {i for i, x in scores.items() if x >= 0.3}
            assert all(i in kept for i, x in labels.items() if x.quality == 1 and scores[i] >= 0.3)
        if name == "near_duplicates":
            want = {i for i, (_, c) in brute_components([(i, r.text) for i, r in before.items()]).items() if i == c}
            assert set(kept) == want and after.count() == len(want)
        if name == "secrets":
            scanner = secrets.SecretScanner(secrets.BASE_RULES + secrets.MORE_RULES)
            found = scanner.spans([r.text for r in before.values()])
            want = {r.doc_id: secrets.redact_text(r.text, f, "<SECRET>") for r, f in zip(before.values(), found, strict=True)}
            assert any(found) and {i: r.text for i, r in kept.items()} == want and all(r.n_chars == len(r.text) for r in kept.values())
        if name == "mixing":
            shares = {d: k for d, k in corpus_pipeline.KEEP.items()}
            rates = {r.doc_id: r.copies for r in mixing.mix_rates(docs, queries.domain_labels(spark.read.parquet(f"{SF}/labels.parquet")), shares, relative=True).collect()}
            assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: n for i, n in rates.items() if n}
            assert all(kept[i].text == before[i].text for i in kept)
        docs = after
    tokens = bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        assert r.ids == other.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_pipeline_edges(spark):
    """Null and empty texts, repeats, ties, a very long text, null ids, further columns and an empty table, in every stage."""
    import corpus_pipeline

    docs = docs_of(spark, EDGES).withColumn("n_tokens", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), SF)
        assert none.count() == 0
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS
        if name in ("secrets", "tokens"):
            assert out.count() == len(EDGES)
        if name == "near_duplicates":
            assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((i or 0, t or "") for i, t in EDGES if i not in (5, 8))
