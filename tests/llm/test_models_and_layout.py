"""The classifier, the mix, the shards, the archives, and the pipeline."""

import base64
import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm.kd_shards import kd_shards
from chronopanel.llm.mixing import mix_documents, mix_plan, mixed_copies
from chronopanel.llm.quality_classifier import fit_on_labels, fit_preferences, quality_scores
from chronopanel.llm.quality_rules import fit_label_model
from chronopanel.llm.warc import archive_pages, read_archives, read_records, record_digests
from tests.llm import brute
from tests.llm.conftest import EDGE, REPEATED, SMALL, frame

SF = "/root/testdata/sf0.01"


def test_classifier_on_rows_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 100
    assert np.mean([r["predicted"] == r["quality"] for r in out]) >= 0.95
    for r in out[:20]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_classifier_does_not_learn_from_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit_on_labels(docs, labels), fit_on_labels(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_classifier_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(4, 1), (17, 0), (18, None), (None, 1), (15, 1), (20, 0), (4, 0)], "doc_id bigint, quality int")
    out = quality_scores(edge, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["score"] == 0.5 for r in quality_scores(edge, labels.limit(0)).collect())
    assert quality_scores(nothing, labels).count() == 0


def test_preferences_order_and_threshold():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, 5)) + np.outer(y, [2, 0, 0, 0, -1])
    model = fit_preferences(x, y)
    raw = model.raw(x)
    better = np.mean(raw[y == 1][:, None] > raw[y == 0][None])
    assert better > 0.9 and abs(np.mean(model.score(x) >= 0.5) - y.mean()) < 0.01


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    patterns = Counter()
    for t in truth:
        patterns[tuple(int(2 * (t if rng.random() < acc else not t)) if rng.random() < 0.8 else 1 for acc in (0.95, 0.9, 0.8, 0.7))] += 1
    model = fit_label_model(list(patterns.items()), 4)
    model.names = list("abcd")
    # The pseudo-counts, a hundredth of the rows, pull a little.
    assert abs(model.prior - 0.8) < 0.1
    assert np.allclose(list(model.accuracies().values()), (0.95, 0.9, 0.8, 0.7), atol=0.07)


@pytest.mark.parametrize("rows", [EDGE, REPEATED])
def test_mix(spark, rows):
    df = frame(spark, rows)
    out = mix_documents(df, block_words=16).collect()
    assert len(out) == len(rows)
    have = defaultdict(int)
    for _, t, s in rows:
        have[s] += len(brute.SPACED.findall(t or ""))
    want = brute.mix_targets(have)
    took = defaultdict(int)
    for r in out:
        assert r["source_size"] == have[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - want[s]) <= 16 for s in have)
    again = mix_documents(df.repartition(7), block_words=16).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    copies = mixed_copies(df, block_words=16)
    assert copies.columns == df.columns
    assert max(copies.groupBy("doc_id", "text").count().toPandas()["count"], default=0) <= 3 * 3


def test_mix_slots(small):
    df, _ = small
    _, sources, slots = mix_plan(df, block_words=64, slots_per_shard=100)
    rows, per = slots.collect(), {r["__source"]: r for r in sources.collect()}
    assert sorted((r["shard"] * 100 + r["slot"]) for r in rows) == list(range(len(rows)))
    used = defaultdict(list)
    for r in rows:
        used[r["__source"], r["pass"]].append(r["block"])
    for (s, k), blocks in used.items():
        assert len(set(blocks)) == len(blocks)
        if k <= per[s]["__passes"]:
            assert sorted(blocks) == list(range(per[s]["__blocks"]))
    # The draw is spread over shards: no shard is one source's.
    shards = defaultdict(Counter)
    for r in rows:
        shards[r["shard"]][r["__source"]] += 1
    full = [c for c in shards.values() if sum(c.values()) == 100]
    assert full and all(max(c.values()) < 60 for c in full)


def test_mix_empty(nothing):
    assert mix_documents(nothing).count() == 0 and mixed_copies(nothing).count() == 0


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = kd_shards(docs, n_shards=13).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(out) == len(texts)
    size, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode())
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        places[t].add(r["shard"])
    assert set(size) == set(range(13))
    assert max(size.values()) - min(size.values()) <= 1.5 * max(r["size"] for r in out)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(p) > 1 for p in places.values()) <= 12


@pytest.mark.parametrize("rows", [EDGE, REPEATED])
def test_shards_edges(spark, rows):
    out = kd_shards(frame(spark, rows), n_shards=40).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_one_text(spark, nothing):
    """A group of copies larger than a shard is cut into pieces, so shards stay even."""
    rows = [(i, "the same text " * 20, "a") for i in range(900)] + [(i, f"text {i} " * 30, "b") for i in range(900, 1300)]
    size = Counter()
    for r in kd_shards(frame(spark, rows), target_bytes=40_000).collect():
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / len(size)
    assert all(0.8 * mean < s < 1.2 * mean for s in size.values())
    assert kd_shards(nothing, n_shards=5).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 5000
    odd = "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/1", big), (2, "http://a/2", "x"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "http://a/5", big), (6, "u", "x"), (7, "u", odd), (None, "u", "only null"), (8, "u", big), (8, "u", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("chunk", F.lit(1)).withColumn("payload", F.lit(2)).withColumn("id", F.lit(3)).repartition(3)
    manifest = archive_pages(pages, str(tmp_path / "w"), chunk_bytes=1000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    chunks = read_archives(manifest, chunk_bytes=700)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 700
    texts = {(i, t) for i, _, t in rows}
    whole = defaultdict(list)
    for r in chunks.filter("record_type = 'response' AND record_id <> '8'").orderBy("record_id", "chunk").collect():
        whole[r["record_id"]].append(bytes(r["data"]))
    for i, parts in whole.items():
        assert b"".join(parts).decode() in {(t or "") for j, t in texts if str(j) == i}
    got = Counter((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in record_digests(chunks).collect())
    top = {}
    for i, _, t in rows:
        if i is not None:
            top[t or ""] = max(top.get(t or "", i), i)
    want = Counter()
    for i, _, t in rows:
        data = (t or "").encode()
        first = top.get(t or "", i)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[(str(i), len(data), digest, "response" if i == first else "revisit", None if i == first else str(first))] += 1
    assert got == want


def test_warc_min_bytes_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    out = record_digests(read_archives(archive_pages(pages, str(tmp_path / "a"), min_bytes=3))).collect()
    assert {r["record_id"] for r in out if r["record_type"] == "revisit"} == {"3"}
    manifest = archive_pages(pages.limit(0), str(tmp_path / "b"))
    assert manifest.count() == 0 and read_archives(manifest).count() == 0


def test_warc_foreign_archive():
    """Plain records of another writer: no HTTP block, several gzip members, one without content."""
    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    pack = lambda data: (p := zlib.compressobj(wbits=31)).compress(data) + p.flush()
    data = pack(record(1, b"first")) + pack(record(2, b"") + record(3, b"x" * 100_000))
    rows = list(read_records(io.BytesIO(data), 30_000))
    assert [(r["record_id"], r["bytes_so_far"]) for r in rows if r["last"]] == [("urn:x:1", 5), ("urn:x:2", 0), ("urn:x:3", 100_000)]
    with pytest.raises(ValueError, match="within a record"):
        list(read_records(io.BytesIO(pack(record(1, b"first")[:-6])), 10))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    (_, quality), (_, dedup), (_, clean), (_, mix), (_, shard) = corpus_pipeline.STAGES
    good = quality(spark, docs, SMALL).cache()
    assert good.columns == columns
    predicted = {r["doc_id"] for r in quality_scores(docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == predicted
    once = dedup(spark, good, SMALL).cache()
    want = [i for i, _, _, kept in brute.near_duplicates([(i, rows[i]) for i in sorted(predicted)], 80) if kept]
    assert sorted(r["doc_id"] for r in once.collect()) == want and once.columns == columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = clean(spark, once, SMALL).cache()
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in want if not brute.contamination(rows[i], items, 10)[1]]
    assert left.columns == columns
    mixed = mix(spark, left, SMALL).cache()
    assert mixed.columns == columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    final = shard(spark, mixed, SMALL).collect()
    assert Counter(r["doc_id"] for r in final) == Counter(r["doc_id"] for r in mixed.collect())


def test_native_operators_run_no_python(spark):
    """The plans of the operators that must stay in the JVM hold no Python node."""
    from chronopanel.llm.license_scan import license_scan
    from chronopanel.llm.quality_rules import quality_filter

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df in (license_scan(docs), quality_filter(docs), kd_shards(docs, n_shards=4), mix_documents(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
