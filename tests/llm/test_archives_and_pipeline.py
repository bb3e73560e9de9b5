"""Archives: both ARC versions, conversion, exact round trip. The pipeline: each stage's contract."""

import hashlib
import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pipeweave.llm import common, langid, mixing, neardup, quality, stages, warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    pages = [(1, "http://a/ b", b"x\n\ny"), (2, None, b""), (3, "http://c/", "é".encode() * 900)]
    records = list(warc.read_arc(warc.write_arc(pages, "t.arc", version)))
    assert len(records) == 4 and records[0].fields["version"] == str(version)
    assert [r.fields["URL"] for r in records[1:]] == ["http://a/%20b", "about:blank", "http://c/"]
    assert [warc._split_http(r.content)[1] for r in records[1:]] == [p[2] for p in pages]


def test_arc_urls_with_spaces_and_bad_records():
    block = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    head = b"filedesc://a 0.0.0.0 19961231 text/plain %d\n" % len(block) + block + b"\n"
    rows = list(warc.read_arc(head + b"http://a/b c 1.2.3.4 19970102030405 text/html 5\nhello\n"))
    assert rows[1].fields["URL"] == "http://a/b c" and rows[1].content == b"hello"
    assert warc.warc_date("19970102030405") == "1997-01-02T03:04:05Z" and warc.warc_date("19961231") == "1996-12-31T00:00:00Z"
    for bad in (b"http://a 1.2.3.4 1997 text/html 50\nhello\n", b"http://a text/html 5\nhello\n", b"http://a 1.2.3.4 1997 text/html x\nhello\n"):
        with pytest.raises(warc.ArcError):
            list(warc.read_arc(head + bad))
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(b"http://a 1.2.3.4 1997 text/html 5\nhello\n"))
    out = b"".join(warc.convert(head + b"http://a/ 1.2.3.4 19970102030405 text/html 5\nhello\n", lambda r, p: None))
    assert b"WARC-Type: resource" in out and b"WARC-Type: warcinfo" in out


def test_pages_come_back(spark):
    big = "ü" * 600
    rows = [(1, "http://a", "x" * 999), (2, "http://b", "x" * 999), (3, "http://c", big), (9, "http://d", big), (5, None, big), (6, "http://e\n f", None), (7, "http://g", "")]
    rows += [(100 + i, "http://h", "z" * 2000) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    out = {r.page_id: r for r in warc.read_archives(warc.write_archives(df)).collect()}
    assert len(out) == len(rows)
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(i, last.get(h, 0))
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        to = last.get(h)
        assert (out[i].record_type, out[i].refers_to) == (("revisit", to) if to not in (None, i) else ("response", None))
    assert warc.read_archives(warc.write_archives(df.where("false"))).count() == 0


def test_pages_without_and_with_repeated_ids(spark):
    rows = [(None, "http://a", "y" * 1500), (None, None, None), (4, "http://b", "y" * 1500), (4, "http://b", "w" * 1500), (4, "http://b", "w" * 1500), (8, "http://c", "y" * 1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.read_archives(warc.write_archives(df)).collect()
    digest = lambda x: hashlib.sha1(x.encode()).hexdigest()
    y, w = digest("y" * 1500), digest("w" * 1500)
    found = sorted((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to or 0) for r in out)
    assert found == sorted([(0, y, "response", 0), (0, digest(""), "response", 0), (4, y, "revisit", 8), (4, w, "response", 0), (4, w, "response", 0), (8, y, "response", 0)])


def test_very_long_pages_and_a_named_folder(spark, tmp_path):
    long = "é<p>" * 3_000_000  # 15 MB, more than an archive holds
    df = spark.createDataFrame([(1, "http://a", long), (2, "http://b", long + "x"), (3, "http://c", long)], "page_id long, url string, html string")
    out = warc.write_archives(df, folder=str(tmp_path / "kept"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(out).collect()}
    assert got == {1: (15_000_000, "revisit", 3), 2: (15_000_001, "response", None), 3: (15_000_000, "response", None)}
    assert {r.path for r in out.collect()} == {str(x) for x in (tmp_path / "kept").glob("*.warc.gz")}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_alone_with_odd_and_no_rows(spark, docs, odd, none, stage):
    sf = "/root/testdata/sf0.01"
    rows = odd.unionByName(docs.limit(300).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    out = stage(spark, rows, sf)
    last = stage is corpus_pipeline.encode
    assert out.columns == (["doc_id", "lang", "source", "n_tokens", "ids", "ids_crc32", "decoded", "samples"] if last else rows.columns)
    found = out.collect()
    ids = [r.doc_id for r in found if r.doc_id is None or r.doc_id < 1000]
    assert 0 < len(found) <= rows.count() and set(ids) <= {None, *range(1, 9)}
    if stage is corpus_pipeline.language_id:
        assert not {1, 2, 3, 4} & set(ids)
    if stage is corpus_pipeline.near_dedup:
        assert 7 not in ids and ids.count(6) == 2 and {1, 2, 3, None} <= set(ids)
    if last:
        assert len(found) == rows.count() and {r.doc_id: r.n_tokens for r in found}[1] == 0
    assert stage(spark, none, sf).count() == 0


def brute_kept(rows):
    """One document of each near-duplicate group, the one with the smallest id."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            p, q = sets[a], sets[b]
            both = len(p & q)
            if both and 100 * both >= 75 * (len(p) + len(q) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if top(i) == i}


def test_stages_decide_as_their_parts_do(spark, docs, labels):
    """Each stage keeps what a plain version of its decision keeps, on its own input."""
    sf = "/root/testdata/sf0.01"
    few = docs.limit(400)
    texts = {r.doc_id: r for r in few.collect()}
    model = langid.fit(few.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    names, vocabulary, ranks = model.arrays()
    kept = set()
    for i, r in texts.items():
        gaps = langid.out_of_place(r.text, vocabulary, ranks, model)
        letters = sum(unicodedata.category(c).startswith("L") for c in r.text or "")
        if gaps is not None and gaps.min() <= stages.STRANGE + stages.SHORT / letters:
            kept.add(i)
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, few, sf).collect()} == kept
    view = quality.fit(few, labels)
    score = lambda r: view.scores(quality.text_features(r.text)[None] / 255.0, quality.meta_features(r.text, r.source, r.lang, r.n_chars, view.sources, view.langs)[None] / 255.0)[0]
    assert {r.doc_id for r in corpus_pipeline.quality_classifier(spark, few, sf).collect()} == {i for i, r in texts.items() if score(r) >= 0.5}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, few, sf).collect()} == brute_kept([(i, r.text) for i, r in texts.items()])
    mixed = mixing.mix(few, budget=stages.BUDGET).where("selected")
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, few, sf).collect()} == {r.doc_id for r in mixed.collect()}


def test_pipeline_stages(spark, docs):
    sf = "/root/testdata/sf0.01"
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    good = corpus_pipeline.quality_classifier(spark, kept, sf)
    assert good.columns == docs.columns and 0.7 * docs.count() < good.count() < docs.count()
    one = corpus_pipeline.near_dedup(spark, good, sf)
    assert one.count() == neardup.near_duplicates(good).select("component_id").distinct().count()
    assert neardup.near_duplicates(one).where("not kept").count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert out.where("not decoded").count() == 0 and 0 < out.count() <= one.count()


def test_pipeline_rejects_texts_without_letters(spark, docs, odd):
    rows = odd.select(*docs.columns).unionByName(docs.limit(300).withColumn("doc_id", F.col("doc_id") + 1000))
    out = {r.doc_id: r for r in corpus_pipeline.language_id(spark, rows, "").collect()}
    assert not {1, 2, 3, 4} & set(out) and {6, 7, None} <= set(out)
    assert all(r.lang not in (None, langid.UND) for r in out.values())


def test_pipeline_rejects_gibberish_and_unlearned_languages(spark, docs):
    rng = random.Random(6)
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(120))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    strange = [(-1, letters), (-2, polish)]
    short = [(-3, "the cat and the dog"), (-4, "and then the other one")]
    rows = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in strange + short], docs.schema)
    out = {r.doc_id: r for r in corpus_pipeline.language_id(spark, docs.unionByName(rows), "").collect()}
    assert not {-1, -2} & set(out) and {-3, -4} <= set(out) and len(out) == docs.count() + 2


def test_pipeline_of_nothing(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_driver_gives_freed_memory_back(spark, docs, monkeypatch):
    """Between an operator's tables the driver's memory is collected and trimmed, but not after each of them."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(common, "_released", [time.monotonic()], raising=False)
    monkeypatch.setattr(common, "RELEASE_S", 3600.0, raising=False)
    space, few, before = common.Workspace(spark, "released"), docs.select("doc_id").limit(10), full()
    space.save(few, "one")
    assert full() == before
    monkeypatch.setattr(common, "RELEASE_S", 0.0, raising=False)
    assert space.save(few, "two").count() == 10 and full() > before
    space.keep()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_begin_with_memory_collected(spark, docs, monkeypatch, stage):
    """Before a stage does anything, tasks collect the heaps that the stage before has filled (here the driver's, as it has the tasks)."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(common, "RELEASE_S", 3600.0)
    monkeypatch.setattr(common, "_released", [time.monotonic()])
    before = full()
    assert stage(spark, docs.limit(20), "/root/testdata/sf0.01") is not None and full() > before
