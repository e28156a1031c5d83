"""Archive, page text, toxicity and the pipeline."""

import base64
import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline
from barlake.llm import extraction, queries, toxicity, warc
from barlake.llm.html import ARTICLE, CHROME, PLAIN, blocks
from barlake.plans.checks import duck, rows_of
from barlake.session import settle, shared_folder

PAGES = "page_id long, url string, html string, row long, host string, payload string, id string"
HTMLS = [(4, "<p>same</p>"), (2, "<p>same</p>"), (9, "<p>same</p>"), (1, None), (7, ""),
         (3, "ünïcode\r\n\r\nWARC/1.1"), (5, "x" * 300_000), (None, "no id")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([
        (i, None if i == 5 else f"http://h/{i}\r\n", t, 1, "h", "p", "q") for i, t in HTMLS], PAGES)


@pytest.mark.parametrize("least", [0, 12])
def test_archive(spark, pages, least):
    got = {r.page_id: r for r in warc.archived(pages, least).collect()}
    assert len(got) == len(HTMLS)
    for i, t in HTMLS:
        payload = (t or "").encode()
        r = got[i]
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        same = [j for j, u in HTMLS if (u or "") == (t or "") and j is not None]
        first = min(same, default=None)
        revisit = i is not None and i != first and len(payload) >= least
        assert (r.record_type, r.refers_to) == (
            ("revisit", first) if revisit else ("response", None))


def test_archive_keeps_payloads_once_and_finds_damage(spark, pages):
    root = shared_folder(spark, "archive-test")
    archive = warc.Archive(f"{root}/blobs", f"{root}/headers")
    warc.write(pages, archive)
    blobs = spark.read.parquet(archive.blobs)
    assert blobs.count() == len({t or "" for _, t in HTMLS})
    records = {r.id: bytes(r.record) for r in warc.records(spark, archive).collect()}
    assert records[3].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert records[3].endswith("ünïcode\r\n\r\nWARC/1.1\r\n\r\n".encode())
    damaged = warc.Archive(f"{root}/damaged", archive.headers)
    blobs.selectExpr("digest", "concat(payload, X'00') AS payload").write.parquet(damaged.blobs)
    with pytest.raises(Exception, match="damaged blob"):
        warc.records(spark, damaged).collect()
    none = spark.createDataFrame([], PAGES)
    assert warc.archived(none).collect() == []


def test_blocks():
    page = ("<!DOCTYPE html><head><title>t</title><style>a{}</style></head><body>"
            "<header>Site</header><ul class='main-menu'><li>One<li>Two</ul>"
            "<article><header><h1>Title &amp; more</h1></header><p><b>First\n\t para.<br>line<p>Sec"
            "<i>ond</i> &lt;b&gt;&nbsp;x<script>if (a < b) '</p>'</script><aside>side</aside>"
            "<section class='comments'><p>rude</p></section><p>Last</article>"
            "<div id='cookie-notice'>We use</div><p>Loose end<footer>f</footer>")
    assert [t for z, t in blocks(page) if z == ARTICLE] == [
        "Title & more", "First para.", "line", "Second <b> x", "Last"]
    assert [t for z, t in blocks(page) if z == PLAIN] == ["Loose end"]
    assert {"Site", "One", "Two", "side", "rude", "We use", "f"} == {
        t for z, t in blocks(page) if z == CHROME}
    assert blocks(None) == blocks("") == blocks("<p>") == []
    assert blocks("a &am b &amp c <") == [(PLAIN, "a &am b & c <")]
    assert blocks("<div class=shadow>no ad</div><div class='x ad'>y</div>") == [
        (PLAIN, "no ad"), (CHROME, "y")]


@pytest.mark.parametrize("before, after", [
    ("<div class='page with-sidebar'>", "</div>"), ("<div id='content-sidebar-wrap'>", "</div>"),
    ("<div class='has-banner'>", "</div>"), ("<body class='single comments-open'>", "</body>"),
    ("<div class='sidebar'><p>lead</p><div class=ad>buy</div>", "</div>"),
    ("<form id='aspnetForm'>", "</form>"), ("<div id='menu'><div class='banner'>", "</div></div>")])
def test_wrappers_keep_their_article(before, after):
    page = ("<article class='post comments-open'><h2 id='related-work'>Related</h2><section "
            "id='social-history'><p>History</p></section><h3 id='notice'>Notice</h3><div class='ad'>"
            "pay</div><ol class='comment-list'><article class='comment-body'>rude</article></ol>"
            "<p>End</p></article>")
    found = blocks(before + page + after + "<div class='main-menu'>m</div><p>loose</p>")
    assert [t for z, t in found if z == ARTICLE] == ["Related", "History", "Notice", "End"]
    assert [t for z, t in found if z == PLAIN] == ["lead"] * ("lead" in before) + ["loose"]
    assert [t for z, t in found if z == CHROME] == ["buy"] * ("buy" in before) + [
        "pay", "rude", "m"]


def test_page_text(spark):
    rng = random.Random(2)

    def words(n):
        return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))

    banner = "this long banner text stands on every page of the host in full"
    rows, expected = [], {}
    for i in range(12):
        own = words(30)
        rows.append((i, f"https://Plain.example:80/{i}", f"<div>{banner}</div><p>{own}</p><i>{words(3)}",
                     1, "", "", ""))
        expected[i] = own
    for i in range(20, 24):  # an article is whole even where it repeats
        rows.append((i, "https://art.example/x", f"<p>{banner}<article><p>{banner}</p></article>",
                     1, "", "", ""))
        expected[i] = banner
    rows += [(30, None, f"<p>{banner}</p>", 1, "", "", ""), (None, "http://plain.example", None, 1,
                                                           "", "", "")]
    expected |= {30: banner, None: ""}
    got = {r.page_id: r for r in extraction.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    for i, text in expected.items():
        assert got[i].text.startswith(text) and banner not in got[i].text.replace(text, "", 1)
        assert got[i].n_chars == len(got[i].text)
    assert extraction.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_repeats_count_distinct_contents(spark):
    def words(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    html = "page_id long, url string, html string"
    rows = [(i, "http://mirror/?q=%d" % i, f"<div>{words('same', 20)}</div><footer>{i}</footer>")
            for i in range(3)]  # copies of an undeclared page
    rows += [(3, "http://mirror/", f"<p>{words('other', 20)}</p>")]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, html)).collect()}
    assert got == {0: words("same", 20), 1: words("same", 20), 2: words("same", 20),
                   3: words("other", 20)}


def test_articles_lose_what_the_host_inserts(spark):
    advert = "buy our very cheap shoes and hats here today and tomorrow"
    quote = "to be or not to be that is the question of it"
    rows = [(i, f"http://shop/{i}", f"<article><p>own text number {i}</p><div>{advert}</div><p>{quote}</p>"
             f"<div>{advert} with own words {i}</div></article>") for i in range(3)]
    rows += [(3, "http://shop/3", f"<article><p>another one</p></article><footer>{advert}</footer>"),
             (4, "http://other/", f"<article><div>{advert}</div></article>"),
             (5, "http://text/", f"<article>one<p>{advert}</p></article><footer>{advert}</footer>"),
             (6, "http://text/", f"<article>two<p>{advert}</p></article><footer>{advert}</footer>")]
    html = "page_id long, url string, html string"
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, html)).collect()}
    assert got == {**{i: f"own text number {i} {quote} {advert} with own words {i}" for i in range(3)},
                   3: "another one", 4: advert, 5: f"one {advert}", 6: f"two {advert}"}


@pytest.mark.parametrize("n", [1, 3, 40])
def test_suffix_array_is_sorted_and_its_intervals_are_equal_runs(spark, n):
    rng = random.Random(n)
    pages = [(i, f"http://h{i % 2}/", "<p>" + " ".join(rng.choice("abc") * (rng.randrange(9) > 0) or str(i)
              for _ in range(60))) for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        read = extraction.read_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
        rows = sorted(extraction.suffix_array(read, 3).collect(), key=lambda r: r.place)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = [(r.host, r.run) for r in rows]
    assert keys == sorted(keys) and len(rows) == 40 * 58
    first = {}
    for r, key in zip(rows, keys, strict=True):
        assert r.interval == first.setdefault(key, r.place)
    assert len(set(first.values())) == len(first)


def test_intervals_against_plain_search(spark):
    rng = random.Random(4)
    shared = [[f"s{k}-{j}" for j in range(rng.randrange(5, 20))] for k in range(6)]
    pages, streams = [], []
    for i in range(30):
        tokens = []
        for _ in range(4):
            tokens += [f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(6))]
            tokens += rng.choice(shared)
        streams.append((f"h{i % 3}", tokens))
        pages.append((i, f"http://h{i % 3}/", "<p>" + " ".join(tokens)))
    read = extraction.read_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    number = {r.row: r.page_id for r in read.collect()}
    got = {number[r.row]: set(r.gone) for r in extraction.covered(read).collect()}
    holders = defaultdict(set)
    for i, (host, t) in enumerate(streams):
        for k in range(len(t) - 7):
            holders[host, tuple(t[k:k + 8])].add(i)
    for i, (host, t) in enumerate(streams):
        gone = {k + j for k in range(len(t) - 7) if len(holders[host, tuple(t[k:k + 8])]) > 1
                for j in range(8)}
        assert got.get(i, set()) == gone


def test_maximal_segments_against_definition():
    rng = random.Random(6)
    for _ in range(300):
        s = np.array([rng.choice([-3.0, -1.0, -0.5, 1.0, 2.0, 2.5]) for _ in range(
            rng.randrange(0, 25))])

        def recursive(a, b):
            best = None
            for i in range(a, b):
                for j in range(i + 1, b + 1):
                    x = (s[i:j].sum(), -(j - i))
                    if x[0] > 0 and (best is None or x > best[0]):
                        best = (x, i, j)
            if best is None:
                return []
            return recursive(a, best[1]) + [best[1:]] + recursive(best[2], b)

        got = toxicity.maximal_segments(s)
        assert sum(x for *_, x in got) == pytest.approx(sum(s[i:j].sum() for i, j in recursive(
            0, len(s))))
        assert all(x == pytest.approx(s[i:j].sum()) for i, j, x in got)


def toxic_corpus(spark):
    rng = random.Random(8)
    plain = [f"word{k}" for k in range(400)]
    rude = ["vilest", "vilely", "vileness", "grubby"]
    docs, labels = [], []
    for i in range(1200):
        w = rng.choices(plain, k=rng.randrange(20, 200))
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = rng.choices(rude, k=4)
        docs.append((i, " ".join(w), i))
        if i % 3 != 1:
            labels.append((i, int(toxic), 1))
    docs += [(5000, None, 1), (5001, "", 1), (5002, "vilest " * 40_000, 1), (None, "vilest vilely", 1)]
    labels += [(5000, None, 1), (None, 1, 1), (0, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, toxic long"),
            spark.createDataFrame(labels, "doc_id long, toxic int, text long"))


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus(spark)
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == 1204
    got = {r.doc_id: r for r in rows}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(1200))
    right = np.mean([got[i].predicted == (i % 6 == 0) for i in held])
    assert right > 0.97
    assert got[5000].predicted == got[5001].predicted == 0 and got[5002].predicted == 1
    assert all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 5000 in ids and 5002 not in ids and len(ids) < 1040


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = toxic_corpus(spark)
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.scored(docs, flipped).collect()}
    assert a == b


def test_logistic_curve_is_balanced_and_does_not_run_away():
    """Many clean documents that overlap few toxic ones, far out: plain Newton steps diverge here."""
    x = np.concatenate([np.arange(0, 7, 0.05), np.arange(3, 8, 0.05)])
    y = np.concatenate([np.zeros(140), np.ones(100)])
    n = np.concatenate([np.exp(-(np.arange(0, 7, 0.05) - 2) ** 2) * 400 + 1,
                        np.exp(-(np.arange(3, 8, 0.05) - 5) ** 2) * 40])
    a, b = toxicity.logistic(x, y, n)
    assert b > 1 and 3 < -a / b < 4.5
    assert toxicity.logistic(x, y, np.where(y == 1, n * 50, n)) == pytest.approx((a, b), abs=0.05)


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = toxic_corpus(spark)
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), labels).collect() == []


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, sf), "stage")
        if name == "packing":
            assert out.groupBy("doc_id").sum("length").count() == docs.count()
            break
        assert out.columns == columns
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        assert out.where("n_chars <> length(text)").count() == 0
        gone = docs.join(out, "doc_id", "left_anti")
        if name == "toxicity":
            bad = toxicity.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).where(
                "predicted = 1")
            assert {r.doc_id for r in gone.collect()} == {r.doc_id for r in bad.collect()}
        elif name in ("line dedup", "secret scans"):
            assert gone.count() == 0
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "line dedup":
            assert after == {i: t for (i, _), (t, _) in zip(
                before, brute.deduplicated(before), strict=True)}
        elif name == "simhash near-dedup":
            assert set(after) == set(brute.similar_components(before))
        elif name == "secret scans":
            for i, t in before:
                spans = brute.base_spans(t)
                assert (after[i] != t) >= bool(spans)
                assert not any(t[a:b] in after[i] for k, a, b in spans if k != "assign")
        docs = out


def test_pipeline_takes_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), "stage")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert rows_of(got) == rows_of(duck(sf).sql(queries.ORACLES[name]).df())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
