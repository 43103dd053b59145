"""Hard negatives, periodic runs and archives against plain versions."""

import base64
import gzip
import hashlib
import io
import random
from collections import Counter

import brute
import numpy as np
import pytest

from quillspan.llm import ann, archives, negatives, periodic, queries
from quillspan.session import ship


# Hard negatives -----------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<double>, score int, anchor_id string, v int, place int, na int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, 2, 3) for r in rows], VECTORS)


def mined(df):
    from pyspark.sql import functions as F

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, label).collect()
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def test_strassen_is_the_product():
    rng = np.random.default_rng(4)
    for shape in ((1, 1, 1), (3, 5, 7), (40, 33, 65), (64, 64, 64), (17, 200, 130), (0, 4, 4), (50, 0, 50)):
        m, k, n = shape
        for top in (300, 1 << 29):  # beyond what a double adds exactly
            a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
            assert (negatives.strassen(a, b, 4) == a @ b).all() and (negatives.strassen(a, b) == a @ b).all()


@pytest.mark.parametrize("blocks", [(8_192, 16_384), (2, 7)])
def test_negatives_against_brute_force(spark, monkeypatch, blocks):
    ship(spark)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", blocks[0])
    monkeypatch.setattr(negatives, "TILE_ROWS", blocks[1])
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.choice([0.0, 0.25, 0.3, 0.5, -0.1]) for _ in range(6)]) for i in range(0, 420, 1)]
    rows += [(i, 1, [0.5] * 6) for i in range(1000, 1040)]  # ties
    assert mined(vectors(spark, rows)) == Counter(brute.negatives(rows)) != Counter()


def test_negatives_odd_rows(spark):
    ship(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(100, 1, [1.0, 0.5]), (100, 2, [9.0, 9.0]), (1, 1, [1.0, 0.5, 0.0]), (1, 1, [1.0, 0.5, 0.0]), (2, 2, [1.0]), (3, 2, []), (4, 2, [0.9, 0.5]), (4, 2, [0.9, 0.5]), (None, 1, [5.0, 5.0])]
    rows += [(5, None, [1.0, 1.0]), (6, 1, None), (8, 1, [nan, 1.0]), (9, 1, [1.0, inf]), (10, 1, [None, 1.0]), (200, 5, [1.0, 1.0]), (300, 1, [-1.0, -1.0])]
    assert mined(vectors(spark, rows)) == Counter(brute.negatives(rows)) != Counter()
    assert not mined(vectors(spark, rows).limit(0)) and not mined(vectors(spark, [(1, 1, [1.0])]))
    with pytest.raises(ArithmeticError):
        mined(vectors(spark, [(100, 1, [1e30]), (1, 1, [1.0])]))


def test_negatives_query(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op11_negatives(spark, sf).collect()
    assert Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == Counter(brute.negatives(rows))


# Runs ---------------------------------------------------------------------------------------------------------------


def sequences(rng):
    """Texts with runs in runs, runs with a word changed, words of few letters, and none."""
    n = rng.randrange(400)
    few = [rng.randrange(rng.choice([2, 3, 60])) for _ in range(rng.randrange(1, max(2, n // 2)))]
    yield [few[i % len(few)] for i in range(n)]
    broken = [few[i % len(few)] for i in range(n)]
    for i in range(0, n, rng.randrange(30, 200)):
        broken[i] = 99
    yield broken
    inner = [1] * rng.randrange(1, 60) + [2, 3][: rng.randrange(3)]
    yield ([7] * rng.randrange(3) + (inner * rng.randrange(1, 5) + [rng.randrange(5) for _ in range(rng.randrange(8))]) * 6)[:500]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    yield b
    yield [rng.randrange(2) for _ in range(n)]


def test_runs_against_brute_force():
    rng, seen = random.Random(6), 0
    for _ in range(120):
        for words in sequences(rng):
            got = [r for r in periodic.runs(np.array(words, np.int64)) if r[1] - r[0] >= 24]
            assert got == brute.runs(words)
            seen += len(got)
    assert seen > 500


def test_runs_of_every_period():
    for q in range(1, 140):
        for size in (3 * q, 3 * q + 1, 4 * q - 1):
            words = [-1, -2, *[i % q for i in range(size)], -3, -4, -5]
            assert (2, 2 + size, q) in periodic.runs(np.array(words)), (q, size)


def test_texts_searched_together_or_alone():
    rng = random.Random(7)
    texts = [[b"%d" % w for w in words] for _ in range(20) for words in sequences(rng)] + [[], [b"x"]]
    assert periodic._searched(texts) == [periodic._searched([t])[0] for t in texts]


def test_synchronising_places_are_dense_and_consistent():
    rng = np.random.default_rng(2)
    words, t = rng.integers(0, 4, 3000), 8
    words[1000:1100] = 1  # windows in there are highly periodic
    words[2000:2100] = words[100:200]
    level, size = periodic._mix(words.astype(np.uint64) + np.uint64(1), np.uint64(0)), 1
    while size < t:
        level, size = periodic._mix(level[:-size], level[size:]), 2 * size
    periodic_at = np.array([any((words[i : i + t - q] == words[i + q : i + t]).all() for q in range(1, t // 3 + 1)) for i in range(len(level))])
    places = periodic.synchronising(level, periodic_at, t)
    inside = places[(places >= 100) & (places + 2 * t <= 200)]
    assert set(inside + 1900) == set(places[(places >= 2000) & (places + 2 * t <= 2100)])
    for i in range(len(words) - 3 * t + 1):
        whole = any((words[i : i + 3 * t - 1 - q] == words[i + q : i + 3 * t - 1]).all() for q in range(1, t // 3 + 1))
        assert whole or ((places >= i) & (places < i + t)).any()


def test_periodic_query_and_odd_rows(spark, sf, monkeypatch):
    ship(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op12_periodic(spark, sf).collect())
    assert got == Counter(brute.periodic(r.doc_id, r.text) for r in docs.collect())
    assert sum(1 for r in got if r[1])
    odd = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b " * 40), (4, "a b " * 40), (None, "é\x1c\x85\u2003 x " * 30), (5, "w " * 30_000), (6, " ".join(map(str, range(9000))) + " tail"), (7, "a " * 23), (8, "a " * 24)]
    table = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS n_runs", "2 AS start", "'x' AS period")
    monkeypatch.setattr(periodic, "WORDS", 50)
    assert Counter(tuple(r) for r in periodic.find(table, plant=True).collect()) == Counter(brute.periodic(i, t) for i, t in odd)
    assert periodic.find(table.limit(0)).count() == 0


# Archives -----------------------------------------------------------------------------------------------------------


def read(data, of):
    return list(of(io.BytesIO(data)))


def test_arc_header_lines_of_both_versions():
    one = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 77\n1 0 Old Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    one = one.replace(b" 77\n", b" %d\n" % (len(one) - one.index(b"\n") - 1), 1) + b"\n"
    body = b"HTTP/1.0 200 OK\nX: y\n\nbody\n\nmore"
    records = read(one + b"http://a.b/x y 1.2.3.4 199701 text/html %d\n" % len(body) + body + b"\n" + b"dns:a.b 1.2.3.4 19970102 text/dns 4\nabcd\n", archives.arc_records)
    assert [r[0]["URL"] for r in records] == ["filedesc://a.arc", "http://a.b/x y", "dns:a.b"] and records[0][0]["version"] == "1"
    assert records[1][1] == body and archives.http_payload(body) == (b"HTTP/1.0 200 OK\nX: y\n\n", b"body\n\nmore") and not any(r[2] for r in records)
    two = archives.arc_head("b.arc", 2, "20010203040506") + b"http://c/ 9.9.9.9 20010203040506 text/html 200 - - 120 b.arc 10\nabc"
    records = read(two, archives.arc_records)
    assert records[0][0]["version"] == "2" and records[1][0]["Result-code"] == "200" and records[1][1:] == (b"abc", True)
    with pytest.raises(ValueError):
        read(b"not a header\n", archives.arc_records)


@pytest.mark.parametrize("digits, date", [("20010203040506", "2001-02-03T04:05:06Z"), ("200102030405", "2001-02-03T04:05:00Z"), ("1997", "1997-01-01T00:00:00Z"), ("19970000000000", "1997-01-01T00:00:00Z"), ("-", "1970-01-01T00:00:00Z"), ("00000000000000", "1970-01-01T00:00:00Z")])
def test_arc_dates(digits, date):
    assert archives.iso(digits) == date


def test_warc_records_of_all_types():
    info = archives.warc_record("x.arc.gz", 0, {"URL": "filedesc://x", "Archive-date": "20010101000000", "version": "2"}, b"2 0 y\n", False, None)
    page = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody"
    fields = {"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html"}
    held = {"file": "y.arc.gz", "n": 3, "url": "http://b/", "date": "2000-01-01T00:00:00Z", "page_id": 9}
    whole, again, cut_off = (archives.warc_record("x.arc.gz", n, fields, page, n == 3, held if n == 2 else None) for n in (1, 2, 3))
    other = archives.warc_record("x.arc.gz", 4, {"URL": "dns:a", "Archive-date": "1999", "Content-type": "text/dns"}, b"1.2.3.4", False, None)
    records = read(info + whole + again + cut_off + other, archives.warc_records)
    assert [h["warc-type"] for h, _ in records] == ["warcinfo", "response", "revisit", "response", "resource"]
    assert [len(b) for _, b in records][1:] == [len(page), len(page) - 4, len(page), 7]
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    assert records[1][0]["warc-payload-digest"] == records[2][0]["warc-payload-digest"] == digest
    assert records[2][0]["warc-refers-to"] == archives.record_id("y.arc.gz", 3) and records[2][0]["warc-refers-to-target-uri"] == "http://b/"
    assert "warc-truncated" in records[3][0] and records[4][0]["content-type"] == "text/dns" and records[1][0]["warc-date"] == "2001-02-03T04:05:06Z"
    assert len({h["warc-record-id"] for h, _ in records}) == 5
    with pytest.raises(ValueError):
        read(whole[:-9], archives.warc_records)


PAGES = [
    (1, "http://a/", "same"), (2, "http://b/ x\ny", "same"), (3, None, "same"), (4, "", None), (5, "http://é/", ""), (6, "x", "é\r\n\r\n😀\x00 WARC/1.1"), (7, "filedesc://x", "own"),
    (8, "http://long/", "y" * 300_000), (9, "dns:z", "same"), (9, "dns:z", "same"), (None, "u", "no id"), (None, "u", "no id"), (None, "v", "same"),
]


def digest_of(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 1, 5])
def test_archive_of_odd_pages(spark, monkeypatch, least):
    ship(spark)
    monkeypatch.setattr(archives, "FILE_RECORDS", 3)
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS file", "3 AS n", "4 AS held")
    want, left = Counter(), Counter(h or "" for *_, h in PAGES)
    for page, _, html in sorted(PAGES, key=lambda r: -1 if r[0] is None else r[0]):
        text = html or ""
        left[text] -= 1
        top = max((p for p, _, h in PAGES if (h or "") == text and p is not None), default=None)
        repeats = left[text] and len(text.encode()) >= least
        want[page, len(text.encode()), digest_of(html), "revisit" if repeats else "response", top if repeats else None] += 1
    got = archives.archive(table, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == want
    assert archives.archive(table.limit(0)).count() == 0


def test_archives_stay_where_asked(spark, tmp_path):
    ship(spark)
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    rows = archives.archive(table, folder=f"file:{tmp_path}/kept").collect()
    arcs, warcs = list((tmp_path / "kept").glob("*.arc.gz")), list((tmp_path / "kept").glob("*.warc.gz"))
    assert len(arcs) == len(warcs) > 1 and len(rows) == len(PAGES)
    heads = Counter(read(gzip.decompress(p.read_bytes()), archives.arc_records)[0][0]["version"] for p in arcs)
    assert set(heads) == {"1", "2"}
    targets = [h.get("warc-target-uri") for p in warcs for h, _ in read(gzip.decompress(p.read_bytes()), archives.warc_records) if h["warc-type"] != "warcinfo"]
    assert Counter(targets) == Counter(None if not u else archives.arc_url(u) for _, u, _ in PAGES)


# Nearest neighbours -------------------------------------------------------------------------------------------------


def test_small_tables_are_searched_by_lists_too(spark):
    """500 and 2,000 rows: no row is scored but for the lists that are opened, and recall holds."""
    from pyspark.sql import functions as F

    for folder, rows in (("sf0.001", 500), ("sf0.1", 2_000)):
        vectors = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
        asked = F.col("vec_id") % 20 == 0
        assert vectors.count() == rows and ann.recall(ann.search(vectors, asked), vectors, asked) >= 0.9


def test_lists_are_probed_on_small_tables():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation = ann.learn_rotations(x)
    index, sets, numbers = ann.Index(ann.encode(x @ rotation)), ann.flip_order(), x @ rotation
    found = [len(index.within(code, y, sets)[0]) for code, y in zip(ann.encode(numbers[:40]), numbers[:40])]
    assert max(found) < 500
