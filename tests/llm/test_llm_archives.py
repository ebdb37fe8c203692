"""Periodic runs, WARC archives and Merkle proofs against brute force."""

import gzip
import hashlib
import random
import sys
import uuid
import zlib
from collections import defaultdict
from os.path import dirname

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, dirname(__file__))
import llm_cases as cases  # noqa: E402

from docshield.llm import merkle, periodic, warc  # noqa: E402
from docshield.llm.catalog import op11_periodic_runs, op12_warc, op13_merkle  # noqa: E402

SF = "/root/testdata/sf0.001"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- periodic runs -------------------------------------------------------------------------

def runs_brute(words, least=24):
    """Every run by comparing all words at all distances."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            m = j - i + q
            if j > i and m >= max(least, 3 * q):
                found.setdefault((i, m), q)
            i = j + 1
    return sorted(([s, m, q] for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def report_brute(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, n, len(runs), *top, H("".join(f"{s},{m},{q}\n" for s, m, q in runs)), hashlib.sha256(kept).hexdigest())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=40), st.integers(1, 9)), max_size=6))
def test_runs_equal_brute_force(parts):
    words = [w for base, times in parts for w in base * times]
    texts = [" ".join(words).encode(), b"", " ".join(words[::-1]).encode(), " ".join(words).encode()]
    for t, (_, found) in zip(texts, periodic.scan(texts)):
        assert found == runs_brute(t.split())


@pytest.mark.parametrize("period,length", [(1, 24), (8, 24), (9, 27), (15, 45), (16, 48), (31, 95), (257, 771), (2000, 7000)])
def test_run_of_a_period_is_found(period, length):
    around = random.Random(period)
    base = [f"w{i}" for i in range(period)]
    for before in (0, 1, 7, 100):
        words = [f"b{i}" for i in range(before)] + [base[i % period] for i in range(length)] + ["end"]
        assert [f for _, f in periodic.scan([" ".join(words).encode()])] == [[[before, length, period]]]
        short = [f"b{i}" for i in range(before)] + [base[i % period] for i in range(max(24, 3 * period) - 1)]
        assert [f for _, f in periodic.scan([" ".join(short).encode()])] == [[]]
        around.shuffle(base)


def test_transform_is_exact():
    import numpy as np

    for p, root in periodic.PRIMES:
        for size in (2, 16, 256):
            x = np.random.default_rng(size).integers(0, p, (size, 3), dtype=np.uint64)
            back = periodic._backward(periodic._forward(x.copy(), p, root), p, root)
            assert (back * np.uint64(pow(size, p - 2, p)) % np.uint64(p) == x).all()


def test_very_repetitive_texts():
    one = list(periodic.scan([b"w " * 50_000]))
    assert one[0][1] == [[0, 50_000, 1]]
    assert periodic._kept(*one[0]) == [b"w"]
    gap = list(periodic.scan([b"a " * 9000 + b"x " + b"a " * 18000]))
    assert gap[0][1] == [[0, 9000, 1], [9001, 18000, 1]]


def test_periodic_query_is_brute_force(spark):
    got = sorted(map(tuple, op11_periodic_runs(spark, SF).select(
        "doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(report_brute(d, t) for d, t in docs)


# --- archives ------------------------------------------------------------------------------

def page_rows(pages):
    groups = defaultdict(list)
    for p, _, h in pages:
        groups[(h or "").encode()].append(p)
    out = []
    for b, ids in groups.items():
        ids.sort(key=lambda p: (p is None, p or 0))
        for i, p in enumerate(ids):
            again = i > 0 and len(b) >= 100
            out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(map(str, out))


PAGES = [(1, "http://a/x", "<p>" + "é" * 60), (2, None, None), (3, "u v\n", ""), (3, "u v\n", "<p>" + "é" * 60),
         (3, "u", "<p>" + "é" * 60), (None, "u", "<p>" + "é" * 60), (None, None, None), (-4, "", "x" * 99), (5, "", "x" * 99),
         (6, "u", "y" * 100), (7, "u", "y" * 100), (9, "u", "WARC/1.1\r\nContent-Length: 7\r\n\r\nno record\r\n\r\n" * 9),
         (8, "u", "z" * 3_000_000), (10, "u", "\r\n\r\n filedesc://x 0.0.0.0 19970101000000 text/plain 9\n\n")]


def test_pages_through_archives(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    for d in (df, df.selectExpr("*", "'own' AS tag", "'own' AS record_id", "'own' AS content", "'own' AS body", "'own' AS first")):
        rows = warc.convert_pages(d).collect()
        assert sorted(str(tuple(r)[:5]) for r in rows) == page_rows(PAGES)
        assert all(r["intact"] for r in rows)
    assert warc.convert_pages(df.limit(0)).collect() == []


def test_shuffled_groups_are_the_same(spark, monkeypatch):
    """More groups than are broadcast: the salted join gives the same records."""
    monkeypatch.setattr(warc.revisits, "__defaults__", (*warc.revisits.__defaults__[:-1], 0))
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    assert sorted(str(tuple(r)[:5]) for r in warc.convert_pages(df).collect()) == page_rows(PAGES)


def test_warc_query_whole(spark):
    rows = op12_warc(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    assert sorted(str(tuple(r)[:5]) for r in rows) == page_rows(pages)


def arc(version, records, date="20010203040506"):
    out = warc.arc_head(version, "old.arc", date)
    for url, when, mime, block in records:
        out += warc.arc_line(version, url, "10.0.0.1", when, mime, len(block), "old.arc", len(out)) + block + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_versions(spark, version, packed):
    page = b"HTTP/1.1 200 OK\nContent-Type: text/html\n\nhello\n\nworld"
    raw = arc(version, [("http://a/ b", "20020304050607", "text/html", page), ("dns:a", "2002", "text/dns", b"a 1.2.3.4"),
                        ("http://b/", "20029999999999", "text/html", b"")])
    data = gzip.compress(raw[:70]) + gzip.compress(raw[70:]) + b"\0" if packed else raw
    df = spark.createDataFrame([("/x/old.arc", bytearray(data))], "path string, content binary")
    info, first, dns, bad = warc.convert(df).collect()
    assert info["type"] == "warcinfo" and f"version {version}".encode() in bytes(info["block"])
    assert (first["type"], first["uri"], first["date"], first["ip"]) == ("response", "http://a/ b", "2002-03-04T05:06:07Z", "10.0.0.1")
    assert first["payload_bytes"] == 12 and first["payload_sha256"] == hashlib.sha256(b"hello\n\nworld").hexdigest()
    assert (dns["type"], dns["mime"], dns["date"]) == ("resource", "text/dns", "2002-01-01T00:00:00Z")
    assert bad["date"] == "2001-02-03T04:05:06Z"  # no such date: the archive's own
    assert {r["info_id"] for r in (first, dns, bad)} == {info["record_id"]}
    again = warc.convert(df).collect()
    assert [r["record_id"] for r in again] == [r["record_id"] for r in (info, first, dns, bad)]
    assert len({r["record_id"] for r in again}) == 4


def test_broken_archives(spark):
    page = b"HTTP/1.1 200 OK\r\n\r\nbody"
    raw = arc(1, [("http://a/", "20020304050607", "text/html", page)])
    cut = [raw[:-4], raw + b"no header line at all\n" + raw[len(warc.arc_head(1, "old.arc", "20010203040506")):], b"", b"junk", None,
           gzip.compress(raw)[:-30]]
    df = spark.createDataFrame([(f"/x/{i}.arc", bytearray(c) if c is not None else None) for i, c in enumerate(cut)],
                               "path string, content binary")
    rows = warc.convert(df).filter("type = 'response'").collect()
    assert [r["truncated"] for r in rows][:3] == [True, False, False]
    assert [r["skipped"] for r in rows][:3] == [0, 0, 22]


def test_small_members_are_not_copied_again_and_again(monkeypatch):
    texts = [random.Random(i).randbytes(n) for i, n in enumerate([500] * 300 + [0, 70_000, 3_000_000])]
    raw = b"".join(gzip.compress(t) for t in texts)
    fed, real = [], zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self._it = real(bits)

        def decompress(self, data, most):
            fed.append(len(data))
            return self._it.decompress(data, most)

        def __getattr__(self, name):
            return getattr(self._it, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    assert b"".join(warc.Source._inflate(raw)) == b"".join(texts)
    assert sum(fed) < 3 * len(raw)


def test_lines_at_hand_are_not_read_again(monkeypatch):
    rows = [dict(record_id=f"urn:uuid:{i}", type="response", uri="http://a/", date="2001-01-01T00:00:00Z", ip="10.0.0.1", mime=warc.HTTP,
                 info_id="urn:uuid:x", block=b"HTTP/1.0 200 OK\r\n\r\n" + b"z" * i, start=19, payload_sha256="0", truncated=False,
                 first=None) for i in range(200)]
    raw = b"".join(map(warc.warc_record, rows))
    packed = b"".join(warc._member(warc.warc_record(r)) for r in rows)
    asked, real = [], warc.Source._more
    monkeypatch.setattr(warc.Source, "_more", lambda self, n: asked.append(n) or real(self, n))
    for data in (raw, packed):  # a record has 14 lines
        asked.clear()
        assert [block for _, block in warc.warc_records(data)] == [r["block"] for r in rows]
        assert len(asked) < 3 * len(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a\n", b"b", b"\n", b"c" * 5000, b"d" * 4095 + b"\n"]), max_size=8), st.lists(st.integers(-1, 5000), max_size=8))
def test_source_lines_and_bytes(parts, asked):
    whole = b"".join(parts)
    for raw in (whole, b"".join(map(warc._member, parts))):
        src, at = warc.Source(raw), 0
        for n in [*asked, *[-1] * 20]:  # -1: a line
            end = (whole.find(b"\n", at) + 1 or len(whole)) if n < 0 else at + n
            assert (src.line() if n < 0 else src.take(n)) == whole[at:end]
            at = min(end, len(whole))
            assert src.offset == at


def test_record_ids_are_named_uuids():
    for name in ["", "a.arc#0", "é#1", *(f"pages.arc.gz#{i}" for i in range(200))]:
        assert warc.named_id(name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


class _Columns:
    """A batch that counts how often a column is asked for."""

    def __init__(self, batch):
        self.batch, self.schema, self.num_rows, self.asked = batch, batch.schema, batch.num_rows, 0

    def column(self, name):
        self.asked += 1
        return self.batch.column(name)


def test_written_rows_are_taken_by_columns(monkeypatch):
    kept = {}

    class Records:
        def select(self, *cols):
            return self

        def mapInArrow(self, run, ddl):
            kept["run"] = run

    rows = [dict(record_id=f"urn:uuid:{i}", type="response", uri=None, date=warc.NO_DATE, ip=None, mime=warc.HTTP, info_id=None,
                 block=b"HTTP/1.0 200 OK\r\n\r\n" + b"z" * i, start=19, payload_sha256="0", truncated=i == 7,
                 first=dict(record_id="urn:uuid:0", uri="http://a/", date=warc.NO_DATE) if i % 3 else None) for i in range(300)]
    monkeypatch.setattr(warc, "prepare", lambda df: df)
    monkeypatch.setattr(warc, "_sink", lambda blobs, folder: None)
    warc.write(Records(), "")
    batch = _Columns(pa.RecordBatch.from_pylist(rows))
    (out,) = kept["run"](iter([batch]))
    assert out.column(0).to_pylist() == [b"".join(warc._member(warc.warc_record(r)) for r in rows)]
    assert batch.asked < len(rows)


def test_warc_format(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nContent-Length: 120\r\n\r\n" + b"x" * 120
    files = spark.createDataFrame([("/a/1.arc", bytearray(arc(1, [("http://a/", "2001", "text/html", page)]))),
                                   ("/a/2.arc", bytearray(arc(2, [("http://b/", "2002", "text/html", page)])))],
                                  "path string, content binary")
    from pyspark.sql import functions as F
    warc.write(warc.revisits(warc.convert(files), F.col("date").substr(1, 4).cast("long")), str(tmp_path / "out"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == 4 and data.count(b"WARC-Type: revisit\r\n") == 1
    assert b"WARC-Refers-To-Target-URI: http://a/\r\nWARC-Refers-To-Date: 2001-01-01T00:00:00Z\r\n" in data
    assert data.count(b"x" * 120) == 1
    rows = {r["uri"]: r for r in warc.resolved(warc.read(warc.archives(spark, str(tmp_path / "out")))).collect()}
    assert rows["http://b/"]["refers_to_id"] == rows["http://a/"]["record_id"]
    assert rows["http://b/"]["payload_bytes"] == 120 and rows["http://b/"]["payload_sha256"] == H("x" * 120)
    assert all(r["intact"] for r in rows.values())


# --- Merkle proofs -------------------------------------------------------------------------

def tree_brute(digests):
    level, paths, place = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        for i, p in enumerate(place):
            first = p // 16 * 16
            paths[i].append((level[first:p], level[p + 1:first + 16]))
            place[i] = p // 16
        level = [H("".join(level[k:k + 16])) for k in range(0, len(level), 16)]
    return level[0], paths


def manifest_brute(rows):
    """(doc_id, text, lang, source, n_chars) rows -> sorted results."""
    def leaf(d, t, lang, s, n):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t)))

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append(tree_brute([leaf(*r) for r in groups[s]]))
    root, tops = tree_brute([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(names, trees, tops):
        for r, path in zip(groups[s], paths):
            whole = path + top
            h = own = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                t = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                h = leaf(r[0], t, *r[2:])
            for before, after in whole:
                h = H("".join(before) + h + "".join(after))
            out.append((r[0], own, subroot, root, H("".join("".join(b) + "".join(a) for b, a in whole)), h, h == root))
    return sorted(map(str, out))


def check_manifest(df):
    from pyspark.sql import functions as F

    return merkle.verify(df, F.crc32(df["doc_id"].cast("string").cast("binary")) % 5 == 0)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [256, 1, 40], [257] + [3] * 17])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(1000 * k + i, f"Text {i} Of {k}" if i % 7 else None, "en", f"s{k}" if k else None, i)
            for k, n in enumerate(sizes) for i in range(n)]
    got = check_manifest(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == manifest_brute(rows)


def test_salted_ancestors(spark, monkeypatch):
    """Ancestors in several copies give the same proofs."""
    monkeypatch.setattr(merkle, "BLOCK", 20)
    rows = [(i, f"T{i}", "en", "hot" if i % 3 else f"s{i % 5}", i) for i in range(400)]
    got = check_manifest(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == manifest_brute(rows)


def test_manifest_query_and_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = op13_merkle(spark, SF).collect()
    assert sorted(str(tuple(r)) for r in got) == manifest_brute([tuple(r) for r in docs.collect()])
    odd = cases.odd(spark)
    want = manifest_brute(cases.ODD)
    assert sorted(str(tuple(r)) for r in check_manifest(odd).collect()) == want
    more = odd.select("*", *[F.lit("own").alias(c) for c in ("t", "h", "o", "at", "n", "doc", "now", "key", "segs", "kids")])
    assert sorted(str(tuple(r)) for r in check_manifest(more).collect()) == want
    assert check_manifest(odd.limit(0)).collect() == []
