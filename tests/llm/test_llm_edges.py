"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import sys
from os.path import dirname

import pytest

sys.path.insert(0, dirname(__file__))
import llm_cases as cases  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from docshield.llm import (bpe, exact_dedup, html_extract, licences, mixing, periodic, pii, quality, simhash, sketch,  # noqa: E402
                           substring_dedup)
from docshield.llm.catalog import vocabulary  # noqa: E402

REPORTS = {
    "quality": quality.classify,
    "dedup": exact_dedup.assignments,
    "pii": pii.protect,
    "bpe": lambda d: bpe.digests(bpe.encode_and_decode(d, vocabulary())),
    "licences": licences.licences,
    "substring": substring_dedup.deduplicate,
    "simhash": simhash.near_duplicates,
    "sketch": sketch.neighbours,
    "mixing": mixing.mix,
    "periodic": lambda d: periodic.report(periodic.runs(periodic.with_tails(d))),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_per_row(spark, name):
    """Every report has one row per input row, whatever is in it and whatever else it carries."""
    run = REPORTS[name]
    rows = run(cases.odd(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in cases.ODD)
    assert run(cases.empty(spark)).collect() == []
    more = run(cases.clashing(spark)).collect()
    assert sorted(map(str, more)) == sorted(map(str, rows))
    twins = [r for r in rows if r["doc_id"] == 7]
    assert len(twins) == 2 and (name == "sketch" or twins[0] == twins[1])


@pytest.mark.parametrize("k", range(4))
def test_stage_keeps_columns(spark, k):
    """Filtering and mixing stages return the input's columns and only input rows."""
    _, stage = cp.STAGES[k]
    for df in (cases.odd(spark), cases.clashing(spark)):
        out = stage(spark, df, "")
        assert out.columns == df.columns
        given = {str(r) for r in df.collect()}
        assert {str(r) for r in out.collect()} <= given
    assert stage(spark, cases.empty(spark), "").count() == 0


def test_dedup_values(spark):
    rows = exact_dedup.assignments(cases.odd(spark)).collect()
    want = cases.dedup_brute([(r[0], r[1]) for r in cases.ODD])
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in rows)
    assert got == sorted((str(cases.ODD[i][0]), str(k), n) for i, (k, n) in want.items())
    kept = exact_dedup.survivors(cases.odd(spark)).collect()
    assert len(kept) == len({k for k in want.values()})
    # equal length: the smallest id stays; a null id loses
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None and r["text"] and "plain" in r["text"]) == [1]


def test_simhash_values(spark):
    rows = simhash.near_duplicates(cases.odd(spark)).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for d, t, *_ in cases.ODD:
        if d is not None:
            assert by_id[d]["fingerprint"] == format(cases.simhash_brute(t), "016x")
    assert by_id[2]["component_id"] == by_id[3]["component_id"] == by_id[4]["component_id"] == 2
    assert by_id[7]["component_id"] == 1
    assert simhash.representatives(cases.odd(spark)).filter("doc_id = 7").count() == 0


def test_null_sources_and_sizes(spark):
    rows = {r["doc_id"]: r for r in mixing.mix(cases.odd(spark)).collect() if r["doc_id"] is not None}
    assert rows[2]["size"] == rows[3]["size"] == rows[4]["size"] == 0
    assert all(r["taken"] <= 2 * r["size"] for r in rows.values())
    assert rows[3]["source"] is None


def test_pages(spark):
    long = "<article><p>" + "word " * 100_000 + "</p></article>"
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>unclosed <b>text<br>here"), (4, "u", long), (5, "u", "<" * 5000),
             (6, "u", "<article><p>a &amp; b&nbsp;c<script>x</script>\n d</p><div class=ad>Buy now</div></article><footer>f</footer>"),
             (6, "u", "<!-- <article><p>no</p> -->"), (7, "u", '<a href="' + "x" * 20000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = html_extract.extract(df).collect()
    assert len(rows) == len(pages)
    texts = {(r["page_id"], r["n_chars"]): r["text"] for r in rows}
    assert texts[(1, 0)] == texts[(2, 0)] == ""
    assert (4, 499_999) in texts
    assert "a & b c d" in texts.values()
    assert all(len(r["text"]) == r["n_chars"] for r in rows)
    assert html_extract.extract(df.limit(0)).count() == 0
