"""The pipeline against plain Python forms of its stages, each on its own input."""

import hashlib
import re
import sys
from collections import Counter, defaultdict
from os.path import dirname

import pytest

sys.path.insert(0, dirname(__file__))
import llm_cases as cases  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from docshield.llm import quality  # noqa: E402
from docshield.llm.catalog import QUERIES, vocabulary  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, stage in cp.STAGES:
        folder = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs.collect())
    return out


def _key(rows):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in rows)


def test_quality_stage(spark, sf, stages):
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert _key(stages[1]) == _key(r for r in stages[0] if model.score(r["text"]) >= quality.THRESHOLD)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    good = [d for d, q in labels.items() if q == 1]
    assert len(kept.intersection(good)) >= 0.98 * len(good)


def test_exact_stage(stages):
    want = cases.dedup_brute([(r["doc_id"], r["text"]) for r in stages[1]])
    keep = {k for k, _ in want.values()}
    assert _key(stages[2]) == _key(r for r in stages[1] if r["doc_id"] in keep)


def test_near_stage(stages):
    fp = {r["doc_id"]: cases.simhash_brute(r["text"]) for r in stages[2]}
    comp = cases.components_brute(fp.values())
    first = defaultdict(list)
    for d, v in fp.items():
        first[comp[v]].append(d)
    keep = {min(x) for x in first.values()}
    assert _key(stages[3]) == _key(r for r in stages[2] if r["doc_id"] in keep)


def test_mix_stage(stages):
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in stages[3]}
    total, taken, largest = Counter(), Counter(), Counter()
    for r in stages[3]:
        total[r["source"]] += size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    for r in stages[4]:
        taken[r["source"]] += size[r["doc_id"]]
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 2
    for s, target in cases.targets_brute(total).items():
        assert abs(taken[s] - target) <= 0.5 * largest[s] + 1
    given = {(r["doc_id"], r["text"]) for r in stages[3]}
    assert {(r["doc_id"], r["text"]) for r in stages[4]} <= given


def test_token_stage(stages):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(vocabulary())
    want = []
    for r in stages[4]:
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, stages[5])) == sorted(want)


def test_run_is_its_stages(spark, sf, stages):
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, stages[5]))


@pytest.mark.parametrize("make", ["odd", "empty", "clashing"])
def test_run_on_odd_tables(spark, tmp_path, make):
    """Nulls, empty and very long texts, repeated rows, clashing names and no rows at all."""
    df = getattr(cases, make)(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in cases.ODD}
    assert max(Counter(r["doc_id"] for r in rows).values(), default=0) <= 2
    assert bool(rows) == (make != "empty")


def test_registered(spark, sf):
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
