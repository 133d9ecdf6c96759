"""The pipeline: columns and effect of every stage, planted cases, nulls, empty tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledger_spark.llm import catalog
from tests.llm.test_text import plain_schedule

SF = "/root/testdata/sf0.001"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeinorstlh") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    base = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    passage = " ".join(words(12, i) for i in range(6))
    rows = [(10_000 + i, f"{words(40, i)} {words(30, 50 + i)}", "en", "clean", 1) for i in range(5)]
    rows += [(10_100 + i, words(80, 99), "en", "copy", 1) for i in range(3)]
    rows += [(10_200, f"{words(60, 7)} {item} {words(30, 8)}", "en", "leak", 1)]
    rows += [(10_300 + i, f"{words(40, 300 + i)} {passage} {words(40, 400 + i)}", "en", "passage", 1) for i in range(3)]
    rows += [(10_400, None, None, None, None), (10_401, "", None, "empty", 0)]
    base.union(spark.createDataFrame(rows, base.schema)).selectExpr("*", "1 AS score").write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, passage


def test_stages_keep_columns_and_planted_cases(spark, planted, tmp_path):
    folder, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns[:len(names)] == names and {r.doc_id for r in docs.collect()} <= before
    left = {r.doc_id: r for r in docs.collect()}
    assert {10_000, 10_001, 10_002, 10_003, 10_004, 10_100, 10_300, 10_301, 10_302} <= set(left)
    assert not {10_101, 10_102, 10_200} & set(left)
    assert sum(passage in (r.text or "") for r in left.values()) == 1
    assert sorted(r.mix_position for r in left.values()) == list(range(len(left)))


def test_stages_against_plain_versions(spark, planted):
    """Each stage on the given tables, row by row, against its brute-force version."""
    from ledger_spark.llm import decontaminate, mixing, quality
    from tests.llm.test_simhash import brute, plain_fingerprint
    from tests.llm.test_text import plain_dedup

    folder, _ = planted
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}

    def run(name):
        return {r.doc_id: r.text for r in stages[name](spark, docs, folder).collect()}

    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), learnable=quality.may_learn(F.col("doc_id"), 5, 0))
    rows = sorted(text)
    scores = model.scores(np.stack([quality.term_vector(text[k]) for k in rows]))
    assert set(run("quality classifier")) == {k for k, s in zip(rows, scores) if s >= 0.3}

    cut = dict(plain_dedup(sorted(text.items())))
    got = run("line dedup")
    assert set(got) == {k for k in text if cut[k] == text[k] or cut[k].strip()}
    assert all(got[k] == cut[k] for k in got)

    least = dict(brute([(k, plain_fingerprint(t)) for k, t in sorted(text.items())]))
    assert set(run("SimHash near-dedup")) == {k for k in text if least[k] == k}

    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [plain(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = {k for k, t in text.items() if any(i in plain(t or "") for i in items)}
    assert 10_200 in held and set(run("benchmark decontamination")) == set(text) - held
    assert decontaminate.matches(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() >= len(held)

    mixed = stages["mixing sources to target weights"](spark, docs, folder).collect()
    order = sorted(mixed, key=lambda r: r.mix_position)
    assert [r.mix_position for r in order] == list(range(len(text)))
    sizes = {}
    for r in mixed:
        sizes.setdefault(r.source, []).append(r.mix_slot)
    names = sorted(sizes, key=lambda s: (s is None, s))
    units = mixing.units_of({s: Fraction(math.isqrt(len(sizes[s]) * 10 ** 12), 10 ** 6) for s in names})
    plan = plain_schedule(units, {s: -(-len(sizes[s]) // mixing.BLOCK_ROWS) for s in names})
    assert {(r.mix_slot, r.source, r.mix_release, r.mix_deadline) for r in mixed} == {(t, s, r, d) for t, s, _, r, d in plan}


def test_run_and_registration(spark):
    got = corpus_pipeline.run(spark, SF)
    assert 0 < got.count() < 200 and "mix_position" in got.columns
    assert sorted(int(q[2:].split("_")[0]) for q in catalog.SPARK) == list(range(1, 14))


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_workers_need_no_path_to_the_package(tmp_path):
    """A driver elsewhere that only extends its own ``sys.path``."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from ledger_spark.session import get_spark\nimport __spark_entry__ as e\n"
            "s = get_spark(master='local[2]', shuffle_partitions=4)\n"
            f"print('GOT', e.queries()['op8_language_hierarchy'](s, {SF!r}).count(), e.queries()['pipeline'](s, {SF!r}).count() > 0)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert "GOT 200 True" in out.stdout, out.stderr[-2000:]
