"""Plan properties that matter at scale."""
import pytest

from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_month_filter_is_pushed_to_the_scan(spark):
    from ledger_spark.plans import catalog as C

    p = plan(C.kpi_total_avg(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p or \
        "GreaterThanOrEqual(o_orderdate" in p


def test_orders_only_reports_do_not_read_customer(spark):
    from ledger_spark.plans import catalog as C

    p = plan(C.q01_monthly_summary(spark, SF_SMALL))
    assert "customer" not in p and "ReadSchema: struct<o_totalprice:double,o_orderdate" in p


@pytest.mark.parametrize("name", ["q02_by_category", "q04_top_expenses", "q05_recurring", "kpi_avg_delta",
                                  "holt_forecast_by_category", "loess_by_category", "gaussian_nb_predictions",
                                  "stratified_split", "category_totals_all", "document_terms"])
def test_no_python_udf_no_cartesian(spark, name):
    import __spark_entry__ as E

    p = plan(E.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad}"


def test_top_n_is_take_ordered(spark):
    from ledger_spark.plans import catalog as C

    p = plan(C.q04_top_expenses(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


@pytest.mark.parametrize("name", ["q01_monthly_summary", "q02_by_category", "q05_recurring", "token_counts",
                                  "stream_monthly_kpis"])
def test_partial_aggregation_before_shuffle(spark, name):
    """A hot key is combined inside each task: every aggregate over fact rows
    has a partial stage below its exchange."""
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    if "HashAggregate" in p:
        assert "partial_" in p, name


def test_hot_key_aggregate_is_exact(spark):
    """One description holding a third of all rows still aggregates exactly."""
    from pyspark.sql import functions as F

    from ledger_spark.operators.reports import recurring

    n = 30000
    t = spark.range(n).select(
        F.col("id"), F.expr("date_add(DATE '2024-01-01', CAST(id % 90 AS INT))").alias("date"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("D"), (F.col("id") % 500).cast("string")))
        .alias("description"), F.lit(1).cast("decimal(12,2)").alias("amount"))
    hot = recurring(t).where("description = 'HOT'").first()
    assert hot.total_paid == n // 3 and hot.months_seen == 3


def test_split_reads_the_texts_once(spark):
    from ledger_spark.operators.features import stratified_split
    from ledger_spark.sources.tables import labelled_documents

    p = plan(stratified_split(labelled_documents(spark, SF_SMALL)))
    assert p.count("text:string") == 1


def test_queries_follow_the_files(spark, tmp_path):
    """Nothing fitted or read is kept between calls."""
    import os
    import shutil

    import __spark_entry__ as E

    d = str(tmp_path / "sf")
    os.mkdir(d)  # a copied folder would keep the mode of one that may be read only
    for name in os.listdir(SF_SMALL):
        shutil.copyfile(f"{SF_SMALL}/{name}", f"{d}/{name}")
    names = ["vocabulary", "categories_fixture", "bernoulli_nb_predictions"]
    before = {n: E.queries()[n](spark, d).collect() for n in names}
    docs, customers = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "customer"))
    docs.selectExpr("doc_id", "concat('zzz zzz ', text) AS text", "if(doc_id % 2 = 0, 'xx', 'yy') AS lang", "source",
                    "n_chars").write.mode("overwrite").parquet(f"{d}/new")
    customers.selectExpr("*").withColumn("c_mktsegment", customers.c_mktsegment.substr(1, 3)).write.parquet(f"{d}/newc")
    os.remove(f"{d}/documents.parquet")
    os.remove(f"{d}/customer.parquet")
    os.rename(f"{d}/new", f"{d}/documents.parquet")
    os.rename(f"{d}/newc", f"{d}/customer.parquet")
    after = {n: E.queries()[n](spark, d).collect() for n in names}
    assert all(before[n] != after[n] for n in names)
    assert "zzz" in {r.word for r in after["vocabulary"]}


@pytest.mark.parametrize("name", ["llm", "llm and pipeline"])
def test_the_library_does_without_the_optional_parts(tmp_path, name):
    """The entry module imports, and its queries are there, without ``llm``."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    ignore = shutil.ignore_patterns(".git", "tests", "__pycache__", "llm", *(["corpus_pipeline.py"] if "pipeline" in name else []))
    shutil.copytree(root, copy, ignore=ignore)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(x.startswith('op') for x in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert out.returncode == 0, out.stderr
    n, pipeline, ops = out.stdout.split()
    assert int(n) > 60 and pipeline == "False" and ops == "False"


def test_a_submitted_session_keeps_its_settings(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("from ledger_spark.session import get_spark\ns = get_spark()\n"
            "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.session.timeZone'), s.sparkContext.appName, "
            "s.conf.get('spark.sql.adaptive.enabled'))")
    env = {**os.environ, "PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS":
           "--master local[2] --name mine --conf spark.ui.enabled=false --conf spark.sql.session.timeZone=Asia/Tokyo pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    got = [x for x in out.stdout.splitlines() if x.startswith("GOT")]
    assert got and got[0].split()[1:3] == ["local[2]", "Asia/Tokyo"], out.stderr[-2000:]


def test_a_cluster_without_checkpoint_folder_is_an_error():
    from types import SimpleNamespace

    from ledger_spark.session import checkpoint_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc))
