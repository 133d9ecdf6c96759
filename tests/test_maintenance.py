import json
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from ledger_spark.sources import maintenance as MT
from ledger_spark.sources import sinks as SK
from ledger_spark.sources import storage
from ledger_spark.sources import tables as TB
from tests.conftest import tx


def test_seed_is_idempotent(spark):
    seeded = MT.seed_categories(spark)
    again = MT.seed_categories(spark, seeded)
    assert again.count() == 13 and [r.id for r in again.orderBy("id").collect()] == list(range(1, 14))
    assert seeded.where("name = 'rent'").first().is_essential == 1


def test_insert_categories_continues_ids(spark):
    base = MT.seed_categories(spark)
    new = spark.createDataFrame([("zeta",), ("alpha",), ("rent",)], "name string")
    out = MT.insert_categories(base, new).where("id > 13").orderBy("id").collect()
    assert [(r.id, r.name, r.color_hex) for r in out] == [(14, "alpha", "#6B7280"), (15, "zeta", "#6B7280")]


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 3000, 1, 7).select(F.col("id").alias("k"), (F.col("id") % 97).alias("d"))
    out = MT.assign_ids(df, start=10, order_cols=("d", "k"), id_col="nid")
    rows = out.orderBy("nid").collect()
    assert [r.nid for r in rows] == list(range(11, 3011))
    assert [(r.d, r.k) for r in rows] == sorted((r.d, r.k) for r in rows)


def test_validate_reasons(spark):
    df = spark.createDataFrame([(1, None, "A", 5.0), (2, "2024-01-01", "", 3.0), (3, "2024-01-01", "B", -1.0),
                                (3, "2024-01-02", "C", 2.0), (4, "2024-01-02", "D", 2.0)],
                               "id long, date string, description string, amount double") \
        .withColumn("date", F.to_date("date")).withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    good, rej = MT.validate_transactions(df)
    assert [r.id for r in good.collect()] == [4]
    got = {}
    for r in rej.collect():
        got.setdefault(r.id, set()).update(r.reasons)
    assert got[1] == {"date is null"} and got[2] == {"description is empty"}
    assert got[3] == {"amount not positive", "duplicate id"}


def test_rows_are_judged_once(spark, cats):
    """One evaluation of the input; the good rows and the rejects read their own files."""
    seen = spark.sparkContext.accumulator(0)

    def mark(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    base = tx(spark, [(i, "2024-01-01", "A", "1.00" if i % 3 else "-1.00", "rent") for i in range(30)], cats)
    good, rejects = MT.validate_transactions(base.mapInPandas(mark, base.schema).where("id IS NOT NULL").coalesce(1), cats)
    evaluated = seen.value
    assert good.count() == 20 and rejects.count() == 10 and seen.value == evaluated
    plan = rejects._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and re.search(r"PartitionFilters: \[[^]]*_good", plan) and "Join" not in plan


def test_budget_uniqueness(spark):
    b = spark.createDataFrame([(1, 1, "2024-01", 5.0), (2, 1, "2024-01", 6.0), (3, 2, "24-1", 1.0)],
                              "id long, category_id long, month string, budget_amt double")
    good, rej = MT.validate_budgets(b)
    assert good.count() == 0 and rej.count() == 3


def test_seeding_an_empty_table_keeps_the_seed_order(spark):
    empty = MT.seed_categories(spark).limit(0)
    rows = MT.seed_categories(spark, empty).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 14))
    assert [r.name for r in rows][:3] == ["rent", "groceries", "food_drink"] and rows[-1].name == "uncategorized"


def test_null_id_and_unknown_category_are_rejected(spark, cats):
    df = spark.createDataFrame([(None, "2024-01-01", "A", 1.0, 1), (2, "2024-01-01", "B", 1.0, 999)],
                               "id long, date string, description string, amount double, category_id long") \
        .withColumn("date", F.to_date("date")).withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    good, rejects = MT.validate_transactions(df, cats)
    assert good.count() == 0
    assert {tuple(r.reasons) for r in rejects.collect()} == {("id is null",), ("unknown category",)}


def test_equal_keys_are_spread_over_tasks(spark):
    """90 % of the rows share one date and description."""
    df = spark.range(20000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).alias("d"))
    out = MT.assign_ids(df, order_cols=("d",), id_col="nid")
    assert sorted(r.nid for r in out.select("nid").collect()) == list(range(1, 20001))
    sizes = [r["count"] for r in out.groupBy(F.floor((F.col("nid") - 1) / 2500)).count().collect()]
    assert len(sizes) == 8
    tied = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(8, "d", "_tie")
    per_task = [r["count"] for r in tied.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) < 2 * 20000 / 8


def _table(spark, cats, path, n=300):
    rows = [(i, f"2024-{1 + i % 3:02d}-05", f"D{i}", "10.00", "rent") for i in range(1, n + 1)]
    MT.reload_transactions(MT.fill_defaults(tx(spark, rows, cats).repartition(16)), path)


def test_few_files_per_month(spark, cats, tmp_path):
    path = str(tmp_path / "t")
    _table(spark, cats, path)
    leaves = storage.current(spark, path).leaves
    assert len({leaf.split("/")[1] for leaf in leaves}) == len(leaves) == 3
    assert all(len([f for f in os.listdir(f"{path}/{leaf}") if f.endswith(".parquet")]) <= 2 for leaf in leaves)


def test_append_maps_category_names_and_reports_rejects(spark, cats, tmp_path):
    path = str(tmp_path / "t")
    _table(spark, cats, path, 3)
    new = spark.createDataFrame([("cinema", 9.5, " Food  Drink "), ("gym", 30.0, "no such"), ("x", -1.0, "rent"),
                                 ("***", 2.0, "rent")], "description string, amount double, category string")
    good, rejects = MT.check_new_rows(new, cats)
    assert good.count() == 2 and {r.reasons[0] for r in rejects.collect()} == {"amount not positive", "description is empty"}
    written = {r.description: (r.id, r.category_id) for r in MT.append_transactions(spark, path, new, cats).collect()}
    ids = {r.name: r.id for r in cats.collect()}
    assert sorted(i for i, _ in written.values()) == [4, 5]
    assert written["CINEMA"][1] == ids["food_drink"] and written["GYM"][1] == ids["uncategorized"]


def test_an_unreadable_table_stops_the_append(spark, cats, tmp_path):
    """A read error must not look like a first write, which restarts the ids."""
    path = str(tmp_path / "t")
    _table(spark, cats, path, 30)
    with open(f"{path}/{storage.current(spark, path).leaves[0]}/part-broken.parquet", "w") as f:
        f.write("not parquet")
    new = spark.createDataFrame([("a", 1.0)], "description string, amount double")
    with pytest.raises(Exception):
        MT.append_transactions(spark, path, new)


def test_delete_and_predictions_reach_the_store(spark, cats, tmp_path):
    path = str(tmp_path / "t")
    _table(spark, cats, path, 9)
    gone = spark.createDataFrame([(i,) for i in (1, 4, 7, 2)], "id long")  # all of one month and a row of another
    MT.delete_stored(spark, path, gone)
    assert sorted(r.id for r in MT.read_transactions(spark, path).collect()) == [3, 5, 6, 8, 9]
    MT.store_predictions(spark, path, spark.createDataFrame([(3, "rent", 0.9)], "id long, predicted_cat string, confidence double"))
    back = {r.id: (r.predicted_cat, r.confidence and float(r.confidence)) for r in MT.read_transactions(spark, path).collect()}
    assert back == {3: ("rent", 0.9), 5: (None, None), 6: (None, None), 8: (None, None), 9: (None, None)}
    MT.delete_stored(spark, path, spark.range(10))
    assert MT.read_transactions(spark, path).count() == 0
    assert [r.id for r in MT.append_transactions(
        spark, path, spark.createDataFrame([("a", 1.0)], "description string, amount double")).collect()] == [1]


def test_reload_switches_versions(spark, cats, tmp_path):
    path = str(tmp_path / "t")
    _table(spark, cats, path, 6)
    before, old = MT.read_transactions(spark, path), storage.current(spark, path).leaves
    _table(spark, cats, path, 3)
    assert not {*storage.current(spark, path).leaves} & {*old}
    assert before.count() == 6 and MT.read_transactions(spark, path).count() == 3  # a reader keeps its version
    MT.reload_transactions(MT.fill_defaults(before.limit(0)), path)
    assert MT.read_transactions(spark, path).count() == 0 and not any(os.path.exists(f"{path}/{leaf}") for leaf in old)


def test_a_write_that_fails_midway_changes_nothing(spark, cats, tmp_path, monkeypatch):
    """A crash after the files are written and before the commit: readers see the old rows only."""
    path = str(tmp_path / "t")
    _table(spark, cats, path, 9)

    def crash(*_):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as m:
        m.setattr(storage, "commit", crash)
        for change in (lambda: MT.delete_stored(spark, path, spark.range(5)),
                       lambda: MT.append_transactions(spark, path, spark.createDataFrame([("a", 1.0)], "description string, amount double")),
                       lambda: _table(spark, cats, path, 3)):
            with pytest.raises(RuntimeError, match="lost the driver"):
                change()
    assert sorted(r.id for r in MT.read_transactions(spark, path).collect()) == list(range(1, 10))
    MT.delete_stored(spark, path, spark.range(5))
    assert sorted(r.id for r in MT.read_transactions(spark, path).collect()) == [5, 6, 7, 8, 9]


def test_two_writers_at_once_both_count(spark, cats, tmp_path, monkeypatch):
    """The slower one finds its state taken, begins again and takes later ids."""
    path = str(tmp_path / "t")
    _table(spark, cats, path, 3)
    row = lambda d: spark.createDataFrame([(d, 1.0)], "description string, amount double")
    commit, others = storage.commit, []

    def overtaken(*args):
        if not others:
            others.append(True)
            others.append([r.id for r in MT.append_transactions(spark, path, row("fast")).collect()])
        return commit(*args)

    with monkeypatch.context() as m:
        m.setattr(storage, "commit", overtaken)
        slow = [r.id for r in MT.append_transactions(spark, path, row("slow")).collect()]
    assert others[1] == [4] and slow == [5]
    assert sorted((r.id, r.description) for r in MT.read_transactions(spark, path).where("id > 3").collect()) == [(4, "FAST"), (5, "SLOW")]
    stored = {leaf.split("/")[0] for leaf in storage.current(spark, path).leaves}
    assert {f for f in os.listdir(path) if f.startswith("v=")} == stored  # nothing is left of the failed attempt


def test_an_append_that_is_tried_again_counts_once(spark, cats, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    _table(spark, cats, path, 3)
    new = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("bad", -1.0)], "description string, amount double")
    commit = storage.commit

    def committed_then_lost(*args):
        commit(*args)
        raise RuntimeError("lost after the commit")

    with monkeypatch.context() as m:
        m.setattr(storage, "commit", committed_then_lost)
        with pytest.raises(RuntimeError):
            MT.append_transactions(spark, path, new, token="batch-7")
    again = MT.append_transactions(spark, path, new, token="batch-7")
    assert sorted((r.id, r.description) for r in again.collect()) == [(4, "A"), (5, "B")]
    assert MT.read_transactions(spark, path).count() == 5
    MT.append_transactions(spark, path, new, token="batch-8")
    assert MT.read_transactions(spark, path).count() == 7
    MT.append_transactions(spark, path, new.limit(0), token="none")
    assert MT.append_transactions(spark, path, new, token="none").count() == 0


def test_finding_ids_reads_their_buckets_only(spark, cats, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"2024-{1 + i % 3:02d}-05", f"D{i}", "10.00", "rent") for i in range(1, 601)]
    MT.reload_transactions(tx(spark, rows, cats), path, buckets=8)
    state = storage.current(spark, path)
    assert state.buckets == 8 and len(state.leaves) == 24
    ids = spark.createDataFrame([(17,), (400,)], "id long")
    found = storage.in_buckets(spark, path, state, ids)
    wanted = {r[0] for r in ids.select(storage.bucket(F.col("id"), 8)).collect()}
    assert len(found.inputFiles()) == 3 * len(wanted) < 24
    assert re.search(r"PartitionFilters: \[[^]]*bucket", found._jdf.queryExecution().executedPlan().toString())
    before = set(state.leaves)
    MT.delete_stored(spark, path, ids)
    after = storage.current(spark, path)
    assert len(before - set(after.leaves)) == 2 and after.buckets == 8  # only the two leaves that held them
    assert MT.read_transactions(spark, path).count() == 598


def test_many_small_appends_are_merged(spark, cats, tmp_path):
    path = str(tmp_path / "t")
    _table(spark, cats, path, 3)
    state = storage.current(spark, path)
    new = storage.write(storage.read(spark, path, state).drop("v").withColumn("id", F.col("id") + 10), path)
    storage.commit(spark, path, state, storage.replace(state, leaves=state.leaves + new))
    storage.compact(spark, path, most=1)
    assert len(storage.current(spark, path).leaves) == 3
    assert sorted(r.id for r in MT.read_transactions(spark, path).collect()) == [1, 2, 3, 11, 12, 13]


def test_reload_append_delete(spark, cats):
    path = tempfile.mkdtemp(prefix="ledger-t-")
    t = MT.fill_defaults(MT.assign_ids(tx(spark, [(0, "2024-01-05", "A", "10.00", "rent"),
                                                 (0, "2024-02-05", "B", "20.00", "rent")], cats).drop("id"),
                                       order_cols=("date",)))
    MT.reload_transactions(t, path)
    MT.reload_transactions(t, path)  # twice = once
    stored = MT.read_transactions(spark, path)
    assert stored.count() == 2 and sorted(r.id for r in stored.collect()) == [1, 2]
    new = spark.createDataFrame([("netflix", 9.99), ("", 5.0), ("gym", -2.0)], "description string, amount double")
    written = MT.append_transactions(spark, path, new)
    assert [(r.id, r.description) for r in written.collect()] == [(3, "NETFLIX")]
    after = MT.read_transactions(spark, path)
    assert after.count() == 3
    back = MT.delete_transactions(after, written.select("id"))
    assert sorted(r.id for r in back.collect()) == [1, 2]


def test_csv_and_json_sinks(spark):
    out = tempfile.mkdtemp(prefix="ledger-s-")
    df = spark.createDataFrame([("\tA *", "1.00")], "description string, amount string")
    SK.write_csv(df, out + "/csv")
    back = spark.read.option("header", True).csv(out + "/csv").first()
    assert back.description == "\tA *"
    cmp = spark.createDataFrame([("k", 50.0), ("lr", 90.0)], "attempt string, accuracy double")
    pc = spark.createDataFrame([("a", 1.0, 0.5, 0.66)], "class string, precision double, recall double, f1 double")
    acc = spark.createDataFrame([(0.9,)], "accuracy double")
    SK.write_summary_json(SK.summary_document(cmp, pc, "Logistic Regression", acc), out + "/json")
    files = [f for f in os.listdir(out + "/json") if f.endswith(".json")]
    doc = json.loads(open(os.path.join(out, "json", files[0])).readline())
    assert doc["best_model"] == "Logistic Regression" and len(doc["model_comparison"]) == 2
    assert doc["per_class"][0]["Recall"] == 0.5


def test_csv_reader_all_text(spark):
    out = tempfile.mkdtemp(prefix="ledger-c-")
    with open(out + "/f.csv", "w") as fh:
        fh.write("date,description,amount,category\n2024-01-01,A,NA,rent\n2024-01-02,B,3.5,\n")
    rows = TB.read_transactions_csv(spark, out).collect()
    assert rows[0].amount is None and rows[1].category is None and rows[1].amount == "3.5"


def test_insert_categories_dedups(spark):
    base = MT.seed_categories(spark)
    new = spark.createDataFrame([("zz",), ("zz",), (None,)], "name string")
    assert MT.insert_categories(base, new).count() == 14


def test_bounds_on_date_and_amount_skip_pages(spark, cats, tmp_path, monkeypatch):
    """A leaf's rows lie by size of amount, then date: statistics leave out what a bound excludes."""
    path = str(tmp_path / "t")
    monkeypatch.setattr(storage, "ROW_GROUP", 64 << 10)
    t = spark.range(60_000, numPartitions=4).select(
        "id", F.expr("date_add(DATE '2024-01-01', CAST(pmod(xxhash64(id), 31) AS INT))").alias("date"), F.lit("D").alias("description"),
        F.expr("CAST(pow(2, 1 + pmod(xxhash64(id, 7), 12)) AS DECIMAL(12,2))").alias("amount"), F.lit(1).cast("long").alias("category_id"))
    MT.reload_transactions(t, path)

    def scanned(rows):
        n = rows.count()
        df = rows.select("id")
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return n, leaf.metrics().apply("numOutputRows").value()

    stored = MT.read_transactions(spark, path)
    for bound in (F.col("amount") > 3000, F.col("date") == F.lit("2024-01-09").cast("date")):
        wanted, read = scanned(stored.where(bound))
        assert 0 < wanted <= read < 30_000
