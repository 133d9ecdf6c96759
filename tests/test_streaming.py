import datetime
import decimal
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from ledger_spark.sources import storage
from ledger_spark.streaming import live as LV


def _write_slices(spark, root, slices, schema):
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/in/s={i:03d}")


def test_change_log_last_op_wins_across_batches(spark):
    root = tempfile.mkdtemp(prefix="ledger-cl-")
    schema = "id long, date date, amount double, seq long, op string"
    d = F.to_date
    import datetime as dt
    j1, f1 = dt.date(2024, 1, 5), dt.date(2024, 2, 5)
    slices = [[(1, j1, 10.0, 1, "insert"), (2, j1, 20.0, 2, "insert"), (3, f1, 30.0, 3, "insert")],
              [(2, j1, 21.0, 5, "update"), (2, j1, 0.0, 4, "delete"), (3, f1, 0.0, 6, "delete")],
              [(4, f1, 40.0, 7, "insert"), (1, j1, 0.0, 8, "delete")]]
    _write_slices(spark, root, slices, schema)
    del d
    cs = LV.read_stream(spark, f"{root}/in/*", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    LV.drain(LV.stream_change_log(cs, f"{root}/table"))
    got = {r.id: r.amount for r in LV.read_changes(spark, f"{root}/table").collect()}
    assert got == {2: 21.0, 4: 40.0}


SCHEMA = "id long, date date, amount double, seq long, op string"
JAN, FEB = datetime.date(2024, 1, 5), datetime.date(2024, 2, 5)


def _apply(spark, table, rows, schema=SCHEMA):
    LV.apply_changes(spark, spark.createDataFrame(rows, schema), table)


def _live(spark, table):
    return sorted((r.id, r.date, r.amount) for r in LV.read_changes(spark, table).collect())


def test_a_new_column_loses_no_rows(spark, tmp_path):
    table = str(tmp_path / "t")
    _apply(spark, table, [(1, JAN, 1.0, 1, "insert"), (2, JAN, 2.0, 1, "insert")])
    _apply(spark, table, [(3, JAN, 3.0, 1, "insert", "n")], SCHEMA + ", note string")
    _apply(spark, table, [(4, JAN, 4.0, 1, "insert")])
    assert [x[0] for x in _live(spark, table)] == [1, 2, 3, 4]
    assert {r.id: r.note for r in LV.read_changes(spark, table).collect()} == {1: None, 2: None, 3: "n", 4: None}


def test_delete_by_id_month_moves_and_late_operations(spark, tmp_path):
    table = str(tmp_path / "t")
    _apply(spark, table, [(1, JAN, 1.0, 1, "insert"), (2, JAN, 2.0, 1, "insert"), (3, FEB, 3.0, 1, "insert")])
    _apply(spark, table, [(1, None, None, 5, "delete"), (2, FEB, 2.5, 4, "update")])
    assert _live(spark, table) == [(2, FEB, 2.5), (3, FEB, 3.0)]
    late = [(1, JAN, 9.0, 3, "update"), (2, JAN, 9.0, 3, "update"), (9, None, None, 7, "delete")]
    _apply(spark, table, late)
    _apply(spark, table, late)  # a replayed batch
    _apply(spark, table, [(9, JAN, 9.0, 6, "insert"), (3, FEB, 3.5, 1, "update")])
    assert _live(spark, table) == [(2, FEB, 2.5), (3, FEB, 3.5)]
    _apply(spark, table, [(1, JAN, 1.5, 8, "insert")])
    assert _live(spark, table) == [(1, JAN, 1.5), (2, FEB, 2.5), (3, FEB, 3.5)]


def test_an_unreadable_table_stops_the_stream(spark, tmp_path):
    table = str(tmp_path / "t")
    _apply(spark, table, [(1, JAN, 1.0, 1, "insert")])
    with open(f"{table}/{storage.current(spark, table).leaves[0]}/part-broken.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        _apply(spark, table, [(2, JAN, 2.0, 1, "insert")])


def test_batches_may_touch_any_number_of_months(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = [(i, datetime.date(1900 + i // 12, 1 + i % 12, 1), 1.0, 1, "insert") for i in range(1300)]
    _apply(spark, table, rows)
    _apply(spark, table, [(0, None, None, 2, "delete")])
    assert LV.read_changes(spark, table).count() == 1299


def test_update_mode_reads_the_latest_row_of_a_key(spark, cats):
    root = tempfile.mkdtemp(prefix="ledger-up-")
    rent = cats.where("name = 'rent'").first().id
    schema = "id long, date date, amount decimal(12,2), category_id long"
    one = lambda i: [(i, JAN, decimal.Decimal(i), rent)]
    _write_slices(spark, root, [one(1), one(2), one(3)], schema)
    st = LV.read_stream(spark, f"{root}/in/*", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    LV.drain(LV.run(LV.stream_monthly_kpis(st, cats), f"{root}/out", "update"))
    assert spark.read.parquet(f"{root}/out").count() == 3
    rows = LV.read_output(spark, f"{root}/out", "update", ["month", "category"]).collect()
    assert [(r.n, float(r.total)) for r in rows] == [(3, 6.0)]


def test_stream_kpis_equal_batch(spark, cats):
    root = tempfile.mkdtemp(prefix="ledger-kp-")
    ids = {r.name: r.id for r in cats.collect()}
    schema = "id long, date date, amount decimal(12,2), category_id long"
    import datetime as dt
    from decimal import Decimal
    rows = [(i, dt.date(2024, 1 + i % 3, 1 + i % 20), Decimal("1.25") * i, ids["rent" if i % 2 else "health"])
            for i in range(1, 60)]
    _write_slices(spark, root, [rows[:20], rows[20:40], rows[40:]], schema)
    st = LV.read_stream(spark, f"{root}/in/*", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    out = f"{root}/kpi"
    LV.drain(LV.run(LV.stream_monthly_kpis(st, cats), out, "complete"))
    streamed = {(r.month, r.category): (r.n, r.total) for r in LV.read_output(spark, out, "complete").collect()}
    batch_df = spark.createDataFrame(rows, schema)
    batch = {(r.month, r.category): (r.n, r.total) for r in LV.stream_monthly_kpis(batch_df, cats).collect()}
    assert streamed == batch


def test_stream_path_for_single_file(spark, tmp_path):
    f = tmp_path / "orders.parquet"
    f.write_text("x")
    assert LV.stream_path(spark, str(f)).endswith("orders.parque[t]")
    assert LV.stream_path(spark, str(tmp_path)) == str(tmp_path)


def test_change_log_empties_a_month(spark):
    import datetime as dt

    root = tempfile.mkdtemp(prefix="ledger-em-")
    schema = "id long, date date, amount double, seq long, op string"
    jan, feb = dt.date(2024, 1, 5), dt.date(2024, 2, 5)
    _write_slices(spark, root, [[(1, jan, 1.0, 1, "insert"), (2, feb, 2.0, 2, "insert")],
                                [(1, jan, 0.0, 3, "delete")]], schema)
    cs = LV.read_stream(spark, f"{root}/in/*", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    LV.drain(LV.stream_change_log(cs, f"{root}/table"))
    assert [r.id for r in LV.read_changes(spark, f"{root}/table").collect()] == [2]


LEDGER = "id long, date date, amount decimal(12,2), category_id long, seq long, op string"


def _kpis(spark, table, cats, out, **kw):
    """The KPI stream over the delta log, drained (it goes on from its checkpoint)."""
    deltas = LV.stream_deltas(spark, table, **kw)
    LV.drain(LV.run(LV.stream_monthly_kpis(deltas, cats, "_sign"), out, "complete"))
    return {(r.month, r.category): (r.n, r.total) for r in LV.live_kpis(LV.read_output(spark, out, "complete")).collect()}


def _batch_kpis(spark, table, cats):
    return {(r.month, r.category): (r.n, r.total) for r in LV.stream_monthly_kpis(LV.read_changes(spark, table), cats).collect()}


def _money(x):
    return decimal.Decimal(x).quantize(decimal.Decimal("0.01"))


def test_live_kpis_follow_every_kind_of_change(spark, cats, tmp_path):
    """Insert, update, recategorise, move, delete, revive, late and replayed batches:
    the stream's KPIs equal those of the table after every batch."""
    table, out = str(tmp_path / "t"), str(tmp_path / "kpis")
    row = lambda i, date, amount, cat, seq, op: (i, date, None if amount is None else _money(amount), cat, seq, op)
    batches = [
        [row(i, JAN if i % 2 else FEB, i, 1 + i % 3, 1, "insert") for i in range(1, 40)],
        [row(1, JAN, 100, 2, 2, "update"), row(2, JAN, 2, 3, 2, "update"), row(3, None, None, None, 2, "delete")],
        [row(1, JAN, 5, 2, 1, "update"), row(3, FEB, 9, 1, 1, "update")],                 # late: nothing changes
        [row(3, FEB, 9, 1, 5, "insert"), row(5, None, None, None, 6, "delete"), row(77, None, None, None, 3, "delete")],
        [row(i, None, None, None, 9, "delete") for i in range(1, 40) if i % 2 == 0],      # all of a month goes
        [row(50, FEB, 7, None, 1, "insert"), row(51, None, 8, 1, 1, "insert")],           # no category, no date
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, LEDGER)
        LV.apply_changes(spark, df, table, buckets=4)
        assert _kpis(spark, table, cats, out) == _batch_kpis(spark, table, cats)
        LV.apply_changes(spark, df, table)  # replayed: no further deltas
        assert _kpis(spark, table, cats, out) == _batch_kpis(spark, table, cats)
    assert sum(n for n, _ in _batch_kpis(spark, table, cats).values()) > 0


def test_deltas_appear_once_whatever_fails(spark, cats, tmp_path, monkeypatch):
    table, out = str(tmp_path / "t"), str(tmp_path / "kpis")
    first = spark.createDataFrame([(i, JAN, _money(i), 1, 1, "insert") for i in range(1, 6)], LEDGER)
    second = spark.createDataFrame([(1, FEB, _money(50), 2, 2, "update"), (2, None, None, None, 2, "delete")], LEDGER)
    LV.apply_changes(spark, first, table)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # before the commit: the batch is applied again from the start
        m.setattr(storage, "commit", lost)
        with pytest.raises(RuntimeError):
            LV.apply_changes(spark, second, table)
    assert _kpis(spark, table, cats, out) == _batch_kpis(spark, table, cats)
    commit = storage.commit

    def committed(*args):
        commit(*args)
        lost()

    with monkeypatch.context() as m:  # after the commit, before its deltas are shown
        m.setattr(storage, "commit", committed)
        with pytest.raises(RuntimeError):
            LV.apply_changes(spark, second, table)
    LV.apply_changes(spark, second, table)
    assert _kpis(spark, table, cats, out) == _batch_kpis(spark, table, cats)
    shown = spark.read.parquet(f"{table}/{LV.DELTAS}/*")
    assert shown.agg(F.sum("_sign")).first()[0] == LV.read_changes(spark, table).count() == 4


def test_a_batch_reads_its_ids_buckets_only(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = [(i, JAN if i % 2 else FEB, float(i), 1, "insert") for i in range(400)]
    LV.apply_changes(spark, spark.createDataFrame(rows, SCHEMA), table, buckets=16)
    state = storage.current(spark, table)
    assert len(state.leaves) == 32
    found = storage.in_buckets(spark, table, state, spark.createDataFrame([(7,)], "id long"))
    assert len(found.inputFiles()) == 2 and re.search(r"PartitionFilters: \[[^]]*bucket", found._jdf.queryExecution().executedPlan().toString())
    _apply(spark, table, [(7, None, None, 2, "delete"), (1000, FEB, 1.0, 1, "insert")])
    after = storage.current(spark, table)
    assert len(set(state.leaves) - set(after.leaves)) == 1  # the leaf that lost a row; the new row came beside
    assert LV.read_changes(spark, table).count() == 400


def test_marks_of_deleted_ids_can_be_dropped(spark, tmp_path):
    table = str(tmp_path / "t")
    _apply(spark, table, [(1, JAN, 1.0, 1, "insert"), (2, JAN, 2.0, 1, "insert"), (3, FEB, 3.0, 1, "insert")])
    _apply(spark, table, [(1, None, None, 5, "delete"), (3, None, None, 9, "delete")])
    LV.forget_deleted(spark, table, 9)
    rows = storage.read(spark, table, storage.current(spark, table))
    assert sorted((r.id, r._deleted) for r in rows.collect()) == [(2, False), (3, True)]
    _apply(spark, table, [(3, FEB, 3.5, 8, "update")])  # older than its mark, which is kept
    assert [x[0] for x in _live(spark, table)] == [2]


@pytest.mark.parametrize("query", ["stream_monthly_kpis_update", "stream_monthly_kpis", "stream_clean"])
def test_a_feed_of_many_files_drains_in_few_batches(spark, tmp_path, monkeypatch, query):
    """Each micro-batch has a fixed cost; all rows count, in whichever batch they come."""
    from ledger_spark.plans import catalog

    day, price = datetime.date(2024, 5, 1), decimal.Decimal("10.00")
    for i in range(9):
        rows = [(10 * i + j, 1 + j % 2, day, price) for j in range(10)]
        (spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice decimal(12,2)")
         .coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders.parquet"))
    (spark.createDataFrame([(1, "a", "BUILDING"), (2, "b", "MACHINERY")], "c_custkey long, c_name string, c_mktsegment string")
     .coalesce(1).write.parquet(f"{tmp_path}/customer.parquet"))
    seen, run = [], LV.run
    monkeypatch.setattr(LV, "run", lambda *a, **k: seen.append(run(*a, **k)) or seen[-1])
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a file of the feed per input file
    try:
        got = getattr(catalog, query)(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert len(got) == 90 if query == "stream_clean" else sorted((r.category, r.n, r.total) for r in got) == [
        ("building", 45, 450.0), ("machinery", 45, 450.0)]
    batches = [p for p in seen[0].recentProgress if p["numInputRows"]]
    assert 1 < len(batches) <= LV.BATCHES
