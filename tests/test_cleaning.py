from pyspark.sql import functions as F

from ledger_spark.functions.rules import amount_bucket, keyword_classify
from ledger_spark.functions.text import clean_description, normalize_category, tokens
from ledger_spark.operators.clean import clean_transactions, map_categories


def raw(spark, rows):
    return spark.createDataFrame(rows, "Date string, Description string, Amount string, Category string")


def test_clean_edge_rows(spark, cats):
    df = raw(spark, [
        ("2024-13-01", "X", "5.00", "rent"),           # bad date -> dropped
        ("2024-01-02", "A", "abc", "rent"),            # bad amount
        ("2024-01-03", "B", "0", "rent"),              # zero
        ("2024-01-04", "C", "-3", "rent"),             # negative
        ("2024-01-05", "D", "0.004", "rent"),          # rounds to 0.00
        ("2024-01-06", "\t café *  ", "12.50", " Food  Drink "),
        ("2024-01-07", "netflix premium", "15.99", "Unknown Thing"),
        ("2024-01-08", "uber uber", "7.00", None),
    ])
    out = clean_transactions(df).orderBy("date").collect()
    assert [r.description for r in out] == ["CAF ", "NETFLIX PREMIUM", "UBER UBER"]
    assert [r.category_raw for r in out] == ["food_drink", "unknown_thing", None]
    assert [r.is_recurring for r in out] == [0, 1, 0]
    mapped = map_categories(clean_transactions(df), cats).orderBy("date").collect()
    ids = {r.name: r.id for r in cats.collect()}
    assert [r.category_id for r in mapped] == [ids["food_drink"], ids["uncategorized"], ids["uncategorized"]]


def test_trailing_space_and_accent_options(spark):
    df = spark.createDataFrame([(" Café * ",)], "d string")
    r = df.select(clean_description("d").alias("a"), clean_description("d", fold_accents=True, retrim=True)
                  .alias("b")).first()
    assert r.a == "CAF " and r.b == "CAFE"


def test_normalize_category_tabs(spark):
    df = spark.createDataFrame([("\tHome   Office \n",)], "c string")
    assert df.select(normalize_category("c")).first()[0] == "home_office"


def test_bucket_edges(spark):
    df = spark.createDataFrame([(x,) for x in ["10.00", "10.01", "25.00", "250.00", "250.01", "0.50"]], "a string")
    got = [r[0] for r in df.select(amount_bucket(F.col("a").cast("decimal(12,2)"))).collect()]
    assert got == ["tiny", "small", "small", "xlarge", "huge", "tiny"]


def test_keyword_order(spark):
    df = spark.createDataFrame([(x,) for x in ["Uber Eats lunch", "UBER trip", "amazon prime", "AMAZON order",
                                               "random"]], "d string")
    got = [r[0] for r in df.select(keyword_classify("d")).collect()]
    assert got == ["food_drink", "transport", "subscriptions", "shopping", "uncategorized"]


def test_keyword_word_boundary_option(spark):
    df = spark.createDataFrame([("SUBPAR",), ("BP STATION",)], "d string")
    loose = [r[0] for r in df.select(keyword_classify("d")).collect()]
    strict = [r[0] for r in df.select(keyword_classify("d", word_boundary=True)).collect()]
    assert loose == ["transport", "transport"] and strict == ["uncategorized", "transport"]


def test_tokens_drop_numbers(spark):
    df = spark.createDataFrame([("LIDL 123 Café-bar h3",)], "d string")
    assert df.select(tokens("d")).first()[0] == ["lidl", "café", "bar", "h3"]


def test_suggestable_input_and_id_by_name(spark, cats):
    from ledger_spark.operators.clean import category_id_by_name, suggestable_input

    df = spark.createDataFrame([("ab", "RENT"), ("abc", "Health"), ("abcd", "nope")], "description string, category string")
    assert [r.description for r in suggestable_input(df).collect()] == ["abc", "abcd"]
    ids = {r.name: r.id for r in cats.collect()}
    got = {r.category: r.category_id for r in category_id_by_name(df, cats).collect()}
    assert got == {"RENT": ids["rent"], "Health": ids["health"], "nope": None}


def test_document_term_matrix_wide(spark):
    from ledger_spark.operators.text import document_term_matrix

    df = spark.createDataFrame([(1, "Uber uber eats"), (2, "rent 12")], "id long, description string")
    rows = {r.id: r for r in document_term_matrix(df, ["uber", "rent", "eats"]).collect()}
    assert (rows[1].uber, rows[1].rent, rows[1].eats) == (1, 0, 1)
    assert (rows[2].uber, rows[2].rent, rows[2].eats) == (0, 1, 0)


def test_time_index(spark):
    from ledger_spark.operators.forecast import time_index

    s = spark.createDataFrame([("a", [5.0, 6.0])], "k string, xs array<double>")
    assert [(r.t, r.x) for r in time_index(s, ["k"]).collect()] == [(1, 5.0), (2, 6.0)]
