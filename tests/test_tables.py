import shutil
from datetime import datetime
from pathlib import Path

import pytest

from latelane.plans.pipeline import run_pipeline
from latelane.schemas import CSV_STEMS, TABLES
from latelane.sources import sinks, tables as tables_module
from latelane.sources.scratch import scratch_root, scratch_run, written
from latelane.sources.star import marketplace_tables
from latelane.sources.tables import MissingInputsError, load_tables, rejected_cells

from .conftest import SMALL

HEADERS = {name: ",".join(schema.names) for name, schema in TABLES.items()}


@pytest.fixture
def folder(tmp_path):
    """A bundle with its own file name prefix, header rows only."""
    for name, stem in CSV_STEMS.items():
        prefix = "" if name == "categories" else "shop_"
        (tmp_path / f"{prefix}{stem}.csv").write_text(HEADERS[name] + "\n", encoding="utf-8")
    return tmp_path


def test_all_tables_are_found_by_their_stem(spark, folder):
    tables = load_tables(spark, str(folder))
    assert {n: df.schema for n, df in tables.items()} == dict(TABLES)


def test_missing_tables_and_columns_in_one_error(spark, folder, tmp_path):
    (folder / "shop_orders_dataset.csv").write_text("order_id,customer_id\n")
    shutil.move(folder / "shop_sellers_dataset.csv", folder / "elsewhere.csv")
    with pytest.raises(MissingInputsError) as error:
        load_tables(spark, str(folder))
    text = str(error.value)
    assert "table sellers" in text and "column orders.order_status" in text
    assert "order_approved_at" not in text


def test_cells(spark, folder):
    (folder / "shop_products_dataset.csv").write_text(
        "﻿product_id,note,product_category_name,product_weight_g,product_length_cm,"
        "product_height_cm,product_width_cm\n"
        'p1,"x ""q"" y",toys,1.5,NaN,abc,4\n'
        'p2,"two\nlines, one cell",NA,,None,2,null\n',
        encoding="utf-8",
    )
    rows = load_tables(spark, str(folder))["products"].orderBy("product_id").collect()
    assert [r["product_id"] for r in rows] == ["p1", "p2"]
    assert rows[0]["note"] == 'x "q" y' and rows[1]["note"] == "two\nlines, one cell"
    assert tuple(rows[0])[2:] == ("toys", 1.5, None, None, 4.0)
    assert tuple(rows[1])[2:] == (None, None, None, 2.0, None)
    rejected = rejected_cells(spark, str(folder)).where("rejected > 0").collect()
    assert [tuple(r) for r in rejected] == [("products", "product_height_cm", 1)]


def test_zip_and_dates(spark, folder):
    (folder / "shop_customers_dataset.csv").write_text(
        "customer_state,customer_zip_code_prefix,customer_id\nSP,01310,c1\nRJ,x,c2\n"
    )
    (folder / "shop_orders_dataset.csv").write_text(
        HEADERS["orders"] + "\no1,c1,delivered,2018-01-02 03:04:05,,,not a date,2018-01-09\n"
    )
    tables = load_tables(spark, str(folder))
    customers = tables["customers"].orderBy("customer_id").collect()
    assert [r["customer_zip_code_prefix"] for r in customers] == [1310, None]
    order = tables["orders"].first()
    assert order["order_purchase_timestamp"] == datetime(2018, 1, 2, 3, 4, 5)
    assert order["order_delivered_customer_date"] is None
    assert order["order_estimated_delivery_date"] == datetime(2018, 1, 9)
    rejected = rejected_cells(spark, str(folder)).where("rejected > 0").collect()
    assert {tuple(r) for r in rejected} == {
        ("customers", "customer_zip_code_prefix", 1),
        ("orders", "order_delivered_customer_date", 1),
    }


def test_csv_is_read_pruned(spark, folder):
    plan = load_tables(spark, str(folder))["orders"].select("order_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<order_id:string>" in text


def test_parquet_folder(spark, tmp_path):
    source = marketplace_tables(spark, SMALL)
    for name, df in source.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    tables = load_tables(spark, str(tmp_path))
    assert tables["orders"].schema["order_id"].dataType.typeName() == "long"
    assert tables["items"].exceptAll(source["items"]).isEmpty()
    assert rejected_cells(spark, str(tmp_path)).where("rejected > 0").isEmpty()


def test_csv_keeps_every_row(spark, tmp_path):
    source = marketplace_tables(spark, SMALL)
    for name, df in source.items():
        sinks.write_csv(df, str(tmp_path / f"{name}.csv"))
    loaded = load_tables(spark, str(tmp_path))
    for name, df in source.items():
        ids = [c for c in df.columns if c.endswith("_id") and c != "order_item_id"]
        same = df.withColumns({c: df[c].cast("string") for c in ids})
        assert loaded[name].exceptAll(same).isEmpty() and loaded[name].count() == df.count(), name
    converted = load_tables(spark, str(tmp_path), convert=True)
    assert converted["orders"].exceptAll(loaded["orders"]).isEmpty()
    assert converted["reviews"].columns == ["order_id", "review_score"]


PRODUCTS = HEADERS["products"] + "\n"


def test_a_quoted_line_break_tears_no_row(spark, folder):
    (folder / "shop_products_dataset.csv").write_text(
        PRODUCTS + 'p1,"toys\nand games",100,1,1,1\np2,plain,2,2,2,2\n'
    )
    rows = load_tables(spark, str(folder))["products"].orderBy("product_id").collect()
    assert [(r["product_id"], r["product_category_name"]) for r in rows] == [
        ("p1", "toys\nand games"), ("p2", "plain"),
    ]
    assert rejected_cells(spark, str(folder)).where("rejected > 0").isEmpty()


def test_content_decides_how_a_file_is_split(spark, folder):
    path = folder / "shop_products_dataset.csv"
    path.write_text('product_id,note\np1,"a ""quoted"" word, and a comma"\n')
    assert not tables_module._spans_lines(spark, str(path))
    path.write_text('product_id,note\np1,"a\nb"\n')
    assert tables_module._spans_lines(spark, str(path))


@pytest.mark.parametrize("kind", ["csv", "parquet", "text"])
def test_one_cell_rule_for_all_sources(spark, folder, kind):
    cells = [("o1", 4.5), ("o2", float("nan")), ("o3", float("inf")), ("o4", None)]
    frame = spark.createDataFrame(cells, "order_id string, review_score double")
    items = frame.selectExpr(
        "order_id", "1 as order_item_id", "'p' as product_id", "'s' as seller_id",
        "review_score as price", "review_score as freight_value",
    )
    for name, df in (("reviews", frame), ("items", items)):
        for old in folder.glob(f"*{CSV_STEMS[name]}.csv"):
            shutil.move(old, folder / f"{old.stem}.unused")
        if kind == "csv":
            sinks.write_csv(df, str(folder / f"{name}.csv"))
            continue
        texts = df.select([df[c].cast("string") for c in df.columns]) if kind == "text" else df
        texts.write.parquet(str(folder / f"{name}.parquet"))
    tables = load_tables(spark, str(folder))
    scores = {r["order_id"]: r["review_score"] for r in tables["reviews"].collect()}
    assert scores == {"o1": 4.5, "o2": None, "o3": float("inf"), "o4": None}
    prices = {r["order_id"]: r["price"] for r in tables["items"].collect()}
    assert prices == scores
    assert tables["items"].schema["order_item_id"].dataType.typeName() == "integer"
    assert rejected_cells(spark, str(folder)).where("rejected > 0").isEmpty()


def test_unreadable_parquet_cells_are_counted(spark, folder):
    frame = spark.createDataFrame([("o1", "five"), ("o2", "5"), ("o3", "NA")], "order_id string, review_score string")
    frame.write.parquet(str(folder / "reviews.parquet"))
    loaded = load_tables(spark, str(folder))["reviews"].orderBy("order_id").collect()
    assert [r["review_score"] for r in loaded] == [None, 5.0, None]
    rejected = rejected_cells(spark, str(folder)).where("rejected > 0").collect()
    assert [tuple(r) for r in rejected] == [("reviews", "review_score", 1)]


def test_json_records_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    path = sinks.write_json_records(df, str(tmp_path / "records"))
    assert spark.read.text(path).first()[0] == '{"x":"a","y":null}'


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def scratch_files(spark):
    return {str(p) for p in Path(scratch_root(spark)).glob("latelane/*/*")}


def test_scratch_goes_after_a_failure_too(spark):
    before = scratch_files(spark)
    with pytest.raises(RuntimeError):
        with scratch_run(spark):
            assert written(spark.range(3), "three").count() == 3
            raise RuntimeError
    assert scratch_files(spark) == before


def test_whole_run(spark, tmp_path):
    for name, df in marketplace_tables(spark, SMALL).items():
        sinks.write_csv(df, str(tmp_path / "in" / f"{name}.csv"))
    before = scratch_files(spark)
    paths = run_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "out"), trees=10, max_depth=4)
    assert scratch_files(spark) == before
    for name, path in paths.items():
        if name != "model":
            reader = spark.read.json if name.endswith("_json") else spark.read.parquet
            assert not reader(path).isEmpty(), name
    report = spark.read.parquet(paths["report_summary"]).collect()
    assert len(report) == 1
    top = spark.read.parquet(paths["revenue_by_state"]).orderBy("revenue", ascending=False).first()
    assert report[0]["top_state"] == top["customer_state"]
    assert report[0]["total_revenue_text"] == f"R$ {report[0]['total_revenue']:,.2f}"
