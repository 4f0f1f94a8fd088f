import datetime

import pytest
from pyspark.sql import functions as F

from stocklens import schemas
from stocklens.operators.quality import violations
from stocklens.plans import generate
from stocklens.plans.revenue import revenue_by_day
from stocklens.plans.turnover import turnover
from stocklens.sinks.versioned import read_version
from stocklens.sources.tables import load_table

AS_OF = "2024-02-01T09:30:00Z"


@pytest.mark.parametrize("n", [1, 2, 12])
def test_sizes(spark, n):
    made = generate.generate(spark, n, AS_OF)
    counts = {name: df.count() for name, df in made.items()}
    assert counts == {
        "product_categories": 8,
        "brands": max(10, 2 * n),
        "warehouses": max(3, n // 2),
        "suppliers": 2 * n,
        "employees": max(5, n),
        "customers": 5 * n,
        "products": 10 * n,
        "supplier_orders": 2 * n,
        "supplier_order_items": 4 * n,
        "goods_receipts": 2 * n,
        "goods_receipt_items": 4 * n,
        "customer_orders": 5 * n,
        "customer_order_items": 20 * n,
        "shipments": 5 * n,
        "shipment_items": 10 * n,
    }
    assert generate.movements(made).count() == 14 * n


def test_seed_count_has_to_be_positive(spark):
    with pytest.raises(ValueError):
        generate.generate(spark, 0, AS_OF)


def test_columns_match_the_declared_ones(spark):
    made = generate.generate(spark, 1, AS_OF)
    made["inventory_movements"] = generate.movements(made)
    for name, df in made.items():
        declared = {f.name: f.dataType for f in schemas.schema(name).fields}
        for field in df.schema.fields:
            assert field.dataType == declared[field.name], (name, field.name)


def test_generated_tables_break_no_constraint(spark):
    made = generate.generate(spark, 3, AS_OF)
    made["inventory_movements"] = generate.movements(made)
    assert [tuple(r) for r in violations(made).where("violations > 0").collect()] == []


def test_violations_are_found(spark):
    made = generate.generate(spark, 2, AS_OF)
    orders = made["customer_orders"]
    made = {
        "customers": made["customers"],
        "customer_orders": orders.unionByName(orders.limit(1)).withColumns(
            {
                "status": F.when(F.col("customer_order_id") == 400003, "gone").otherwise(F.col("status")),
                "customer_id": F.when(F.col("customer_order_id") == 400004, 999).otherwise(F.col("customer_id")),
                "delivery_address": F.when(F.col("customer_order_id") != 400005, F.col("delivery_address")),
            }
        ),
    }
    found = {(r.check_kind, r.subject): r.violations for r in violations(made).where("violations > 0").collect()}
    assert found == {
        ("unique", "customer_order_id"): 1,
        ("domain", "status"): 1,
        ("reference", "customer_id"): 1,
        ("not_null", "delivery_address"): 1,
    }


def test_rows(spark):
    made = generate.generate(spark, 2, AS_OF)
    supplier = made["suppliers"].where("supplier_id = 3").first()
    assert tuple(supplier) == (3, "Supplier 3", "supplier3@example.com", "+100000    3")
    employee = made["employees"].where("employee_id = 4").first()
    assert tuple(employee)[3:] == ("manager", datetime.date(2024, 1, 28))
    assert [r.category_name for r in made["product_categories"].orderBy("category_id").collect()] == generate.CATEGORIES
    product = made["products"].where("product_id = 11").first()
    assert tuple(product) == (11, 3, 1, "Product 11", "box")
    item = made["customer_order_items"].where("customer_order_item_id = 410006").first()
    assert (item.customer_order_id, item.product_id, str(item.ordered_quantity), str(item.sale_price)) == (
        400002,
        3,
        "3.000",
        "24.00",
    )
    order = made["customer_orders"].where("customer_order_id = 400002").first()
    assert order.created_at == datetime.datetime(2024, 1, 30, 9, 30) and order.status == "picking"


def test_long_numbers_are_not_cut(spark):
    from stocklens.functions.scalars import padded_phone

    df = spark.range(1234567, 1234568).select(padded_phone("+1", F.col("id")).alias("p"))
    assert df.first().p == "+11234567"


def test_overlapping_movement_ids(spark):
    n = 2600
    made = generate.generate(spark, n, AS_OF)
    moves = generate.movements(made)
    assert moves.count() == 10 * n + 10_000
    assert moves.where("inventory_movement_id = 540001").first().movement_type == "receipt"
    apart = generate.movements(made, non_overlapping_ids=True)
    assert apart.count() == 14 * n == apart.select("inventory_movement_id").distinct().count()


def test_reports_on_generated_tables(spark):
    made = generate.generate(spark, 4, AS_OF)
    made["inventory_movements"] = generate.movements(made)
    made["customer_order_audit_notes"] = spark.createDataFrame([], schemas.TABLES["customer_order_audit_notes"])
    assert turnover(made).count() > 0
    report = revenue_by_day(made).collect()
    assert report and all(r.audit_note_count == 0 for r in report)


def test_seed_steps_run_once(spark, tmp_path):
    path = str(tmp_path / "shop")
    assert generate.run_seed_steps(spark, path, 1, "prod", AS_OF) == []
    assert generate.run_seed_steps(spark, path, 1, "dev", AS_OF, upto=2) == [1, 2]
    assert generate.run_seed_steps(spark, path, 1, "dev", AS_OF) == [3, 4, 5]
    assert generate.run_seed_steps(spark, path, 1, "dev", AS_OF) == []
    assert read_version(spark, f"{path}/inventory_movements").count() == 14
    assert load_table(spark, "products", f"{path}/products/v1").count() == 10


def test_merging_seed_rows_keeps_ids(spark, tmp_path, rows):
    path = str(tmp_path / "warehouses")
    old = spark.createDataFrame([(77, "Warehouse 1", "Old"), (78, "Other", "X")], schemas.TABLES["warehouses"])
    generate.merge_table(spark, old, path, "warehouses", ["warehouse_name"])
    generate.merge_table(spark, generate.locations(spark, 1, AS_OF), path, "warehouses", ["warehouse_name"])
    found = rows(read_version(spark, path), "warehouse_id", "warehouse_name", "city")
    assert found[-2:] == [(77, "Warehouse 1", "City 1"), (78, "Other", "X")] and len(found) == 4


def test_seed_rows_beside_stored_ones_keep_ids_apart(spark, tmp_path):
    """Two stored brands with ids that the seed would give to others: ids stay unique and references right."""
    path = str(tmp_path / "shop")
    old = spark.createDataFrame([(3, "Brand 2"), (1, "Own brand")], schemas.TABLES["brands"])
    generate.merge_table(spark, old, f"{path}/brands", "brands", ["brand_name"])
    assert generate.run_seed_steps(spark, path, 1, "dev", AS_OF) == [1, 2, 3, 4, 5]
    brands = {r.brand_id: r.brand_name for r in read_version(spark, f"{path}/brands").collect()}
    fresh = {r.brand_id: r.brand_name for r in generate.brands(spark, 1, AS_OF).collect()}
    assert len(brands) == len(set(fresh.values()) | {"Own brand"}) == read_version(spark, f"{path}/brands").count()
    assert brands[3] == "Brand 2" and brands[1] == "Own brand"
    products = {r.product_name: brands[r.brand_id] for r in read_version(spark, f"{path}/products").collect()}
    assert products == {r.product_name: fresh[r.brand_id] for r in generate.products(spark, 1, AS_OF).collect()}
    tables = {n: read_version(spark, f"{path}/{n}") for n in [*generate.TABLES, "inventory_movements"]}
    assert violations(tables).where("violations > 0").collect() == []


def test_probe_movement(spark):
    made = generate.generate(spark, 1, AS_OF)
    row = generate.probe_movement(made, 990_001, AS_OF).first()
    assert (row.inventory_movement_id, row.product_id, row.warehouse_id, row.employee_id) == (990_001, 1, 1, 1)
    assert (row.movement_type, str(row.quantity)) == ("adjustment", "11.111")
