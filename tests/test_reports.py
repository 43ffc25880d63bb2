"""Reports from one read equal the single reports."""

from __future__ import annotations

from postwise.operators import reports

ROWS = [
    ("Real", "a", 0.9, True), ("Real", "a", 0.51, True), ("Fake", "a", 0.2, False), ("Fake", "b", 0.0, False),
    ("Fake", "b", 1.0, False), (None, "a", None, None), ("Real", None, 0.77, True), ("Real", "c", 0.5, True), (None, None, 0.3, None),
]
SCHEMA = "label string, category string, fake_news_prob double, is_real boolean"


def test_tables_from_one_read_equal_the_single_reports(spark):
    for rows in (ROWS, ROWS * 3, ROWS[:1]):
        frame = spark.createDataFrame(rows, SCHEMA)
        found = reports.classification_tables(frame)
        assert set(found) == {
            "fake_real_distribution", "classification_by_category", "prob_histogram",
            "classification_kpis", "categories_by_real_share", "share_within_category",
        }
        for name, table in found.items():
            single = getattr(reports, name)(frame)
            assert table.columns == single.columns
            assert sorted(map(str, table.collect())) == sorted(map(str, single.collect())), name


def test_reports_read_the_classified_table_once(spark, monkeypatch):
    plans, real = [], reports.stored
    monkeypatch.setattr(reports, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    found = reports.classification_tables(spark.createDataFrame(ROWS, SCHEMA))
    assert len(plans) == 1 and plans[0].count("Scan ExistingRDD") == 1 and plans[0].count("Expand") == 1
    for table in found.values():
        assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
