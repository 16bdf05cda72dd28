"""Every query with SQL against that SQL; every other query runs and keeps its columns."""

import pytest

from quillmesh.queries import core, core_sql, review, review_sql

QUERIES, SQL = {**core.QUERIES, **review.QUERIES}, {**core_sql.SQL, **review_sql.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(compare, name):
    compare(name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    assert df.columns
    df.limit(5).collect()


def test_kept_dictionary_gives_the_same_instants(spark, data_dir):
    rows = [{tuple(r) for r in QUERIES[name](spark, data_dir).collect()} for name in ("p6_found", "p6_incremental")]
    assert rows[0] == rows[1] and rows[0]


def test_metrics_of_predictions_by_hand(spark, data_dir):
    """Baseline metrics over the joined labels, counted row by row."""
    labels = {r["item"]: r["a"] >= 2 for r in core._label_pairs(spark, data_dir).collect()}
    counts: dict = {}
    for r in QUERIES["baseline_predictions"](spark, data_dir).collect():
        if r["article_id"] in labels:
            key = (r["baseline"], r["predicted"], labels[r["article_id"]])
            counts[key] = counts.get(key, 0) + 1
    for r in QUERIES["baseline_metrics"](spark, data_dir).collect():
        cells = [counts.get((r["baseline"], p, a), 0) for p, a in ((True, True), (True, False), (False, True), (False, False))]
        assert [r["tp"], r["fp"], r["fn"], r["tn"]] == cells and r["abstained"] == sum(counts.get((r["baseline"], None, a), 0) for a in (True, False))


def test_links_and_categories_add_up(spark, data_dir):
    links = [tuple(r) for r in QUERIES["entity_links"](spark, data_dir).collect()]
    summary = {r["entity_id"]: r for r in QUERIES["entity_link_summary"](spark, data_dir).collect()}
    assert {e: r["mentions"] for e, r in summary.items()} == {e: sum(x[1] == e for x in links) for e in summary}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    assert all(texts[x[0]][x[3]:x[4]].lower() == x[2] for x in links)
    articles = spark.read.parquet(f"{data_dir}/articles.parquet").select("article_id").distinct().count()
    assert sum(r["articles"] for r in QUERIES["sampling_categories"](spark, data_dir).collect()) == articles


def test_manifest_counts_the_rows(spark, data_dir):
    rows = QUERIES["model_inputs"](spark, data_dir)
    for r in QUERIES["dataset_manifest"](spark, data_dir).collect():
        assert 0 <= r["missing"] <= r["observations"]
    assert rows.limit(1).count() == 1


def test_entry(spark, data_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(core.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"quillmesh\.llm|from \.*llm", path.read_text()), path
