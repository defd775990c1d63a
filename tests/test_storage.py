import json

from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.operators import answering as A
from vitrine.sources import files
from vitrine.sources.points import PointTable, dimension_check, upsert, write_results
from vitrine.streaming.answers import accepted_requests, stream_answers

POINTS = "id string, embedding array<float>, version long, note string"


def test_catalog_file(spark, tmp_path):
    rows = [
        {"sku": "b", "name": "B", "sizes": ["M"], "stock": {"XL": 1, "M": 2}, "price_eur": 5},
        {"sku": "a", "name": "A", "colors": ["red"], "stock": {}},
    ]
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(rows), encoding="utf-8")
    got = files.read_catalog(spark, str(path)).orderBy("ord").collect()
    assert [r.sku for r in got] == ["b", "a"]
    assert list(got[0].stock.items()) == [("XL", 1), ("M", 2)] and got[0].price_eur == 5.0
    assert got[1].stock == {} and got[1].sizes is None


def test_document_files(spark, tmp_path):
    (tmp_path / "one.two.md").write_text("Ä line\n\nanother\n", encoding="utf-8")
    (tmp_path / "empty.md").write_text("", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("no", encoding="utf-8")
    docs = {r.id: r.text for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert docs == {"one.two": "Ä line\n\nanother\n", "empty": ""} or docs == {"one.two": "Ä line\n\nanother\n"}
    missing = files.read_documents(spark, str(tmp_path / "nowhere"))
    assert missing.count() == 0 and missing.schema == schemas.DOCUMENT


def test_gold_and_results_round_trip(spark, tmp_path):
    item = {
        "id": "q1", "question": "Q?", "expected_answer": "A", "source_type": "policy", "source_ids": ["p"],
        "required_facts": ["f", "g"], "difficulty": "easy",
    }
    path = tmp_path / "gold.json"
    path.write_text(json.dumps([item]), encoding="utf-8")
    gold = files.read_gold(spark, str(path))
    assert gold.first().asDict() == item
    out = str(tmp_path / "deep" / "er" / "results")
    for _ in range(2):  # the second write replaces the first
        write_results(gold, out)
    assert [r.asDict() for r in spark.read.schema(schemas.GOLD).json(out).collect()] == [item]
    assert files.rubric(spark).count() == 15


def rows_of(frame):
    return sorted((r.id, r.version, r.note) for r in frame.collect())


def test_upsert_replaces_adds_and_is_idempotent(spark):
    stored = spark.createDataFrame([("a", [1.0], 1, "old"), ("b", [1.0], 5, "kept"), ("c", [1.0], 1, "c")], POINTS)
    batch = spark.createDataFrame(
        [("a", [2.0], 1, "a new"), ("b", [2.0], 4, "late"), ("d", [2.0], 1, "first"), ("d", [2.0], 2, "second")], POINTS
    )
    once = upsert(stored, batch)
    assert rows_of(once) == [("a", 1, "a new"), ("b", 5, "kept"), ("c", 1, "c"), ("d", 2, "second")]
    assert rows_of(upsert(once, batch)) == rows_of(once)


def test_dimension_check(spark):
    points = spark.createDataFrame([("a", [1.0, 2.0], 0, ""), ("b", [1.0], 0, ""), ("c", None, 0, "")], POINTS)
    rows = {r.id: (r.dim, r.accepted) for r in dimension_check(points, 2).collect()}
    assert rows == {"a": (2, True), "b": (1, False), "c": (0, False)}


def test_point_table(spark, tmp_path):
    table = PointTable(spark, str(tmp_path / "points"), dim=2)
    assert not table.exists()
    first = spark.createDataFrame([("a", [1.0, 0.0], 1, "one"), ("bad", [1.0], 1, "short")], POINTS)
    assert [r.id for r in table.upsert(first).collect()] == ["bad"]
    second = spark.createDataFrame([("a", [0.0, 1.0], 2, "two"), ("b", [0.0, 1.0], 1, "new")], POINTS)
    for _ in range(2):
        table.upsert(second)
    assert rows_of(table.read()) == [("a", 2, "two"), ("b", 1, "new")]


def test_point_table_writes_only_what_changes(spark, tmp_path):
    table = PointTable(spark, str(tmp_path / "points"), dim=1, buckets=8)
    many = spark.range(200).selectExpr("CAST(id AS STRING) AS id", "array(CAST(id AS FLOAT)) AS embedding", "0L AS version", "'first' AS note")
    table.upsert(many)
    before = table.manifest()
    assert set(before.values()) == {0} and len(before) == 8
    one = spark.createDataFrame([("7", [1.0], 1, "second")] * 90, POINTS)  # one id holds a batch
    for _ in range(2):
        assert table.upsert(one).count() == 0
    after = table.manifest()
    assert sum(after[b] != before[b] for b in after) == 1
    assert dict((r.id, r.note) for r in table.read().collect())["7"] == "second" and table.read().count() == 200

    def broken_off(points):
        """A write that ends between its buckets and its manifest."""
        real, table._path = table._path, lambda *parts: (_ for _ in ()).throw(OSError("lost"))
        try:
            table.upsert(points)
        finally:
            table._path = real

    for lost in (broken_off, lambda p: table.upsert(p.withColumn("note", F.raise_error(F.lit("lost"))))):
        try:
            lost(many.withColumn("version", F.lit(9).cast("bigint")))
            raise AssertionError("the write should have failed")
        except AssertionError:
            raise
        except Exception as error:
            assert "lost" in str(error)
    assert table.manifest() == after and {r.version for r in table.read().collect()} == {0, 1}
    assert table.upsert(many.limit(0)).count() == 0 and table.manifest() == after
    assert table.vacuum() > 0 and table.read().count() == 200 and table.manifest() == after
    table.upsert(many.withColumn("version", F.lit(2).cast("bigint")))
    assert {r.version for r in table.read().collect()} == {2}


def test_empty_point_table(spark, tmp_path):
    table = PointTable(spark, str(tmp_path / "none"), dim=2)
    bad = spark.createDataFrame([("a", [1.0], 0, "short")], POINTS)
    assert [r.id for r in table.upsert(bad).collect()] == ["a"]
    assert not table.manifest()


def test_stream_equals_batch_and_replay_changes_nothing(spark, shop, tmp_path):
    docs = spark.createDataFrame([("returns_policy", "r" * 10)], "id string, text string")
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [(str(n), q) for n, q in enumerate(["medium in stock?", "return", None, "hello", "black size"])]
    questions = spark.createDataFrame(rows, "question_id string, query string")
    questions.repartition(3).write.json(source)

    def answer(batch):
        return A.answer_batch(batch, shop, docs).select("question_id", "answer", "tool_info")

    def run():
        incoming = spark.readStream.schema(questions.schema).option("maxFilesPerTrigger", 1).json(source)
        stream_answers(accepted_requests(incoming), answer, out, check).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("question_id", "answer", "tool_info").collect())

    expected = sorted(tuple(r) for r in answer(accepted_requests(questions)).collect())
    assert run() == expected
    assert run() == expected  # nothing new, nothing twice
    spark.createDataFrame([("9", "refund")], questions.schema).write.mode("append").json(source)
    assert len(run()) == len(expected) + 1
