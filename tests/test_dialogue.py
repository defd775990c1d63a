import pytest
from pyspark.sql import functions as F

from vitrine.operators import answering as A
from vitrine.operators import evaluation as E
from vitrine.operators import routing as R

# Golden questions with the intents (inventory, returns,
# shipping), the slots, the number of inventory matches and the rule expected
# without retrieval.
GOLDEN = [
    ("q001", "Do you ship to Berlin? How long does delivery take?", "s", None, None, None, 1),
    ("q002", "What is your return policy? Can I return items if they don't fit?", "r", None, None, None, 3),
    ("q003", "Do you offer international shipping outside Germany?", "s", None, None, None, 1),
    ("q004", "How can I find my correct size? Do you have a size guide?", "i", None, None, 8, 4),
    ("q005", "What payment methods do you accept?", "", None, None, None, 5),
    ("q006", "I need something for a summer wedding. What do you recommend?", "", None, None, None, 7),
    ("q007", "Do you have plus sizes or XXL options?", "i", None, None, 8, 7),
    ("q008", "Are your outfits suitable for Eid celebrations?", "", None, None, None, 7),
    ("q009", "Do you have the Embroidered Black Shalwar Kameez in size M?", "i", None, "black", 1, 7),
    ("q010", "Which shalwar kameez do you have in white?", "", None, "white", None, 7),
    ("q011", "Is the Green Printed Lawn Suit available in size S?", "i", None, None, 8, 6),
    ("q012", "What is the most expensive item you have?", "", None, None, None, 7),
    ("q013", "I am looking for something casual for everyday wear under 55 EUR. What do you have?", "", None, None, None, 7),
    ("q014", "Do you have any wool or warm items for winter?", "", None, None, None, 7),
    ("q015", "Which items are good for formal events or weddings?", "", None, None, None, 7),
    ("q016", "I need a black outfit for an evening event, but I wear size L. What can you offer?", "i", None, "black", 1, 7),
    ("q017", "I want to buy a gift for a friend who likes pastel colors and casual styles. What do you suggest?", "", None, None, None, 7),
    ("q018", "Are there any items that are currently out of stock in some sizes but available in others?", "i", None, None, 8, 6),
    ("q019", "I have a budget of 80 EUR and need something formal. What are my options?", "", None, None, None, 7),
    ("q020", "Which items are suitable for both casual and festive occasions?", "", None, None, None, 7),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(g[0], g[1]) for g in GOLDEN], "question_id string, query string")


@pytest.fixture(scope="module")
def policies(spark):
    rows = [("returns_policy", "Returns: " + "r" * 400), ("shipping_policy", "We send parcels.")]
    return spark.createDataFrame(rows, "id string, text string")


def test_routing_of_the_golden_questions(golden):
    rows = {r.question_id: r for r in R.route(golden).collect()}
    for key, _, flags, size, color, _, _ in GOLDEN:
        r = rows[key]
        assert (r.wants_inventory, r.wants_returns, r.wants_shipping) == tuple(c in flags for c in "irs"), key
        assert (r.size, r.color) == (size, color), key


def test_size_slot_needs_blanks_and_an_order(spark):
    asked = ["size M?", "size m please", "Large or medium", "a SMALL one", " l and s ", "large s ", None]
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "n int, query string")
    slots = [r[0] for r in frame.orderBy("n").select(R.slot_size(F.col("query"))).collect()]
    assert slots == [None, "M", "M", "S", "L", "L", None]


def test_answers_without_retrieval(golden, shop, policies):
    rows = {r.question_id: r for r in A.answer_batch(golden, shop, policies).collect()}
    assert len(rows) == 20
    for key, _, _, _, _, matches, rule in GOLDEN:
        r = rows[key]
        assert r.answer == A.RETAIL_RULES[rule - 1][1], key
        assert r.sources == [] and r.context_chunks == []
        if matches is not None:
            assert f"found {matches} matching items" in r.tool_info
    assert rows["q009"].tool_info == "Inventory check: found 1 matching items. Examples: Item 2."
    assert rows["q004"].tool_info == "Inventory check: found 8 matching items. Examples: Item 1, Item 2."
    assert rows["q001"].tool_info == "\nShipping policy excerpt:\nWe send parcels...."
    assert rows["q002"].tool_info == "\nReturns policy excerpt:\n" + ("Returns: " + "r" * 400)[:300] + "..."
    assert rows["q012"].tool_info == ""


def test_tool_texts_in_order_and_fallbacks(spark, shop, policies):
    asked = spark.createDataFrame(
        [("all", "stock of medium black, return and ship"), ("none", "is a small white one in stock"), ("gap", "refund")],
        "question_id string, query string",
    )
    only_black = shop.filter("sku = 'SK-002'")
    rows = {r.question_id: r.tool_info for r in R.add_tools(asked, R.inventory_texts(only_black), policies).collect()}
    assert rows["all"].startswith("Inventory check: found 1 matching items. Examples: Item 2.\nReturns policy excerpt:\n")
    assert rows["all"].endswith("\nShipping policy excerpt:\nWe send parcels....")
    assert rows["none"] == R.NO_MATCH
    missing = {r.question_id: r.tool_info for r in R.add_tools(asked, R.inventory_texts(shop), policies.filter("false")).collect()}
    assert missing["gap"] == "\nReturns policy excerpt:\nPolicy 'returns_policy' not found...."


def test_every_rule_is_reachable_on_bare_text(spark):
    texts = [
        "Ship to BERLIN", "ship outside", "exchange", "measure my size", "paying", "available?", "I need", "hello",
        "size", "ship",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    rules = [r[0] for r in frame.orderBy("n").select(A.rule_number(F.col("t"))).collect()]
    assert rules == [1, 2, 3, 4, 5, 6, 7, 8, 8, 8]


HITS = "question_id string, rank int, id string, source_type string, text string, score double"


def test_prompt_and_context(spark, shop, policies):
    asked = spark.createDataFrame([("a", "s1", "hello"), ("b", None, "hi")], "question_id string, session_id string, query string")
    hits = spark.createDataFrame([("a", 2, "y", "product", "two", 0.1), ("a", 1, "x_chunk_0", "policy", "one", 0.2)], HITS)
    row = {r.question_id: r for r in A.answer_batch(asked, shop, policies, hits, step=lambda df: df.withColumn("answer", F.col("prompt"))).collect()}
    assert row["a"].sources == ["x_chunk_0", "y"] and row["a"].session_id == "s1"
    assert row["a"].answer == (
        A.SYSTEM_TEXT + "\n\nContext:\n[policy] x_chunk_0:\none\n\n[product] y:\ntwo\n\nTool info:\n(No tool info)"
        "\n\nQuestion: hello\n\nAnswer:"
    )
    assert "Context:\n(No context retrieved)\n" in row["b"].answer
    answers = A.answer_batch(asked, shop, policies, hits)
    chat = {r.question_id: r for r in A.chat_projection(answers).collect()}
    assert chat["a"].sources == ["x_chunk_0", "y"] and chat["b"].sources == []
    with pytest.raises(ValueError):
        A.answer_step("nobody")


def test_requests_and_sessions(spark):
    requests = spark.createDataFrame([("a", None), (None, "s"), ("", "s")], "query string, session_id string")
    accepted, rejected = R.validate_requests(requests)
    assert accepted.count() == 2 and rejected.count() == 1
    turns = spark.createDataFrame([("s", 1, "old"), ("s", 10, "new"), ("s", 9, "mid"), ("t", 1, "only")], "session_id string, turn long, answer string")
    assert {r.session_id: r.answer for r in A.latest_per_session(turns).collect()} == {"s": "new", "t": "only"}


def test_retrieval_feeds_the_answer(spark, shop, policies):
    from vitrine.operators import corpus

    chunks = corpus.corpus(shop, policies)
    asked = spark.createDataFrame([("a", "Please send it"), ("b", "some wool blend."), ("c", "qqq")], "question_id string, query string")
    answers = {r.question_id: r for r in A.answer_batch(asked, shop, policies, A.retrieve(asked, chunks, 3)).collect()}
    assert answers["a"].sources == ["shipping_policy_chunk_0"]
    assert answers["b"].sources[0] == "SK-005"
    assert answers["b"].answer == A.RETAIL_RULES[5][1]  # a product chunk brings in "Stock:"
    assert answers["c"].sources == []


def test_run_eval_fields(spark, shop, policies):
    gold = spark.createDataFrame(
        [("q1", "Do you ship?", "yes", "policy", ["shipping_policy"], ["ship"], "easy")],
        "id string, question string, expected_answer string, source_type string, source_ids array<string>, required_facts array<string>, difficulty string",
    )
    result = E.run_eval(gold, shop, policies)
    assert result.columns == ["id", "question", "expected_answer", "predicted_answer", "retrieved_sources", "required_facts", "difficulty"]
    row = result.first()
    assert row.predicted_answer == A.RETAIL_RULES[0][1] and row.retrieved_sources == [] and row.required_facts == ["ship"]


def test_context_recall(spark):
    corpus = spark.createDataFrame(
        [("p_chunk_0", "policy", ("p",)), ("p_chunk_1", "policy", ("p",)), ("SK-1", "product", (None,))],
        "id string, source_type string, payload struct<policy_id:string>",
    )
    hits = spark.createDataFrame([("a", "p_chunk_0"), ("a", "p_chunk_1"), ("b", "SK-1"), ("c", "SK-1")], "question_id string, id string")
    gold = spark.createDataFrame(
        [("a", "p"), ("a", "other"), ("b", "products"), ("c", "SK-1"), ("d", "p"), ("e", None)], "question_id string, source_id string"
    )
    rows = E.context_recall(gold, E.gold_id_of_hit(hits, corpus)).collect()
    assert {r.question_id: (r.n_expected, r.n_found, r.recall) for r in rows} == {
        "a": (2, 1, 0.5), "b": (1, 1, 1.0), "c": (1, 1, 1.0), "d": (1, 0, 0.0), "e": (0, 0, None),
    }


def test_rollups(spark):
    from vitrine.sources.files import rubric

    scores = spark.createDataFrame([("tone", "easy", 5), ("tone", "hard", 1), ("tone", "hard", 2)], "dimension string, difficulty string, score int")
    rows = {(r.dimension, r.difficulty): (r.n_scores, r.mean_score, r.top_share) for r in E.rubric_rollup(scores, rubric(spark)).collect()}
    assert rows == {("tone", "easy"): (1, 5.0, 1.0), ("tone", "hard"): (1, 1.0, 0.0), ("tone", None): (2, 3.0, 0.5), (None, None): (2, 3.0, 0.5)}
    gold = spark.createDataFrame([("policy", "easy"), ("policy", "hard")], "source_type string, difficulty string")
    assert {(r.source_type, r.difficulty): r.n_items for r in E.gold_profile(gold).collect()} == {
        ("policy", "easy"): 1, ("policy", "hard"): 1, ("policy", None): 2, (None, None): 2,
    }


def test_stream_reads_a_file_or_a_folder_of_files(spark, tmp_path, monkeypatch):
    """Turns in one file, in several files of a folder, and in none."""
    from vitrine.plans import dialogue_plans as D

    monkeypatch.setattr(D, "catalog", lambda *_: None)
    monkeypatch.setattr(D, "policy_documents", lambda *_: spark.range(1))
    monkeypatch.setattr(D, "chunk_index", lambda *_: (None, None))
    monkeypatch.setattr(D.R, "inventory_texts", lambda *_: spark.range(1))
    monkeypatch.setattr(D.A, "retrieve", lambda *_: None)
    filled = [F.lit("x").alias(c) for c in ("answer", "sources", "tool_info", "context_chunks")]
    monkeypatch.setattr(D.A, "answer_batch", lambda batch, *_, **__: batch.select("*", *filled[:1], F.array(F.lit("x")).alias("sources"), *filled[2:]))
    turns = spark.createDataFrame([(i, 1, "user" if i % 2 else "assistant", f"t{i}") for i in range(20)], "conv_id long, turn int, role string, text string")
    turns.repartition(3).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    turns.coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file" / "conversations.parquet")
    turns.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    for folder, expected in (("folder", 10), ("file", 10), ("none", 0)):
        rows = D.stream_answers(spark, f"{tmp_path}/{folder}").collect()
        assert sorted(r["query"] for r in rows) == sorted(f"t{i}" for i in range(1, 2 * expected, 2))
