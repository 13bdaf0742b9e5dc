"""The queries over conversations carry whole texts."""

from gritstone.plans import catalog


def test_whole_messages(spark, tmp_path):
    long = "a message that says the same for its first forty characters and more, then "
    rows = [(1, 0, "user", long + "one"), (1, 1, "assistant", "yes"), (1, 2, "user", long + "two"), (2, 0, "user", long + "three"), (2, 1, "assistant", "no")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    latest = catalog.QUERIES["latest_user_message"](spark, str(tmp_path)).collect()
    assert {r["conv_id"]: r["latest"] for r in latest} == {1: long + "two", 2: long + "three"}
    held = catalog.QUERIES["conversation_context"](spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["turn"]): r["ctx"] for r in held} == {(1, 0): long + "one", (1, 1): long + "one", (1, 2): long + "two", (2, 0): long + "three", (2, 1): long + "three"}
