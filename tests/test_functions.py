import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.operators import chunking, matching, relational, retrieval, stateful
from gritstone.plans import router
from gritstone.sources import files
from gritstone.streaming import windows


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "key"), [("15/9-F-5", "159F5"), ("15/9-f-5", "159F5"), ("15/9-F-5 A", "159F5A"), ("15_9_F_5", "159F5"), ("", "")])
def test_well_key(spark, name, key):
    assert one(spark, T.well_key(F.col("v")), v=name) == key


@pytest.mark.parametrize("key", ["159F5PETROPHYSICAL", "159F5FORMATION", "159F5REPORT"])
def test_suffix(spark, key):
    assert one(spark, T.strip_first_suffix(F.col("v")), v=key) == "159F5"


def test_canonical_and_extracted(spark):
    assert one(spark, T.canonical_well(F.col("v")), v="15_9_F_5") == "15/9-F-5"
    assert one(spark, T.extract_well(F.col("v")), v="what of well 15/9-F-5 there") == "15/9-F-5"
    assert one(spark, T.extract_well(F.col("v")), v="no name here") is None


def test_toc_and_headers(spark):
    assert one(spark, T.is_toc(F.col("v")), v="1 Intro ..... 3\n2 Body ...... 7")
    assert not one(spark, T.is_toc(F.col("v")), v="plain text\nof two lines")
    text = "\n".join(["12", "Page 3 of 4", "Draft", *"abcdefgh"])
    assert one(spark, T.drop_headers_footers(F.col("v")), v=text) == "\n".join("abcdefgh")


def test_redaction(spark):
    assert one(spark, T.redact(F.col("v")), v="mail a.b@c.org password: hunter2") == "mail [EMAIL] password=[REDACTED]"


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_ratio_bounds(a, b):
    assert 0 <= matching.indel_ratio(a, b) <= 100 and matching.indel_ratio(a, a) == 100
    assert matching.indel_ratio(a, b) == matching.indel_ratio(b, a)
    assert matching.partial_indel_ratio(a, a + b) == 100 or not a


def test_route(spark):
    assert one(spark, router.route(F.col("v")), v="What is the depth of Hugin formation in 15/9-F-4?") == "lookup_well_picks"
    assert one(spark, router.route(F.col("v")), v="hello") == "llm"


def test_rerank_merge_and_mmr(spark):
    c = spark.createDataFrame([(1, i) for i in range(4)], "query_id int, idx int")
    got = retrieval.merge_order(c, F.array(F.lit(2), F.lit(9), F.lit(0))).orderBy("place").collect()
    assert [r["idx"] for r in got] == [2, 0, 1, 3]
    v = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0])], "query_id long, doc_id long, score double, embedding array<double>")
    assert [r["doc_id"] for r in retrieval.diversify(v, 2, 0.5).orderBy("place").collect()] == [1, 3]


def test_metrics_edge(spark):
    runs = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id int, doc_id int, rank int")
    none = spark.createDataFrame([], "query_id int, doc_id int")
    r = retrieval.evaluate(runs, none, (1,)).first()
    assert (r["precision"], r["recall"], r["rr"], r["ndcg"]) == (0.0, 0.0, 0.0, 0.0)


def test_bucket_and_cache(spark):
    e = spark.createDataFrame([(i, f"2020-01-01 00:00:{s:02d}", 1) for i, s in enumerate([0, 1, 2, 40])], "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["allowed"] for r in stateful.token_bucket(e, 2).orderBy("event_id").collect()] == [True, True, False, True]
    assert [r["hit"] for r in stateful.cache_replay(e, 1.5).orderBy("event_id").collect()] == [False, True, False, False]


def test_chunks(spark):
    text = " ".join(f"Word{i} " + "x " * 9 + "end." for i in range(30))
    d = spark.createDataFrame([(1, text), (2, "short."), (3, None)], "doc_id long, text string")
    got = chunking.pack_chunks(d.where("text is not null"), size=100, overlap=20, least=20).collect()
    assert {r["doc_id"] for r in got} == {1} and all(r["token_count"] <= 111 for r in got)


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hello")
    (tmp_path / "README.md").write_text("no")
    found = files.discover(spark, str(tmp_path))
    assert [r["text"] for r in found.collect()] == ["hello"]
    assert files.changed(found, found).count() == 0
    (tmp_path / "l.jsonl").write_text('{"id": "1", "text": "Ab 15/9-F"}\n')
    assert files.read_lexical(spark, str(tmp_path / "l.jsonl")).first()["tokens"] == ["ab", "15/9-f"]


def test_stream_matches_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    got = {(r["bin"], r["event_type"]): r["n"] for r in windows.run_once(windows.tumbling(windows.event_stream(spark, str(tmp_path / "in"))), "tumbled").collect()}
    batch = e.groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes").alias("w"), "event_type").count().collect()
    want = {(r["w"]["start"], r["event_type"]): r["count"] for r in batch}
    assert got.items() <= want.items() and len(want) - len(got) <= 5  # windows that the watermark has not passed
    assert windows.run_once(windows.deduplicated(windows.event_stream(spark, str(tmp_path / "in"))), "once").count() == e.count()


def test_sections(spark):
    s = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 1)], "g int, pos int, level int")
    assert [r["end_pos"] for r in relational.section_ends(s, "g", "pos", "level").orderBy("pos").collect()] == [4, 3, 4, None]
