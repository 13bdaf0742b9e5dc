"""Matching, state, chunking, files and retrieval on small tables: against brute force and worked examples."""

import itertools
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.functions import wells
from gritstone.operators import chunking, lookup, matching, relational, retrieval, stateful
from gritstone.plans import router
from gritstone.sources import files
from gritstone.streaming import windows


def slow_ratio(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_scorers():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc d"), rng.integers(0, 9))) for _ in range(60)]
    for a, b in itertools.product(texts, texts):
        assert matching.indel_ratio(a, b) == pytest.approx(slow_ratio(a, b))
        x, y = sorted((a, b), key=len)
        windows_ = [slow_ratio(x, y[i:j]) for i in range(len(y)) for j in range(i + 1, len(y) + 1) if j - i == len(x) or (j - i < len(x) and (i == 0 or j == len(y)))]
        if a and b and len(a) != len(b):
            assert matching.partial_indel_ratio(a, b) == pytest.approx(max(windows_))
        assert matching.partial_indel_ratio(a, b) == pytest.approx(matching.partial_indel_ratio(b, a))
    assert matching.weighted_ratio("15/9-F-4", "15/9-F-4") == 100 and matching.weighted_ratio("", "a") == 0
    assert matching.token_ratio("b a", "a b") == 100 and matching.weighted_ratio("hugin", "the hugin formation of the field") == pytest.approx(90)


def test_best_terms(spark):
    """Blocks and bounds lose no pair."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcde"), rng.integers(1, 9)))
    asked, terms = sorted({word() for _ in range(70)}), sorted({word() for _ in range(90)})
    q, t = spark.createDataFrame([(a,) for a in asked], "q string"), spark.createDataFrame([(x,) for x in terms], "t string")
    for score, floor in ((matching.indel_ratio, 60), (matching.partial_indel_ratio, 70), (matching.weighted_ratio, 0)):
        got: dict = {}
        for r in matching.best_terms(q, t, "q", "t", score, 3, floor, block=16).collect():
            got.setdefault(r["q"], set()).add((r["t"], round(r["score"], 6)))
        for a in asked:
            best = sorted((-score(a, x), x) for x in terms if score(a, x) >= floor)[:3]
            assert got.get(a, set()) == {(x, round(-s, 6)) for s, x in best}


def test_formations_and_labels(spark):
    names = spark.createDataFrame([("Hugin",), ("Sleipner",), ("Ty",), ("Ekofisk Fm.",)], "formation string")
    asked = spark.createDataFrame([(1, "the hugin formation"), (2, "sleipmer"), (3, "nothing alike"), (4, ""), (5, "ekofisk"), (6, None)], "id int, q string")
    got = {r["id"]: r["formation"] for r in matching.resolve_formation(asked, names, "q", "formation", "id").collect()}
    assert got == {1: "Hugin", 2: "Sleipner", 5: "Ekofisk Fm."}
    got = {r["id"]: r["matched"] for r in matching.match_formation(spark.createDataFrame([(1, "HUGIN"), (2, "Sleipnr"), (3, "x")], "id int, f string"), names, "f", "formation", "id").collect()}
    assert got == {1: "Hugin", 2: "Sleipner"}
    labels = spark.createDataFrame([("NO 15/9-F-4",), ("NO 15/9-F-14",), ("NO 15/9-19 A",)], "well string")
    got = {r["id"]: r["well"] for r in matching.match_label(spark.createDataFrame([(1, "15/9-F-4"), (2, "15/9-19A"), (3, "zzz")], "id int, w string"), labels, "w", "well", "id").collect()}
    assert got[2] == "NO 15/9-19 A" and got[1] in ("NO 15/9-F-4", "NO 15/9-F-14") and 3 not in got
    got = {r["id"]: r["matched"] for r in matching.match_well(spark.createDataFrame([(1, "15_9-F-4 A"), (2, "zz")], "id int, w string"), spark.createDataFrame([("15/9-F-4",), ("15/9-19 A",)], "well string"), "w", "well", "id").collect()}
    assert got == {1: "15/9-F-4"}


def test_accept_or_ask(spark):
    s = spark.createDataFrame([(1, "a", 95.0), (1, "b", 80.0), (2, "a", 95.0), (2, "b", 90.0), (3, "a", 40.0)], "g int, t string, score double")
    got = {r["g"]: (r["accepted"], r["choices"]) for r in matching.accept_or_ask(s, "g", "t", 90, 8).collect()}
    assert got == {1: ("a", []), 2: (None, ["a", "b"]), 3: (None, ["a"])}


def test_properties_and_entities(spark):
    asked = spark.createDataFrame([(1, "matrx densty here"), (2, "porosity"), (3, "zzzz"), (4, "flud density")], "id int, q string")
    got = {r["id"]: r["property"] for r in matching.resolve_property(asked, "q", "id").collect()}
    assert got[1] == "matrix_density" and got[2] == "phif" and got[3] is None and got[4] == "fluid_density"
    known = spark.createDataFrame([("15/9-F-4", ["Hugin", "Ty"]), ("15/9-F-5", ["Sleipner"])], "well string, formations array<string>")
    asked = spark.createDataFrame([(1, "porosity of hugin in 15/9-F-4"), (2, "porosity of hugin"), (3, "hello 15/9-F-5")], "id int, q string")
    got = {r["id"]: r for r in matching.resolve_entities(asked, known, "q", "id").collect()}
    assert (got[1]["well"], got[1]["formation"], got[1]["property"], got[1]["tool"], got[1]["question_back"]) == ("15/9-F-4", "Hugin", "phif", "lookup_petrophysical_params", None)
    assert got[2]["well"] is None and got[2]["question_back"] and got[3]["property"] is None and got[3]["question_back"]
    chosen = spark.createDataFrame([(2, "15/9-F-4", None, None), (3, None, None, "no such")], "id int, well string, formation string, property string")
    got = {r["id"]: r for r in matching.resolve_entities(asked, known, "q", "id", chosen).collect()}
    assert got[2]["well"] in ("15/9-F-4", None) and got[3]["property"] is None


def test_find_wells(spark):
    stored = spark.createDataFrame([("NO 15/9-F-4",), ("NO 15/9-F-15 A",), ("NO 15/9-19 A",)], "well string")
    asked = spark.createDataFrame([(1, "tops of 15/9-F-4"), (2, "tops of 15/9-F-15"), (3, "tops of 15/9-19"), (4, "no well"), (5, "tops of 15/9-F-4B")], "query_id int, query string")
    got = {r["query_id"]: r["well"] for r in lookup.find_wells(asked, stored, fuzzy=False).collect()}
    assert got == {1: "NO 15/9-F-4", 2: "NO 15/9-F-15 A", 3: "NO 15/9-19 A", 5: "NO 15/9-F-4"}


def test_resolve_file(spark):
    found = spark.createDataFrame([("d/15_9-F-4_R.pdf", "15_9-F-4_R.pdf", True), ("d/b.pdf", "b.pdf", True), ("d/x/c.pdf", "c.pdf", False), ("d/15_9-F-5_old_S.pdf", "15_9-F-5_old_S.pdf", True), ("d/UP.pdf", "UP.pdf", True)], "path string, name string, top boolean")
    asked = spark.createDataFrame([(1, r"..\v\15_9-F-4\R.pdf"), (2, "b.pdf"), (3, "q/c.pdf"), (4, "v/15_9-F-5/S.pdf"), (5, "up.PDF"), (6, "my_b.pdf"), (7, "none.txt")], "ask_id int, asked string")
    got = {r["ask_id"]: (r["rule"], r["path"]) for r in relational.resolve_file(asked, found).collect()}
    assert got == {1: (0, "d/15_9-F-4_R.pdf"), 2: (1, "d/b.pdf"), 3: (2, "d/x/c.pdf"), 4: (3, "d/15_9-F-5_old_S.pdf"), 5: (4, "d/UP.pdf"), 6: (5, "d/b.pdf")}


def test_buckets(spark):
    """The limiter by hand: a refused endpoint call has spent its global token; an idle bucket comes back full."""
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(0, 400, 300)) * 0.5
    ends = [("query", "llm", "other")[i] for i in rng.integers(0, 3, 300)]
    e = spark.createDataFrame([(i, float(t), 7 if i % 2 else 8, x) for i, (t, x) in enumerate(zip(at, ends, strict=True))], "event_id long, t double, user_id long, endpoint string").withColumn("ts", F.timestamp_seconds("t"))
    limits = stateful.endpoint_limits(6)
    assert limits == {"query": 6, "retrieval": 12, "llm": 3}
    got = {r["event_id"]: (r["allowed"], r["refused_by"]) for r in stateful.token_bucket(e, 6, endpoint="endpoint", limits=limits).collect()}
    state: dict = {}

    def take(name, cap, now):
        tokens, last = state.get(name, (cap, now))
        tokens = min(cap, tokens + (now - last) * cap / 60)
        state[name] = (tokens - (tokens >= 1), now)
        return tokens >= 1

    for i, (t, x) in enumerate(zip(at, ends, strict=True)):
        u = 7 if i % 2 else 8
        want = (True, None)
        if not take((u, None), 6, t):
            want = (False, "global")
        elif x in limits and not take((u, x), limits[x], t):
            want = (False, "endpoint")
        assert got[i] == want


def test_bounded_cache(spark):
    rng = np.random.default_rng(5)
    keys, at = rng.integers(0, 6, 200).tolist(), np.cumsum(rng.integers(1, 9, 200)).tolist()
    e = spark.createDataFrame([(i, float(t), "c", k, k == 5) for i, (t, k) in enumerate(zip(at, keys, strict=True))], "event_id long, t double, cache string, k long, value_null boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["event_id"]: r["hit"] for r in stateful.bounded_cache_replay(e, 25, 3, "cache", "k").collect()}
    held: dict = {}  # key: expiry, last use
    for i, (t, k) in enumerate(zip(at, keys, strict=True)):
        if k in held and t > held[k][0]:
            del held[k]
        hit = k in held and k != 5
        assert got[i] == hit
        if hit:
            held[k] = (held[k][0], i)
        else:
            if k not in held and len(held) >= 3:
                del held[min(held, key=lambda x: held[x][1])]
            held[k] = (t + 25, i)


def test_chunk_documents(spark):
    sentence = lambda i, n=12: f"S{i} " + "word " * (n - 2) + "end."
    plain = " ".join(sentence(i) for i in range(20))
    heads = "\n".join(f"{h}\n" + " ".join(sentence(i, 14) for i in range(4)) for h in ("INTRODUCTION A", "RESULTS OF IT", "CONCLUSION NOW", "SUMMARY OF ALL"))
    d = spark.createDataFrame([(1, plain), (2, "dropped before\n" + heads), (3, ""), (4, None), (5, "tiny one.")], "doc_id long, text string")
    rows = chunking.chunk_documents(d, size=60, overlap=20, least=20).orderBy("doc_id", "section_header", "chunk_id").collect()
    one, two = [r for r in rows if r["doc_id"] == 1], [r for r in rows if r["doc_id"] == 2]
    assert {r["doc_id"] for r in rows} == {1, 2} and {r["strategy"] for r in one} == {"semantic"} and {r["strategy"] for r in two} == {"sections"}
    assert {r["section_header"] for r in two} == {"INTRODUCTION A", "RESULTS OF IT", "CONCLUSION NOW", "SUMMARY OF ALL"} and not any("dropped" in r["text"] for r in two)
    assert {i for r in one for i in range(20) if f"S{i} " in r["text"]} == set(range(20))
    assert all(0.1 <= r["confidence"] <= 1 and r["token_count"] >= 20 for r in rows)
    packs = chunking._packed([(f"s{i}", 10, False) for i in range(12)], 50, 30, False)
    assert [len(h) for h, _ in packs][:2] == [5, 5] and packs[1][0][:3] == packs[0][0][-3:] or len(packs) > 1
    stats = chunking.chunk_statistics(chunking.chunk_documents(d, 60, 20)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["total_chunks"]) for r in stats] == [(1, len(one)), (2, len(two))]


def docx(path, paragraphs, table, header):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>')
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}">{p(header)}</w:hdr>')


def test_documents_of_every_kind(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    docx(root / "sub" / "A.docx", ["first", "second"], [["a", "b"], ["c", ""]], "top")
    stream = b"BT /F1 12 Tf (Hello \\(there\\)) Tj T* [(Wo) -20 (rld)] TJ ET"
    for name, data in (("plain.pdf", stream), ("small.PDF", zlib.compress(stream))):
        (root / name).write_bytes(b"%PDF-1.4\n1 0 obj\n<< >>\nstream\n" + data + b"\nendstream\nendobj\n")
    (root / "t.txt").write_bytes(b"text \xff here")
    (root / "old.doc").write_bytes(b"x")
    (root / "Well_picks.dat").write_text("Well NO 15/9-1 A\nWell name  Surface name\nNO 15/9-1 A   Ty Fm. Top   1 NR 10.5 9 -8\n")
    (root / "README.md").write_text("no")
    found = files.discover(spark, str(root))
    docs = {r["filename"]: r for r in files.read_documents(found).collect()}
    assert docs["a.docx"]["text"] == "first\nsecond\n[TABLE]\na | b\nc | \n[HEADER] top" and docs["t.txt"]["text"] == "text  here"
    assert docs["plain.pdf"]["text"] == docs["small.pdf"]["text"] == "Hello (there)\nWorld" and docs["plain.pdf"]["page"] == 0
    assert docs["old.doc"]["warnings"] == ["NO_TEXT_EXTRACTED"] and docs["old.doc"]["method"] == "none" and docs["well_picks.dat"]["is_well_picks"]
    assert [(r["well"], r["formation"], r["md_m"]) for r in files.read_picks(found).collect()] == [("NO 15/9-1 A", "Ty Fm.", 10.5)]
    files.write_documents(files.read_documents(found), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(docs)


def test_best_extraction():
    long, short = lambda c: ["x" * 2000 + " word" * 60], lambda c: ["few"]

    def broken(c):
        raise OSError

    assert files.best_extraction(b"", {"a": short, "b": long}, {"c": broken}, {"o": broken})[0] == "b"
    assert files.best_extraction(b"", {"a": broken}, {"c": short}, {})[:2] == ("c", 0.5)
    assert files.best_extraction(b"", {"a": short}, {}, {"o": lambda c: ["longer text than before"]})[0] == "o"
    assert files.best_extraction(b"", {"a": broken}, {}, {}) == ("none", 0.0, [])


def test_cached_table(spark, tmp_path):
    calls = []

    def parse(f):
        calls.append(sorted(r["path"] for r in f.select("path").collect()))
        return f.select(F.col("path").alias("source"), F.upper("text").alias("row"))

    table = lambda rows: files.cached_table(spark, str(tmp_path / "t"), spark.createDataFrame(rows, "path string, checksum string, text string"), parse, "source string, row string")
    got = lambda df: sorted((r["source"], r["row"]) for r in df.collect())
    assert got(table([])) == []
    assert got(table([("a", "1", "x"), ("b", "1", "y")])) == [("a", "X"), ("b", "Y")]
    assert got(table([("a", "1", "x"), ("b", "1", "y")])) == [("a", "X"), ("b", "Y")] and len(calls) == 1
    assert got(table([("a", "1", "x"), ("b", "2", "z")])) == [("a", "X"), ("b", "Z")] and calls[1] == ["b"]
    assert got(table([("b", "2", "z")])) == [("b", "Z")] and got(table([])) == [("b", "Z")]


def test_stores_and_logs(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "1", "Ab 15/9-F", "s", "well_picks", True), (2, "2", "c", "t", None, False)], "doc_id long, id string, text string, source string, document_type string, is_well_picks boolean")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id long, embedding array<double>")
    assert files.read_vectors(spark, str(tmp_path / "none")) is None
    files.write_vectors(chunks, vectors, str(tmp_path / "v"))
    store = files.read_vectors(spark, str(tmp_path / "v"))
    assert store.count() == 2 and [r["doc_id"] for r in files.fetch(store, picks=True).collect()] == [1] and [r["doc_id"] for r in files.fetch(store, chunks.where("source = 't'")).collect()] == [2]
    files.write_lexical(chunks, str(tmp_path / "l"))
    assert {r["id"]: r["tokens"] for r in files.read_lexical(spark, str(tmp_path / "l")).collect()} == {"1": ["ab", "15/9-f"], "2": ["c"]}
    metrics = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 'm' AS metric, 1.5D AS value, map('a', 'b') AS metadata")
    for _ in range(2):
        files.append_metrics(metrics, str(tmp_path / "log"))
    assert [r["value"] for r in files.read_metrics(spark, str(tmp_path / "log"), 5).collect()] == [1.5, 1.5]
    windows.append_metrics(windows.metric_stream(spark, str(tmp_path / "log")), str(tmp_path / "log2"), str(tmp_path / "cp"))
    assert files.read_metrics(spark, str(tmp_path / "log2"), 5).count() == 2
    files.write_evaluation(vectors, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2


def test_retrieval_shapes(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "delta")], "doc_id long, text string")
    got = retrieval.bm25_top(d, spark.createDataFrame([(1, "alpha")], "query_id int, query string"), 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3] and got[1]["score"] == 0 and got[0]["score"] > 0
    v = spark.createDataFrame([(1, 5, 0.2, [1.0, 0.0], 1), (1, 4, 0.9, [1.0, 0.1], 2)], "query_id long, doc_id long, score double, embedding array<double>, idx int")
    assert [r["doc_id"] for r in retrieval.diversify(v, 2).orderBy("place").collect()] == [5, 4]
    c = spark.createDataFrame([(1, i, 1 - i / 40, [float(i % 3), 1.0], i) for i in range(30)], "query_id long, doc_id long, score double, embedding array<double>, idx int")
    merged = retrieval.merge_diversified(c, 5).orderBy("place").collect()
    assert len(merged) == 24 and len({r["doc_id"] for r in merged}) == 24 and [r["place"] for r in merged] == list(range(1, 25))
    first = [r["doc_id"] for r in retrieval.diversify(c, 10).orderBy("place").collect()]
    assert [r["doc_id"] for r in merged][:10] == first and [r["doc_id"] for r in merged][10:] == [i for i in range(30) if i not in first][:14]
    chunks = spark.createDataFrame([(i, "1 a ..... 2\n2 b ..... 3" if i == 0 else f"word{i} same", [float(i), 1.0]) for i in range(6)], "doc_id long, text string, embedding array<double>")
    lists = spark.createDataFrame([(1, 0, i, 1 - i / 10, i + 1) for i in range(6)], "query_id long, variant int, doc_id long, score double, rank int")
    ask = lambda q: [r["doc_id"] for r in retrieval.hybrid(lists, lists, chunks, spark.createDataFrame([(1, q)], "query_id long, query string"), 3).orderBy("place").collect()]
    assert ask("word3 please")[0] == 3 and 0 not in ask("word3 please") and len(ask("word3 please")) == 3
    chosen = spark.createDataFrame([(1, [2, 99, 0])], "query_id long, chosen array<int>")
    both = [retrieval.hybrid(lists, lists, chunks, spark.createDataFrame([(1, "word3")], "query_id long, query string"), 3, f, chosen=c).orderBy("place").collect() for f, c in (("weighted", None), ("rrf", chosen))]
    assert all(len(b) == 3 for b in both)


def test_graded_and_parts(spark):
    pairs = spark.createDataFrame([("a", "Why?", "x" * 60, 0), ("b", "Why?", "x" * 60, 0), ("c", "Why?", "x", 0)], "key string, question string, context string, rewrites int")
    got = {r["key"]: r["step"] for r in router.graded(pairs, spark.createDataFrame([("a", "Yes"), ("a", "yes")], "key string, verdict string")).collect()}
    assert got == {"a": "answer", "b": "rewrite", "c": "rewrite"}
    asked = spark.createDataFrame([(1, "q"), (2, "r"), (3, "s")], "query_id int, question string")
    model = spark.createDataFrame([(1, True, ["x", "y"], "z"), (2, False, [], "better")], "query_id int, is_complex boolean, sub_queries array<string>, rewritten string")
    got = sorted((r["query_id"], r["n"], r["question"]) for r in router.sub_questions(asked, model).collect())
    assert got == [(1, 0, "x"), (1, 1, "y"), (2, 0, "better"), (3, 0, "s")]
    assert wells.REGISTRY[0][0] == "matrix_density"


def test_loose_wells(spark):
    """F-1 is held by F-11: the join of all wells takes it where no key is the same."""
    picks = spark.createDataFrame([("NO 15/9-F-1", "Hugin Fm."), ("NO 15/9-F-2", "Hugin Fm.")], "well string, formation string")
    petro = spark.createDataFrame([("15/9-F-11", "Hugin", 0.5, 0.2, 0.3, 1.0, 2.0, 3.0, "s", 1, 1, 0)], "well string, formation string, netgros double, phif double, sw double, klogh_a double, klogh_h double, klogh_g double, source string, page_start int, page_end int, row int")
    found = lambda **o: {r["well"]: r["found"] for r in lookup.formation_properties(picks, petro, **o).collect()}
    assert found() == {"NO 15/9-F-1": False, "NO 15/9-F-2": False} and found(by_key=False) == {"NO 15/9-F-1": True, "NO 15/9-F-2": False}
