"""The training-data operators on small tables: brute force, exact round trips, and odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gritstone.llm import ann, exact_dedup, licenses, line_dedup, mixing, near_dedup, quality, segmentation, token_output, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, drop string, k_ string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20000))
ODD = [(1, None), (2, ""), (3, "a b\tc"), (4, "a b c"), (4, "a b c"), (5, LONG), (6, LONG + " tail"), (None, "a  b c"), (7, " \n "), (8, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None if n % 3 else "s", None, "x", None) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_exact(spark, odd, empty, docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for digest_all in (True, False):
        got = exact_dedup.exact_dedup(odd, digest_all=digest_all).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == Counter(
            {(1, 1, 2, True): 1, (2, 1, 2, False): 1, (3, 3, 4, True): 1, (4, 3, 4, False): 2, (None, 3, 4, False): 1, (5, 5, 1, True): 1, (6, 6, 1, True): 1, (7, 7, 1, True): 1, (8, 8, 1, True): 1}
        )
        assert exact_dedup.exact_dedup(empty, digest_all=digest_all).count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in exact_dedup.exact_dedup(docs, digest_all=True).collect():
        assert r["text_sha256"] == hashlib.sha256(norm(texts[r["doc_id"]]).encode()).hexdigest()


def near_by_force(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near(spark, odd, empty, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for words, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(docs, words, percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_by_force(rows, words, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd, 3, 85).collect())
    assert got == Counter({(1, 1, True): 1, (2, 2, True): 1, (3, 3, True): 1, (4, 3, False): 2, (None, None, True): 1, (5, 5, True): 1, (6, 5, False): 1, (7, 7, True): 1, (8, 8, True): 1})
    assert near_dedup.near_duplicates(empty).count() == 0


def test_crowded_buckets(spark):
    """Many texts that are alike, some linked, some not: more than a piece holds."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(1, 9)):
            w[j] = f"v{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(d, 3, 85).collect()}
    assert got == near_by_force(rows, 3, 85)


def test_registers_estimate():
    rng = np.random.default_rng(1)
    for n in (1, 7, 60, 3000):
        whole = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(whole[: n + n // 2]), np.unique(whole[n // 2 :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        regs = near_dedup.hyperminhash([a, b], 2000)
        near = near_dedup.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(near - true) < 0.06


def test_lines(spark, odd, empty):
    line = lambda who: f"Posted on day 12 by {who} in the section for news"
    rows = [(1, "first own line here\n" + line("ann")), (2, line("bob") + "\nanother own line now"), (3, "x\n" + line("cy")), (4, "Page 3 of 7 here\nmine"), (5, "Page 4 of 9 here"), (6, "Page 10 of 11 here\nPage 1 of 1 here")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("another own line now", 1), 3: ("x", 1), 4: (rows[3][1], 0), 5: ("", 1), 6: ("", 2)}
    assert line_dedup.line_dedup(odd).count() == len(ODD) and line_dedup.line_dedup(empty).count() == 0


def test_lines_with_recurring_fields(spark):
    """Two fields whose values recur: one line stays, whatever the size of the table."""
    for users, topics in ((4, 4), (12, 9)):
        lines = [f"This entry was posted by u{chr(97 + u)} in t{chr(97 + t)} on the public board today" for u in range(users) for t in range(topics)]
        prose = [f"This entry was {' '.join(f'q{chr(97 + i)}{chr(97 + j)}' for j in range(10))}" for i in range(5)]
        d = spark.createDataFrame(list(enumerate(lines + prose)), "doc_id long, text string")
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(d).collect()}
        assert [i for i, n in got.items() if not n and i < len(lines)] == [0]
        assert all(got[len(lines) + i] == 0 for i in range(len(prose)))


def test_lines_of_rare_variants(spark):
    """Two rare variants of a line that stands in many documents go with it."""
    line = lambda who: f"Posted on the board by {who} in the news"
    rows = [*enumerate([line("ann")] * 20), (20, line("bob")), (21, line("cy"))]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i > 0) for i in range(22)}


def test_short_and_long_lines(spark):
    """Short lines that recur as they are go, those that differ in digits or are empty stay; a long line goes from the second document on."""
    passage = " ".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    rows = [(i, f"All rights reserved.\nNo. {i}\n\nown{chr(97 + i)}") for i in range(4)] + [(4, "before\n" + passage), (5, passage + "\nafter"), (6, "just two here once"), (7, "just two here once")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {0: (rows[0][1], 0), **{i: (f"No. {i}\n\nown{chr(97 + i)}", 1) for i in (1, 2, 3)}, 4: (rows[4][1], 0), 5: ("after", 1), 6: (rows[6][1], 0), 7: (rows[7][1], 0)}
    assert got == want


def test_quality(spark, odd, empty, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(big, labels)
    rows = quality.score_quality(big, model).where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    bad, good = ([r["score"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    got = quality.score_quality(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.score_quality(empty, model).count() == 0
    assert {r["score"] for r in quality.score_quality(odd, quality.train(empty, labels.limit(0))).collect()} == {0.5}
    kept = quality.keep_quality(odd, model)
    assert kept.columns == odd.columns


def test_machine_identity():
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(rng.normal(size=quality.DIMENSION), rng.normal(size=(quality.DIMENSION, 3)), 0.3)
    i, x = np.array([3, 9, 70]), np.array([0.5, -1.0, 2.0])
    pairs = sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(3) for b in range(a))
    z, _ = m.raw(i, x, np.array([0]))
    assert z[0] == pytest.approx(0.3 + float(m.w[i] @ x) + pairs)


def test_tokens(spark, odd, empty, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for table in (docs, odd):
        rows = sorted(((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0]))
        want, start = [], 0
        for i, t in rows:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        got = token_output.read_tokens(token_output.write_tokens(table, path, block_tokens=5000)).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want)
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == start
            start += r["n_tokens"]
        known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
        assert known == sorted(known)
    assert token_output.read_tokens(token_output.write_tokens(empty, path)).count() == 0


def test_value_code():
    v = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(v) + 1):
        control, data = token_output.encode_values(v[:n])
        assert token_output.decode_values(control, data, n).tolist() == v[:n].tolist()


def test_licenses(spark, odd, empty):
    apache = {t.name: t.text for t in licenses.TEMPLATES}["Apache-2.0"]
    words = apache.split()
    cut = " ".join(w for n, w in enumerate(words) if n % 9)  # a ninth of the words is gone
    rows = [(1, "prose before. " + apache + " prose after"), (2, "x " * 300 + cut), (3, "Released under the MIT License.\nmore\nReleased under the MIT License."), (4, "the license of this work is open"), (5, None)]
    got = {r["doc_id"]: [(x["license"], x["coverage"]) for x in r["licenses"]] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("Apache-2.0", 1.0) in got[1] and "Apache-2.0" in dict(got[2]) and got[4] == [] and got[5] == []
    assert "MIT-short" in dict(got[3])
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(empty).count() == 0
    assert licenses.patience(list("abcxyz"), list("abdyz")) == [(0, 0), (1, 1), (4, 3), (5, 4)]


def test_license_copies():
    """Each copy is found once, alone in a text, back to back, damaged or between words."""
    scanner = licenses.Scanner()
    for name in ("MIT-short", "Apache-2.0", "MIT", "ISC"):
        text = {t.name: t.text for t in licenses.TEMPLATES}[name]
        whole = licenses.license_words(text)
        n = len(whole)
        damaged = [w for i, w in enumerate(whole) if i != n // 3]
        changed = [w if i != 4 * n // 5 else "other" for i, w in enumerate(whole)]
        for copies in ([whole] * 2, [whole] * 3, [whole] * 7, [damaged, changed], [changed, damaged, whole], [damaged] * 4):
            for between in ([], ["more"], ["words"] * 2 * n):
                for edge in ([], ["prose"] * 50):
                    words, spans = list(edge), []
                    for c in copies:
                        spans.append((len(words), len(words) + len(c)))
                        words += [*c, *between]
                    found = sorted((f for f in scanner.scan(" ".join(words + edge)) if f.name == name), key=lambda f: f.start)
                    near = [abs(f.start - a) + abs(f.end - b) <= 2 + n // 10 for f, (a, b) in zip(found, spans, strict=False)]
                    assert len(found) == len(copies) and all(near), (name, len(between), len(edge), found, spans)


def test_license_copies_of_rows(spark):
    d = spark.createDataFrame([(3, "Released under the MIT License.\nmore\nReleased under the MIT License.")], "doc_id long, text string")
    (row,) = licenses.scan_licenses(d).collect()
    assert [(x["license"], x["start"], x["end"]) for x in row["licenses"]] == [("MIT-short", 0, 5), ("MIT-short", 6, 11)]


def test_segmentations(spark, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = segmentation.Pieces(path)
    text = "the cat"
    keys = np.random.default_rng(3).integers(0, 2**63, 4000).tolist()
    found = segmentation.sampled(pieces, [text] * len(keys), keys, 3)
    logp = {tuple(s.ids): s.logp for f in found for s in f}
    first = Counter(tuple(f[0].ids) for f in found)
    for ids, n in first.most_common(3):
        assert n / len(keys) == pytest.approx(np.exp(logp[ids]), abs=0.03)
    assert sum(np.exp(s.logp) / s.inclusion for f in found for s in f) / len(keys) == pytest.approx(1, abs=0.02)
    assert all(len({tuple(s.ids) for s in f}) == 3 and f[0].perturbed > f[1].perturbed > f[2].perturbed for f in found)
    for t in ("a  b\n\nc 中\U0001f600 é", " x ", "\n", "a"):
        for s in segmentation.sampled(pieces, [t], [5], 3)[0]:
            assert pieces.decode(s.ids).decode() == t == pieces.model.decode(s.ids.tolist())
    rows = segmentation.sample_segmentations(odd, path).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
    assert rows == segmentation.sample_segmentations(odd, path).collect()
    assert segmentation.sample_segmentations(empty, path).count() == 0


def test_mix(spark, odd, empty, docs):
    for table in (docs, odd):
        got = mixing.mix(table, block=64).totals().collect()
        assert len(got) == table.count()
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        by = {}
        for r in got:
            by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
        assert all(sum(v) == int(t) for (s, t), v in by.items())
        assert sum(t for _, t in by) == pytest.approx(sum(r["size"] for r in got))
        assert Counter(got) == Counter(mixing.mix(table, block=64).totals().collect())
    plan = mixing.mix(docs, block=64)
    pieces = plan.pieces().groupBy("doc_id").agg({"to_word": "sum", "from_word": "sum"}).collect()
    assert {r["doc_id"]: r["sum(to_word)"] - r["sum(from_word)"] for r in pieces} == {r["doc_id"]: r["taken"] for r in plan.totals().collect() if r["taken"]}
    assert mixing.mix(empty).totals().count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_urls(spark):
    urls = ["http://a.Example.NET/en/x", "http://example.net/de/", "http://net/", "http://xnet/", "x", None, "", "https://example.com/de/?q", "https://m.org/fr/1#a", "https://m.org/f", "http://a.net", "http://a.b/wp-login.php"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "block")]
    got = url_filter.url_filter(d).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == want
    assert got[0]["host"] == "a.example.net" and got[0]["path"] == "/en/x" and got[4]["host"] == ""
    assert url_filter.url_filter(d.limit(0)).count() == 0


def test_urls_in_upper_case(spark):
    urls = ["http://x.com/Casino/", "http://x.com/SETUP.EXE", "http://x.com/WP-Login.php?A", "http://example.com/DE/", "http://example.com/de/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rules in (None, url_filter.default_rules() + [url_filter.host_rule(f"h{i}.org/", "block") for i in range(3000)]):
        got = url_filter.url_filter(d, rules).orderBy("page_id").collect()
        assert [(r["matched_by"], r["verdict"]) for r in got] == [("casino", "block"), ("executable", "block"), ("wp-login", "block"), (None, "allow"), ("example.com/de/", "block")]
        assert got[1]["path"] == "/SETUP.EXE"


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(300)] + [(300, None), (320, [0.0] * 8), (340, [1.0, None, *[0.0] * 6]), (360, [float("nan"), *[1.0] * 7]), (None, [1.0] * 8), (380, [float("inf")] * 8)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    use = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v)).all() and np.any(v)]
    want = {}
    for q, x in use:
        if q % 20 == 0:
            want[q] = [i for _, i in sorted((-float(x @ y), i) for i, y in use if i != q)[:20]]
    got: dict = {}
    for r in ann.nearest_neighbours(d, query_block=7, candidate_block=50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want
    assert ann.nearest_neighbours(d.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = p.stored(stage(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
    out = p.run(spark, SF)
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
