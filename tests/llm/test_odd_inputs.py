"""Columns of any name, odd tables, wide vectors, other tokenizers, sibling licenses, small lattices: against brute force."""

import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from gritstone.llm import ann, licenses, line_dedup, mixing, near_dedup, quality, segmentation, token_output, url_filter
from gritstone.llm import common

#: Names that the operators use inside, in one way or another.
NAMES = (
    "k_", "drop_", "id_", "th_", "drop", "th", "i", "leaf", "key", "n_", "copies", "n_chars_", "hash_of_text", "ID_OF_DROP", "places_of_drop", "n_lines", "n_dropped", "key_of_mix", "id_of_gone", "size_as_stated",
    "size", "bucket", "place", "component_id", "kept", "score", "whole", "regs", "node", "label", "h", "slot", "blk", "first", "need", "order_", "quality", "held_out", "ids", "size_",
)
LINE = "Posted on day {} by {} in the section for news"


@pytest.fixture(scope="module")
def wide(spark):
    texts = [LINE.format(i, w) + f"\nown line {w} with words of its own kind {w}{i}" for i, w in enumerate("abcdef")] + ["", None, "the same text of ten words stands here two times over"] * 2
    rows = [(i, t, "en", "s" if i % 2 else None, len(t or ""), *(f"{n}-{i}" for n in NAMES)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


def carried(table) -> dict:
    return {r["doc_id"]: tuple(r[n] for n in NAMES) for r in table.collect()}


@pytest.mark.parametrize("name", ["lines", "mix", "quality", "near"])
def test_columns_of_any_name(spark, wide, name):
    """Each row that stays carries its own values, and no column comes or goes."""
    model = quality.FactorisationMachine(np.zeros(quality.DIMENSION), np.zeros((quality.DIMENSION, 2)))
    stage = {
        "lines": lambda d: line_dedup.line_dedup(d, counts=False), "mix": lambda d: mixing.mixed_documents(d, block=8), "quality": lambda d: quality.keep_quality(d, model), "near": near_dedup.without_near_duplicates,
    }[name]
    out = stage(wide)
    assert out.columns == wide.columns
    got, want = carried(out), carried(wide)
    assert got and all(want[i] == v for i, v in got.items())
    if name in ("lines", "quality"):
        assert sorted(got) == sorted(want)


def test_pipeline_on_odd_rows(spark, wide, tmp_path):
    """Mixed and sampled rows, over odd, repeated and empty tables: every stage keeps the columns, and no row without cause goes."""
    import corpus_pipeline as p

    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (wide, wide.unionByName(wide), wide.limit(0), wide.select("doc_id", "text", "lang", "source", "n_chars")):
        docs = table
        for name, stage in p.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, str(tmp_path)), "test")
            assert docs.columns == table.columns, name
        out = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(out) == docs.count() and all(r["round_trip"] for r in out)
        assert all(len(r["ids"]) == r["n_samples"] and [len(x) for x in r["ids"]] == r["n_ids"] for r in out)
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() > 0


def test_scratch_tables_go(spark):
    """Tables of a block go with it, but for those that are kept; a cluster without a shared folder is refused."""
    exists = lambda d: spark._jvm.org.apache.hadoop.fs.Path(d.inputFiles()[0]).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(d.inputFiles()[0]))
    with common.scratch(spark):
        with common.scratch(spark):
            gone, kept = common.stored(spark.range(3), "a"), common.stored(spark.range(3), "b", keep=True)
            file = gone.inputFiles()[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and exists(kept)

    unset = type("Unset", (), {"get": lambda self, *a: None})()
    cluster = type("Context", (), {"master": "spark://somewhere:7077", "getConf": lambda self: unset})()
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(type("Session", (), {"conf": unset, "sparkContext": cluster})())


def test_wide_vectors(spark):
    """Bounds hold for vectors of any width: plus and minus one, whose products are all alike."""
    rng = np.random.default_rng(3)
    x = rng.choice([-1.0, 1.0], size=(60, 2500))
    assert (ann.whole_products(x[:5].astype(np.float32) * 127, (x.T * 127).astype(np.float32)) == (x[:5] @ x.T) * 127 * 127).all()
    d = spark.createDataFrame([(i, v.tolist(), f"c{i}") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    got: dict = {}
    for r in ann.nearest_neighbours(d, query_block=2, candidate_block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in (0, 20, 40):
        assert got[q] == [i for _, i in sorted((-float(x[q] @ x[i]), i) for i in range(60) if i != q)[:20]]


def test_other_tokenizers(spark):
    """A file that may not be cut is asked for whole texts."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_output.may_be_cut(public_tokenizers.path("word_bpe_49k.json")) and not token_output.may_be_cut(path)
    texts = ["Two  Words.", "a.b, c\n\nd", "", None, " lead", "x <|endoftext|> y", "É " * 40]
    tok = Tokenizer.from_file(path)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_output.read_tokens(token_output.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (len(ids), __import__("zlib").crc32(ids.tobytes()))


def license_names(text: str) -> list[str]:
    return [f.name for f in licenses.Scanner().scan("some words before it. " + text + " and some words after it")]


def test_license_siblings():
    """Texts that differ in a word or two have their own names; one without a template has none."""
    known = {t.name: t.text for t in licenses.TEMPLATES}
    for name, text in known.items():
        assert license_names(text) == [name]
    gpl = known["GPL-3.0-or-later"]
    assert license_names(gpl.replace("version 3", "version 2")) == ["GPL-2.0-or-later"]
    assert license_names(gpl.replace("version 3", "version 1")) == []
    assert license_names(gpl.replace("GNU General", "GNU Lesser General")) == ["LGPL-3.0-or-later"]
    assert license_names(known["CC-BY-4.0"].replace("Attribution", "Attribution-ShareAlike")) == ["CC-BY-SA-4.0"]
    assert license_names("Released under the BSD License.") == ["BSD-short"]
    assert license_names("Licensed under the Apache License, Version 1.1.") == []
    bsd2 = known["BSD-2-Clause"]
    assert license_names(bsd2) == ["BSD-2-Clause"] and license_names(bsd2.replace("THIS SOFTWARE IS PROVIDED", licenses._BSD_NAME + " THIS SOFTWARE IS PROVIDED", 1)) == ["BSD-3-Clause"]


def test_license_alignment_is_a_common_subsequence():
    """What is aligned is never more than the longest common subsequence, and all of it where words do not repeat."""

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(8)
    for _ in range(300):
        a = [str(w) for w in rng.permutation(14)[: rng.integers(1, 14)]]
        b = [str(w) for w in rng.permutation(14)[: rng.integers(1, 14)]]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        assert len(pairs) <= longest(a, b) and (len(pairs) == longest(a, b) or len(pairs) >= 1)
        c = [str(w) for w in rng.integers(0, 5, 9)]
        assert len(licenses.patience(a, c)) <= longest(a, c)


def test_sampling_against_enumeration():
    """All segmentations of a short part: their chances, first and second draws without replacement, and inclusion."""
    pieces = segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    text = "cat"
    part = segmentation.SPACE + text
    weight = {}
    for length, (_, ids, w, _) in pieces.by_length.items():
        for i, x in zip(ids.tolist(), w.tolist(), strict=True):
            weight[pieces.model.id_to_piece(i)] = (i, x, length)

    def ways(rest: str):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight:
                i, w, _ = weight[rest[:n]]
                for ids, s in ways(rest[n:]):
                    yield (i, *ids), w + s

    every = dict(ways(part))
    total = math.log(sum(map(math.exp, every.values())))
    chance = {k: math.exp(v - total) for k, v in every.items()}
    keys = np.random.default_rng(4).integers(0, 2**63, 20000).tolist()
    found = segmentation.sampled(pieces, [text] * len(keys), keys, 2)
    for s in itertools.chain.from_iterable(found[:200]):
        assert math.exp(s.logp) == pytest.approx(chance[tuple(s.ids)], rel=1e-9)
    first = Counter(tuple(f[0].ids) for f in found)
    both = Counter((tuple(f[0].ids), tuple(f[1].ids)) for f in found)
    for k, p in sorted(chance.items(), key=lambda x: -x[1])[:4]:
        assert first[k] / len(keys) == pytest.approx(p, abs=0.015)
    third = Counter(tuple(f[2].ids) for f in segmentation.sampled(segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 6.0), [text] * 4000, keys[:4000], 3))
    warm = {k: math.exp(v / 6) for k, v in every.items()}
    warm = {k: v / sum(warm.values()) for k, v in warm.items()}
    for k in sorted(warm, key=warm.get)[-4:]:
        want = sum(warm[a] * warm[b] / (1 - warm[a]) * warm[k] / (1 - warm[a] - warm[b]) for a, b in itertools.permutations(warm, 2) if k not in (a, b))
        assert third[k] / 4000 == pytest.approx(want, abs=0.03)
    for a, b in itertools.permutations(sorted(chance, key=chance.get, reverse=True)[:3], 2):
        assert both[a, b] / len(keys) == pytest.approx(chance[a] * chance[b] / (1 - chance[a]), abs=0.015)
    weights = [math.exp(s.logp) / s.inclusion for f in found for s in f]
    assert sum(weights) / len(keys) == pytest.approx(1, abs=0.02)
    few = segmentation.sampled(pieces, [text], [7], len(chance) + 5)[0]
    assert {tuple(s.ids) for s in few} == set(chance) and all(s.inclusion == 1.0 for s in few)


def test_url_rule_lists(spark):
    """Rules from lines; odd urls, repeated rows, long urls and columns of clashing names."""
    rules = url_filter.read_rules(["# a list", "", "block bad.org", "allow bad.org/good/", r"block ~ pills ~ \bpills\b ~ pills"])
    assert [(r.name, r.verdict) for r in rules] == [("bad.org/", "block"), ("bad.org/good/", "allow"), ("pills", "block")]
    for line in ("bad.org", "block", "block ~ x ~ y", "allow ---"):
        with pytest.raises(ValueError, match="line 1"):
            url_filter.read_rules([line])
    urls = ["http://bad.org/x", "http://a.bad.org/good/1", "http://c.com/Pills", "http://c.com/x" + "y" * 20000, None, "http://bad.org/x", "://", "http://c.com/%zz?[("]
    d = spark.createDataFrame([(i, u, "host", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, tokens string")
    got = [(r["matched_by"], r["verdict"]) for r in url_filter.url_filter(d, rules).orderBy("page_id").collect()]
    assert got == [("bad.org/", "block"), ("bad.org/good/", "allow"), ("pills", "block"), (None, "allow"), (None, "allow"), ("bad.org/", "block"), (None, "allow"), (None, "allow")]
    assert {r["verdict"] for r in url_filter.url_filter(d, [], default="block").collect()} == {"block"}


def test_repeated_labels(spark):
    """A repeated or contradicting label, and repeated rows of a labelled document, leave the sample bounded and reruns alike."""
    docs = spark.createDataFrame([(1, "good words here", 15)] * 50 + [(1, "other words", 3), (2, "bad bad", 7), (3, None, None)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    one, two = quality.train(docs, labels), quality.train(docs.orderBy("text"), labels.orderBy("quality"))
    assert (one.w == two.w).all() and one.bias == two.bias
