"""Token ids in binary: ranks by frequency in a byte-aligned variable-length code with separate control bytes.

A file row holds a block of documents: shard, block, first (tokens of the shard before it), doc_ids, lengths (tokens
of each, uint32), control and data. A token is written as its rank by frequency, as 1 to 4 bytes, the fewest that
hold it; `control` has two bits a token for the number of bytes less one, four tokens a byte, the first lowest.
The table of ids by rank is a file of its own. Blocks ascend by (shard, block) in order of doc_id.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritstone.llm.common import scratch, slices, stored

BLOCK_TOKENS = 1 << 16
#: For each control byte: the bytes of its four values, and where each of 16 bytes of output comes from (-1: zero).
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_FIRST = np.cumsum(_SIZES, axis=1) - _SIZES
_SHUFFLE = np.where(np.arange(4) < _SIZES[:, :, None], _FIRST[:, :, None] + np.arange(4), -1).reshape(256, 16)
_TOTAL = _SIZES.sum(axis=1)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return np.bitwise_or.reduce(code, axis=1).tobytes() if len(v) else b"", data.tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    c = np.frombuffer(control, np.uint8)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(17, np.uint8)])
    base = np.cumsum(_TOTAL[c]) - _TOTAL[c]
    take = _SHUFFLE[c]
    out = np.where(take < 0, 0, raw[np.minimum(base[:, None] + take, len(raw) - 1)]).astype(np.uint8)
    return out.reshape(-1).view("<u4")[:count]


# The normaliser and the pre-tokenizer of files whose texts may be cut into parts.
_CUT_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_CUT_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def may_be_cut(path: str) -> bool:
    """Whether the ids of a text are those of its parts: the file lower-cases, drops white space, sets runs of letters, single
    digits and runs of other signs apart, and its special tokens all hold `<|`. Anything else in the file says no."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    steps = (found.get("pre_tokenizer") or {}).get("pretokenizers")
    plain = not any(found.get(k) for k in ("post_processor", "truncation", "padding")) and not (found.get("model") or {}).get("dropout")
    return plain and found.get("normalizer") == _CUT_NORMALIZER and steps == [_CUT_SPLIT, _CUT_BYTES] and all("<|" in t["content"] for t in found.get("added_tokens") or [])


class _WholeTexts:
    """Ids of whole texts, for files of any kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.fromiter((i for f in found for i in f), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


class _Tokens:
    """Ids of the parts of a text between spaces and line feeds: a tokenizer that drops white space makes the same ids of
    the parts as of the whole (see may_be_cut). Forgets all once it holds `most` parts. The tokenizer's encodings take far more
    room than their ids, so those of `at_once` parts are held at a time."""

    def __init__(self, path: str, most: int = 1_500_000, at_once: int = 8192):
        from tokenizers import Tokenizer

        pa.set_cpu_count(1)
        self.tokenizer, self.most, self.at_once = Tokenizer.from_file(path), most, at_once
        self.clear()

    def clear(self) -> None:
        self.known, self.size, self.flat = {}, np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def parts(texts: pa.Array) -> pa.ListArray:
        """A, for the tokenizer, equal text cut at spaces and line feeds: A-Z lower-cased, and a full stop or comma that ends
        a word set apart. Texts in which special tokens may stand are only cut."""
        texts = pc.fill_null(texts, "")
        plain = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        plain = pc.replace_substring_regex(plain, r"(\p{Ll}|[0-9])([.,]) ", r"\1 \2 ")
        return pc.split_pattern(pc.if_else(pc.match_substring(texts, "<|"), pc.replace_substring(texts, "\n", " "), plain), " ")

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number in each text."""
        parts = self.parts(texts)
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.clear()
        unseen = [p for p in distinct if p not in self.known]
        sizes, flats = [self.size], [self.flat]
        for a in range(0, len(unseen), self.at_once):
            new = unseen[a : a + self.at_once]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flats.append(np.fromiter((i for f in found for i in f), np.uint32))
        if unseen:
            self.size, self.flat = np.concatenate(sizes), np.concatenate(flats)
        code = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        size = self.size[code]
        start = (np.cumsum(self.size) - self.size)[code]
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        count = pc.list_value_length(parts).to_numpy()
        return self.flat[at], np.add.reduceat(size, np.cumsum(count) - count) if len(size) else np.zeros(0, np.int64)


def _tokenise(path: str, cut: bool, end_id: int, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        end = np.array([end_id], kind).tobytes()
        tokens = _Tokens(path) if cut else _WholeTexts(path)
        for batch in slices(batches, budget=(8 if cut else 1) << 20):
            ids, count = tokens.ids(batch.column("text"))
            whole, at = ids.astype(kind).tobytes(), np.concatenate([[0], np.cumsum(count)]) * np.dtype(kind).itemsize
            rows = [whole[a:b] + end for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    return run


def _tally(kind: str, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most, np.int64)
        for batch in batches:
            for part in slices([batch], "ids"):
                total += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), kind), minlength=most)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    return run


_FILE = "shard int, block long, first long, tokens long, doc_ids array<long>, lengths binary, control binary, data binary"


def _write(kind: str, rank: np.ndarray, block_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, docs, held, size
            control, data = encode_values(rank[np.concatenate(held)])
            row = {"shard": shard, "block": block, "first": first, "tokens": size, "doc_ids": docs, "lengths": np.array([len(h) for h in held], "<u4").tobytes(), "control": control, "data": data}
            block, first, docs, held, size = block + 1, first + size, [], [], 0
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(i)
                held.append(np.frombuffer(x, kind))
                size += len(held[-1])
                if size >= block_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def _read(ids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                length = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                values = ids[decode_values(row["control"], row["data"], int(length.sum()))].astype("<u4")
                at = np.concatenate([[0], np.cumsum(length)])
                whole = values.tobytes()
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                start = pa.array(row["offset"] + row["first"] + at[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), start, pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


@dataclass
class TokenFiles:
    """blocks: the rows of the files; vocabulary: rank and id."""

    blocks: DataFrame
    vocabulary: DataFrame

    def table(self) -> np.ndarray:
        """Ids by rank: as many as the tokenizer's vocabulary has, at most."""
        rows = self.vocabulary.orderBy("rank").collect()
        return np.array([r["id"] for r in rows], np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> TokenFiles:
    """Encode whole texts, end each with end_id, and write them in ascending order of doc_id (null ids first).

    Null and empty texts are the end id alone. Rows that share a doc_id follow each other, by their ids. An empty
    table writes no block. Texts go through the tokenizer once; the ids are kept in the shared folder, counted
    for their ranks, and dealt by range of doc_id into the shards. Other columns are not read. A text of any length is
    one row of ids. Where the tokenizer's file allows it (may_be_cut), each distinct part of the texts is encoded
    once by a worker; any other file encodes each text whole.
    """
    with scratch(docs.sparkSession):
        return _write_tokens(docs, tokenizer, end_id, block_tokens)


def _write_tokens(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int) -> TokenFiles:
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if most <= 1 << 16 else "<u4"
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = stored(read.mapInArrow(_tokenise(tokenizer, may_be_cut(tokenizer), end_id, kind), "doc_id long, ids binary"), "token-ids")
    tally = encoded.select("ids").mapInArrow(_tally(kind, most), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = sorted(tally.collect(), key=lambda r: (-r["n"], r["id"]))
    ids = np.array([r["id"] for r in counts], np.uint32)
    rank = np.zeros(most, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    ranked = docs.sparkSession.createDataFrame([(n, int(i)) for n, i in enumerate(ids)], "rank int, id int")
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return TokenFiles(stored(ordered.mapInArrow(_write(kind, rank, block_tokens), _FILE), "token-files", keep=True), stored(ranked, "token-vocabulary", keep=True))


def read_tokens(files: TokenFiles) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens and the crc32 of the ids as little-endian uint32, a row per document."""
    shards = files.blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = shards.select(F.col("shard").alias("s_"), before.alias("offset"))
    placed = files.blocks.join(offsets, F.col("shard") == F.col("s_")).select("offset", "first", "doc_ids", "lengths", "control", "data")
    return placed.mapInArrow(_read(files.table()), "doc_id long, start long, n_tokens long, ids_crc32 long")
