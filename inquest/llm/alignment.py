"""Cross-tokenizer alignment by whitespace-token anchors.

Both tokenizers encode the whole text. Where both have a token that begins with a space mark at
one and the same byte, the tokens before it end there on both sides: such shared ends cut a
document into windows of token ids. A window's alignment follows from its ids alone, so it is
worked out once for each different pair of id tuples of a block of documents. Within a window,
every byte offset where tokens of both sides end closes a group; all A-B pairs of a group are
linked.

How many documents hold a pair of ids linked is counted over the corpus: a task reports each
pair once for a block of documents, with its count there, and only those rows are shuffled. The
totals return to the blocks, which hold each document's pairs as numbers within the block.

Defined results: texts that are null or empty, or whose tokens do not spell the text (with a
space before it), have no tokens: zeros and an empty digest. Special tokens inside texts are
plain text. Each row is a document of its own, repeated and null ids too. Windows and groups of
any length take linear time, but for the pairs that they link. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from inquest.llm.common import present, shared_folder

BLOCK_ROWS, BLOCK_TOKENS = 4096, 3 << 20   # a block of documents ends at either of these
MARK = "▁"
# Fixed value: how byte-level files split a text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(a_json: str) -> tuple[Callable[[str], list[int]], list[bytes], bool]:
    """An encoder without special tokens, the bytes of every id, and whether ids always spell the text.

    A plain byte-level file whose merges come in the order of their ids is the same tokenizer as
    its vocabulary used as ranks, which a faster library encodes by; other files go to their own.
    """
    from tokenizers import Tokenizer
    file = json.loads(a_json)
    model, before = file["model"], file["pre_tokenizer"]
    # printable bytes stand for themselves, the others for the letters from U+0100 on, in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in
                enumerate(b for b in range(256) if b not in set(plain))}

    def spelt(token: str) -> bytes:
        return bytes(map(letters.__getitem__, token)) if all(
            map(letters.__contains__, token)) else token.encode()
    whole = Tokenizer.from_str(a_json)
    whole.encode_special_tokens = True
    whole.no_padding()
    whole.no_truncation()
    tokens = [spelt(whole.id_to_token(i) or "")
              for i in range(whole.get_vocab_size(with_added_tokens=True))]
    vocabulary = model.get("vocab", {})
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "")
              for m in model.get("merges", [])]
    order = [vocabulary.get(m, -1) for m in merged]
    if (model["type"] == "BPE" and not file.get("normalizer") and before == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges",
                                               "continuing_subword_prefix", "end_of_word_suffix"))
            and order == sorted(order) and len(vocabulary) == 256 + len(merged)
            and all(vocabulary[c] < min(order, default=256) for c in letters)):
        import tiktoken
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, special_tokens={}, mergeable_ranks={
            spelt(t): i for t, i in vocabulary.items()}).encode_ordinary, tokens, True
    return lambda text: whole.encode(text, add_special_tokens=False).ids, tokens, False


class Pair:
    """Both tokenizers, opened where they are used, with the bytes of every token."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a_json, self.b_model = a_json, b_model

    def open(self) -> Pair:
        import sentencepiece
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
        self.encode_a, self.a_bytes, self.lossless = byte_level(self.a_json)
        self.b_bytes = [self.piece(i) for i in range(self.b.get_piece_size())]
        self.a_length = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.a_mark = np.array([x[:1] == b" " for x in self.a_bytes])
        self.b_mark = np.array([x[:1] == b" " for x in self.b_bytes])
        return self

    def piece(self, i: int) -> bytes:
        text = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(text[3:5], 16)])
        return text.replace(MARK, " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides for each text; none where either does not spell the text."""
        a_ids = map(self.encode_a, [" " + t for t in texts])
        b_ids = self.b.encode(texts, num_threads=1)
        for text, a, b in zip(texts, a_ids, b_ids):
            whole = b" " + text.encode()
            spelt = (text and b"".join(map(self.b_bytes.__getitem__, b)) == whole and (
                self.lossless or b"".join(map(self.a_bytes.__getitem__, a)) == whole))
            yield (a, b) if spelt else ([], [])


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each of consecutive runs."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def numbered(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different run, and where each number is first met.

    ``runs`` has values and starts of one or several parallel runs. Equal hashes are held to
    their values, and hashed anew should any two differ.
    """
    n = len(runs[0][1])
    sizes = [np.diff(np.append(starts, len(values))) for values, starts in runs]
    salt = np.uint64(0x9E3779B97F4A7C15)
    while True:
        mark = np.zeros(n, dtype=np.uint64)
        for (values, starts), size in zip(runs, sizes):
            x = values.astype(np.uint64) + (places(size).astype(np.uint64) + np.uint64(1)) * salt
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            mark = (mark ^ mark >> np.uint64(29)) * salt + np.add.reduceat(x ^ x >> np.uint64(31), starts)
        _, first, number = np.unique(mark, return_index=True, return_inverse=True)
        same = True
        for (values, starts), size in zip(runs, sizes):
            model = first[number]
            same = same and bool((size == size[model]).all()) and bool(
                (values[np.repeat(starts[model], size) + places(size)] == values).all())
        if same:
            return number, first
        salt += np.uint64(2)


class Block:
    """Documents of one task: aligned together, each different window once."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.names = [str(i) for i in range(max(len(pair.a_bytes), len(pair.b_bytes)))]
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple] = []
        self.a, self.b = array("i"), array("i")         # the ids of all documents, end to end

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_ROWS or len(self.a) + len(self.b) >= BLOCK_TOKENS

    def add(self, doc_id: int | None, a: list[int], b: list[int]) -> None:
        self.docs.append((doc_id, len(a), len(b)))
        self.a.extend(a)
        self.b.extend(b)

    def linked(self, a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
        """A group as text, its different id pairs, and how often each is linked."""
        left, right, name = a.tolist(), b.tolist(), self.names.__getitem__
        text = ",".join(map(name, left)) + "|" + ",".join(map(name, right))
        if len(left) * len(right) <= 64 and len(set(left)) == len(left) and len(set(right)) == len(right):
            pairs = np.array([x << 32 | y for x in left for y in right])
            return text, pairs, np.ones(len(pairs), dtype=np.int64)
        x, n_x = np.unique(a, return_counts=True)
        y, n_y = np.unique(b, return_counts=True)
        return (text, (x.astype(np.int64)[:, None] << 32 | y[None, :]).ravel(),
                (n_x[:, None] * n_y[None, :]).ravel())

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """The documents, then the block's pairs with the number of documents that hold each."""
        n = len(self.docs)
        if not n:
            return
        ids, n_a, n_b = zip(*self.docs)
        spoken = np.nonzero(n_a)[0]                     # documents that have tokens
        digests = [""] * n
        n_groups, n_links = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        held, times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        pairs = np.empty(0, dtype=np.int64)
        if len(spoken):
            a, b = np.frombuffer(self.a, dtype=np.int32), np.frombuffer(self.b, dtype=np.int32)
            # tokens of both sides that end at one byte close a group; documents end on both sides
            a_ends, b_ends = np.cumsum(self.pair.a_length[a]), np.cumsum(self.pair.b_length[b])
            at = np.searchsorted(b_ends, a_ends)
            shared = b_ends[at] == a_ends
            a_starts = np.append(0, np.nonzero(shared)[0][:-1] + 1)
            b_starts = np.append(0, at[shared][:-1] + 1)
            # a window begins where a space-marked token follows on both sides, as in each text
            opens = np.nonzero(self.pair.a_mark[a[a_starts]] & self.pair.b_mark[b[b_starts]])[0]
            group, first = numbered([(a, a_starts), (b, b_starts)])
            window, model = numbered([(group, opens)])
            # what is known of each different group
            size_a, size_b = (np.diff(np.append(x, len(y))) for x, y in ((a_starts, a), (b_starts, b)))
            known = [self.linked(a[i:i + k], b[j:j + m]) for i, k, j, m in zip(
                *(x[first].tolist() for x in (a_starts, size_a, b_starts, size_b)))]
            texts = [x[0] for x in known]
            widths = np.array([len(x[1]) for x in known], dtype=np.int64)
            pairs, number = np.unique(np.concatenate([x[1] for x in known]), return_inverse=True)
            often = np.concatenate([x[2] for x in known])
            # the alignment of each different window, and with it of each document
            stops = np.append(opens[1:], len(group))
            whole = [";".join(map(texts.__getitem__, group[i:j].tolist()))
                     for i, j in zip(opens[model].tolist(), stops[model].tolist())]
            doc_of_group = np.searchsorted(np.cumsum(n_a), a_starts, side="right")
            edges = np.searchsorted(doc_of_group[opens], np.append(spoken, n)).tolist()
            for d, i, j in zip(spoken.tolist(), edges, edges[1:]):
                said = ";".join(map(whole.__getitem__, window[i:j].tolist()))
                digests[d] = hashlib.sha256(said.encode()).hexdigest()
            n_groups = np.bincount(doc_of_group, minlength=n)
            n_links = np.bincount(doc_of_group, weights=size_a * size_b, minlength=n).astype(np.int64)
            # every pair of every document once, with how often it is linked there
            width = widths[group]
            item = np.repeat((np.cumsum(widths) - widths)[group], width) + places(width)
            key = np.repeat(doc_of_group, width) * len(pairs) + number[item]
            held, back = np.unique(key, return_inverse=True)
            times = np.bincount(back, weights=often[item]).astype(np.int64)
        owner, held = np.divmod(held, max(1, len(pairs)))
        cuts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)

        def lists(values: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.astype(np.int32)))
        yield batch(n, block, 0, doc_id=ids, n_a=n_a, n_b=n_b, groups_sha256=digests,
                    n_groups=n_groups, n_links=n_links, pairs=lists(held), times=lists(times))
        docs = np.bincount(held, minlength=len(pairs))
        for at in range(0, len(pairs), 1 << 16):
            some = slice(at, min(len(pairs), at + (1 << 16)))
            yield batch(some.stop - at, block, 1, pair=np.arange(at, some.stop), a=pairs[some] >> 32,
                        b=pairs[some] & 0xFFFFFFFF, docs=docs[some])
        self.clear()


SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
    ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())),
    ("times", pa.list_(pa.int32())), ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()),
    ("docs", pa.int64())])
SPARK = ("part int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
         "groups_sha256 string, pairs array<int>, times array<int>, pair int, a int, b int, docs long")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
          "count_sum long, groups_sha256 string")


def batch(rows: int, block: int, part: int, **columns) -> pa.RecordBatch:
    columns |= {"part": np.full(rows, part), "block": np.full(rows, block)}

    def column(field: pa.Field) -> pa.Array:
        if field.name not in columns:
            return pa.nulls(rows, field.type)
        values = columns[field.name]
        return values if isinstance(values, pa.Array) else pa.array(values, field.type)
    return pa.record_batch([column(f) for f in SCHEMA], schema=SCHEMA)


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Aligned documents (``part`` 0) and each block's linked pairs (``part`` 1), stored."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*shared.value).open()
        mine, base, at, size = Block(pair), TaskContext.get().partitionId() << 32, 0, 0
        for part in parts:
            for start in range(0, part.num_rows, 64):
                piece = part.slice(start, 64)
                texts = piece.column(1).to_pylist()
                for doc_id, ids in zip(piece.column(0).to_pylist(), pair.encode(texts)):
                    mine.add(doc_id, *ids)
                    if mine.full():
                        yield from mine.rows(base + at)
                        at += 1
        yield from mine.rows(base + at)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       present(F.col(text_col)).alias("text")).mapInArrow(run, SPARK)
    path = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    rows.write.partitionBy("part").parquet(path)
    return spark.read.schema(SPARK).parquet(path)


def pair_counts(stored: DataFrame) -> DataFrame:
    """``a, b, count, best``: documents that hold the pair, and whether that is A's highest."""
    counts = stored.filter("part = 1").groupBy("a", "b").agg(F.sum("docs").alias("count"))
    highest = F.max("count").over(Window.partitionBy("a"))
    return counts.select("a", "b", "count", (F.col("count") == highest).alias("best"))


def with_counts(docs: pa.Table, values: pa.Table) -> pa.Table:
    """Sum what a block's pairs are worth over each of its documents' links."""
    n = values.num_rows
    count, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    at = np.asarray(values.column("pair"), dtype=np.int64)
    count[at] = np.asarray(values.column("count"))
    best[at] = np.asarray(values.column("best")).astype(np.int64)
    pairs = docs.column("pairs").combine_chunks()
    numbers = np.asarray(pairs.flatten(), dtype=np.int64)
    times = np.asarray(docs.column("times").combine_chunks().flatten(), dtype=np.int64)
    row = np.repeat(np.arange(docs.num_rows), np.asarray(pairs.value_lengths()))

    def summed(value: np.ndarray) -> pa.Array:
        total = np.zeros(docs.num_rows, dtype=np.int64)
        np.add.at(total, row, times * value[numbers])
        return pa.array(total)
    columns = {name: docs.column(name) for name in (
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    columns |= {"n_best": summed(best), "count_sum": summed(count)}
    return pa.table({f.split()[0]: columns[f.split()[0]] for f in RESULT.split(", ")})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per document."""
    stored = blocks(docs, a_path, b_path, id_col, text_col)
    values = stored.filter("part = 1").join(pair_counts(stored), ["a", "b"]).select(
        F.col("block").alias("of"), "pair", "count", "best")
    whole = stored.filter("part = 0").select(
        "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return whole.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(with_counts, RESULT)
