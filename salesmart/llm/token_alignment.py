"""Alignment of two tokenizers over the same bytes: groups of tokens that end together, and how ids go together.

In a text's bytes each tokenizer's tokens have cumulative ends, held in a dictionary from end to index. The ends
that both dictionaries have cut the two lists of ids into groups, and tokens of a group whose bytes overlap are
linked. How often a pair of ids is linked is counted over all texts: a task adds up the pairs of a block of texts,
blocks are added up by pair, and each block gets the counts of its own pairs back, so that a pair that is in every
text is sent once a block and nothing is sent whole to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import materialise, text_or_empty
from .piece_encoding import SPACE, encoder as piece_encoder
from .tokens import byte_tokens


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Ends that both lists have, ascending, and how many tokens of each list lie before each of them."""
    index_a, index_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = list(filter(index_a.__contains__, index_b))  # the intersection, in the order of the keys: ends ascend
    return common, list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common))


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the tokens whose bytes overlap: one for each stretch between neighbouring ends of either.

    Both lists end together, so that the links of a group are those of its slices.
    """
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Aligner:
    """Aligns the tokens of a byte-level vocabulary, for a space and the text, with a piece model's for the text."""

    def __init__(self, vocabulary: str, model: str) -> None:
        self.encode_a, tokens = byte_tokens(vocabulary)
        self.size_a = np.array([len(t) for t in tokens], np.int64)
        self.b = piece_encoder(model)
        self.size_b = np.array([len(t) for t in self.b.tokens], np.int64)
        self.text_a, self.text_b = tokens, self.b.tokens
        names = [str(i) for i in range(max(len(tokens), len(self.b.tokens)))]
        self.listed = [np.array([n + mark for n in names], object) for mark in ",|;"]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Both lists of ids; none for an empty text or where the bytes of one aren't the space and the text.

        Tokens of a list are neighbouring slices of what its tokenizer reads: the first of the space and the text,
        which they cover if their sizes add up, the second of the normalised text, with spaces for marks.
        """
        if not text:
            return None
        spaced = " " + text
        normal = self.b.normalised(text)
        if normal.replace(SPACE, " ") != spaced:
            return None
        a, b = np.array(self.encode_a(spaced), np.int64), self.b.merged(normal)
        size = len(spaced.encode())
        return (a, b) if self.size_a[a].sum() == size == self.size_b[b].sum() else None

    def align(self, text: str | None):
        """ids a, ids b, groups' ends in each list, ends in bytes of each token; none as for ``tokens``."""
        ids = self.tokens(text)
        if ids is None:
            return None
        ends_a, ends_b = np.cumsum(self.size_a[ids[0]]), np.cumsum(self.size_b[ids[1]])
        _, cut_a, cut_b = cuts(ends_a.tolist(), ends_b.tolist())
        return *ids, np.array(cut_a), np.array(cut_b), ends_a, ends_b

    def written(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """Groups as `a1,a2|b1;a3|b2,b3`."""
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[cut_a - 1], mark_b[cut_b - 1] = 1, 2
        out = np.empty(len(a) + len(b), object)
        before_a, before_b = np.concatenate([[0], cut_a[:-1]]), np.concatenate([[0], cut_b[:-1]])
        place_a = np.arange(len(a)) + np.repeat(before_b, cut_a - before_a)
        place_b = np.arange(len(b)) + np.repeat(cut_a, cut_b - before_b)
        for ids, mark, place in ((a, mark_a, place_a), (b, mark_b, place_b)):
            for k in np.unique(mark):
                own = mark == k
                out[place[own]] = self.listed[k][ids[own]]
        return "".join(out.tolist())[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(vocabulary: str, model: str) -> Aligner:
    key = vocabulary, model
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _pairs(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pair codes, ascending, and how often each occurs."""
    if times is None:
        return np.unique(codes, return_counts=True)
    code, own = np.unique(codes, return_inverse=True)
    return code, np.bincount(own, times, len(code)).astype(np.int64)


def _packed(code: np.ndarray, times: np.ndarray) -> bytes:
    """Pair codes as their differences, then the counts: small numbers compress well."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(code, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 12
    code = raw[: 8 * n].reshape(8, n).T.copy().view("<u8").ravel().astype(np.int64)
    return np.cumsum(code), raw[8 * n :].reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def align_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", model: str = "piece_bpe_32k.model") -> DataFrame:
    """Every document's tokens and groups: doc_id, a_ids, b_ids, a_cuts, b_cuts (arrays of int).

    Group k holds the tokens from a_cuts[k - 1] to a_cuts[k] of the one list, and likewise of the other. Special
    tokens' strings inside texts are plain text. Null and empty texts, and texts whose bytes one of the
    tokenizers doesn't give back, have empty arrays. Repeated rows and null ids are aligned each; an empty table
    gives none; other columns are ignored. A very long text is aligned whole in one task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(vocabulary, model)
        for batch in batches:
            done = [own.align(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([[] if d is None else d[k].astype(np.int32) for d in done], pa.list_(pa.int32())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


_ROWS = "block long, doc_id long, whole boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def _blocks(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """A row a document, and one a block of them (whole) with the sums of its documents' pairs.

    A block is what a task gets in one Arrow batch, so that its bytes are bounded; it is numbered by task and batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, width, task = aligner(vocabulary, model), 1 << 32, TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            rows, all_codes, all_times = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = own.align(text)
                if found is None:
                    rows.append((task + number, doc, False, 0, 0, 0, 0, "", None))
                    continue
                a, b, cut_a, cut_b, ends_a, ends_b = found
                i, j = links(ends_a, ends_b)
                code, times = _pairs(b[j].astype(np.int64) * width + a[i])
                all_codes.append(code)
                all_times.append(times)
                rows.append((task + number, doc, False, len(a), len(b), len(cut_a), len(i), hashlib.sha256(own.written(a, b, cut_a, cut_b).encode()).hexdigest(), _packed(code, times)))
            if all_codes:
                rows.append((task + number, None, True, 0, 0, 0, 0, "", _packed(*_pairs(np.concatenate(all_codes), np.concatenate(all_times)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, _ROWS)


_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(block, a, b, times) of every block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist()):
                code, times = _unpacked(blob)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array((code >> 32).astype(np.int32)), pa.array(times)], names=["block", "a", "b", "times"])

    return blocks.where("whole").select("block", "pairs").mapInArrow(run, "block long, a int, b int, times long")


def digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k", model: str = "piece_bpe_32k.model") -> DataFrame:
    """Every document's alignment in figures, with the counts of its linked id pairs over all documents.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its b id, ties
    included), count_sum (of the links' pairs), groups_sha256. Edge cases as in ``align_documents``; documents
    without tokens have zeros and ''. The best count of each b id is broadcast: at most one row an id of the
    vocabulary.
    """
    blocks = materialise(_blocks(docs, vocabulary, model))
    each = materialise(pair_counts(blocks))
    counts = each.groupBy("a", "b").agg(F.sum("times").alias("n"))
    counts = materialise(counts)
    best = counts.groupBy("b").agg(F.max("n").alias("top"))
    known = each.select("block", "a", "b").join(counts, ["a", "b"]).join(F.broadcast(best), "b").select("block", "a", "b", "n", (F.col("n") == F.col("top")).alias("is_best"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        code = right.column("b").to_numpy().astype(np.int64) << 32 | right.column("a").to_numpy()
        order = np.argsort(code)
        code, n, top = code[order], right.column("n").to_numpy()[order], right.column("is_best").to_numpy(zero_copy_only=False)[order]
        sums, tops = [], []
        for blob in left.column("pairs").to_pylist():
            if blob is None:
                sums.append(0)
                tops.append(0)
                continue
            own, times = _unpacked(blob)
            at = np.searchsorted(code, own)
            sums.append(int(n[at] @ times))
            tops.append(int(times[top[at]].sum()))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(left.column(c) for c in names), pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), left.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])

    rows = blocks.where("not whole").drop("whole")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(meet, schema)
