"""Exact substring deduplication: bytes under any 50-byte string that starts in an earlier document go.

Suffixes are sampled, sorted in shares, and the rest is induced from the sample. The sample holds each
position that is the smallest hashed K-byte string of some 50-byte window; a window depends on its bytes
alone for the choice, so equal windows choose alike and meet in the same share. The suffixes whose sampled
one to the right is the same make a run; the run is one tuple (its bytes, at most 80), and its windows are
sorted inside a share, where the least document of each prefix of 50 bytes settles all of them.

First the sampled hashes alone are counted; a sample that occurs in one document only can't be in a
repeated window, and its run is never shipped. Hashes travel as arrays, one a block of documents and share, each
hash once a block;
the number of shares follows from the bytes of all texts, so shares grow in number with the data and not in size.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import partitions, text_or_empty

#: Bytes of a repeated string, and of the sampled strings within it.
WIDTH, K = 50, 20
#: Documents of a block, whose runs a task holds at once, and bytes of their texts (one longer text is a block).
BLOCK, BLOCK_BYTES = 2000, 16 << 20
#: Bytes of text of a share; there are no fewer shares than shuffle partitions.
SHARE = 32 << 20
#: Window starts handled at once in a long text, and windows compared at once.
CHUNK, COMPARED = 1 << 20, 1 << 16
_SPREAD = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _MASK, _LOW = 0x9E3779B97F4A7C15, (1 << 64) - 1, np.uint64(0xFFFFFFFF)
_MESSAGE = "share long, block long, kind int, a binary, b binary, c binary, d binary"
_COLUMNS = ["share", "block", "kind", "a", "b", "c", "d"]
_LIST, _DATA = 0, 1


def _doubling(x: np.ndarray, width: int, join, state):
    """Combine each ``width`` neighbours of ``x`` by joining blocks of powers of two; state squares along."""
    done, done_len, now, now_len = None, 0, x, 1
    while width:
        if width & 1:
            if done is None:
                done, done_len = now, now_len
            else:
                n = len(x) - (done_len + now_len) + 1
                done, done_len = join(done[:n], now[done_len : done_len + n], state), done_len + now_len
        width >>= 1
        if width:
            n = len(x) - 2 * now_len + 1
            now, now_len = join(now[:n], now[now_len : now_len + n], state), 2 * now_len
            state = state * state & _MASK
    return done


def window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each ``width`` bytes."""
    h = _doubling(_SPREAD[raw], width, lambda a, b, m: a * np.uint64(m) + b, _BASE)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, sample's hash) of each run of windows with one sampled string."""
    out = []
    for at in range(0, max(0, len(text) - WIDTH + 1), CHUNK):
        h = window_hashes(np.frombuffer(text[at : at + CHUNK + WIDTH - 1], np.uint8), K)
        bits = np.uint64(24)  # over the places in a chunk
        v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        least = _doubling(v, WIDTH - K + 1, lambda a, b, _: np.minimum(a, b), 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        out.append((first + at, np.diff(first, append=len(least)), h[(least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _split(share: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(share, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(share[order])) + 1) if len(order) else []:
        yield int(share[rows[0]]), rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _block(order: np.ndarray, key: np.ndarray) -> int:
    """A block's number, from what is in it, so that a task run again gives it again."""
    return xxhash.xxh64_intdigest(order.tobytes() + key.tobytes(), 6) >> 1


_pack = lambda x: zstandard.ZstdCompressor(level=3).compress(x)
_unpack = lambda x: zstandard.ZstdDecompressor().decompress(x)


def _blocks(batches: Iterator[pd.DataFrame], size) -> Iterator[pd.DataFrame]:
    """Batches cut after ``BLOCK`` documents or before ``BLOCK_BYTES`` of their texts; ``size`` gives a row's bytes."""
    for batch in batches:
        sizes = np.array([size(x) for x in batch["text" if "text" in batch else "z"]], np.int64)
        first = 0
        while first < len(batch):
            room = int(np.searchsorted(np.cumsum(sizes[first : first + BLOCK]), BLOCK_BYTES, side="right"))
            last = first + max(1, room)
            yield batch.iloc[first:last]
            first = last


def _grouped(batches: Iterator[pd.DataFrame], by: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of equal ``by`` from batches sorted by it."""
    held: list[tuple] = []
    at = _COLUMNS.index(by)
    for batch in batches:
        for row in batch[_COLUMNS].itertuples(index=False, name=None):
            if held and held[0][at] != row[at]:
                yield held[0][at], held
                held = []
            held.append(row)
    if held:
        yield held[0][at], held


def _counts_out(shares: int):
    """Sampled hashes of a block's documents: each distinct one once, by share.

    A hash that several documents of the block have is repeated whatever other blocks hold: its documents stay in
    the block's own list, and the share is only told of it. So a
    string that is in every document takes one entry a block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _blocks(batches, len):
            order, key = batch["o"].to_numpy(np.int64), batch["h"].to_numpy(np.int64)
            block, hashes, docs = _block(order, key), [], []
            for i, text in enumerate(batch["text"]):
                u = np.unique(runs(text.encode("utf-8", "surrogatepass"))[2])
                hashes.append(u)
                docs.append(np.full(len(u), i, np.uint32))
            h, d = (np.concatenate(x) for x in (hashes, docs))
            by = np.argsort(h, kind="stable")
            h, d = h[by], d[by]
            first = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
            many = np.repeat(np.diff(np.append(np.flatnonzero(first), len(h))) > 1, np.diff(np.append(np.flatnonzero(first), len(h))))
            rows = [(block % shares, block, _LIST, order.tobytes(), key.tobytes(), _pack((h[many] & _LOW).astype("<u4").tobytes()), _pack(d[many].tobytes()))]
            told, single = first & many, ~many
            for share, at in _split((h[told | single] >> np.uint64(32)) % np.uint64(shares)):
                mine, lone, doc = h[told | single][at], single[told | single][at], d[told | single][at]
                low = lambda x: (x & _LOW).astype("<u4").tobytes()
                rows.append((share, block, _DATA, low(mine[lone]), _pack(doc[lone].tobytes()), low(mine[~lone]), None))
            yield _frame(rows)

    return run


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of single documents that another block has too, back to their blocks."""
    for share, rows in _grouped(batches, "share"):
        data = [r for r in rows if r[2] == _DATA]
        out = [r for r in rows if r[2] == _LIST]
        if data:
            lone, told = ([np.frombuffer(r[c], "<u4") for r in data] for c in (3, 5))
            _, where, n = np.unique(np.concatenate(lone + told + told), return_inverse=True, return_counts=True)
            many = np.split(n[where[: sum(map(len, lone))]] > 1, np.cumsum([len(x) for x in lone])[:-1])
            for r, x, m in zip(data, lone, many):
                if m.any():
                    docs = np.frombuffer(_unpack(r[4]), np.uint32)
                    out.append((share, r[1], _DATA, x[m].tobytes(), _pack(docs[m].tobytes()), None, None))
        yield _frame(out)


def _flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each document its hashes that others have too."""
    for _, rows in _grouped(batches, "block"):
        listed = next(r for r in rows if r[2] == _LIST)
        order, key = np.frombuffer(listed[3], np.int64), np.frombuffer(listed[4], np.int64)
        data = [r for r in rows if r[2] == _DATA]
        low = np.concatenate([np.frombuffer(_unpack(listed[5]), "<u4"), *[np.frombuffer(r[3], "<u4") for r in data]])
        docs = np.concatenate([np.frombuffer(_unpack(listed[6]), np.uint32), *[np.frombuffer(_unpack(r[4]), np.uint32) for r in data]])
        yield pd.DataFrame([(order[i], key[i], low[at].tobytes()) for i, at in _split(docs)], columns=["o", "h", "flags"])


def _runs_out(shares: int):
    """Runs whose sample other documents have, by share; repeats inside the block are settled here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _blocks(batches, zstandard.frame_content_size):
            order, key = batch["o"].to_numpy(np.int64), batch["h"].to_numpy(np.int64)
            block = _block(order, key)
            least: dict[bytes, int] = {}
            found, share = [], []
            for i, (z, flags) in enumerate(zip(batch["z"], batch["flags"])):
                text, own = _unpack(z), int(order[i])
                start, n, h = runs(text)
                keep = np.isin((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.frombuffer(flags, "<u4"))
                share.append(((h[keep] >> np.uint64(32)) % np.uint64(shares)).astype(np.int64))
                for s, m in zip(start[keep].tolist(), n[keep].tolist()):
                    run_ = text[s : s + m + WIDTH - 1]
                    if least.get(run_, own) >= own:
                        least[run_] = own
                    found.append((run_, i, s, m, own))
            rows = [(block % shares, block, _LIST, order.tobytes(), key.tobytes(), None, None)]
            settled = [f for f in found if f[4] > least[f[0]]]
            if settled:
                lo = np.array([f[2] for f in settled], np.uint32)
                rows.append((block % shares, block, _LIST + 2, np.array([f[1] for f in settled], np.uint32).tobytes(), lo.tobytes(), (lo + np.array([f[3] + WIDTH - 1 for f in settled], np.uint32)).tobytes(), None))
            shares_of = np.concatenate(share) if share else np.zeros(0, np.int64)
            open_ = np.array([f[4] <= least[f[0]] for f in found], bool)
            picked = np.flatnonzero(open_)
            for k, at in _split(shares_of[picked]):
                mine = [found[j] for j in picked[at].tolist()]
                body = b"".join(f[0] for f in mine)
                rows.append((k, block, _DATA, _pack(body), np.array([f[3] for f in mine], np.uint8).tobytes(),
                             _pack(np.array([f[1] for f in mine], np.uint32).tobytes() + np.array([f[2] for f in mine], np.uint32).tobytes()),
                             _pack(np.array([f[4] for f in mine], np.int64).tobytes())))
            yield _frame(rows)

    return run


def _least_order(raw: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each window at ``at`` in ``raw`` the least ``own`` of the windows with the same bytes.

    Windows are sorted by hash and neighbours compared byte by byte; where different windows share a
    hash, that hash's windows are sorted by their bytes.
    """
    h = window_hashes(raw, WIDTH)[at]
    by = np.lexsort((own, h))
    new = np.concatenate(([True], h[by][1:] != h[by][:-1]))
    window = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)
    repeats = np.flatnonzero(~new)
    chance = [c[(window[at[by[c]]] != window[at[by[c - 1]]]).any(axis=1)] for c in np.split(repeats, range(COMPARED, len(repeats), COMPARED))]
    groups = np.flatnonzero(new)
    for g in np.unique(np.searchsorted(groups, np.concatenate(chance), side="right")):
        rows = np.arange(groups[g - 1], groups[g] if g < len(groups) else len(by))
        ordered = sorted((window[at[w]].tobytes(), own[w], w) for w in by[rows])
        by[rows] = [w for _, _, w in ordered]
        new[rows[1:]] = [a[0] != b[0] for a, b in zip(ordered, ordered[1:])]
    least = np.empty_like(own)
    least[by] = own[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    return least


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sort the windows of a share and return those that an earlier document has, as byte ranges by block."""
    for share, rows in _grouped(batches, "share"):
        data = [r for r in rows if r[2] == _DATA]
        out = [r for r in rows if r[2] != _DATA]
        if data:
            raw = np.frombuffer(b"".join(_unpack(r[3]) for r in data), np.uint8)
            n = np.concatenate([np.frombuffer(r[4], np.uint8) for r in data]).astype(np.int64)
            order = np.concatenate([np.frombuffer(_unpack(r[6]), np.int64) for r in data])
            size = n + WIDTH - 1
            ends = np.cumsum(n)
            run = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(run)) - (ends - n)[run]
            least = _least_order(raw, (np.cumsum(size) - size)[run] + step, order[run])
            own = order[run]
            hit = own > least
            # stretches of covered windows, cut where a run ends
            begin = hit & np.concatenate(([True], ~hit[:-1] | (run[1:] != run[:-1])))
            stop = hit & np.concatenate((~hit[1:] | (run[1:] != run[:-1]), [True]))
            b, e = np.flatnonzero(begin), np.flatnonzero(stop)
            both = [np.frombuffer(_unpack(r[5]), np.uint32) for r in data]
            doc = np.concatenate([x[: len(x) // 2] for x in both])
            start = np.concatenate([x[len(x) // 2 :] for x in both]).astype(np.int64)
            lo = start[run[b]] + step[b]
            hi = start[run[e]] + step[e] + WIDTH
            blocks = np.repeat(np.arange(len(data)), [len(r[4]) for r in data])[run[b]]
            for k, at in _split(blocks):
                out.append((share, data[k][1], _LIST + 2, doc[run[b]][at].astype(np.uint32).tobytes(), lo[at].astype(np.uint32).tobytes(), hi[at].astype(np.uint32).tobytes(), None))
        yield _frame(out)


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each document its covered byte ranges, merged."""
    for _, rows in _grouped(batches, "block"):
        listed = next(r for r in rows if r[2] == _LIST)
        order, key = np.frombuffer(listed[3], np.int64), np.frombuffer(listed[4], np.int64)
        data = [r for r in rows if r[2] > _DATA]
        out = []
        if data:
            doc, lo, hi = (np.concatenate([np.frombuffer(r[c], np.uint32) for r in data]).astype(np.int64) for c in (3, 4, 5))
            for i, at in _split(doc):
                by = at[np.argsort(lo[at], kind="stable")]
                a, z = lo[by], np.maximum.accumulate(hi[by])
                new = np.concatenate(([True], a[1:] > z[:-1]))
                first = np.flatnonzero(new)
                out.append((order[i], key[i], np.concatenate((a[first], z[np.append(first[1:], len(a)) - 1])).astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["o", "h", "spans"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = []
        for doc, z, spans in zip(batch["doc_id"].tolist(), batch["z"], batch["spans"]):
            text = _unpack(z)
            kept, at, gone, n = hashlib.sha256(), 0, 0, 0
            if spans is not None:
                both = np.frombuffer(spans, "<u4")
                n = len(both) // 2
                for a, b in zip(both[:n].tolist(), both[n:].tolist()):
                    kept.update(text[at:a])
                    at, gone = b, gone + b - a
            kept.update(text[at:])
            out.append((None if doc != doc or doc is None else int(doc), len(text), gone, n, kept.hexdigest()))
        yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})


def covered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, o, h, z) and their covered byte ranges as (o, h, spans).

    o orders the documents (a null doc_id comes last), h hashes the text, z is the packed text.
    """
    spark = docs.sparkSession
    n = max(partitions(spark), (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARE)

    @F.pandas_udf("binary")
    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in texts:
            yield pd.Series([pack(t.encode("utf-8", "surrogatepass")) for t in batch], dtype="object")

    base = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    stored = base.select("doc_id", "o", "h", packed("text").alias("z"))

    def exchange(rows: DataFrame, by: str, step, schema: str) -> DataFrame:
        return rows.repartition(n, by).sortWithinPartitions(by, "kind").mapInPandas(step, schema)

    counted = exchange(base.select("o", "h", "text").mapInPandas(_counts_out(n), _MESSAGE), "share", _count, _MESSAGE)
    flags = exchange(counted, "block", _flags, "o long, h long, flags binary").dropDuplicates(["o", "h"])
    met = stored.select("o", "h", "z").join(flags, ["o", "h"])
    sent = met.select("o", "h", "z", "flags").mapInPandas(_runs_out(4 * n), _MESSAGE)
    spans = exchange(exchange(sent, "share", _settle, _MESSAGE), "block", _spans, "o long, h long, spans binary").dropDuplicates(["o", "h"])
    return stored, spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text).

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; strings are
    judged on the input and never cross documents. Null texts are empty. A null doc_id comes after all
    others; rows that share a doc_id are one document's and don't remove each other's bytes. A very long text is a
    block of its own, hashed in chunks. An empty table gives none, other columns are ignored.
    """
    stored, spans = covered(docs)
    return stored.join(spans, ["o", "h"], "left").select("doc_id", "z", "spans").mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
