"""SentencePiece encoding that keeps where every piece comes from, and decoding.

A text is normalised by the model's compiled character map: from each place the longest key that the map holds
is replaced, other characters stay, and every normalised byte keeps the byte of the source that it stands for.
Pairs are merged by the pieces' scores, and a piece's end in the normalised text gives its span in the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty

SPACE = "▁"
#: Stretches that begin with two spaces, and how many of them a worker keeps with their ids.
TIED, KEPT = re.compile("( {2,}[^ ]*)"), 100_000


class CharacterMap:
    """A compiled character map: a double-array trie of UTF-8 keys, and the texts in their place.

    The blob is the trie's size in four bytes, its units of four bytes, and texts that end in a zero byte.
    """

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        first = [b for b in range(256) if self._step(self._below(0), b) is not None] if self.units else []
        # characters that begin no key pass in one piece: of ASCII those without a child, of others by their first byte
        self.begins = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in first) + b"]") if first else None

    def _below(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at``, and what replaces it."""
        base, found = self._below(0), None
        for k in range(at, len(raw)):
            node = self._step(base, raw[k])
            if node is None:
                break
            base = self._below(node)
            if self.units[node] >> 8 & 1:
                found = k + 1 - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])]

    def parts(self, raw: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(normalised bytes, start, length in the source); what passes unchanged comes in long parts."""
        at = plain = 0
        while self.begins and (m := self.begins.search(raw, at)):
            at = m.start()
            hit = self.longest(raw, at)
            if hit is None:  # one character stays
                at += 1
                while at < len(raw) and raw[at] & 0xC0 == 0x80:
                    at += 1
                continue
            if plain < at:
                yield raw[plain:at], plain, at - plain
            yield hit[1], at, hit[0]
            at += hit[0]
            plain = at
        if plain < len(raw):
            yield raw[plain:], plain, len(raw) - plain


class Encoder:
    """Encoder of one model of byte-pair merges with byte pieces.

    Merging by scores is merging by ranks, which the rank encoder does fast: bytes first grow into the model's
    characters, a byte at a time, then pairs into pieces, best score first. What it leaves of a character that the
    model doesn't have becomes byte pieces. Ranks can't say that scores are equal, when the leftmost pair goes
    first; only runs of marks have equal scores, and stretches that begin with two go to the library's own merging.
    """

    def __init__(self, model: bytes) -> None:
        import tiktoken
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kind, normal = pb.ModelProto.SentencePiece, proto.normalizer_spec
        pieces = [p.piece for p in proto.pieces]
        plain = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        merged = sorted((score, i) for p, (score, i) in plain.items() if p.strip(SPACE) and len(p) > 1)
        supported = (
            proto.trainer_spec.model_type == pb.TrainerSpec.BPE and proto.trainer_spec.byte_fallback and normal.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type in (kind.USER_DEFINED, kind.UNUSED) or " " in p.piece for p in proto.pieces)
            and all(a[0] < b[0] for a, b in zip(merged, merged[1:])) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain)
        )
        if not supported:
            raise ValueError("only byte-pair models with byte pieces, unequal scores and marks at the front of pieces are supported")
        self.prefix, self.squeeze = normal.add_dummy_prefix, normal.remove_extra_whitespaces
        self.map = CharacterMap(normal.precompiled_charsmap) if normal.precompiled_charsmap else None
        own = {int(p[3:5], 16): i for i, p in enumerate(pieces) if proto.pieces[i].type == kind.BYTE}
        #: Bytes that each piece stands for, with spaces for marks; value of byte pieces, else -1; bytes when normalised.
        self.tokens = [p.replace(SPACE, " ").encode() if p in plain else b"" for p in pieces]
        self.byte, self.size = np.full(len(pieces), -1, np.int32), np.array([len(p.encode()) for p in pieces], np.int32)
        for b, i in own.items():
            self.tokens[i], self.byte[i] = bytes([b]), b
        ranks = {bytes([b]): b for b in range(256)}
        for grown in sorted({c[:k] for p in plain if len(p) == 1 and (c := p.replace(SPACE, " ").encode()) for k in range(2, len(c) + 1)}, key=lambda c: (len(c), c)):
            ranks[grown] = len(ranks)
        for _, i in merged:
            ranks[self.tokens[i]] = len(ranks)
        known = {self.tokens[i]: i for _, i in plain.values()}
        lists = [[known[t]] if t in known else [own[b] for b in t] for t in ranks]
        self.many, self.start = np.array([len(x) for x in lists]), np.cumsum([0, *map(len, lists)])[:-1]
        self.flat = np.array([i for x in lists for i in x], np.int32)
        self.ranked = tiktoken.Encoding("pieces", pat_str=" *[^ ]+| +", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        processor = SentencePieceProcessor(model_proto=model)
        self.decode = processor.decode
        normal.Clear()
        normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
        self.merge = lru_cache(KEPT)(SentencePieceProcessor(model_proto=proto.SerializeToString()).encode)  # of normalised texts

    def merged(self, normal: str) -> np.ndarray:
        """Ids of a normalised text."""
        text = normal.replace(SPACE, " ")
        parts = []
        for k, part in enumerate(TIED.split(text) if "  " in text else [text]):
            if k % 2:
                parts.append(np.array(self.merge(part.replace(" ", SPACE)), np.int32))
            elif part:
                rank = np.array(self.ranked(part), np.int64)
                at, n = self.start[rank], self.many[rank]
                if n.max() > 1:
                    at = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                parts.append(self.flat[at])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the normalised text that each piece takes; of a character's byte pieces the last takes all."""
        out, value = self.size[ids], self.byte[ids]
        byte = value >= 0
        if byte.any():
            goes_on = byte & (value & 0xC0 == 0x80)
            last = np.flatnonzero(byte & ~np.append(goes_on[1:], False))
            out[byte] = 0
            out[last] = last - np.flatnonzero(byte & ~goes_on) + 1
        return out

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the source it stands for."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return "", np.zeros(1, np.int32)
        made, origin = [], []
        for new, start, length in self.map.parts(raw) if self.map else [(raw, 0, len(raw))]:
            made.append(new)
            origin.append(start + np.arange(length, dtype=np.int32) if len(new) == length and new == raw[start : start + length] else np.full(len(new), start, np.int32))
        out, at = b"".join(made), np.concatenate(origin)
        end = len(raw)
        if self.squeeze:  # one space between words, none before the first
            space = np.frombuffer(out, np.uint8) == 32
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            out, at = np.frombuffer(out, np.uint8)[keep].tobytes(), at[keep]
        if self.prefix and (out or not self.squeeze):
            out, at = b" " + out, np.concatenate([at[:1] if self.squeeze else [0], at]).astype(np.int32)
        at = np.repeat(at, np.where(np.frombuffer(out, np.uint8) == 32, 3, 1))
        out = out.replace(b" ", SPACE.encode())
        if self.squeeze:  # nor after the last
            last = len(out)
            while out.endswith(SPACE.encode(), 0, last):
                last -= 3
            end = int(at[last]) if last < len(out) else end
            out, at = out[:last], at[:last]
        return out.decode("utf-8", "surrogatepass"), np.append(at, np.int32(end))

    def normalised(self, text: str) -> str:
        """The normalised text alone."""
        if self.map or self.squeeze or not text:
            return self.normalise(text)[0]
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each piece's first byte in the source and the byte after its last.

        The dummy prefix stands for no byte. A character that takes several byte pieces belongs to the last one.
        """
        normal, origin = self.normalise(text)
        ids = self.merged(normal)
        ends = np.cumsum(self.sizes(ids), dtype=np.int64)
        return ids, origin[np.concatenate([[0], ends[:-1]]) if len(ends) else ends], origin[ends]


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    """Encoder of a public model, one for each worker."""
    import public_tokenizers

    with open(public_tokenizers.path(model), "rb") as f:
        return Encoder(f.read())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Every document encoded: doc_id, ids, starts, ends (arrays of a number each piece), decoded.

    starts and ends are bytes of the text in UTF-8. No begin or end ids, no sampling; ``decoded`` is what the
    model's decoder makes of the ids. Null texts count as empty: no pieces, and an empty decoded text. Repeated
    rows and null ids are encoded each; an empty table gives none; other columns, of any name, are ignored. Rows
    stay in the task that reads them; a very long text is encoded whole in that task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model)
        for batch in batches:
            done = [codec.encode(t) for t in batch.column("text").to_pylist()]
            decoded = pa.array([codec.decode(ids.tolist()) if len(ids) else "" for ids, _, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(_lists([d[k] for d in done]) for k in range(3)), decoded], names=["doc_id", "ids", "starts", "ends", "decoded"])

    schema = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
