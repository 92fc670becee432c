"""Piece encoding, alignment of tokenizers and periodic runs against the libraries and against plain definitions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from salesmart.llm import periodic_runs, piece_encoding, queries, token_alignment

from .data import EMPTY, SCHEMA, documents

MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "▁", "é", "漢", "🎉", "\n", "\t", "\0", "the", "<s>", "<0x41>", "</s>", "<|endoftext|>", "xxxxx", "\r\n", "ﬃ", "1", "22", "ｱ", "①", "　", "é", "㌔", " ", "Å", "A"]


def strings(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rows = documents(9)
    texts = [*strings(1, 60), "a b " * 900, "z" * 3000, " ".join("xyz"[i % 3] for i in range(40)), "▁ a", "  ", " lead", "<|endoftext|> and more"]
    rows += [(100 + i, t, None, "s", len(t), "z") for i, t in enumerate(texts)]
    return [*rows, rows[20], (None, "no id at all", None, "s", 1, "z")]


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tokens")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# piece encoding


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
def test_normalised_texts_and_spans_are_the_librarys(rule, squeeze):
    made = pb.ModelProto()
    made.ParseFromString(open(MODEL, "rb").read())
    rules = pb.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=squeeze).serialized_model_proto())
    made.normalizer_spec.CopyFrom(rules.normalizer_spec)
    own, library = piece_encoding.Encoder(made.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=made.SerializeToString())
    for text in strings(3, 400):
        ids, starts, ends = own.encode(text)
        assert own.normalise(text)[0] == library.normalize(text)
        pieces = library.encode(text, return_type="proto").pieces
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist())) == [(p.id, p.begin, p.end) for p in pieces], text


def test_the_longest_key_is_replaced():
    spec = pb.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
    mapped = piece_encoding.CharacterMap(spec.normalizer_spec.precompiled_charsmap)
    assert mapped.longest("e\u0301e".encode(), 0) == (3, "\u00e9".encode())  # the letter and its accent before the letter alone
    assert mapped.longest(b"e", 0) in (None, (1, b"e"))
    assert list(mapped.parts("\u2460\u2461x".encode())) == [(b"1", 0, 3), (b"2", 3, 3), (b"x", 6, 1)]


def test_marks_in_a_row():
    own, library = piece_encoding.encoder("piece_bpe_32k.model"), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k in range(1, 60):
        for text in (" " * k, "word" + " " * k + "the end", "▁" * k + "x", " " * k + "a  b   c"):
            assert own.encode(text)[0].tolist() == library.encode(text)


def test_spans_cut_the_text_up():
    own = piece_encoding.encoder("piece_bpe_32k.model")
    for text in strings(4, 200):
        _, starts, ends = own.encode(text)
        raw = text.encode()
        assert b"".join(raw[s:e] for s, e in zip(starts, ends)) == raw
        assert all(s == e for s, e in zip(starts[1:].tolist(), ends[:-1].tolist()))


def test_op11(spark, tables, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode())))
    got = queries.op11_encode_pieces(spark, tables)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_other_models_are_refused():
    made = pb.ModelProto()
    made.ParseFromString(open(MODEL, "rb").read())
    made.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError, match="byte pieces"):
        piece_encoding.Encoder(made.SerializeToString())


# alignment


def by_definition(rows: list[tuple]) -> list[tuple]:
    """Figures of every document from all pairs of its tokens' byte ranges."""
    a_of, b_of = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_of.encode_special_tokens = True
    names = {c: b for b, c in _byte_letters().items()}
    done, count = [], Counter()
    for doc, text, *_ in rows:
        raw = (" " + (text or "")).encode()
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        ta = [bytes(names[c] for c in a_of.id_to_token(i)) for i in a]
        tb = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_of.id_to_piece(i)]]
        if not text or b"".join(ta) != raw or b"".join(tb) != raw:
            done.append((doc, [], [], "", []))
            continue
        ea, eb = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        both = sorted(set(ea) & set(eb))
        groups = [([i for i, e in zip(a, ea) if low < e <= high], [i for i, e in zip(b, eb) if low < e <= high]) for low, high in zip([0, *both], both)]
        linked = [(i, j) for i, e, t in zip(a, ea, ta) for j, f, u in zip(b, eb, tb) if max(e - len(t), f - len(u)) < min(e, f)]
        count.update(linked)
        done.append((doc, a, b, sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)), linked, len(groups)))
    top: dict[int, int] = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(doc, len(a), len(b), n[0] if n else 0, len(linked), sum(count[p] == top[p[1]] for p in linked), sum(count[p] for p in linked), digest) for doc, a, b, digest, linked, *n in done]


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(other)}}


def test_op12(spark, tables, rows):
    got = queries.op12_align_tokens(spark, tables).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = by_definition([r for r in rows if len(r[1] or "") < 2500])
    short = {r[0] for r in rows if len(r[1] or "") < 2500}
    long = [r for r in rows if r[0] not in short]
    assert got.count() == len(rows) and long
    mine = got.drop("n_best", "count_sum").collect()
    assert Counter(map(tuple, [r for r in mine if r[0] in short])) == Counter(r[:5] + r[7:] for r in want)


def test_op12_counts(spark, rows, tmp_path, monkeypatch):
    small = [r for r in rows if len(r[1] or "") < 2500]
    spark.createDataFrame(small, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # several blocks a task, some of empty texts alone
    try:
        got = queries.op12_align_tokens(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(map(tuple, got)) == Counter(by_definition(small))


def test_groups_as_arrays(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    own = token_alignment.aligner("byte_bpe_50k", "piece_bpe_32k.model")
    for r in token_alignment.align_documents(docs).where("size(a_cuts) > 0").limit(40).collect():
        assert r["a_cuts"][-1] == len(r["a_ids"]) and r["b_cuts"][-1] == len(r["b_ids"]) and len(r["a_cuts"]) == len(r["b_cuts"])
        for a0, a1, b0, b1 in zip([0, *r["a_cuts"]], r["a_cuts"], [0, *r["b_cuts"]], r["b_cuts"]):
            assert b"".join(own.text_a[i] for i in r["a_ids"][a0:a1]) == b"".join(own.text_b[i] for i in r["b_ids"][b0:b1])


# periodic runs


def runs_by_definition(words: list) -> list[tuple[int, int, int]]:
    seen: dict = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in seen.items())


def test_runs_by_definition():
    rng, total = random.Random(5), 0
    for _ in range(1500):
        k, words = rng.choice([1, 2, 3, 5, 30]), []
        while len(words) < rng.randint(0, 160):
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 14))]
            words += (unit * 8)[: rng.randint(1, 8 * len(unit))] if rng.random() < 0.5 else unit
        if rng.random() < 0.2:
            words = words[:20] * rng.randint(3, 6)
        want = runs_by_definition(words)
        total += len(want)
        assert periodic_runs.runs_of(np.array(words, np.int64)) == want
    assert total > 500


def test_split_keeps_runs_and_drops_the_rest():
    words = np.array([*range(100, 130), *[1, 2, 3] * 4, *range(200, 230), *[7] * 3, *[8] * 6], np.int64)
    assert periodic_runs.split(words) == [(30, 42), (75, 81)]


@pytest.mark.parametrize("words", [np.zeros(200_000, np.int64), np.tile(np.random.default_rng(1).integers(0, 500, 1000), 200), np.random.default_rng(2).integers(0, 2, 200_000)], ids=["one word", "one period", "two words"])
def test_runs_of_very_long_texts(words):
    found = periodic_runs.runs_of(words)
    for s, n, q in found[:50]:
        part = words[s : s + n]
        assert n >= max(6, 4 * q) and (part[q:] == part[:-q]).all()
        assert (s == 0 or words[s - 1] != words[s - 1 + q]) and (s + n == len(words) or words[s + n] != words[s + n - q])
    if words[:2000].max() != 1:
        assert found == [(0, len(words), 1 if words.max() == 0 else 1000)]


def test_op13(spark, tables, rows):
    want = []
    for doc, text, *_ in rows:
        words = periodic_runs.WORD.findall(text or "")
        h, n = 1 if doc is None else zlib.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = runs_by_definition(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
        milli = 1000 * best[1] // best[2] if found else None
        kept = [w for i, w in enumerate(words) if i not in gone]
        want.append((doc, len(found), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(kept))))
    got = queries.op13_periodic_runs(spark, tables)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert sum(w[1] > 0 for w in want) >= 3


@pytest.mark.parametrize("query", [queries.op11_encode_pieces, queries.op12_align_tokens, queries.op13_periodic_runs])
def test_empty_tables(spark, tmp_path, query):
    spark.createDataFrame([], EMPTY).write.parquet(f"{tmp_path}/documents.parquet")
    assert query(spark, str(tmp_path)).count() == 0
