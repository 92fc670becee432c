"""The pipeline's stages on awkward tables and against brute force, and the queries as registered."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salesmart.llm import langid, queries
from salesmart.llm.common import materialise

from .data import SCHEMA, documents
from .test_exact import brute_secrets, brute_words
from .test_models import check_packing
from .test_near_copies import brute_groups

SF = "/root/testdata/sf0.001"
#: Names that operators give to columns of their own.
CLASHING = ("_p", "_lang", "_score", "_predicted", "_d", "_k", "_s", "_hit", "_th", "_t", "_salt", "_own", "_n", "_start", "_rank", "Lang_Pred", "group", "key", "c", "w", "m")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_on_awkward_tables(spark, docs):
    """Extra columns of any name, nulls in any column, empty and repeated rows: no stage crashes, all columns stay."""
    rows = [(None, None, None, None, None), (None, "a text without an id", "en", None, None), (1, None, "en", "s", 0), (1, "", None, "s", 0)] * 2
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    all_ = docs.unionByName(odd.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    now = all_.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHING)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == now.columns, name
        now = materialise(out)
        assert 0 < now.count() <= all_.count(), name
        assert now.where(" or ".join(f"`{c}` <> 'x{k}'" for k, c in enumerate(CLASHING))).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.where("piece = 0").count() == now.count()


def test_stages_on_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def brute_contaminated(rows, items):
    held = set()
    for item in items:
        w = brute_words(item)
        k = min(len(w), 5)
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, text in rows:
            v = brute_words(text)
            if own and len(own & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}) >= 0.8 * len(own):
                held.add(d)
    return held


def test_run_against_brute_force(spark, docs):
    accepted = {r.doc_id for r in langid.identify(docs).collect() if r.accepted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in accepted]
    label = brute_groups(rows)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[label[i]] = min(d, first.get(label[i], d))
    rows = [(d, t) for d, t in rows if d in set(first.values())]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = brute_contaminated(rows, items)
    rows = [(d, t) for d, t in rows if d not in gone]
    assert gone and rows
    # the masked texts are the operator's own, of which nothing found by the base patterns is left
    kept = docs.where(F.col("doc_id").isin([d for d, _ in rows]))
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, kept, SF).collect()}
    for d, t in rows:
        assert (masked[d] == t) == (not brute_secrets(t)) or "AKIA" in t
        assert not any(t[int(a) : int(b)] in masked[d] for _, a, b in (s.split(":") for s in brute_secrets(t)))
    check_packing(corpus_pipeline.run(spark, SF).collect(), sorted(masked.items()), 2048)


COLUMNS = {
    "op1_pack_sequences": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2_order_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_format_chats": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_simhash_near_duplicates": "doc_id fingerprint component_id",
    "op5_scan_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_extract_pages": "page_id url text n_chars",
    "op8_identify_language": "doc_id held_out lang_pred score",
    "op9_token_shards": "slot shard doc_id piece length ids_crc32",
    "op10_decontaminate": "doc_id item_id",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_queries(spark, docs, name):
    """Each query runs over the whole table and returns its columns; a row a document, page or conversation where it says so."""
    out = materialise(queries.queries()[name](spark, SF))
    assert set(COLUMNS[name].split()) <= set(out.columns)
    n = docs.count()
    if name.split("_")[0] in ("op2", "op4", "op5", "op6", "op8"):
        assert out.count() == out.select("doc_id").distinct().count() == n
    elif name.startswith("op7"):
        assert out.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    elif name.startswith("op3"):
        chats = spark.read.parquet(f"{SF}/conversations.parquet")
        assert out.count() == chats.select("conv_id").distinct().count() + 1
        said = "<|im_end|><|im_start|>assistant ok"
        one = out.where("conv_id = -1").first()
        assert (one.n_turns, one.loss_chars, one.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
        assert one.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    elif name.startswith("op1_") or name.startswith("op9"):
        assert out.select("doc_id").distinct().count() == n
        assert out.select("doc_id", "piece").distinct().count() == out.count()


def test_documents_of_the_fixture_pass_all_stages(spark):
    now = spark.createDataFrame(documents(8), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        now = materialise(stage(spark, now, SF))
    assert now.count() > 10
