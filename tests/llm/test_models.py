"""Packing, fingerprints, chats, pages, language and shards: round trips, bounds and held-out accuracy."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmart.llm import chat, html_extract, langid, order_minhash, packing, token_shards
from salesmart.llm.common import work_dir
from salesmart.llm.tokens import cuts, encoder

from .data import EMPTY, SCHEMA, documents, words

VOCABULARY = "byte_bpe_50k"


def test_ids_equal_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(f"{VOCABULARY}.json"))
    encode = encoder(VOCABULARY)
    texts = [r[1] or "" for r in documents(3)] + ["  two\n\n spaces   ", "it's 123 ²x", "<|endoftext|> a", "emoji 🙂‍↔️ é", "\r\n\t\x00"]
    for x in texts:
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_cuts():
    for n in (1, 5, 2047, 2048, 2049, 4096, 5000):
        c = cuts(n, 2048)
        assert sum(m for _, m in c) == n and all(m == 2048 for _, m in c[1:]) and [a for a, _ in c] == np.cumsum([0] + [m for _, m in c])[:-1].tolist()


def check_packing(rows, docs, capacity):
    encode = encoder(VOCABULARY)
    ids = {d: np.append(encode(t or ""), 0).astype("<u4") for d, t, *_ in docs}
    by_seq, by_doc = {}, Counter()
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
    assert by_doc == {d: len(x) for d, x in ids.items()}
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_packing(spark):
    docs = documents(4, 120)
    n = check_packing(packing.pack_documents(spark.createDataFrame(docs, SCHEMA), 512).collect(), docs, 512)
    total = sum(len(encoder(VOCABULARY)(r[1] or "")) + 1 for r in docs)
    assert n <= -(-total // 512) + 2
    assert packing.pack_documents(spark.createDataFrame([], EMPTY)).count() == 0


def test_plan_holds_the_histogram():
    rng = random.Random(2)
    for top, n in ((64, 500), (2048, 3000), (100, 60_000)):
        histogram = Counter(min(top, int(rng.lognormvariate(0.6 * np.log(top), 0.8)) + 1) for _ in range(n))
        configs = packing.plan(histogram, top)
        held = Counter()
        for config, times in configs:
            assert sum(k * a for k, a in config) <= top
            for k, a in config:
                held[k] += a * times
        assert held == histogram
        bins, least = sum(t for _, t in configs), -(-sum(k * v for k, v in histogram.items()) // top)
        assert least <= bins <= sum(packing.best_fit(histogram, top).values())


def plain_best_fit(items, capacity):
    rooms = []
    for length in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= length]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - length)
    return len(rooms)


def test_best_fit_is_item_by_item_best_fit():
    rng = random.Random(3)
    for top in (12, 64, 300):
        for _ in range(20):
            items = [min(top, int(rng.lognormvariate(0.6 * np.log(top), 0.8)) + 1) for _ in range(rng.randint(1, 300))]
            assert sum(packing.best_fit(Counter(items), top).values()) == plain_best_fit(items, top)


@pytest.mark.parametrize("each", [1, 10_000])
def test_plan_at_size(each):
    """300,000 pieces and far more: no more sequences than best fit and within 0.1 % of the tokens' bound."""
    rng = np.random.default_rng(5)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 300_000).astype(int) + 1)
    histogram = {int(k): int(n) * each for k, n in zip(*np.unique(lengths, return_counts=True))}
    configs = packing.plan(histogram)
    held = Counter()
    for config, times in configs:
        assert sum(k * a for k, a in config) <= 2048
        for k, a in config:
            held[k] += a * times
    assert held == histogram
    bins, least = sum(t for _, t in configs), -(-sum(k * v for k, v in histogram.items()) // 2048)
    assert bins <= sum(packing.best_fit(histogram, 2048).values()) and bins <= 1.001 * least


def test_program_covers_and_bounds():
    histogram = {5: 30, 4: 50, 3: 20, 2: 10}
    columns, bound = packing.solve(histogram, 10)
    used = Counter()
    for config, x in columns.items():
        assert sum(k * a for k, a in config) <= 10
        for k, a in config:
            used[k] += a * x
    assert all(used[k] <= n + 1e-6 for k, n in histogram.items())
    assert bound <= sum(t for _, t in packing.plan(histogram, 10)) + 1e-9 and packing.plan({}, 10) == []


def test_price_is_the_best_knapsack():
    from itertools import product

    values = np.zeros(13)
    values[[3, 5, 7]] = [2.0, 3.6, 5.1]
    config = packing.price(values, 12)
    best = max(a * 2 + b * 3.6 + c * 5.1 for a, b, c in product(range(5), repeat=3) if 3 * a + 5 * b + 7 * c <= 12)
    assert abs(sum(values[k] * a for k, a in config.items()) - best) < 1e-9


def test_order_minhash(spark):
    docs = documents(5)
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: r for r in order_minhash.fingerprint_pairs(df).collect()}
    texts = [t or "" for _, t in sorted((d, t) for d, t, *_ in docs)]
    sign = [order_minhash.signature(order_minhash.codes(t)) for t in texts]
    assert len(got) == len(docs)
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        s = order_minhash.signature(order_minhash.codes(edited))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), sign[i].tobytes().hex(), s.tobytes().hex())
        assert r.near_edited == order_minhash.likeness(sign[i], s) and r.near_next == order_minhash.likeness(sign[i], sign[(i + 1) % len(texts)])
    assert {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(df).collect()} == {i: r.fingerprint for i, r in got.items()}
    assert order_minhash.fingerprint_pairs(spark.createDataFrame([], EMPTY)).count() == 0
    one = order_minhash.fingerprint_pairs(spark.createDataFrame([(None, "abc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].doc_id is None and one[0].near_next == 1.0


def plain_signature(text, k=6, size=128):
    """The signature by its definition, in plain whole numbers."""
    full = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    if not text:
        return [0] * size
    k = min(k, len(text))
    seen, grams = Counter(), []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & full
        h = mix((h + k) & full)
        grams.append((mix((h + seen[h] * 0xD1B54A32D192ED03) & full), i))
        seen[h] += 1
    grams.sort()
    out = []
    for j in range(size):
        first = next((n for n, (g, _) in enumerate(grams) if g >= j << 57), 0)
        value = 0
        for g, _ in sorted((grams[(first + n) % len(grams)] for n in range(min(2, len(grams)))), key=lambda x: x[1]):
            value = mix((value * 0x9E3779B97F4A7C15 + g) & full)
        out.append(value >> 48 | 1)
    return out


def test_signature_is_as_defined():
    rng = random.Random(12)
    for text in ["", "a", "abcdef", "aaaaaaaaaaaaaaaa", "abcabcabcabc", *(words(rng, n) for n in (1, 3, 20, 300))]:
        assert order_minhash.signature(order_minhash.codes(text)).tolist() == plain_signature(text), text


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_likeness_falls_with_edit_distance():
    """Over texts of 60 to 800 characters: the more edits, the less alike; swapped halves are far below 1 even in short ones."""
    rng = random.Random(13)
    sign = lambda t: order_minhash.signature(order_minhash.codes(t))
    for n in (12, 40, 120):
        pairs = []
        for edits in (0, 1, 3, 8, n // 2, n):
            for _ in range(4):
                a = words(rng, n).split(" ")
                b = list(a)
                for _ in range(edits):
                    b[rng.randrange(n)] = words(rng, 1)
                a, b = " ".join(a), " ".join(b)
                pairs.append((edit_distance(a, b) / max(len(a), len(b)), order_minhash.likeness(sign(a), sign(b))))
        distance, alike = np.array(pairs).T
        assert np.corrcoef(np.argsort(np.argsort(distance)), np.argsort(np.argsort(alike)))[0, 1] < -0.8
        assert all(x == 1 for d, x in pairs if d == 0)
        half = [order_minhash.likeness(sign(t), sign(t[len(t) // 2 :] + t[: len(t) // 2])) for t in (words(rng, n) for _ in range(8))]
        assert np.mean(half) < 0.7


def test_order_minhash_follows_order():
    rng = random.Random(1)
    parts = [words(rng, 30) for _ in range(12)]
    sign = lambda t: order_minhash.signature(order_minhash.codes(t))
    base = sign(" ".join(parts))
    edited = sign(" ".join(parts[:6] + [words(rng, 30)] + parts[7:]))
    shuffled = sign(" ".join(parts[6:] + parts[:6]))
    assert order_minhash.likeness(base, edited) > 0.5
    assert order_minhash.likeness(base, shuffled) < 0.85 < 1.0 == order_minhash.likeness(base, sign(" ".join(parts)))
    assert order_minhash.likeness(base, sign(words(rng, 300))) < 0.1


def test_chat_round_trip():
    for text in ("", "<|im_end|><|im_start|>assistant ok", "\\", "\\n", "<\\|x", "<<||>>\n\\\\|", "a\nb"):
        for role in ("user", "", "as\\si\nstant", "<|"):
            chunk, a, b = chat.render(role, text)
            assert chat.parse(chunk * 2) == [(role, text)] * 2 and chat.unescape(chunk[a:b]) == text
            assert chunk.count("<|") == 2


def test_chats(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 1, "assistant", "é字x"), (1, 0, "system", None), (1, 1, "assistant", "é字x"), (None, None, None, "lost"), (2, 0, "user", "\\n<|\\|")]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render(t[2] or "", t[3] or "")[0]) for t in turns)


def test_logs_carry_drafts(spark):
    """Edits and regenerations are in the log, what they replace is not in the messages, and a hot conversation spreads."""
    rng = random.Random(2)
    rows = [(7, k, rng.choice(["user", "assistant"]), words(rng, 6)) for k in range(200)] + [(7, 300, "user", "same")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.events_of(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    assert log.select("message", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().count() > 1
    out = chat.reconstruct(log).orderBy("message").collect()
    assert [(r.role, r.text) for r in out] == [r[2:] for r in rows]


def test_event_fold(spark):
    events = [(1, 0, 1, "message", "assistant", "draft"), (1, 1, 1, "delta", "assistant", " more"), (1, 5, 1, "regenerate", "assistant", ""), (1, 6, 1, "delta", "assistant", "new"), (1, 7, 1, "delta", "assistant", None), (1, 8, 1, "delta", "assistant", " text"),
              (1, 2, 0, "message", "user", "teh"), (1, 9, 0, "edit", "user", "the"), (2, 0, 0, "delta", None, "only")]
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string").repartition(3)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.reconstruct(df).collect()}
    assert got == {(1, 0): ("user", "the"), (1, 1): ("assistant", "new text"), (2, 0): ("", "only")}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad -->
<div class="ad">buy</div><article><h1>Head &amp;  line</h1><p><b>First.<br><p>Second
 <i>part</i> &eacute;&#x5b57;</p><div class="comments"><p>reader</p></div></article><footer>&copy; site</footer>"""


def test_blocks():
    assert html_extract.blocks(PAGE) == (["Head & line", "First.", "Second part é字"], [])
    assert html_extract.blocks(None) == ([], []) and html_extract.blocks("plain <b>text") == ([], ["plain text"])
    assert html_extract.blocks("<html><head><title>T</title><meta name=a><body><article><p>text<p>more</article>") == (["text", "more"], [])
    hidden = ['class="site-navigation"', 'id="cookie_consent"', 'class="x replies"', 'style="color:red; display: none"', "hidden", 'role="banner"']
    seen = ['class="address"', 'class="headers"', 'style="display:block"', 'id="shared"']
    page = "<article>" + "".join(f"<div {a}>{i}</div>" for i, a in enumerate(hidden + seen)) + "</article>"
    assert html_extract.blocks(page) == (["6", "7", "8", "9"], [])


def test_common_lines():
    assert html_extract.common_lines(list("abcbd"), list("xbcd")) == {1, 2, 4}
    assert html_extract.common_lines(list("ab"), []) == set()


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
    return row[-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randint(0, 40))] for _ in range(2))
        found = sorted(html_extract.common_lines(a, b))
        rest = iter(b)
        assert all(a[i] in rest for i in found)  # in order in b, too
        assert len(found) == table_length(a, b)
    a = [rng.randrange(2000) for _ in range(8000)]
    assert len(html_extract.common_lines(a, a[:3000] + a[4000:])) == 7000


def test_structure_keeps_text():
    """What is no furniture stays: an article's title in its header, words of classes on text, a form around the page."""
    lines = lambda x: [t for own in html_extract.blocks(x) for t in own]
    assert lines("<header>Site</header><article><header><h1>Title</h1></header><p>Text</article>") == ["Title", "Text"]
    assert lines('<article><h1 class="entry-header">T</h1><p class="market share">A<section id="related-work">B</section><div class="comment-list">C</div></article>') == ["T", "A", "B"]
    assert lines("<form><p>The whole page is in a form.<input></p></form>") == ["The whole page is in a form."]
    assert lines("<form><label>Mail</label></form><p>The page's own text.") == ["The page's own text."]
    began = time.time()
    assert len(lines("<ul>" + "<li>x" * 100_000)) == 100_000
    assert time.time() - began < 10


def test_near_copies_take_nothing(spark):
    """Neighbours that share most of the text are copies; those that share the frame are differenced."""
    div = lambda *lines: "".join(f"<div>{x}</div>" for x in lines)
    body = [f"a long line {k} of the text that both pages have" for k in range(9)]
    rows = [(1, "http://c.org/1", div("Top", *body, "one")), (2, "http://c.org/2", div("Top", *body, "two")), (3, "http://c.org/3", div("Top", "another page's own text, of some length"))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "\n".join(["Top", *body, "one"]), 2: "\n".join([*body, "two"]), 3: "another page's own text, of some length"}


def test_extract(spark):
    div = lambda *lines: "".join(f"<div>{x}</div>" for x in lines)
    rows = [(1, "http://h.org/a/1", div("Top", "one one", "End")), (2, "https://www.h.org/a/2?q=1", div("Top", "two two", "End")), (3, "http://h.org/a/3#x", div("Top", "three", "End")),
            (4, "http://alone.org/", div("Top", "kept")), (5, "http://h.org/a/4", PAGE), (6, None, None), (7, "http://h.org/a/4", ""), (1, "http://h.org/a/1", div("Top", "one one", "End"))]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    article = "Head & line\nFirst.\nSecond part é字"
    assert got == [(1, "one one", 7), (1, "one one", 7), (2, "two two", 7), (3, "three", 5), (4, "Top\nkept", 8), (5, article, len(article)), (6, "", 0), (7, "", 0)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extract_runs_and_teasers(spark):
    """Runs of equal pages have the nearest different pages as neighbours; an article protects only where it holds most of the text."""
    div = lambda *lines: "".join(f"<div>{x}</div>" for x in lines)
    rows = [(i, f"http://h.org/a/{i:03}", div("Top", "same text", "End")) for i in range(10, 60)]
    rows += [(1, "http://h.org/a/001", div("Top", "first", "End")), (90, "http://h.org/a/090", div("Top", "last", "End")), (91, "http://i.org/1", div("Top", "End"))]
    teaser = "<article>See also</article>"
    rows += [(200 + i, f"http://t.org/{i}", teaser + div("Top", f"the body of page {i}", "End")) for i in range(3)]
    rows += [(300 + i, f"http://u.org/{i}", div("Top", f"by {i}") + "<article>a long text that all pages share</article>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    want = {i: "same text" for i in range(10, 60)} | {1: "first", 90: "last", 91: "Top\nEnd"}
    want |= {200 + i: f"the body of page {i}" for i in range(3)} | {300 + i: f"by {i}\na long text that all pages share" for i in range(2)}
    assert got == want


def test_language(spark):
    rng = random.Random(8)
    parts = {"aa": "the and ing er on th".split(), "bb": "que les eau é oi tion".split(), "cc": "sch ung ß ü ver ich".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([2, 20, 200]))), lang) for i in range(300) for lang in [rng.choice(list(parts))]]
    extra = [(1000, None, "aa"), (1001, "12 -- 34", "bb"), (1002, "", None), (None, "ung sch", "cc")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert [(got[i].lang_pred, got[i].score, got[i].accepted) for i in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert got[None].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == sum(r.accepted for r in got.values())
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_training_segments(spark):
    params = langid.Params(segment=5, per_document=4)
    texts = ["", "abc", "éèêëēabcde", "é" * 20, "".join(chr(0x4E00 + i) for i in range(97))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.parts for r in df.select("text", langid.segments(params).alias("parts")).collect()}
    assert got[""] == [] and got["abc"] == ["abc"] and got[texts[2]] == ["éèêëē", "abcde"] and got[texts[3]] == ["ééééé"] * 4
    assert got[texts[4]] == [texts[4][k : k + 5] for k in (0, 24, 48, 72)]


def test_permutation():
    for n in (1, 2, 5, 64, 1000, 4097):
        p = token_shards.permute(np.arange(n), n, 3)
        assert sorted(p.tolist()) == list(range(n))
    assert token_shards.permute(np.arange(1000), 1000, 3).tolist() != token_shards.permute(np.arange(1000), 1000, 4).tolist()


def test_pieces_are_not_moved_for_their_slots(spark):
    """The stored pieces are bucketed by the partition that made them, so that the join with the slots moves only slots."""
    rows = spark.range(0, 1000, 1, 5).select("id", F.spark_partition_id().cast("long").alias("part"))
    table = token_shards._stored(rows, work_dir(spark))
    slots = spark.range(5).select(F.col("id").alias("part"), F.lit(1).alias("slots"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(table).join(slots, "part")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000 and plan.count("Exchange hashpartitioning(part") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {table}")


def test_shards(spark, tmp_path):
    docs = documents(6)
    df = spark.createDataFrame(docs, SCHEMA)
    path = f"file://{tmp_path}/shards"
    n = token_shards.write_shards(df, path, stride=64, shard=32, width=2)
    rows = sorted(token_shards.read_shards(spark, path).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(n)) and all(r.shard == r.slot // 32 for r in rows)
    later = token_shards.read_shards(spark, path, n // 2, shard=32, width=2)
    assert sorted(r.slot for r in later.collect()) == list(range(n // 2, n)) and "GreaterThanOrEqual(slot" in later._jdf.queryExecution().toString()
    files = later.select(F.input_file_name().alias("f")).distinct().count()
    assert files == -(-n // 64) - n // 2 // 64  # one file a range, and only the ranges from the slot on are opened
    written = spark.read.parquet(path).groupBy(F.input_file_name().alias("f"), "first").agg(F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert sorted((r.a, r.b) for r in written) == [(k, min(k + 63, n - 1)) for k in range(0, n, 64)] and all(r.first == r.a for r in written)
    read = list(token_shards.sequences(spark, path, n - 100, 32, 2))
    assert [k for k, _ in read] == list(range(n - 100, n)) and all(x.tobytes() == bytes(rows[k].ids) for k, x in read)
    ids = {d: np.append(encoder(VOCABULARY)(t or ""), 0) for d, t, *_ in docs}
    back = {d: {} for d in ids}
    for r in rows:
        x = np.frombuffer(r.ids, "<u2")
        assert len(x) == 64 and not x[r.length :].any()
        back[r.doc_id][r.piece] = x[: r.length]
    for d, x in ids.items():
        assert np.concatenate([back[d][k] for k in sorted(back[d])]).tolist() == x.tolist()
    again = f"file://{tmp_path}/again"
    token_shards.write_shards(df.repartition(7, "text"), again, stride=64, shard=32)  # another layout, the same order
    assert token_shards.read_shards(spark, again).exceptAll(token_shards.read_shards(spark, path)).count() == 0
    assert token_shards.write_shards(spark.createDataFrame([], EMPTY), f"file://{tmp_path}/none") == 0


def test_buckets_follow_the_bytes(spark, monkeypatch):
    """As many buckets as asked for, of equal bytes, also where one id has a third of the rows."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 5000 == 1, None).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    found = order_minhash.edges(rows, 12)
    assert len(found.firsts) > 45_000
    found = order_minhash.edges(rows, 5_000)
    sizes = order_minhash.with_next(rows, found).where("ahead = 0").groupBy("bucket").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()
    total = sum(r.n for r in sizes)
    assert len(sizes) == len(found.firsts) and total / 5_000 <= len(sizes) <= total / 5_000 + 8 and max(r.n for r in sizes) <= 5_030


def test_neighbours_across_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET", 300)
    test_order_minhash(spark)
    docs = [(i, f"{i} {'again ' * (i % 5)}") for i in range(20)] + [(3, "other"), (3, "third"), (3, "third"), (None, "none"), (None, "nil")]
    got = order_minhash.fingerprint_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in docs)


SPARSE = {"every seventh": (range(500, 901, 7), 76_418, 69_883), "coarse": ((310, 480, 650, 900, 1200), 76_667, 73_473), "every tenth": (range(301, 1101, 10), 69_931, 68_266), "all": (range(500, 900), 76_544, 70_287)}


@pytest.mark.parametrize("lengths, plain, most", SPARSE.values(), ids=SPARSE)
def test_plan_of_sparse_lengths(lengths, plain, most):
    """Where few columns fill a sequence to the last token the program still decides; figures are of 200,000 pieces."""
    rng = np.random.default_rng(1)
    histogram = Counter(rng.choice(list(lengths), 200_000).tolist())
    found = packing.plan(histogram)
    held: Counter = Counter()
    for config, times in found:
        assert sum(k * a for k, a in config) <= packing.SEQUENCE
        for k, a in config:
            held[k] += a * times
    assert held == histogram
    n, best = sum(t for _, t in found), sum(packing.best_fit(histogram, packing.SEQUENCE).values())
    assert packing.solve(histogram, packing.SEQUENCE)[1] <= n <= best - 0.8 * (plain - most)


def test_ranges_of_turns_are_cut_by_numbers(spark):
    """Spark samples what ranges are cut by to the driver, so that no text may be among it."""
    turns = spark.createDataFrame([(1, 0, "user", "a text")], "conv_id long, turn long, role string, text string")
    plan = chat.events_of(turns)._jdf.queryExecution().optimizedPlan().toString()
    cut = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(cut) == 1 and cut[0].count("xxhash64(") == 2
    assert "role" not in cut[0].replace("xxhash64(role", "") and "text" not in cut[0].replace("xxhash64(text", "")


def test_three_thousand_languages(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.md5((F.col("id") % 3000).cast("string"))).alias("text"), F.concat(F.lit("l"), F.col("id") % 3000).alias("lang"))
    params = langid.Params(steps=200, epochs=1, buckets=1 << 12)
    model = langid.train(rows, params)
    assert len(model.languages) > 1500
    lang, score, _ = model.predict("word of some language")
    assert lang in model.languages and 0 < score < 1
