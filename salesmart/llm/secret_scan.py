"""Secret scanning with multipart credential linking, in DataFrame functions only.

Positions come from splitting: the parts between the matches of a pattern and the matches themselves
alternate, so their running lengths (in code points) give each match's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import free, materialise, text_or_empty

# The patterns of the base kinds and of the parts that are linked.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LONG = r"[0-9a-f]{24,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"https?://[^\x20\x09-\x0D\"'<>]+"
#: Least characters of an assigned value, an access identifier and a hex run.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Base kinds in the order in which they are listed at one start.
KINDS = ("assign", "access", "hex", "linked_secret", "linked_endpoint")
#: Characters to each side of an access identifier that make its scope.
SCOPE = 400

#: Matches walked at once, and code points of a text masked at once.
BLOCK, CHUNK = 64, 65_536

SPAN = "struct<start:bigint,ord:int,end:bigint>"


def _matches(pattern: str, ord_: int, keep) -> F.Column:
    """Spans of the matches in ``text`` that ``keep`` admits; an empty array where there is none.

    Arrays are grown by copying, so matches are walked in blocks: each block's spans count from its own
    start, and the blocks' starts are added at the end.
    """
    parts = F.split("text", pattern, -1)
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    zipped = F.zip_with(whole, F.slice(parts, 1, F.size(whole)), lambda m, g: F.struct(F.length(g).cast("bigint").alias("gap"), m.alias("m")))
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.lit(0).cast("bigint")

    def step(acc: F.Column, x: F.Column) -> F.Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def blocks(found: F.Column) -> F.Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda k: F.aggregate(F.slice(found, k * BLOCK + 1, BLOCK), F.struct(zero.alias("at"), none.alias("out")), step))

    def joined(done: F.Column) -> F.Column:
        starts = F.aggregate(
            done, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]
        return F.flatten(F.zip_with(done, starts, lambda x, at: F.transform(x["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["ord"].alias("ord"), (s["end"] + at).alias("end")))))

    # one-element arrays bind what is used many times, so that it is computed once
    walked = F.transform(F.transform(F.array(zipped), blocks), joined)[0]
    return F.when(F.col("text").rlike(pattern), walked).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, weak, ends): spans of the base kinds and of weak parts, one row per row of ``docs``.

    ``key`` hashes the text, so that repeated rows with one doc_id and different texts stay apart.
    """
    text = docs.select("doc_id", text_or_empty().alias("text"))
    assign = _matches(ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"])
    access = _matches(ACCESS, 1, lambda m: F.length(m) >= LEAST["access"])
    long_hex = _matches(HEX_LONG, 2, lambda m: F.lit(True))
    has_id = F.col("text").rlike(ACCESS)
    none = F.array().cast(f"array<{SPAN}>")
    return text.select(
        "doc_id",
        F.when(has_hit(), F.xxhash64("text")).alias("key"),
        F.array_sort(F.concat(assign, access, long_hex)).alias("base"),
        F.when(has_id, _matches(WEAK_SECRET, 3, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"))).otherwise(none).alias("weak"),
        F.when(has_id, _matches(ENDPOINT, 4, lambda m: F.lit(True))).otherwise(none).alias("ends"),
    )


def has_hit() -> F.Column:
    """Whether a text matches any base pattern."""
    return F.coalesce(F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX_LONG), F.lit(False))


def linked(cands: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, key, span) of weak parts that complement an access identifier within its scope.

    An interval join: the scope of each identifier covers bins of ``scope`` characters, each weak part
    lies in the bins it touches, and the parts of a bin are compared on their spans. A weak secret is
    reported beside an identifier, an endpoint beside an identifier that also has a secret, weak or
    assigned, in its scope.
    """
    rows = cands.where("key is not null")
    key = ["doc_id", "key"]

    def bins(start, end):
        return F.explode(F.sequence(F.floor(start / scope).cast("bigint"), F.floor((end - 1) / scope).cast("bigint")))

    ids = rows.select(*key, F.explode("base").alias("i")).where("i.ord = 1").distinct()
    ids = ids.select(*key, "i", bins(F.greatest(F.col("i.start") - scope, F.lit(0)), F.col("i.end") + scope).alias("bin"))
    assigned = F.filter("base", lambda s: s["ord"] == 0)
    parts = rows.select(*key, F.explode(F.concat("weak", "ends", assigned)).alias("p")).distinct()
    parts = parts.select(*key, "p", bins(F.col("p.start"), F.col("p.end")).alias("bin"))
    a, b = ids.alias("a"), parts.alias("b")
    met = a.join(
        b,
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.bin") == F.col("b.bin"))
        & (F.col("b.p.start") < F.col("a.i.end") + scope) & (F.col("b.p.end") > F.col("a.i.start") - scope),
    ).select("a.doc_id", "a.key", "i", "p").distinct()
    both = met.groupBy(*key, "i").agg(F.max(F.col("p.ord") != 4).alias("secret"), F.collect_set("p").alias("ps"))
    return both.select(*key, "secret", F.explode("ps").alias("span")).where("span.ord = 3 or (span.ord = 4 and secret)").select(*key, "span").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, base and spans (arrays of start, kind number, end).

    Base kinds are found leftmost and without overlap, each kind by itself; linked parts are added and
    never displace them. Null and empty texts have empty arrays; a null doc_id is a value like any other.
    Repeated rows are scanned each and come back each; an empty table gives none; other columns, of any name,
    are ignored. A very long text is scanned whole, masked in chunks of 65,536 characters.
    """
    cands = materialise(candidates(docs))
    more = linked(cands, scope).groupBy("doc_id", "key").agg(F.collect_list("span").alias("more"))
    more = more.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "more")
    out = cands.where("key is not null").join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    out = out.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))).alias("spans"))
    return out.unionByName(cands.where("key is null").select("doc_id", "key", "base", F.col("base").alias("spans")))


def listed(spans: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` and ``n_chars`` set anew.

    Overlapping spans become one mask. Texts without a find stay as they are, nulls too; only texts
    with a find are shuffled, to meet their spans. All columns stay, whatever their names; an empty table
    stays empty, and repeated rows are masked each.
    """
    d, k, s = free(docs, "_d", "_k", "_s")
    found = scan(docs.select("doc_id", "text")).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("spans").alias(s)).distinct()
    clean, dirty = docs.where(~has_hit()), docs.where(has_hit())
    dirty = dirty.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(k)), "left")

    def masked(chunk: F.Column, number: F.Column) -> F.Column:
        first = number.cast("bigint") * CHUNK
        mine = F.filter(s, lambda x: (x["start"] < first + CHUNK) & (x["end"] > first))
        return F.aggregate(
            mine,
            F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
            lambda acc, x: F.struct(
                F.greatest(acc["at"], F.least(x["end"] - first, F.lit(CHUNK).cast("bigint"))).alias("at"),
                # a span that began in the chunk before has its mask there
                F.when(
                    x["start"] - first >= acc["at"],
                    F.concat(acc["out"], F.substring(chunk, acc["at"].cast("int") + 1, (x["start"] - first - acc["at"]).cast("int")), F.lit(mask)),
                ).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: F.concat(acc["out"], F.substring(chunk, acc["at"].cast("int") + 1, F.lit(CHUNK))),
        )

    # texts are masked chunk by chunk, since reaching a place in a string takes the longer the further it is
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = F.array_join(F.transform(chunks, masked), "")
    dirty = dirty.withColumn("text", F.when(F.col(s).isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in docs.columns:
        dirty = dirty.withColumn("n_chars", F.length("text").cast("long"))
    return clean.unionByName(dirty.select(*docs.columns))
