"""Chat formatting from an event log: reconstruction of final messages, rendering, and reading back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import partitions

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Event kinds. A message, an edit and a regeneration begin a message's text anew; a delta adds to it.
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: str) -> str:
    r"""Reversibly free ``text`` of control strings: a backslash is doubled and ``<|`` becomes ``<\|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted, and the start and end in it of the text."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def events_of(turns: DataFrame) -> DataFrame:
    """An event log (conv_id, seq, message, kind, role, text) of finished turns (conv_id, turn, role, text).

    An assistant's text comes as a stream: an opening, and its two halves as deltas. Others come whole. A
    quarter of the messages, by a hash of their text, have a draft before them: an assistant's is streamed as
    far as its first half and generated anew, the others' holds the second half alone and is edited. Null
    texts count as empty, null roles as ''. Rows that share conv_id and turn are messages of their own, in
    order of the hashes of role and text. Messages are numbered by ranges of that order, so that a conversation
    of any size spreads over tasks; numbers rise within a conversation but have gaps. Ranges are cut by numbers
    alone, since Spark samples what it cuts by to the driver. Other columns are ignored.
    """
    cut = ["conv_id", "turn", F.xxhash64("role"), F.xxhash64("text"), "row"]
    order = [*cut[:4], "role", "text", "row"]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    # equal rows are interchangeable; their place in the input spreads them
    rows = rows.repartitionByRange(partitions(turns.sparkSession), *cut).sortWithinPartitions(*order)
    rows = rows.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("message"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def events(*kinds_and_texts) -> F.Column:
        return F.array(*[F.struct((F.col("message") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(kinds_and_texts)])

    empty, stream = F.lit(""), (("delta", first), ("delta", second))
    drafted, own = F.pmod(F.xxhash64("text"), F.lit(4)) == 0, F.col("role") == "assistant"
    log = (
        F.when(own & drafted, events(("message", empty), ("delta", first), ("regenerate", empty), *stream))
        .when(own, events(("message", empty), *stream))
        .when(drafted, events(("message", second), ("edit", F.col("text"))))
        .otherwise(events(("message", F.col("text"))))
    )
    return rows.select("conv_id", "message", "role", F.explode(log).alias("e")).select("conv_id", "e.seq", "message", "e.kind", "role", "e.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold an event log into final messages (conv_id, message, role, text).

    The log is partitioned by conversation and message and sorted by seq (ties by kind and text). A
    message is its last beginning (message, edit or regenerate) and the deltas after it; deltas before
    any beginning count too. The role is that of its first event. Null texts add nothing.
    """
    by = Window.partitionBy("conv_id", "message").orderBy("seq", F.desc("kind"), "text")
    marked = events.withColumn("_epoch", F.sum(F.when(F.col("kind").isin("message", "edit", "regenerate"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_k", F.row_number().over(by))
    folded = marked.groupBy("conv_id", "message").agg(
        F.min_by("role", "_k").alias("role"), F.max("_epoch").alias("last"),
        F.array_sort(F.collect_list(F.struct("_epoch", "_k", F.coalesce("text", F.lit("")).alias("text")))).alias("all"),
    )
    live = F.filter("all", lambda e: e["_epoch"] == F.col("last"))
    return folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def formatted(messages: DataFrame) -> DataFrame:
    """Rendered turns: conv_id, message, chunk, loss (whether the text is trained on), mask_start, mask_end in the chunk.

    A conversation's formatted text is its chunks in order of message.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [render(r, t) for r, t in zip(batch["role"], batch["text"])]
            out = pd.DataFrame(done, columns=["chunk", "mask_start", "mask_end"])
            yield pd.concat([batch[["conv_id", "message"]].reset_index(drop=True), out.assign(loss=(batch["role"] == "assistant").to_numpy())], axis=1).astype({"conv_id": "Int64"})

    return messages.select("conv_id", "message", "role", "text").mapInPandas(run, "conv_id long, message long, chunk string, mask_start long, mask_end long, loss boolean")


def digests(chunks: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations sees, one row each.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Chunks are streamed in
    order and hashed as they come, so that memory doesn't grow with a conversation; its hashes take one task,
    since SHA-256 reads a text from end to end.
    """
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None  # conv_id, turns, hash, loss characters, loss hash, characters

        def row():
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

        for batch in batches:
            out = []
            for conv, chunk, start, end, loss in zip(*(batch[c].tolist() for c in ("conv_id", "chunk", "mask_start", "mask_end", "loss"))):
                conv = None if conv != conv else int(conv)
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(chunk):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    learned = unescape(chunk[start:end])
                    now[3] += len(learned)
                    now[4].update(learned.encode("utf-8", "surrogatepass"))
                now[5] += len(chunk)
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
        if now is not None:
            yield pd.DataFrame([row()], columns=columns).astype({"conv_id": "Int64"})

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "message").mapInPandas(run, schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Turns -> event log -> folded messages -> formatted chunks, one a row of ``turns``.

    Nulls, ties, repeated rows and other columns are as in ``events_of``; an empty table gives none. A very long
    text is rendered whole in one task, a conversation of very many turns is spread over tasks.
    """
    return formatted(reconstruct(events_of(turns)))
