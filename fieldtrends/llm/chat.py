"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is
trainable. Turns after the last assistant turn, which no example would hold, are returned as one more row
without a target, so the conversations can be read back from the output.

Template: a turn is ``### Role: `` + text + `` </turn>`` + newline. Where a text or role holds the start of a
control string, a backslash is put before it, and before backslashes, so reading back is exact.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, AFTER_ROLE = "### ", " </turn>\n", ": "


def escaped(text: Column) -> Column:
    """Backslashes are doubled; then each ``#`` and ``<`` and each colon of a role gets one, so no control string appears in a text."""
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\#<:])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*) </turn>\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError("not in the template")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, target_start, target_end: the reply is ``text[target_start:target_end]`` in code points.

    The row after the last example, with null target, holds a conversation that does not end with an assistant
    turn. Turns are ordered by ``turn``, then role and text; null role and text count as empty, rows without conv_id
    form one conversation, repeated rows are repeated turns, more columns are ignored, and an empty table gives no rows.

    A conversation is one example's text at its longest, so its turns meet in one row; conversations are spread over tasks.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(AFTER_ROLE)).alias("head"), escaped(F.col("text")).alias("body"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    # running ends of the turns, in code points
    ends = F.aggregate(F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)), F.array().cast("array<int>"),
                       lambda a, n: F.concat(a, F.array(F.when(F.size(a) == 0, 0).otherwise(F.element_at(a, -1)) + n)))
    laid = whole.select("conv_id", F.array_join(pieces, "").alias("formatted"), "turns", ends.alias("ends"))
    marks = F.filter(F.transform("turns", lambda t, i: F.struct(
        i.alias("i"), t["role"].alias("role"), F.length(t["body"]).alias("n"))), lambda m: m["role"] == "assistant")
    spans = F.transform(marks, lambda m: F.struct(
        F.element_at("ends", m["i"] + 1).alias("end"), (F.element_at("ends", m["i"] + 1) - len(CLOSE) - m["n"]).alias("target_start"),
        (F.element_at("ends", m["i"] + 1) - len(CLOSE)).alias("target_end")))
    tail = F.when(F.element_at("turns", -1)["role"] == "assistant", F.array().cast("array<struct<end:int,target_start:int,target_end:int>>")).otherwise(
        F.array(F.struct(F.element_at("ends", -1).alias("end"), F.lit(None).cast("int").alias("target_start"), F.lit(None).cast("int").alias("target_end"))))
    rows = laid.select("conv_id", "formatted", F.posexplode(F.concat(spans, tail)).alias("example", "s"))
    return rows.select("conv_id", "example", F.substr("formatted", F.lit(1), F.col("s.end")).alias("text"), "s.target_start", "s.target_end")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the examples: turns from the longest text, replies from the targets."""
    import hashlib

    schema = "conv_id bigint, example int, reply string, n_turns bigint, turns_sha256 string, chars bigint"
    last = formatted.groupBy("conv_id").agg(F.max("example").alias("last"))
    rows = formatted.join(last.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c"))).select(
        "conv_id", "example", "text", "target_start", "target_end", (F.col("example") == F.col("last")).alias("whole"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(lo, 64).to_pylist():
                    text, n, sha = r["text"], None, None
                    if r["whole"]:
                        turns = parse(text)
                        n, sha = len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
                    reply = None if r["target_start"] is None else unescape(text[r["target_start"]:r["target_end"]])
                    out.append((r["conv_id"], r["example"], reply, n, sha, len(text)))
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    read = rows.mapInArrow(run, schema)
    replies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: F.coalesce(x["reply"], F.lit(""))), "")
    per = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), replies.alias("loss"),
        F.sum("chars").alias("formatted_chars"), F.count("reply").alias("n_examples"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
