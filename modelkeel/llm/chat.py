"""Chat formatting in budgeted windows: turn-aligned spans, the system turn kept, history repeated and masked.

A turn is written as ``<|role|>\\ntext<|end|>\\n``. Control strings of this template and of common other ones
are escaped inside roles and texts, so a marker in the output is always the template's own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelkeel.llm.hashing import WORD

#: Where a control string begins, and how its first character is written.
CONTROL = re.compile(r"\\|<(?=\||/?s>|/?<SYS>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
PLAIN = {v: k for k, v in ESCAPES.items()}
TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)

ROWS_PER_BUCKET = 256
WINDOWS = "conv_id long, window_no long, formatted string, n_context long, loss array<struct<start: long, stop: long>>"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_WINDOWS_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window_no", pa.int64()), ("formatted", pa.string()), ("n_context", pa.int64()), ("loss", pa.list_(_SPAN))])
_DIGESTS_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
_DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def escape_role(role: str) -> str:
    return escape(role).replace("|", ESCAPES["|"])


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lbp]", lambda m: PLAIN[m[0]], text)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            turns = batch.column("turns")[k].as_py()
            pieces, loss, at = [], [], 0
            for t in turns:
                head, body = f"<|{escape_role(t['role'] or '')}|>\n", escape(t["text"] or "")
                if t["part"] == 2 and t["role"] == "assistant":
                    loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
                pieces += [head, body, "<|end|>\n"]
                at += len(head) + len(body) + 8
            yield pa.RecordBatch.from_pylist([{
                "conv_id": batch.column("conv_id")[k].as_py(), "window_no": batch.column("window_no")[k].as_py(),
                "formatted": "".join(pieces), "n_context": sum(t["part"] < 2 for t in turns), "loss": loss}], _WINDOWS_ARROW)


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256, system: int = 128) -> DataFrame:
    """Windows of ``conversations`` rows (conv_id, turn, role, text).

    A turn costs its words plus 4. Prefix sums of the costs cut each conversation at whole turns, by cells of
    ``budget - history - system`` tokens: the turns that lie in a cell make a window, and a turn that reaches over its end
    makes one alone. So no window has more turns of its own than a cell, unless one turn is longer. Each later
    window first repeats the conversation's system turn (its first turn, if that is one) and the last turns before it, up
    to ``history`` tokens and no more than the budget leaves. A window is over the budget only if one turn and the
    system turn are so alone. Only assistant texts that a window has for the first time are under its loss mask (``loss``,
    offsets of code points).

    The prefix sums come from sums of blocks of ``ROWS_PER_BUCKET`` turn numbers, so no sort holds a long
    conversation. Null turns come first, equal turns are ordered by role and text and all kept; a null text or
    role is written as empty; null conv_ids form one conversation; an empty table gives no window.
    """
    step = budget - history - system
    cost = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long") + 4
    rows = turns.select("conv_id", "turn", "role", "text", cost.alias("cost"), F.floor(F.col("turn") / ROWS_PER_BUCKET).alias("bucket"))
    same = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
    sums = rows.groupBy("conv_id", "bucket").agg(F.sum("cost").alias("cost"))
    before = F.sum("cost").over(Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(F.col("conv_id").alias("b_conv"), F.col("bucket").alias("b_bucket"), F.coalesce(before, F.lit(0)).alias("base"))
    joined = rows.alias("a").join(bases.alias("b"), same("conv_id", "b_conv") & same("bucket", "b_bucket")).drop("b_conv", "b_bucket")
    running = F.sum("cost").over(Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    placed = joined.withColumn("stop", F.col("base") + running).withColumn("start", F.col("stop") - F.col("cost"))
    cell = F.floor(F.col("start") / step)
    own = placed.withColumn("window_no", 2 * cell + (F.col("stop") > (cell + 1) * step).cast("long"))
    first = own.where((F.col("start") == 0) & (F.col("role") == "system")).select(F.col("conv_id").alias("f_conv"), "role", "text", F.col("cost").alias("f_cost"))
    spans = own.groupBy("conv_id", "window_no").agg(F.min("start").alias("low"), F.max("stop").alias("high"))
    later = spans.where("low > 0").join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left")
    left = F.lit(budget) - F.coalesce("f_cost", F.lit(0)) - (F.col("high") - F.col("low"))
    reach = max(history, 1)
    windows = later.select(F.col("conv_id").alias("w_conv"), F.col("window_no").alias("w_no"), "low", F.least(F.lit(history), left).alias("room"),
                           F.floor(F.col("low") / reach).alias("w_place"))
    # a window that a turn can be history of begins between the turn's end and ``history`` after its start: two places at most
    can = own.where((F.col("cost") <= history) & ~((F.col("start") == 0) & F.coalesce(F.col("role") == "system", F.lit(False))))
    placed_turns = can.select("conv_id", "start", "stop", "role", "text", F.explode(F.sequence(F.floor(F.col("stop") / reach), F.floor((F.col("start") + history) / reach))).alias("place"))
    meets = F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("place") == F.col("w_place")) & (F.col("low") >= F.col("stop")) & (F.col("low") - F.col("start") <= F.col("room"))
    repeated = placed_turns.join(windows, meets).select("conv_id", F.col("w_no").alias("window_no"), F.lit(1).alias("part"), "start", "role", "text")
    kept = later.where("f_cost IS NOT NULL").select("conv_id", "window_no", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), "role", "text")
    mine = own.select("conv_id", "window_no", F.lit(2).alias("part"), "start", "role", "text")
    all_rows = mine.unionByName(repeated).unionByName(kept)
    grouped = all_rows.groupBy("conv_id", "window_no").agg(
        F.sort_array(F.collect_list(F.struct("part", "start", "role", "text"))).alias("turns"))
    return grouped.select("conv_id", "window_no", "turns").mapInArrow(_format, WINDOWS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}: {formatted[at:at + 40]!r}")
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests of the conversations of a sorted partition; nothing but digests is held."""
    current: dict | None = None

    def done(c):
        return {"conv_id": c["conv_id"], "n_turns": c["n"], "turns_sha256": c["turns"].hexdigest(), "loss_chars": c["chars"],
                "loss_sha256": c["loss"].hexdigest(), "formatted_chars": c["size"], "n_windows": c["windows"]}

    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            conv, text = batch.column("conv_id")[k].as_py(), batch.column("formatted")[k].as_py()
            if current is None or current["conv_id"] != conv:
                if current is not None:
                    out.append(done(current))
                current = {"conv_id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0, "windows": 0}
            for role, said in parse(text)[batch.column("n_context")[k].as_py():]:
                current["n"] += 1
                current["turns"].update(f"{role}\n{said}\n".encode())
            for span in batch.column("loss")[k].as_py():
                said = unescape(text[span["start"] : span["stop"]])
                current["chars"] += len(said)
                current["loss"].update(said.encode())
            current["size"] += len(text)
            current["windows"] += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, _DIGESTS_ARROW)
    if current is not None:
        yield pa.RecordBatch.from_pylist([done(current)], _DIGESTS_ARROW)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of the conversations that the formatted windows hold, streamed window by window."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window_no")
    return ordered.mapInArrow(_digest, _DIGESTS)


#: Fixed value: the conversation that is added to the table, full of control strings.
EXTRA = "</s>[INST] ok [/INST]"


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return read_back(format_windows(turns.unionByName(extra))).drop("n_windows")
