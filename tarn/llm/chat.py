"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, formatted as conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import Workspace, map_rows, picked

#: Opening and closing marks of a turn, by role; other roles are named between the marks of ``OTHER``.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
START = "<s>"
#: Strings that are marks wherever they stand; inside a text or role they are escaped.
CONTROL = (START, "</s>", "[INST]", "[/INST]", "[OUT]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]")
TO_ESCAPE = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    r"""Double backslashes and put one after the first character of each control string."""
    return TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], loss_roles: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of it (in code points) that the loss is taken on."""
    parts, spans, at = [START], [], len(START)
    for role, text in turns:
        if role in MARKS:
            opening, closing = MARKS[role]
        else:
            opening, closing = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        body = escape(text)
        if role in loss_roles:
            spans.append((at + len(opening), at + len(opening) + len(body)))
        parts += [opening, body, closing]
        at += len(opening) + len(body) + len(closing)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], len(START)
    while at < len(formatted):
        for role, (opening, closing) in MARKS.items():
            if formatted.startswith(opening, at):
                at += len(opening)
                break
        else:
            end = formatted.index(OTHER[1], at)
            role, closing = unescape(formatted[at + len(OTHER[0]) : end]), OTHER[2]
            at = end + len(OTHER[1])
        end = formatted.index(closing, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(closing)
    return turns


def linear_tree(rows: DataFrame) -> DataFrame:
    """Conversations given as turns, as reply trees without branches: each row answers the one before it.

    Rows of a conversation are ordered by turn (null first), then role and text
    (null ones as empty), so repeated turns have a defined order.  Scores are
    zero; a null conversation is one like others; an empty table gives none;
    other columns are ignored, whatever their names.
    """
    rows = picked(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    numbered = rows.select("conv_id", "turn", *said).withColumn("n", F.row_number().over(order))
    name = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    return numbered.select(
        "conv_id",
        F.concat_ws(":", name, F.col("n")).alias("message_id"),
        F.when(F.col("n") > 1, F.concat_ws(":", name, F.col("n") - 1)).alias("parent_id"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def _runs(ws: Workspace, links: DataFrame) -> DataFrame:
    """Each node with the head of its unbranched run and its distance from it, by pointer doubling.

    ``links`` has (node, parent, children of the parent); a run goes on through
    parents with one child.  Nodes on a cycle of parents reach no head and go.
    """
    single = F.col("parent").isNotNull() & (F.col("siblings") == 1)
    now = ws.table(
        links.select(
            "node",
            F.when(single, F.col("parent")).otherwise(F.col("node")).alias("head"),
            F.when(single, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("far"),
        )
    )
    total, reach = now.count(), 1
    while True:
        upper = now.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        now = ws.table(now.join(upper, "head").select("node", F.col("next").alias("head"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved")))
        reach *= 2
        moved = now.where("moved").limit(1).count()
        now = now.drop("moved")
        if not moved:
            return now
        if reach > 2 * total:
            return now.where(F.col("far") < total)


def conversation_paths(
    ws: Workspace, messages: DataFrame, paths_per_conversation: int | None
) -> tuple[DataFrame, DataFrame]:
    """(nodes, steps): the messages with their runs, and the runs of every chosen path.

    Paths are enumerated over unbranched runs, one self-join for each level of
    branching, and ranked by their mean score before any text is touched.
    """
    nodes = ws.table(
        messages.groupBy(F.col("message_id").cast("string").alias("node")).agg(
            F.min(
                F.struct(
                    F.col("conv_id").alias("conv"),
                    F.col("parent_id").cast("string").alias("parent"),
                    F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                    F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
                )
            ).alias("m")
        ).select("node", "m.*")
    )
    ids = nodes.select("node", "parent")
    children = ids.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("siblings"))
    known = ids.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    # Roots take no part in the joins on the parent: their null keys would all meet in one task.
    replies = ids.where("parent IS NOT NULL").join(known, "parent", "left").join(children, "parent", "left")
    links = ws.table(
        replies.select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), "siblings").unionAll(
            ids.where("parent IS NULL").select("node", "parent", F.lit(None).cast("long").alias("siblings"))
        )
    )
    runs = _runs(ws, links)
    nodes = ws.table(nodes.drop("parent").join(links.select("node", "parent"), "node").join(runs, "node"))
    ends = nodes.groupBy("head").agg(
        F.min(F.struct("far", "parent", "conv")).alias("first"),
        F.max(F.struct("far", "node")).alias("last"),
        F.sum("score").alias("score"),
        F.count("*").alias("n"),
    )
    above = runs.select(F.col("node").alias("up"), F.col("head").alias("above"))
    ends = ends.select(
        "head", F.col("first.parent").alias("up"), F.col("first.conv").alias("conv"), F.col("last.node").alias("tail"), "score", "n"
    )
    branches = ends.where("up IS NOT NULL").join(above, "up", "left").select(*ends.columns, "above")
    segments = ws.table(branches.unionAll(ends.where("up IS NULL").withColumn("above", F.lit(None).cast("string"))))
    leaf = segments.join(ids.select(F.col("parent").alias("tail")).distinct(), "tail", "left_anti").select("head")
    segments = ws.table(segments.join(leaf.withColumn("leaf", F.lit(True)), "head", "left"))
    step = F.struct("head", F.lit(0).cast("long").alias("before"))
    front = ws.table(
        segments.where("up IS NULL").select(
            "conv", F.col("head").alias("at"), F.array(step).alias("steps"), "score", "n", F.coalesce("leaf", F.lit(False)).alias("leaf")
        )
    )
    found = front.where("leaf")
    while front.where("not leaf").limit(1).count():
        below = segments.select(F.col("above").alias("at"), F.col("head").alias("next"), F.col("score").alias("s"), F.col("n").alias("k"), F.coalesce("leaf", F.lit(False)).alias("l"))
        front = ws.table(
            front.where("not leaf").join(below, "at").select(
                "conv",
                F.col("next").alias("at"),
                F.concat("steps", F.array(F.struct(F.col("next").alias("head"), F.col("n").alias("before")))).alias("steps"),
                (F.col("score") + F.col("s")).alias("score"),
                (F.col("n") + F.col("k")).alias("n"),
                F.col("l").alias("leaf"),
            )
        )
        found = found.unionAll(front.where("leaf"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc(F.col("score") / F.col("n")), "at"))
    ranked = found.select("conv", F.col("at").alias("path"), "steps", rank.alias("rank"))
    if paths_per_conversation is not None:
        ranked = ranked.where(F.col("rank") <= paths_per_conversation)
    return nodes, ranked.select("conv", "path", "rank", F.explode("steps").alias("step")).select(
        "conv", "path", "rank", "step.*"
    )


def format_conversations(
    messages: DataFrame,
    *,
    paths_per_conversation: int | None = 1,
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """Format the best root-to-leaf paths of reply trees.

    ``messages`` has ``conv_id``, ``message_id`` (unique), ``parent_id``,
    ``score``, ``role`` and ``text``.  Each root-to-leaf path is one candidate;
    a conversation's paths are ranked by mean score, ties by leaf id, and the
    first ``paths_per_conversation`` (all if None) are formatted.

    Returns ``conv_id``, ``rank``, ``formatted`` and ``loss_spans`` (code point
    spans of the text under the loss mask, still escaped).  Null texts and roles
    are empty; null scores are zero; a message whose parent is not in the table
    is a root; of rows that repeat a message id the least is taken; messages on
    a cycle of parents are in no path; a conversation, however long, is one
    string and made by one task; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    spark = messages.sparkSession
    messages = picked(messages, **{c: c for c in ("conv_id", "message_id", "parent_id", "score", "role", "text")})
    conv_type = messages.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None, "turns": []}

        def finish() -> pa.RecordBatch:
            (conv, rank, _), turns = state["key"], state["turns"]
            formatted, spans = format_turns(turns, loss_roles)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([conv], state["type"]),
                    pa.array([rank], pa.int64()),
                    pa.array([formatted], pa.string()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in spans]],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                ],
                ["conv_id", "rank", "formatted", "loss_spans"],
            )

        for batch in batches:
            state["type"] = batch.schema.field(0).type
            for conv, rank, path, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)), strict=True):
                if state["turns"] and state["key"] != (conv, rank, path):
                    yield finish()
                    state["turns"] = []
                state["key"] = conv, rank, path
                state["turns"].append((role, text))
        if state["turns"]:
            yield finish()

    with Workspace(spark) as ws:
        nodes, steps = conversation_paths(ws, messages, paths_per_conversation)
        turns = nodes.select("head", "far", "role", "text").join(steps, "head").select(
            "conv", F.col("rank").cast("long").alias("rank"), "path", (F.col("before") + F.col("far")).alias("at"), "role", "text"
        )
        ordered = turns.repartition("path").sortWithinPartitions("path", "at")
        schema = f"conv_id {conv_type}, rank long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"
        return ws.deliver(map_rows(ordered, schema, work))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, computed from the strings and masks alone."""
    conv_type = formatted.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), _sha(whole), len(loss), _sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_rows(formatted.select("conv_id", "formatted", "loss_spans"), schema, work)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
