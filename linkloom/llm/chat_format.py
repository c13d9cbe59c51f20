"""Chat formatting: reply trees to conversations.

Messages with parents form trees. Pointer jumping, a self-join for each power of two, finds every message's
depth and the score of its path from the root, so a chain of a thousand replies takes ten joins. The leaves are
the ends of root-to-leaf paths; they are ranked within their tree by mean score, and the chosen ones' paths are
enumerated by the same jumps backwards. Each path is one conversation, formatted with ``TEMPLATE``.

Control strings inside texts are escaped reversibly: a backslash before each one, and before each run of
backslashes that stands at one or at the text's end. Reading back removes them.

Defined cases: a null text is empty, a null role is ``user``; a message whose parent is missing, or itself, is a
root; of messages with one id the least by (parent, role, text) holds; messages in a circle have no root and form no
conversation; ties in score go to the least leaf id; an empty table gives an empty result. In a table of linear
conversations each row answers the one before it, by turn, role and text; rows are kept even if they repeat.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._common import discard, map_batches, numbered, stored

#: What stands before and after a turn's text. The end mark of the assistant's turn is no loss.
TEMPLATE = {
    "system": ("[SYS] ", " [/SYS]\n"),
    "user": ("[INST] ", " [/INST]\n"),
    "assistant": ("[ANS] ", "</s>\n"),
}
OTHER = ("[ROLE:", "] ", " [/ROLE]\n")
CONTROL = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "</s>", "[ROLE:", "[/ROLE]")

_ANY = "|".join(map(re.escape, CONTROL))
_TO_ESCAPE = re.compile(rf"(?<!\\)(\\*)({_ANY})|(?<!\\)(\\+)\Z")
_ESCAPED = re.compile(rf"(?<!\\)(\\+)({_ANY}|\Z)")
_ROLE = re.compile(r"\[ROLE:((?:[^\\\]]|\\.)*)\] ", re.S)


def escape(text: str) -> str:
    """Doubles the backslashes that stand before a control string or the end; puts one before the string."""
    return _TO_ESCAPE.sub(lambda m: m[3] * 2 if m[3] else m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans in it that count for the loss: each assistant text, escaped."""
    out, mask, at = [], [], 0
    for role, text in turns:
        before, after = TEMPLATE.get(role) or (OTHER[0] + _role(role) + OTHER[1], OTHER[2])
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), mask


def _role(role: str) -> str:
    return re.sub(r"([\\\]])", r"\\\1", role)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: an end mark counts where an even run of backslashes stands before it. What
    was not written by ``format_turns`` is a ValueError."""
    turns, at = [], 0
    kinds = {v[0]: k for k, v in TEMPLATE.items()}
    while at < len(formatted):
        for mark, role in kinds.items():
            if formatted.startswith(mark, at):
                at, end = at + len(mark), TEMPLATE[role][1]
                break
        else:
            if (m := _ROLE.match(formatted, at)) is None:
                raise ValueError(f"no turn begins at {at}")
            role, at, end = re.sub(r"\\(.)", r"\1", m[1], flags=re.S), m.end(), OTHER[2]
        control = end.strip()
        stop = formatted.find(control, at)
        while True:
            if stop < 0:
                raise ValueError(f"the turn before {at} has no end")
            slashes = stop
            while slashes > at and formatted[slashes - 1] == "\\":
                slashes -= 1
            start = stop - (len(end) - len(end.lstrip()))
            if (stop - slashes) % 2 == 0 and start >= at and formatted.startswith(end, start):
                break
            stop = formatted.find(control, stop + 1)
        turns.append((role, unescape(formatted[at:start])))
        at = start + len(end)
    return turns


def linear(conversations: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of conversations whose rows follow each other by turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = numbered(rows, "tree", ["turn"], ["role", "text"], "node", conversations.count())
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, depth, role, text) of each tree's root-to-leaf paths, or of its best ones."""
    keys = ["tree", "node"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit("user"))
    rows = messages.select("tree", "node", "parent", role.alias("role"), text.alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.groupBy(*keys).agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select(*keys, "m.*")
    # null trees are a tree too: keys that compare
    rows = rows.withColumn("tree", F.to_json(F.struct("tree"))).where("node is not null")
    rows = stored(rows, "messages")
    longest = max(1, rows.count())  # no table here has more rows, but that of paths
    slim = rows.select(*keys, "parent", "score")
    known = rows.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    slim = slim.join(known, ["tree", "parent"], "left")
    up = F.when(F.col("known") & (F.col("parent") != F.col("node")), F.col("parent"))
    names = ["tree", "node", "up", "total", "steps"]
    first = stored(slim.select(*keys, up.alias("up"), F.col("score").alias("total"), F.lit(1).alias("steps")), "jumps", longest)
    whole, jumps = first.where("up is null"), [first.where("up is not null")]  # at their root, and on their way
    while 1 << len(jumps) <= 2 * longest and not jumps[-1].isEmpty():  # a circle would go on for ever
        last = jumps[-1]
        ahead = last.unionByName(whole).toDF("tree", "up", "up2", "total2", "steps2")
        joined = last.join(ahead, ["tree", "up"])
        further = stored(joined.select(*keys, F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("steps") + F.col("steps2")).alias("steps")), "jumps", longest)
        whole = whole.unionByName(further.where("up is null")).select(*names)
        jumps.append(further.where("up is not null"))
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = whole.join(inner, keys, "left_anti").withColumn("mean", F.col("total") / F.col("steps"))
    leaves = stored(leaves.select(*keys, "mean"), "ends", longest)
    leaves = numbered(leaves, "tree", [F.desc("mean"), "node"], [], "rank", longest).withColumn("rank", F.col("rank").cast("int"))
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    found = stored(leaves.select("tree", F.col("node").alias("leaf"), "rank", "node"), "leaves", longest)
    for jump in reversed(jumps):
        above = found.join(jump.select("tree", "node", "up"), keys)
        found, last = stored(found.unionByName(above.select("tree", "leaf", "rank", F.col("up").alias("node"))), "leaves", 2 * found.count()), found
        discard(last)
    depth = whole.select(*keys, F.col("steps").alias("depth"))
    return found.join(depth, keys).join(rows.select(*keys, "role", "text"), keys)


FORMATTED = "tree string, leaf long, rank int, formatted string, mask array<struct<start:long,end:long>>"


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """A row for each chosen path: the formatted text, and the spans that count for the loss."""
    turn = F.struct("depth", "role", "text")
    grouped = paths(messages, best).groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def write(cols):
        made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in cols["turns"]]
        yield {
            "tree": cols["tree"], "leaf": cols["leaf"], "rank": cols["rank"], "formatted": [m[0] for m in made],
            "mask": [[{"start": a, "end": b} for a, b in m[1]] for m in made],
        }

    return map_batches(grouped, write, FORMATTED)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string"
)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""

    def read(cols):
        out: dict[str, list] = {k.split()[0]: [] for k in DIGEST.split(", ")}
        for tree, text, mask in zip(cols["tree"], cols["formatted"], cols["mask"], strict=True):
            turns = read_turns(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            out["conv_id"].append(tree)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256(whole.encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(text))
            out["formatted"].append(text)
        yield out

    rows = formatted.select(F.get_json_object("tree", "$.tree").cast("long").alias("tree"), "formatted", "mask")
    return map_batches(rows, read, DIGEST)
