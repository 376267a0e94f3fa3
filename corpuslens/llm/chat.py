"""Chat formatting as prefix trees: what conversations share is emitted once.

A turn is rendered as ``[INST]role[/INST]text</s>``. Control strings inside roles and texts get
a backslash after their first character (one more, if some are there), which is undone by
taking one away. A node is a turn after given earlier turns; its id is a hash chained over them, so
conversations that begin alike share their first nodes, and each tree hangs on one first
turn. ``trees`` lays each tree out depth first, every node's tokens once:

* distinct paths are sorted by their node ids (range partitioned); a node belongs to the first
  path that holds it, and (path, depth) is the depth-first order;
* offsets are running sums within sort ranges plus the totals of the ranges before (as many
  numbers as ranges), taken from the root's offset;
* ``position`` is the number of tokens on the way from the root, so position ids go on as if the
  conversation stood alone; ``attends`` lists the stretches of the tree's sequence that
  hold the ancestors. A token sees those and what precedes it in its own node.

No tree, however many conversations share its first turns, is gathered anywhere: hot nodes
are pre-aggregated, and only single conversations are rows.

Defined cases: a null text or role is empty; turns are ordered by number (null first), then role,
then text, and repeated turns all count; null conversation ids form one conversation; equal
conversations share all nodes; an empty table gives empty tables; columns other than the four
named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written
from .packing import encoder

# The control strings of the template.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_PLAIN = re.compile(r"(\[)(\\*)(/?INST\])|(<)(\\*)(/s>)")
_ESCAPED = re.compile(r"(\[)\\(\\*)(/?INST\])|(<)\\(\\*)(/s>)")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def turns_of(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError("not a formatted conversation")
        mid = text.index(CLOSE, at)
        end = text.index(END, mid)
        out.append((unescape(text[at + len(OPEN):mid]), unescape(text[mid + len(CLOSE):end])))
        at = end + len(END)
    return out


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, roles, texts): a row per conversation, its turns in order."""
    turn = F.struct(F.col(turn_col).alias("turn"),
                    F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return (rows.groupBy(F.col(conv_col).alias("conv_id"))
            .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("conv_id", F.col("turns.role").alias("roles"),
                    F.col("turns.text").alias("texts")))


def _paths(convs: DataFrame) -> DataFrame:
    """Conversations with ``path``, the ids of their nodes from the root on."""
    kind = convs.schema["conv_id"].dataType.simpleString()

    def make():
        def chain(roles, texts):
            out, last = [], b""
            for r, t in zip(roles, texts):
                r, t = r.encode("utf-8", "surrogatepass"), t.encode("utf-8", "surrogatepass")
                last = hashlib.blake2b(b"%b%d:%b%b" % (last, len(r), r, t), digest_size=16).digest()
                out.append(last)
            return out

        def run(batch):
            cols = {c: batch.column(c) for c in ("conv_id", "roles", "texts")}
            return cols | {"path": [chain(r, t) for r, t in zip(cols["roles"].to_pylist(),
                                                                cols["texts"].to_pylist())]}

        return run

    return map_batches(convs, make, f"conv_id {kind}, roles array<string>, texts array<string>, "
                                    "path array<binary>")


def _tokens(nodes: DataFrame, ranks_path: str, json_path: str) -> DataFrame:
    """Nodes with ``ids`` (little-endian 32-bit), ``n_tokens`` and the stretch of them that
    bears loss: the text of an assistant's turn. Its tokens begin and end with it."""
    def make():
        encode = encoder(ranks_path, json_path)

        def run(batch):
            ids, n, a, b = [], [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                head, body = encode(OPEN + escape(role) + CLOSE), encode(escape(text))
                every = np.array([*head, *body, *encode(END)], "<u4")
                ids.append(every.tobytes())
                n.append(len(every))
                a.append(len(head))
                b.append(len(head) + (len(body) if role == "assistant" else 0))
            return {"node": batch.column("node"), "ids": ids, "n_tokens": n, "loss_start": a,
                    "loss_end": b}

        return run

    return map_batches(nodes, make, "node binary, ids binary, n_tokens long, loss_start long, "
                                    "loss_end long", ("text",))


def trees(rows: DataFrame, ranks_path: str, json_path: str, conv_col: str = "conv_id",
          turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, members).

    nodes: a row per node: node, parent (null at the root), tree (the root's node), depth, offset,
    position, n_tokens, ids, loss_start, loss_end (tokens of the node), attends: array of
    (start, end) in the tree's sequence. members: conv_id and its path of nodes.
    """
    convs = written(_paths(conversations(rows, conv_col, turn_col, role_col, text_col)), "paths")
    members = convs.select("conv_id", "path")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # Equal conversations are one path. Its number is its place in the sorted order.
    distinct = convs.groupBy(F.element_at("path", -1).alias("leaf")).agg(F.first("path").alias("path"))
    paths = written(distinct.select("path").repartitionByRange(n, "path").sortWithinPartitions("path")
                    .select(F.monotonically_increasing_id().alias("nr"), "path"), "sorted")
    parents = F.concat(F.array(F.lit(None).cast("binary")), F.expr("slice(path, 1, size(path) - 1)"))
    steps = paths.select("nr", F.element_at("path", 1).alias("tree"), F.posexplode(F.arrays_zip(
        F.col("path").alias("node"), parents.alias("parent"))).alias("depth", "step")).select(
        "nr", "tree", "depth", "step.node", "step.parent")
    # The same for all paths that hold a node, so any one will do.
    owners = steps.groupBy("node").agg(
        F.min("nr").alias("nr"), F.first("depth").cast("long").alias("depth"),
        F.first("tree").alias("tree"), F.first("parent").alias("parent"))

    turns = convs.select(F.explode(F.arrays_zip("path", "roles", "texts")).alias("t")).select(
        F.col("t.path").alias("node"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))
    turns = turns.groupBy("node").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    nodes = owners.join(_tokens(turns, ranks_path, json_path), "node")

    part = F.shiftright("nr", 33)
    order = Window.partitionBy("part").orderBy("nr", "depth")
    laid = written(nodes.withColumn("part", part).withColumn(
        "offset", F.sum("n_tokens").over(order) - F.col("n_tokens")), "laid")
    # A total for each sort range: as many rows as shuffle partitions.
    totals = sorted((r["part"], r["n"]) for r in
                    laid.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    begin, at = {}, 0
    for p, size in totals:
        begin[p] = at
        at += size
    if begin:
        base = F.create_map(*[F.lit(x) for kv in begin.items() for x in kv])
        laid = laid.withColumn("offset", F.col("offset") + base[F.col("part")])
    roots = laid.where("depth = 0").select("tree", F.col("offset").alias("root"))
    laid = laid.join(roots, "tree").withColumn("offset", F.col("offset") - F.col("root"))

    # Every path with its nodes' places; the nodes that it owns get positions and ancestors.
    places = laid.select("node", F.col("nr").alias("owner"), "offset", "n_tokens")
    along = (steps.select("nr", "depth", "node").join(places, "node").groupBy("nr")
             .agg(F.sort_array(F.collect_list(F.struct("depth", "node", "owner", "offset",
                                                       "n_tokens"))).alias("steps")))
    seen = _ancestors(along)
    nodes = laid.join(seen, "node").select(
        "node", "parent", "tree", "depth", "offset", "position", "n_tokens", "ids", "loss_start",
        "loss_end", "attends")
    return nodes, members


def _ancestors(along: DataFrame) -> DataFrame:
    def make():
        def run(batch):
            out = {"node": [], "position": [], "attends": []}
            for nr, steps in zip(batch.column("nr").to_pylist(), batch.column("steps").to_pylist()):
                at, over = 0, []
                for s in steps:
                    if s["owner"] == nr:
                        out["node"].append(s["node"])
                        out["position"].append(at)
                        out["attends"].append([{"start": a, "end": b} for a, b in over])
                    end = s["offset"] + s["n_tokens"]
                    if over and over[-1][1] == s["offset"]:
                        over[-1] = over[-1][0], end
                    else:
                        over.append((s["offset"], end))
                    at += s["n_tokens"]
            return out

        return run

    return map_batches(along, make, "node binary, position long, "
                                    "attends array<struct<start: bigint, end: bigint>>")


def read_back(nodes: DataFrame, members: DataFrame, ranks_path: str) -> DataFrame:
    """What the token sequences say of each conversation: conv_id, ``formatted`` (its text),
    ``turns`` (role, text, as parsed from it) and ``loss`` (its texts under the loss mask)."""
    steps = members.select("conv_id", F.posexplode("path").alias("depth", "node"))
    whole = (steps.join(nodes.select("node", "ids", "loss_start", "loss_end"), "node")
             .groupBy("conv_id").agg(F.sort_array(F.collect_list(
                 F.struct("depth", "ids", "loss_start", "loss_end"))).alias("steps")))
    kind = members.schema["conv_id"].dataType.simpleString()

    def make():
        import base64

        with open(ranks_path, "rb") as f:
            say = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}

        def text(raw: bytes) -> str:
            return b"".join(map(say.__getitem__, np.frombuffer(raw, "<u4").tolist())).decode(
                "utf-8", "surrogatepass")

        def run(batch):
            formatted, turns, loss = [], [], []
            for steps in batch.column("steps").to_pylist():
                formatted.append("".join(text(s["ids"]) for s in steps))
                turns.append([{"role": r, "text": t} for r, t in turns_of(formatted[-1])])
                loss.append([unescape(text(s["ids"][4 * s["loss_start"]:4 * s["loss_end"]]))
                             for s in steps if s["loss_end"] > s["loss_start"]])
            return {"conv_id": batch.column("conv_id"), "formatted": formatted, "turns": turns,
                    "loss": loss}

        return run

    return map_batches(whole, make, f"conv_id {kind}, formatted string, "
                                    "turns array<struct<role: string, text: string>>, "
                                    "loss array<string>")
