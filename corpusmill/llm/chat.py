"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins double the reach of each message's
pointer towards its root, so a tree of depth d takes about log2(d) joins, of narrow
rows, spread by (conversation, message) however large one tree is. Leaves are ranked by
the score of their branch; the joins in reverse order enumerate the messages of the
chosen root-to-leaf paths, each once. Texts are joined last.

Template of a turn: ``### role: text</turn>`` and a newline. In roles and texts
``\\`` becomes ``\\\\``, and ``###``, ``</turn>`` and (in roles) ``:`` get a ``\\`` before
them, so that a reader can tell them from the template's own and undo it.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import dropped, tuned, written

#: Role whose texts stand under the loss mask.
LEARNT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for control in ("\\", "###", "</turn>", *([":"] if role else [])):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", text)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:\\\\|\\###|\\</turn>|(?!</turn>)[^\\])*)</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def chain(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each answers the row before it.

    Rows are ordered by turn, role and text, nulls first; null role or text is empty.
    """
    order = Window.partitionBy("conv_id").orderBy(*[F.asc_nulls_first(c) for c in ("turn", "role", "text")])
    return conversations.select(
        "conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("node")
    ).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """Format the ``best`` branches of every conversation of ``messages`` (conv_id, node, parent, role, text, score).

    Returns conv_id, branch (1 is the best), n_turns, formatted and loss_spans, the code
    point ranges of the learnt role's escaped texts. A branch's score is the mean over its
    messages; ties go to the longer branch, then to the smaller leaf. A message whose parent
    is null or missing is a root; of rows that repeat (conv_id, node) the least counts; a
    null node takes no part, nor do messages whose parents go round in a circle. Null
    scores are 0, null texts and roles empty; a null conv_id is a conversation; an empty
    table gives an empty table.
    """
    spark = messages.sparkSession
    row = F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")))
    msgs = written(messages.where("node IS NOT NULL").groupBy("conv_id", "node").agg(row.alias("m")).select("conv_id", "node", "m.*"), "messages")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    a, b = msgs.select("conv_id", "node", "parent", "score").alias("a"), msgs.select("conv_id", F.col("node").alias("n")).alias("b")
    known = a.join(b, F.expr("a.conv_id <=> b.conv_id AND a.parent = b.n"), "left")
    # up: the message that far above (null: past the root); hops and total: messages and scores from this one up to it
    step = written(known.select("a.conv_id", "a.node", F.col("b.n").alias("up"), F.lit(1).cast("long").alias("hops"), F.col("a.score").alias("total")), "reach0")
    reach, most = [step], step.count()
    for k in range(max(1, math.ceil(math.log2(most + 1))) if most else 0):
        if step.where("up IS NOT NULL").isEmpty():
            break
        joined = step.alias("a").join(step.alias("b"), F.expr("a.conv_id <=> b.conv_id AND a.up = b.node"), "left")
        step = written(
            joined.select("a.conv_id", "a.node", F.col("b.up").alias("up"), (F.col("a.hops") + F.coalesce("b.hops", F.lit(0))).alias("hops"), (F.col("a.total") + F.coalesce("b.total", F.lit(0.0))).alias("total")),
            f"reach{k + 1}",
        )
        reach.append(step)
    rooted = step.where("up IS NULL").select("conv_id", "node", "hops", "total")
    parents = reach[0].where("up IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("up").alias("p")).distinct()
    leaves = rooted.join(parents, F.expr("conv_id <=> c AND node = p"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("hops")), F.desc("hops"), "node"))
    path = leaves.withColumn("branch", rank).where(F.col("branch") <= best).select("conv_id", "branch", "node", F.col("hops").alias("place"))
    for k in reversed(range(len(reach) - 1)):
        jump = reach[k].where("up IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up", F.col("hops").alias("far"))
        both = path.join(jump, F.expr("conv_id <=> c AND node = n"), "left")
        steps = F.array(F.struct("node", "place"), F.struct(F.col("up").alias("node"), (F.col("place") - F.col("far")).alias("place")))
        path = both.select("conv_id", "branch", F.explode(steps).alias("s")).where("s.node IS NOT NULL").select("conv_id", "branch", "s.*")
    turns = path.alias("a").join(msgs.alias("b"), F.expr("a.conv_id <=> b.conv_id AND a.node = b.node")).select("a.conv_id", "branch", "place", "role", "text")
    head = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": "))
    turns = turns.select("conv_id", "branch", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = (F.length("head") + F.length("body") + len("</turn>\n")).cast("long")
    before = F.sum(size).over(Window.partitionBy("conv_id", "branch").orderBy("place")) - size
    turns = turns.withColumn("at", before + F.length("head"))
    span = F.when(F.col("role") == LEARNT, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    out = turns.groupBy("conv_id", "branch").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit("</turn>\n")).alias("turn")))), lambda t: t["turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )
    out = written(out, "formatted")
    for t in (msgs, *reach):
        dropped(t)
    return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


TRAP = "says `\\### Assistant: </turn> ok`"


def with_trap(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts hold control strings."""
    spark: SparkSession = conversations.sparkSession
    rows = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def digests(conversations: DataFrame) -> DataFrame:
    """Format every conversation and read it back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    tuned(conversations.sparkSession)
    done = format_trees(chain(conversations)).select("conv_id", "formatted", "loss_spans")

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text, turns = r["formatted"], read_back(r["formatted"])
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in r["loss_spans"])
                rows.append((len(turns), _sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), _sha(loss), len(text)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = done.schema["conv_id"].dataType.simpleString()
    return done.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests_sql() -> str:
    def size(c: str, role: bool = False) -> str:
        for control in ("\\", "###", "</turn>", *([":"] if role else [])):
            c = f"replace({c}, '{control}', '\\{control}')"
        return f"length({c})"

    trap = f"(-7, 0, 'user', '{TRAP}'), (-7, 1, 'assistant', '{TRAP}')"
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    return f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {trap}) AS v(conv_id, turn, role, text)),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id {order}) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNT}'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = '{LEARNT}'), '')) AS loss_sha256,
 CAST(sum(14 + {size("role", True)} + {size("text")}) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""
