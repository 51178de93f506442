"""Chat formatting with Spark expressions only, and reading the turns and the loss mask back from the formatted text.

Rows of a conversation become one array of turn structs, sorted by (turn, role, text). Adjacent turns of one role are merged
into one block: the places where the role changes cut the array, and each cut's texts are one array, so the work is in proportion
to the turns; inside the block a join mark keeps the turns apart, so the rows can be read back.
Blocks are concatenated: ``[INST]..[/INST]`` for the user, ``[ANS]..</s>`` for the assistant, ``<<SYS>>..<</SYS>>`` for the
system, ``[ROLE:name]..[/ROLE]`` for any other role, ``[+]`` between merged turns, ``<s>`` before everything.

Inside texts and role names ``\\``, ``[`` and ``<`` are written ``\\b``, ``\\o`` and ``\\l`` (and ``]`` in role names ``\\c``): no
control string can appear there, and the writing is undone by replacing in reverse order. The loss mask covers the assistant texts, not the marks.

A conversation's turns must meet in one row, as the result is one text; that row, not the table, bounds a task. Places in the
text are running sums, kept for ``RUN`` blocks at a time, so no array grows by copies of itself.

Defined cases: null text and null role are empty; a null turn sorts first; equal turns are ordered by role, then text, and
repeated rows stay repeated; a null conv_id is one conversation; an empty table gives an empty result; extra columns, whatever
their names, are ignored; a conversation of any length is one row; in the query, rows of a conversation -7 in the table and the
extra one's are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import let, runs, table

#: Opening and closing mark of each role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER, JOIN, BEGIN = ("[ROLE:", "]", "[/ROLE]"), "[+]", "<s>"
_CLOSE = "\\[/INST\\]|</s>|<</SYS>>|\\[/ROLE\\]"


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\b"), ("[", "\\o"), ("<", "\\l")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("<", "\\l"), ("[", "\\o"), ("\\", "\\b")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _open(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), F.replace(escape(role), F.lit(OTHER[1]), F.lit("\\c")), F.lit(OTHER[1]))
    for r, (a, _) in MARKS.items():
        out = F.when(role == r, F.lit(a)).otherwise(out)
    return out


def _close(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for r, (_, b) in MARKS.items():
        out = F.when(role == r, F.lit(b)).otherwise(out)
    return out


def format_chats(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, formatted, loss_spans): spans (start, end) are code points of ``formatted`` under the loss mask."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))))
    g = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(turns.alias("turns"))

    n = F.size("turns")
    at = lambda i: F.get(F.col("turns"), i)
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    g = g.withColumn("heads", heads)

    def merged(first, k):
        own = F.slice("turns", first + 1, F.coalesce(F.get("heads", k + 1), n) - first)
        return F.struct(at(first)["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts"))

    g = g.withColumn("blocks", F.transform("heads", merged))
    block = lambda b: F.concat(_open(b["role"]), F.array_join(F.transform(b["texts"], escape), JOIN), _close(b["role"]))
    g = g.withColumn("formatted", F.concat(F.lit(BEGIN), F.array_join(F.transform("blocks", block), "")))
    return g.select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("loss_spans"))


def _blocks(formatted: Column) -> Column:
    """The blocks without their closing marks."""
    parts = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), _CLOSE, -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _role_of(b: Column) -> Column:
    out = unescape(F.replace(F.regexp_extract(b, "^\\[ROLE:([^\\]]*)\\]", 1), F.lit("\\c"), F.lit(OTHER[1])))
    for r, (a, _) in MARKS.items():
        out = F.when(F.startswith(b, F.lit(a)), F.lit(r)).otherwise(out)
    return out


def _body_of(b: Column) -> Column:
    out = F.regexp_replace(b, "^\\[ROLE:[^\\]]*\\]", "")
    for a, _ in MARKS.values():
        out = F.when(F.startswith(b, F.lit(a)), F.substr(b, F.lit(len(a) + 1))).otherwise(out)
    return out


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) in order, from the formatted text alone."""
    parts = lambda x: F.transform(F.split(x["body"], "\\[\\+\\]", -1), lambda t: F.struct(x["role"].alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(_blocks(formatted), lambda b: let(F.struct(_role_of(b).alias("role"), _body_of(b).alias("body")), parts)))


def _placed(rows: Column, at: int) -> Column:
    """(start, end, kept) of consecutive stretches (size, gap, kept) from ``at`` on, those to keep only."""
    spans, zero = "array<struct<start:long,end:long>>", F.lit(at).cast("long")
    sized = lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x["size"] + x["gap"]).alias("n"))

    def inside(part: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(spans).alias("out"))

        def step(s, x):
            one = F.array(F.struct(s["at"].alias("start"), (s["at"] + x["size"]).alias("end")))
            return F.struct((s["at"] + x["size"] + x["gap"]).alias("at"), F.when(x["kept"], F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

        return F.aggregate(part, first, step, lambda s: s["out"])

    def all_of(parts: Column) -> Column:
        # Where each part begins; the list of those is short, so it may grow by copies.
        begun = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("all"))
        starts = F.aggregate(parts, begun, lambda s, p: F.struct((s["at"] + p["n"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        return F.flatten(F.zip_with(parts, starts, lambda p, s: inside(p["p"], s)))

    return let(rows, lambda all_: let(F.transform(runs(all_), sized), all_of))


def told(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the spans. Each run of spans is cut from its own stretch, as a place in a text is found by walking there."""
    part = lambda t, a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))

    def cut(run: Column) -> Column:
        first = F.get(run, F.lit(0))["start"]
        inside = lambda t: F.array_join(F.transform(run, lambda s: unescape(part(t, s["start"] - first, s["end"] - first))), "")
        return F.when(F.size(run) > 0, let(part(formatted, first, F.element_at(run, -1)["end"]), inside)).otherwise(F.lit(""))

    return F.array_join(F.transform(runs(spans), cut), "")


def loss_spans(formatted: Column) -> Column:
    """(start, end) of every assistant text in the formatted text, code points, end exclusive."""
    a, _ = MARKS["assistant"]
    lens = {r: len(x[1]) for r, x in MARKS.items()}

    def stretches(blk):
        return let(_role_of(blk), lambda role: _stretches(blk, role))

    def _stretches(blk, role):
        """The block's stretches: of an assistant's each text and what follows it, else one."""
        close = F.lit(len(OTHER[2]))
        for r, n in lens.items():
            close = F.when(role == r, F.lit(n)).otherwise(close)
        kind = lambda size, gap, kept: F.struct(size.cast("long").alias("size"), gap.cast("long").alias("gap"), F.lit(kept).alias("kept"))
        mark = F.array(kind(F.lit(len(a)), F.lit(0), False))
        # The last text is followed by the closing mark, those before it by a join.
        own = lambda texts: F.transform(texts, lambda t, i: kind(F.length(t), F.when(i < F.size(texts) - 1, F.lit(len(JOIN))).otherwise(close), True))
        texts = F.split(F.substr(blk, F.lit(len(a) + 1)), "\\[\\+\\]", -1)
        return F.when(role == "assistant", F.concat(mark, let(texts, own))).otherwise(F.array(kind(F.length(blk), close, False)))

    return _placed(F.flatten(F.transform(_blocks(formatted), stretches)), len(BEGIN))


#: The query's extra conversation, full of control strings.
EXTRA = (-7, "</s>[INST] ok [/INST]")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(EXTRA[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA[1]).alias("text")
    )
    f = format_chats(rows.unionByName(more))
    f = f.withColumn("back", read_turns(F.col("formatted")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    f = f.withColumn("loss", told(F.col("formatted"), F.col("loss_spans")))
    loss = F.col("loss")
    return f.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _esc_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '\\', '\\b'), '[', '\\o'), '<', '\\l')"


OP7_SQL = f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA[1]}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA[1]}'),
l AS (SELECT *, lag(role) OVER w AS prev FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, CASE WHEN prev IS NOT DISTINCT FROM role THEN 3 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 9 WHEN role = 'system' THEN 15
  ELSE 14 + length({_esc_sql('role')}) END AS mark FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(mark + length({_esc_sql('text')})))::BIGINT AS formatted_chars FROM m GROUP BY conv_id
"""
