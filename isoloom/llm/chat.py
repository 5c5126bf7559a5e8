"""Preference formatting of chats: one prompt, and a chosen and a rejected completion with loss masks.

Conversations that open with the same turn are alternatives. The one with most characters of
assistant text (ties: the smallest conv_id) is the chosen one of its group; every other member is
rejected in one pair with it, so a group of n gives n - 1 pairs. The longest common prefix of
their turns, compared by role and text, is rendered once as the prompt; what follows in each is
its completion, with the character spans of assistant text as the loss mask.

All of it is DataFrame and SQL code. Each group is dealt over SALTS parts by a hash of conv_id: every
part has its best, the best of at most SALTS parts is the group's, and it goes back to each part. So
a hot opening is never one task's.

Defined results: turns stand in the order of turn, role, text; a null role or text is empty, a
null turn comes first; a row with a null conv_id belongs to no conversation and is left out;
repeated rows are repeated turns; a conversation without partners gives a row of kind 'single'
whose prompt is all that comes before its last assistant turn (all of it, if there is none) and whose
rejected completion is null; identical conversations give empty completions; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rendering of a turn: opening, role, middle, text, closing. Fixed values.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: Parts of a group of conversations with one opening.
SALTS = 64


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as array<struct<role, text>>; with the size of its assistant text."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    ordered = whole.select("conv_id", F.transform("ts", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("ts"))
    size = F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + F.when(t.role == "assistant", F.length(t.text)).otherwise(0))
    return ordered.withColumn("said", size)


def rendered(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.text, F.lit(CLOSE))), "")


def mask(ts: Column) -> Column:
    """Spans (start, end) of assistant text in the rendered turns, its closing included."""
    fixed = len(OPEN) + len(MIDDLE)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start: long, end: long>>)").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a.at + fixed + F.length(t.role)
        end = start + F.length(t.text) + len(CLOSE)
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(t.role == "assistant", F.concat(a.spans, F.array(span))).otherwise(a.spans).alias("spans"))

    return F.aggregate(ts, zero, step, lambda a: a.spans)


def pairs(turns: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, kind, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    c = conversations(turns).withColumn("opening", F.sha2(F.to_json(F.col("ts")[0]), 256))
    c = c.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    group = Window.partitionBy("opening")
    parts = c.groupBy("opening", "salt").agg(F.max_by(F.struct("said", (-F.col("conv_id")).alias("_"), "conv_id", "ts"), F.struct("said", -F.col("conv_id"))).alias("best"), F.count("*").alias("n"))
    best = parts.withColumn("best", F.max("best").over(group)).withColumn("n", F.sum("n").over(group))
    both = c.join(best, ["opening", "salt"]).where((F.col("n") == 1) | (F.col("conv_id") != F.col("best.conv_id")))
    same = F.array_position(F.zip_with(F.col("best.ts"), F.col("ts"), lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(same > 0, same - 1).otherwise(F.size("ts"))
    last = F.array_position(F.transform(F.reverse("ts"), lambda t: t.role), "assistant")
    alone = F.size("ts") - last
    sized = both.select(
        F.col("best.conv_id").alias("chosen_id"),
        F.when(F.col("n") > 1, F.col("conv_id")).alias("rejected_id"),
        F.when(F.col("n") > 1, "pair").otherwise("single").alias("kind"),
        F.when(F.col("n") > 1, common).when(last > 0, alone).otherwise(F.size("ts")).cast("long").alias("n_prompt_turns"),
        F.col("best.ts").alias("good"),
        F.col("ts").alias("bad"),
    )
    cut = lambda ts: F.slice(ts, (F.col("n_prompt_turns") + 1).cast("int"), F.greatest(F.size(ts), F.lit(1)))
    parts = sized.select("chosen_id", "rejected_id", "kind", "n_prompt_turns", F.slice("good", F.lit(1), F.col("n_prompt_turns").cast("int")).alias("head"), cut("good").alias("good"), F.when(F.col("kind") == "pair", cut("bad")).alias("bad"))
    return parts.select("chosen_id", "rejected_id", "kind", "n_prompt_turns", rendered(F.col("head")).alias("prompt"), rendered(F.col("good")).alias("chosen"), mask(F.col("good")).alias("chosen_mask"), rendered(F.col("bad")).alias("rejected"), mask(F.col("bad")).alias("rejected_mask"))


def digests(turns: DataFrame) -> DataFrame:
    """As `pairs`, with sizes and MD5 digests for the texts, and the masks as text."""
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s.start, F.lit("-"), s.end)), ",")
    out = pairs(turns)
    texts = [x for n in ("prompt", "chosen", "rejected") for x in (F.length(n).cast("long").alias(f"{n}_chars"), F.md5(n).alias(f"{n}_md5"))]
    return out.select("chosen_id", "rejected_id", "kind", "n_prompt_turns", *texts, spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


def oracle_sql() -> str:
    """The digests in DuckDB, with turns as rows."""
    body = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
    part = lambda name, side, where: f"""{name} AS (SELECT p.pid, string_agg(t.body, '' ORDER BY t.i) AS s,
        string_agg(CASE WHEN t.role = 'assistant' THEN (t.e - t.size + {len(OPEN) + len(MIDDLE)} + length(t.role) - p.cut)::VARCHAR || '-' || (t.e - p.cut)::VARCHAR END, ',' ORDER BY t.i) AS m
        FROM (SELECT p.*, coalesce((SELECT max(x.e) FROM t x WHERE x.conv_id = p.{side} AND x.i <= p.n), 0) AS cut FROM p) p JOIN t ON t.conv_id = p.{side} AND {where} GROUP BY p.pid)"""  # noqa: E731
    return f"""
    WITH r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT *, {body} AS body, length({body}) AS size, sum(length({body})) OVER (PARTITION BY conv_id ORDER BY i) AS e FROM r),
    c AS (SELECT conv_id, count(*) AS len, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said, max(CASE WHEN role = 'assistant' THEN i END) AS last FROM t GROUP BY conv_id),
    o AS (SELECT c.*, t.role AS o_role, t.text AS o_text FROM c JOIN t USING (conv_id) WHERE t.i = 1),
    g AS (SELECT *, first_value(conv_id) OVER w AS best, first_value(len) OVER w AS best_len, count(*) OVER (PARTITION BY o_role, o_text) AS n_group FROM o WINDOW w AS (PARTITION BY o_role, o_text ORDER BY said DESC, conv_id)),
    m AS (SELECT g.conv_id, coalesce(min(a.i) FILTER (b.i IS NULL OR a.role <> b.role OR a.text <> b.text) - 1, max(a.i)) AS common FROM g JOIN t a ON a.conv_id = g.conv_id LEFT JOIN t b ON b.conv_id = g.best AND b.i = a.i GROUP BY g.conv_id),
    p AS (SELECT g.conv_id AS pid, g.best AS chosen_id, CASE WHEN n_group > 1 THEN g.conv_id END AS rejected_id, CASE WHEN n_group > 1 THEN 'pair' ELSE 'single' END AS kind,
        CASE WHEN n_group > 1 THEN least(m.common, g.best_len) WHEN g.last IS NOT NULL THEN g.last - 1 ELSE g.len END AS n FROM g JOIN m USING (conv_id) WHERE n_group = 1 OR g.conv_id <> g.best),
    {part('h', 'chosen_id', 't.i <= p.n')},
    {part('a', 'chosen_id', 't.i > p.n')},
    {part('b', 'rejected_id', 't.i > p.n')}
    SELECT chosen_id, rejected_id, kind, n::BIGINT AS n_prompt_turns, length(coalesce(h.s, ''))::BIGINT AS prompt_chars, md5(coalesce(h.s, '')) AS prompt_md5,
        length(coalesce(a.s, ''))::BIGINT AS chosen_chars, md5(coalesce(a.s, '')) AS chosen_md5,
        CASE WHEN kind = 'pair' THEN length(coalesce(b.s, ''))::BIGINT END AS rejected_chars, CASE WHEN kind = 'pair' THEN md5(coalesce(b.s, '')) END AS rejected_md5,
        coalesce(a.m, '') AS chosen_mask, CASE WHEN kind = 'pair' THEN coalesce(b.m, '') END AS rejected_mask
    FROM p LEFT JOIN h USING (pid) LEFT JOIN a USING (pid) LEFT JOIN b USING (pid)"""
