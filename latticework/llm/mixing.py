"""Mixing sources to target weights by temperature, realised as budgeted permutations of blocks.

The share of each source in all tokens is raised to an exponent between 0 (all sources alike) and 1 (as
they are) and normalised. The exponent is the smallest one at which the entropy of the weights is not over its
target and no source is repeated more often than allowed; as both fall with the exponent it
is found by bisection. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
GRID = 32  # intervals that one round of the bisection looks at
ROUNDS = 6


def draw(*parts: Column | str) -> Column:
    """A reproducible draw from 0 to 2^32 - 1 for the values of ``parts``."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


@dataclass(frozen=True)
class Mix:
    """``entropy``: target as a share of the largest possible; ``repeats``: passes over one source at most;
    ``block``: documents in a block on average; ``seed``: of all permutations."""

    entropy: float = 0.95
    repeats: float = 2.0
    block: int = 256
    seed: str = "mix"


def exponent(shares: DataFrame, mix: Mix) -> float:
    """The exponent for a table of ``share`` values, all over 0, that sum up to 1.

    Each round evaluates the borders of GRID equal intervals in one aggregation (the rows of a
    source are pre-aggregated with those of others), and one figure reaches the driver: the
    border after which the limits hold.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        width = (high - low) / GRID
        tried = shares.select("share", F.explode(F.transform(F.sequence(F.lit(1), F.lit(GRID - 1)), lambda k: F.lit(low) + k * F.lit(width))).alias("e"))
        tried = tried.withColumn("p", F.exp(F.col("e") * F.log("share")))
        sums = tried.groupBy("e").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("s"), F.max("share").alias("most"), F.min("share").alias("least"), F.count(F.lit(1)).alias("n"))
        level = F.log("z") - F.col("s") / F.col("z")
        times = F.exp((1 - F.col("e")) * (F.log("most") - F.log("least")))
        good = sums.where((level <= F.lit(mix.entropy) * F.log("n")) & (times <= F.lit(mix.repeats))).agg(F.min("e")).first()[0]
        high = high if good is None else good
        low = high - width
    return high


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """For rows (source, n_docs, n_tokens): also weight, passes, whole, rest (tokens of the last, partial pass), blocks, groups.

    The budget is the smallest with which every source is seen whole at least once, so no document is
    lost. A source without tokens has weight 0 and one pass.
    """
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    shares = rows.where("n_tokens > 0").select((F.col("n_tokens") / F.lit(max(total, 1))).alias("share"))
    e = exponent(shares, mix)
    sums = shares.agg(F.sum(F.exp(F.lit(e) * F.log("share"))), F.max("share")).first()
    norm, most = sums[0] or 1.0, sums[1] or 1.0
    full = F.col("n_tokens") > 0
    share = F.col("n_tokens") / F.lit(max(total, 1))
    out = rows.withColumn("weight", F.when(full, F.exp(F.lit(e) * F.log(share)) / norm).otherwise(0.0))
    out = out.withColumn("passes", F.when(full & (share < most), F.exp(F.lit(1 - e) * (F.log(F.lit(most)) - F.log(share)))).otherwise(1.0))
    out = out.withColumn("whole", F.floor("passes").cast("int"))
    out = out.withColumn("rest", ((F.col("passes") - F.col("whole")) * F.col("n_tokens")))
    blocks = F.ceil(F.col("n_docs") / mix.block).cast("long")
    return out.withColumn("blocks", blocks).withColumn("groups", F.ceil(F.col("blocks") / 1024).cast("long"))


def mixed(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The passes over each document: rows (doc_id, source, n_tokens, weight, epoch, block, place).

    Tokens are words here. Documents are dealt by a hash into blocks of about ``mix.block``; in each pass the
    blocks of a source, and the documents inside each block, come in another order. Whole passes
    hold every document; the last pass is cut where the budget of the source is used up, the
    document that crosses it being in. ``place`` counts from 1 inside a block. Running sums go
    through documents in a block, blocks in a group of about 1024 and groups in a source, so that
    no window holds a whole source. A null source counts as ''. Rows with the same id and source are one
    document with all their words; null ids are one id. A null or empty text has 0 tokens.
    """
    mix = mix or Mix()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n"))
    # texts are read once: all that follows works on these few figures and on one row a source
    rows = written(rows.groupBy("doc_id", "source").agg(F.sum("n").alias("n_tokens")), "tokens")
    totals = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "sources")
    sources = plan(totals, mix)
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # one row a source: Spark broadcasts it while its files are small, and splits hot sources of a sort-merge join otherwise
    rows = rows.join(sources.drop("n_docs", "n_tokens"), "source")
    rows = rows.withColumn("block", F.pmod(draw(mix.seed, "block", named), F.col("blocks"))).withColumn("group", F.pmod(F.col("block"), F.col("groups")))
    rows = rows.withColumn("turn", draw(mix.seed, "doc", F.col("whole"), named))

    by_block = rows.groupBy("source", "block", "group", "whole").agg(F.sum("n_tokens").alias("tokens"))
    by_block = by_block.withColumn("block_turn", draw(mix.seed, "in", F.col("whole"), F.col("source"), F.col("block")))
    by_group = by_block.groupBy("source", "group", "whole").agg(F.sum("tokens").alias("tokens"))
    by_group = by_group.withColumn("group_turn", draw(mix.seed, "of", F.col("whole"), F.col("source"), F.col("group")))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_group = by_group.select("source", "group", before(Window.partitionBy("source").orderBy("group_turn", "group"), "tokens").alias("group_start"))
    by_block = by_block.join(by_group, ["source", "group"])
    by_block = by_block.select("source", "block", (F.col("group_start") + before(Window.partitionBy("source", "group").orderBy("block_turn", "block"), "tokens")).alias("block_start"))

    rows = rows.join(by_block, ["source", "block"])
    rows = rows.withColumn("start", F.col("block_start") + before(Window.partitionBy("source", "block").orderBy("turn", "doc_id"), "n_tokens"))
    epochs = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("start") < F.col("rest"), 0).otherwise(1))
    out = rows.withColumn("epoch", F.explode(epochs)).withColumn("turn", draw(mix.seed, "doc", F.col("epoch"), named))
    return out.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", F.row_number().over(Window.partitionBy("source", "block", "epoch").orderBy("turn", "doc_id")).cast("long").alias("place"))


def mixed_rows(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``df``, each as often as its document has passes; columns stay as they are."""
    found = mixed(df, mix, id_col, text_col, source_col).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("__passes"))
    named = found.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "__passes")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & F.coalesce(F.col(source_col).cast("string"), F.lit("")).eqNullSafe(F.col("__source"))
    repeated = df.join(named, same).withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__passes"))))
    return repeated.select(*[F.col(f"`{c}`") for c in df.columns])


def oracle(mix: Mix | None = None) -> str:
    """DuckDB SQL for ``mixed`` over ``documents``."""
    mix = mix or Mix()
    number = lambda *parts: "CAST(concat('0x', substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8)) AS BIGINT)"
    head = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS BIGINT) AS n_tokens FROM documents GROUP BY 1, 2),
s AS (SELECT source, count(*) AS n_docs, sum(n_tokens) AS n_tokens FROM d GROUP BY 1),
p AS (SELECT n_tokens / (SELECT CAST(sum(n_tokens) AS DOUBLE) FROM s) AS share FROM s WHERE n_tokens > 0),
r0 AS (SELECT CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high)"""
    for k in range(ROUNDS):
        head += f""",
t{k} AS (SELECT low + i * ((high - low) / {GRID}) AS e FROM r{k}, range(1, {GRID}) g(i)),
z{k} AS (SELECT e, sum(exp(e * ln(share))) AS z, sum(exp(e * ln(share)) * (e * ln(share))) AS s, max(share) AS most, min(share) AS least, count(*) AS n FROM t{k}, p GROUP BY e),
g{k} AS (SELECT min(e) AS good FROM z{k} WHERE ln(z) - s / z <= {mix.entropy} * ln(n) AND exp((1 - e) * (ln(most) - ln(least))) <= {mix.repeats}),
r{k + 1} AS (SELECT coalesce(good, high) - (high - low) / {GRID} AS low, coalesce(good, high) AS high FROM g{k}, r{k})"""
    return head + f""",
e AS (SELECT high AS e, (SELECT sum(exp(high * ln(share))) FROM p) AS norm, (SELECT max(share) FROM p) AS most, (SELECT CAST(sum(n_tokens) AS DOUBLE) FROM s) AS total FROM r{ROUNDS}),
q AS (SELECT source, n_docs, n_tokens, CASE WHEN n_tokens > 0 THEN exp(e * ln(n_tokens / total)) / norm ELSE 0.0 END AS weight,
  CASE WHEN n_tokens > 0 AND n_tokens / total < most THEN exp((1 - e) * (ln(most) - ln(n_tokens / total))) ELSE 1.0 END AS passes FROM s, e),
q2 AS (SELECT *, CAST(floor(passes) AS INT) AS whole, (passes - floor(passes)) * n_tokens AS rest, CAST(ceil(n_docs / {mix.block}) AS BIGINT) AS blocks FROM q),
q3 AS (SELECT *, CAST(ceil(blocks / 1024) AS BIGINT) AS groups FROM q2),
w AS (SELECT d.doc_id, d.source, d.n_tokens, weight, whole, rest, {number(f"'{mix.seed}'", "'block'", "coalesce(CAST(doc_id AS VARCHAR), '')")} % blocks AS block, groups FROM d JOIN q3 USING (source)),
w2 AS (SELECT *, block % groups AS grp, {number(f"'{mix.seed}'", "'doc'", "CAST(whole AS VARCHAR)", "coalesce(CAST(doc_id AS VARCHAR), '')")} AS turn FROM w),
b AS (SELECT source, block, grp, whole, sum(n_tokens) AS tokens, {number(f"'{mix.seed}'", "'in'", "CAST(whole AS VARCHAR)", "source", "CAST(block AS VARCHAR)")} AS block_turn FROM w2 GROUP BY source, block, grp, whole),
gr AS (SELECT source, grp, whole, sum(tokens) AS tokens, {number(f"'{mix.seed}'", "'of'", "CAST(whole AS VARCHAR)", "source", "CAST(grp AS VARCHAR)")} AS group_turn FROM b GROUP BY source, grp, whole),
gr2 AS (SELECT source, grp, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY group_turn, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS group_start FROM gr),
b2 AS (SELECT source, block, group_start + coalesce(sum(tokens) OVER (PARTITION BY source, grp ORDER BY block_turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_start FROM b JOIN gr2 USING (source, grp)),
w3 AS (SELECT w2.*, block_start + coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w2 JOIN b2 USING (source, block)),
x AS (SELECT *, unnest(range(0, whole + CASE WHEN start < rest THEN 1 ELSE 0 END)) AS epoch FROM w3)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, CAST(epoch AS INT) AS epoch, CAST(block AS BIGINT) AS block,
 row_number() OVER (PARTITION BY source, block, epoch ORDER BY {number(f"'{mix.seed}'", "'doc'", "CAST(epoch AS VARCHAR)", "coalesce(CAST(doc_id AS VARCHAR), '')")}, doc_id) AS place FROM x"""
