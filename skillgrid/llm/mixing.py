"""Mixing sources to target weights by hierarchical budgets.

The tree has a level for each of a list of columns (domain, language, source). The
budget of tokens goes down the tree: a node shares its budget among its children in
proportion to their weights, but no child gets more than its subtree can give (its
tokens times `epochs`); what a child cannot take goes to its siblings by their weights.
So a shortage of a source is first made up by the sources of the same language, and
only if these run short by other languages, then other domains. Filling up to a common
level w * L with caps c has a closed form: in order of c / w, L is the largest of
(budget - caps before) / (weight from here on), so windows over siblings do it.

Each leaf then takes a prefix, by tokens, of its documents in seeded order: whole epochs
first, and of the last one the documents up to the rest of its budget, each epoch in an
order of its own. The place where a leaf's prefix ends is found over the sums of 256 ranges
of the order, then of 256 ranges of the range where it lies, and so on until that has at
most RANGE_ROWS rows: no task holds more of a leaf, however large it is. Documents are
selected by comparing with that place, where they are.

Tokens are words split at white space. Documents without any (null, empty) are in no
leaf's prefix. Null keys count as "". Weights are whole numbers; unnamed values weigh 1,
and those of 0 or less get nothing, though their tokens count in the total that the budget
is a share of. Rows of one leaf with equal ids are taken or left together; they are one
place of the order, however many they are. Budgets are whole tokens, rounded down. Very
long texts count whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, load

SEED, EPOCHS, SHARE = 17, 2, 0.6
LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
#: Hexadecimal digits that a round of the search for a leaf's end adds, at most so many
#: (an order has 32), and rows in which it is looked up one by one.
_DIGITS, _MOST_DIGITS, RANGE_ROWS = 2, 16, 4096
_WS = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """Words between white space: trimmed at both ends, the text is split once."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, _WS))).otherwise(0).cast("long")


def with_domain(df: DataFrame) -> DataFrame:
    """The domain of a source by its number, four in all."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1)
    return df.withColumn("domain", F.concat(F.lit("d"), (F.when(number == "", F.lit("0")).otherwise(number).cast("long") % 4).cast("string")))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: dict[str, dict[str, int]], share: float, epochs: int) -> DataFrame:
    """levels, tokens and budget of each leaf, from levels and tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    out = leaves.agg(F.floor(F.sum("tokens") * F.lit(float(share))).cast("long").alias("budget")).withColumn("_root", F.lit(0))
    for level in levels:
        leaves = leaves.where(_weight(level, weights) > 0)
    above: list[str] = ["_root"]
    for level in levels:
        here = [*above, level]
        nodes = leaves.withColumn("_root", F.lit(0)).groupBy(*here).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.join(out.select(*above, "budget"), above).withColumn("w", _weight(level, weights))
        w = Window.partitionBy(*above).orderBy(F.col("cap") / F.col("w"), level)
        caps = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("fill", (F.col("budget") - caps).cast("double") / left.cast("double"))
        fill = F.max("fill").over(Window.partitionBy(*above))
        out = nodes.withColumn("budget", F.floor(F.least(F.col("cap").cast("double"), F.col("w") * fill)).cast("long"))
        above = here
    return out.select(*levels, "tokens", "budget")


def _place(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[str, ...] = LEVELS, weights: dict[str, dict[str, int]] = WEIGHTS,
    share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """A row for each selected document and epoch: the columns `keep` (all, if None) with
    the levels as leaf_<level>, n_tokens and epoch, which replace columns of these names.
    The budget is `share` of all tokens."""
    scratch = Scratch(df.sparkSession, "mix")
    keep = tuple(df.columns) if keep is None else keep
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in levels]
    slim = scratch.table(df.select(F.col(id_col).alias("k"), *named, words(F.col(text_col)).alias("n")).where("n > 0"))
    leaves = scratch.table(slim.groupBy(*levels).agg(F.sum("n").alias("tokens"), F.count("*").alias("c")))
    plan = budgets(leaves.drop("c"), levels, weights, share, epochs).where("budget > 0")
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")))
    plan = scratch.table(plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")))
    partial = plan.where("rest > 0").join(leaves.drop("tokens"), list(levels))
    ends = scratch.table(partial.select(*levels, "whole", F.lit("").alias("range"), F.col("rest").alias("room"), "c"))
    digits = 0
    while True:
        rows = slim.join(scratch.hint(ends.drop("c")), list(levels)).withColumn("place", _place(seed, F.col("whole") + 1, F.col("k")))
        rows = rows.where(F.substring("place", 1, digits) == F.col("range")) if digits else rows
        if (ends.agg(F.max("c")).first()[0] or 0) <= RANGE_ROWS or digits >= _MOST_DIGITS:
            break
        digits += _DIGITS
        # the range in which the leaf's room ends, and what is left of it there
        sums = rows.groupBy(*levels, "whole", "room", F.substring("place", 1, digits).alias("range"))
        sums = sums.agg(F.sum("n").alias("n"), F.count("*").alias("c"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*levels).orderBy("range")))
        sums = sums.where((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("n") <= F.col("room")))
        left = F.col("room") - (F.col("upto") - F.col("n"))
        ends = scratch.table(sums.select(*levels, "whole", "range", left.alias("room"), "c"))
    inside = rows.groupBy(*levels, "room", "place").agg(F.sum("n").alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*levels).orderBy("place")))
    last = inside.where(F.col("upto") <= F.col("room")).groupBy(*levels).agg(F.max("place").alias("last"))
    plan = plan.join(ends.select(*levels, "range"), list(levels), "left").join(last, list(levels), "left")
    plan = scratch.table(plan.select(*[F.col(c).alias(f"leaf_{c}") for c in levels], "whole", "rest", "range", "last"))
    leaf = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"leaf_{c}") for c in levels]
    made = {"n_tokens", "epoch", *(f"leaf_{c}" for c in levels)}
    keep = tuple(c for c in keep if c not in made)
    chosen = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(id_col).alias("k"), words(F.col(text_col)).alias("n_tokens"), *leaf)
    chosen = chosen.where("n_tokens > 0").join(scratch.hint(plan), [f"leaf_{c}" for c in levels])
    place = _place(seed, F.col("whole") + 1, F.col("k"))
    early = (F.col("rest") > 0) & ((place < F.coalesce("range", F.lit("g"))) | (place <= F.coalesce("last", F.lit(""))))
    chosen = chosen.withColumn("times", F.col("whole") + F.when(early, 1).otherwise(0)).where("times > 0")
    epochs_of = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("epoch")
    return chosen.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *[f"leaf_{c}" for c in levels], "n_tokens", epochs_of)


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = with_domain(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mix(docs, keep=("doc_id",)).select("doc_id", *[F.col(f"leaf_{c}").alias(c) for c in LEVELS], "n_tokens", "epoch")


def _weight_sql(level: str) -> str:
    named = " ".join(f"WHEN '{v}' THEN {w}" for v, w in WEIGHTS.get(level, {}).items())
    return f"CASE {level} {named} ELSE 1 END" if named else "1"


def _level_sql(name: str, level: str, above: tuple[str, ...], parent: str) -> str:
    keys = ", ".join((*above, level))
    part = f"PARTITION BY {', '.join(above)} " if above else ""
    join = f"JOIN {parent} USING ({', '.join(above)})" if above else f"CROSS JOIN {parent}"
    return f"""
{name}_n AS (SELECT {keys}, any_value(budget) AS budget, sum(cap)::BIGINT AS cap, any_value({_weight_sql(level)})::BIGINT AS w
FROM leaf {join} GROUP BY {keys}),
{name}_f AS (SELECT *, (budget - coalesce(sum(cap) OVER ({part}ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1
PRECEDING), 0))::DOUBLE
             / (sum(w) OVER ({part}ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS fill FROM {name}_n),
{name} AS (SELECT {keys}, floor(least(cap::DOUBLE, w * max(fill) OVER ({part.strip()})))::BIGINT AS budget FROM {name}_f)"""


ORACLE = f"""
WITH t AS (
  SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s, coalesce(lang, '') AS
  lang, coalesce(source, '') AS source,
         'd' || (CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 0 ELSE
         regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1)::BIGINT % 4 END)::VARCHAR AS domain
  FROM documents),
d AS (SELECT doc_id, domain, lang, source, len(string_split_regex(s, '[ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n FROM t WHERE s <> ''),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, {EPOCHS} * sum(n)::BIGINT AS cap FROM d GROUP BY ALL),
root AS (SELECT floor(sum(tokens)::BIGINT::DOUBLE * {SHARE}::DOUBLE)::BIGINT AS budget FROM leaf),
{_level_sql("a", "domain", (), "root")},
{_level_sql("b", "lang", ("domain",), "a")},
{_level_sql("c", "source", ("domain", "lang"), "b")},
plan AS (SELECT c.*, tokens, budget // tokens AS whole, budget % tokens AS rest FROM c JOIN leaf USING (domain, lang, source) WHERE budget > 0),
r AS (SELECT d.*, whole, rest, md5('{SEED}:' || (whole + 1)::VARCHAR || ':' || doc_id::VARCHAR) AS place FROM d JOIN plan USING
(domain, lang, source)),
u AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM r),
e AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM u)
SELECT doc_id, domain, lang, source, n AS n_tokens, unnest(range(1, (times + 1)::BIGINT)) AS epoch FROM e
"""
