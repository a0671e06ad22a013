"""Mix sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sources, in code point order with NULL last, get the weights in turn and share
   ``budget`` times all words. A target stops at ``max_repeats`` times its source; the
   excess is shared again by weight (closed form: sources sorted by cap per weight).
2. The targets, counted in blocks of ``block`` words, are apportioned to the sources by
   highest quotients target/(2s-1), and each source's seats to its shards by
   size/(2s-1). Only seats that are in doubt are listed: about two per shard.
3. Within a shard the documents lie end to end in seeded order. All blocks are taken
   ``seats div blocks`` times; the remaining seats are a seeded circular run of
   blocks. Overlap of a document with the run is arithmetic: no block is listed.

A shard holds a bounded number of documents, so a hot source is spread over many
tasks. A source's taken words miss its target by about one block per shard at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.columns import SPACE, WORD, join_groups, text_of, word_count
from tidemark.session import save_stage


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    budget: float = 1.5
    max_repeats: int = 2
    block: int = 16
    seed: int = 7
    least_shard: int = 512  # documents in a shard
    most_shard: int = 20_000


DEFAULT = Mix()


def _number(text: Column) -> Column:
    """A number below 2^32 from the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _rows(docs: DataFrame, mix: Mix, id_col: str, source_col: str, text_col: str) -> DataFrame:
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    seeded = F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.withColumns({
        "__src": source, "__size": word_count(text_of(text_col)), "__turn": F.md5(seeded),
    })


def targets(rows: DataFrame, mix: Mix = DEFAULT) -> DataFrame:
    """One row per source: ``__src, docs, source_size, target``."""
    sums = rows.groupBy("__src").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("__size").alias("source_size")
    )
    # One row per source from here on; the order of all sources is part of the rule.
    in_turn = Window.orderBy(F.col("__src") == "", "__src")
    turn = F.pmod(F.row_number().over(in_turn) - 1, F.lit(len(mix.weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), turn + 1)
    weighed = sums.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * mix.max_repeats
    )
    fullest = Window.orderBy(F.col("cap") / F.col("weight"), "__src")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    share = F.lit(mix.budget) * F.sum("source_size").over(everything)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", (share - spent) / left).withColumn(
        "capped", F.col("level") > F.col("cap") / F.col("weight")
    )
    final = F.min_by(F.col("level"), F.when(~F.col("capped"), F.col("cap") / F.col("weight")))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * final.over(everything)
    )
    return level.select("__src", "docs", "source_size", target.alias("target"))


def apportion(units: DataFrame, group: list[str], key: str, weight: str, seats: str,
              cap: str | None = None) -> DataFrame:
    """Sainte-Laguë within ``group``: adds ``quota``; ``seats`` is the group's number.

    A unit's quota lies between what rounding gives it for half as many seats less or
    more as there are units. Seats below are certain; those between are ranked.
    """
    whole = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(whole), F.sum(weight).over(whole)

    def rounded(s: Column) -> Column:
        ideal = F.when(total > 0, F.col(weight) * s / total).otherwise(F.lit(0.0))
        return F.floor(ideal + 0.5)

    most = rounded(F.col(seats) + n / 2) + 1
    least = F.greatest(rounded(F.greatest(F.col(seats) - n / 2, F.lit(0))) - 1, F.lit(0))
    if cap:
        most = F.least(most, F.col(cap))
    most = F.when(F.col(weight) > 0, most).otherwise(F.lit(0)).cast("long")
    bounded = units.withColumns({"__least": F.least(least, most).cast("long"), "__most": most})
    doubt = bounded.withColumn("__sure", F.sum("__least").over(whole)).select(
        "*", F.explode(F.sequence(F.col("__least") + 1, F.greatest("__most", F.col("__least") + 1)))
        .alias("__seat")
    )
    quotient = F.col(weight) / (2 * F.col("__seat") - 1)
    offered = F.col("__seat") <= F.col("__most")
    order = Window.partitionBy(*group).orderBy((~offered), quotient.desc(), key, "__seat")
    won = offered & (F.row_number().over(order) + F.col("__sure") <= F.col(seats))
    names = [c for c in units.columns if c not in (*group, key)]
    return (
        doubt.withColumn("__won", won.cast("long")).groupBy(*group, key)
        .agg(*[F.first(c).alias(c) for c in names],
             (F.first("__least") + F.sum("__won")).alias("quota"))
    )


def _plan(rows: DataFrame, narrow: DataFrame, mix: Mix) -> DataFrame:
    """Adds size, source_size, target, taken and the pieces taken of each document."""
    sources = save_stage(targets(narrow, mix))
    total = sources.agg(F.sum("docs"), F.sum("target")).first()
    docs, words = total[0] or 0, total[1] or 0.0
    seats = sources.select("__src", "target", F.lit(0).alias("__all")).withColumn(
        "seats", F.lit(int(words / mix.block + 0.5))
    )
    quotas = apportion(seats, ["__all"], "__src", "target", "seats").select(
        "__src", F.col("quota").alias("seats")
    )
    per_shard = min(max(docs // 100, mix.least_shard), mix.most_shard)
    shards_of = F.ceil(F.col("docs") / per_shard)
    sources = save_stage(
        sources.join(quotas, "__src").withColumn("shards", F.greatest(shards_of, F.lit(1)))
    )
    shard = F.pmod(F.conv(F.substring("__turn", 1, 8), 16, 10).cast("long"), F.col("shards"))

    def dealt(frame: DataFrame) -> DataFrame:
        joined = join_groups(frame, sources, ["__src"], "docs", docs)
        return joined.withColumn("__shard", shard.cast("long"))

    shards = (
        dealt(narrow).groupBy("__src", "__shard")
        .agg(F.sum("__size").alias("length"), F.first("seats").alias("seats"))
        .withColumn("blocks", F.ceil(F.col("length") / mix.block))
        .withColumn("cap", F.col("blocks") * mix.max_repeats)
    )
    shards = save_stage(apportion(shards, ["__src"], "__shard", "length", "seats", "cap"))
    start = _number(F.concat_ws(":", F.lit(str(mix.seed)), F.col("__src"), F.col("__shard")))
    shards = shards.where(F.col("blocks") > 0).select(
        "__src", "__shard", "length",
        F.expr("quota div blocks").alias("passes"),
        F.pmod(start, F.col("blocks")).alias("first"),
        F.pmod("quota", "blocks").alias("run"),
        "blocks",
    )
    line = Window.partitionBy("__src", "__shard").orderBy("__turn", "__size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = dealt(rows).withColumn("__end", F.sum("__size").over(line))
    placed = placed.join(shards, ["__src", "__shard"], "left")
    begin, end = F.col("__end") - F.col("__size"), F.col("__end")
    stop = F.col("first") + F.col("run")
    runs = [
        (F.col("first") * mix.block, F.least(stop * mix.block, F.col("length"))),
        (F.lit(0), F.greatest(stop - F.col("blocks"), F.lit(0)) * mix.block),
    ]
    pieces = [
        (F.greatest(a, begin) - begin, F.greatest(F.least(b, end) - F.greatest(a, begin), F.lit(0)))
        for a, b in runs
    ]
    taken = F.col("passes") * F.col("__size") + pieces[0][1] + pieces[1][1]
    return placed.withColumns({
        "size": F.col("__size"),
        "taken": F.coalesce(taken, F.lit(0)).cast("long"),
        "__passes": F.coalesce(F.col("passes"), F.lit(0)),
        "__pieces": F.array(*[
            F.struct(F.coalesce(a, F.lit(0)).cast("int").alias("skip"),
                     F.coalesce(n, F.lit(0)).cast("int").alias("words"))
            for a, n in pieces
        ]),
    })


def mix_report(
    docs: DataFrame, mix: Mix = DEFAULT, id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``size, source_size, target, taken``.

    A NULL source is a source of its own, a NULL or empty text has no words and takes
    none. Repeated rows are separate documents. An empty table gives an empty result.
    """
    narrow = save_stage(
        _rows(docs.select(id_col, source_col, text_col), mix, id_col, source_col, text_col)
        .select(F.col(id_col).alias("__id"), "__src", "__size", "__turn")
    )
    planned = _plan(narrow, narrow, mix)
    return planned.select(
        F.col("__id").alias(id_col), "size", "source_size", "target", "taken"
    )


def mix_documents(
    docs: DataFrame, mix: Mix = DEFAULT, id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The mix itself: a row for each taken copy or piece, with the columns of ``docs``.

    A document taken whole keeps its text unchanged. A piece is the taken words with the
    white space between them. Documents of which no word is taken are left out. An
    ``n_chars`` column follows the new text.
    """
    narrow = save_stage(
        _rows(docs.select(id_col, source_col, text_col), mix, id_col, source_col, text_col)
        .select("__src", "__size", "__turn")
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    rows = _rows(docs, mix, id_col, source_col, text_col).select(whole, "__src", "__size", "__turn")
    planned = _plan(rows, narrow, mix)
    nothing = F.struct(F.lit(0).alias("skip"), F.lit(0).alias("words"))
    full = F.struct(F.lit(0).alias("skip"), F.col("__size").cast("int").alias("words"))
    parts = F.concat(
        F.filter(F.col("__pieces"), lambda p: p["words"] > 0),
        F.when(F.col("__size") > 0, F.array_repeat(full, F.col("__passes").cast("int")))
        .otherwise(F.array_repeat(nothing, F.lit(0))),
    )
    taken = planned.withColumn("__part", F.explode(parts))
    text = text_of(f"__doc.{text_col}")
    # Each word with the white space after it.
    lead = F.regexp_extract(text, f"^{SPACE}*", 0)
    tokens = F.split(F.substr(text, F.length(lead) + 1), f"(?<={SPACE})(?=[^{SPACE[1:]})")
    piece = F.array_join(F.slice(tokens, F.col("__part.skip") + 1, F.col("__part.words")), "")
    piece = F.regexp_replace(piece, f"{SPACE}+$", "")
    entire = F.col("__part.words") == F.col("__size")
    new_text = F.when(entire, text).otherwise(piece)
    types = dict(docs.dtypes)
    columns = [
        new_text.alias(c) if c == text_col
        else F.length(new_text).cast(types[c]).alias(c) if c == "n_chars"
        else F.col(f"__doc.`{c}`")
        for c in docs.columns
    ]
    return taken.select(*columns)


def _oracle(mix: Mix = DEFAULT) -> str:
    """The mix in DuckDB SQL. Here every seat is listed and ranked, as the rule says."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mix.weights))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents
), sums AS (
  SELECT src, count(*) AS docs, sum(size)::BIGINT AS source_size FROM d GROUP BY src
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY src = '', src) - 1) % {len(mix.weights)} {weight} END AS weight,
         source_size * {mix.max_repeats} AS cap
  FROM sums
), levels AS (
  SELECT *, ({mix.budget}::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT *, CASE WHEN level > cap / weight THEN cap::DOUBLE
                 ELSE weight * min_by(level, CASE WHEN level <= cap / weight THEN cap / weight END) OVER () END AS target
  FROM levels
), seats AS (
  SELECT src, count(*) AS seats
  FROM (SELECT src, target / (2 * s - 1) AS q
        FROM (SELECT src, target, unnest(range(1, (target / {mix.block})::BIGINT + 1000)) AS s FROM targets)
        QUALIFY row_number() OVER (ORDER BY q DESC, src)
                <= (SELECT floor(sum(target) / {mix.block} + 0.5) FROM targets) AND q > 0)
  GROUP BY src
), sources AS (
  SELECT targets.*, coalesce(seats, 0) AS seats, greatest(ceil(docs / (
           SELECT least(greatest(sum(docs) // 100, {mix.least_shard}), {mix.most_shard}) FROM sums)), 1)::BIGINT AS shards
  FROM targets LEFT JOIN seats USING (src)
), dealt AS (
  SELECT *, ('0x' || turn[1:8])::BIGINT % shards AS shard FROM d JOIN sources USING (src)
), lengths AS (
  SELECT src, shard, sum(size)::BIGINT AS length, any_value(seats) AS seats,
         ceil(sum(size) / {mix.block})::BIGINT AS blocks
  FROM dealt GROUP BY src, shard
), offered AS (
  SELECT src, shard, seats, length / (2 * s - 1) AS q
  FROM (SELECT *, unnest(range(1, blocks * {mix.max_repeats} + 1)) AS s FROM lengths)
), quotas AS (
  SELECT src, shard, count(*) AS quota
  FROM (SELECT * FROM offered QUALIFY row_number() OVER (PARTITION BY src ORDER BY q DESC, shard) <= seats)
  GROUP BY src, shard
), runs AS (
  SELECT src, shard, length, blocks, coalesce(quota, 0) // blocks AS passes,
         coalesce(quota, 0) % blocks AS run,
         ('0x' || md5('{mix.seed}:' || src || ':' || shard)[1:8])::BIGINT % blocks AS first
  FROM lengths LEFT JOIN quotas USING (src, shard) WHERE blocks > 0
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY src, shard ORDER BY turn, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM dealt LEFT JOIN runs USING (src, shard)
)
SELECT doc_id, size, source_size, target, coalesce((
         passes * size
         + greatest(least((first + run) * {mix.block}, length, stop) - greatest(first * {mix.block}, stop - size), 0)
         + greatest(least(greatest(first + run - blocks, 0) * {mix.block}, stop) - (stop - size), 0)
       )::BIGINT, 0) AS taken
FROM placed
"""


ORACLE = _oracle()
