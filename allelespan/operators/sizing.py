"""Size checks, hot keys and per-group top rows."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from allelespan.session import local_table

# A lookup result is held as a local table, and broadcast, only up to this many rows.
PIN_ROWS = 2_000
# Beyond this rank the optimiser no longer cuts groups before the shuffle (its default threshold).
GROUP_LIMIT = 1_000


class Pinned(NamedTuple):
    """Rows of a small lookup result, and the same rows as a local table."""

    rows: list[Row]
    table: DataFrame


def pin_if_small(df: DataFrame, max_rows: int = PIN_ROWS) -> Pinned | None:
    """The rows if there are at most ``max_rows``; otherwise None.

    At most ``max_rows + 1`` rows ever reach the driver. Callers need another way for None.
    """
    rows = df.take(max_rows + 1)
    return None if len(rows) > max_rows else Pinned(rows, local_table(df.sparkSession, rows, df.schema))


def site_predicate(rows: list[Row], ranges: int = 64) -> Column:
    """Filter for the (chrom, pos) pairs of pinned rows.

    The positions of each chromosome are merged into narrow ranges, at most ``ranges`` over all chromosomes (one per
    chromosome at least), by closing the smallest gaps first. Ranges reach the Parquet scan, where they prune folders and row groups; a
    list of positions would reach it only as its smallest and largest value. The exact pairs are left to the join.
    """
    places = sorted({(row.chrom, row.pos) for row in rows if row.chrom is not None and row.pos is not None})
    if not places:
        return F.lit(False)
    gaps = [(b[1] - a[1], k) for k, (a, b) in enumerate(zip(places, places[1:])) if a[0] == b[0]]
    chroms = len({chrom for chrom, _ in places})
    # the widest gaps stay open
    opened = {k for _, k in sorted(gaps, reverse=True)[: max(0, ranges - chroms)]}
    tests, start = [], 0
    for k in range(len(places)):
        if k + 1 == len(places) or places[k + 1][0] != places[k][0] or k in opened:
            low, high = places[start][1], places[k][1]
            here = f"pos = {low}" if low == high else f"pos BETWEEN {low} AND {high}"
            # a name as bytes needs no quoting; Spark folds it into a plain literal
            tests.append(f"(chrom = CAST(X'{places[k][0].encode().hex()}' AS STRING) AND {here})")
            start = k + 1
    return F.expr(" OR ".join(tests))  # one expression, not hundreds of calls from Python


def range_predicate(ranges: list[tuple[int, int]], most: int = 64) -> Column:
    """Filter for ``pos`` in any of the ranges; beyond ``most`` of them the smallest gaps are closed."""
    joined: list[list[int]] = []
    for low, high in sorted(ranges):
        if joined and low <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    if not joined:
        return F.lit(False)
    gaps = sorted(((b[0] - a[1], k) for k, (a, b) in enumerate(zip(joined, joined[1:]))), reverse=True)
    opened = {k for _, k in gaps[: most - 1]}
    tests, start = [], 0
    for k in range(len(joined)):
        if k + 1 == len(joined) or k in opened:
            tests.append(F.col("pos").between(joined[start][0], joined[k][1]))
            start = k + 1
    return reduce(lambda left, right: left | right, tests)


def interval_predicate(rows: list[Row]) -> Column:
    """Filter for the ``chrom, start_pos, end_pos`` intervals of pinned rows, pushed to the scan."""
    tests = [(F.col("chrom") == row.chrom) & F.col("pos").between(row.start_pos, row.end_pos) for row in rows]
    return reduce(lambda left, right: left | right, tests) if tests else F.lit(False)


def content_salt(df: DataFrame, salts: int) -> Column:
    """Salt from a row's own content, so a recomputed task gives every row the same salt again."""
    return F.pmod(F.xxhash64(*df.columns), F.lit(salts))


def left_join_nullable(left: DataFrame, right: DataFrame, on: dict[str, Column]) -> DataFrame:
    """Left join on text keys of which many may be NULL on the left.

    ``on`` maps each key column of ``right`` to the matching expression over ``left``. A NULL never matches,
    but all NULLs would meet in one task of a shuffled join; here each takes a stand-in made from its row's
    content, which no real key equals. The key columns of ``right`` are dropped.
    """
    stand_in = F.concat(F.lit("\u0000"), F.xxhash64(*left.columns).cast("string"))
    keyed = left
    for i, key in enumerate(on.values()):
        keyed = keyed.withColumn(f"_key{i}", F.coalesce(key, stand_in))
    return keyed.join(right.withColumnsRenamed({name: f"_key{i}" for i, name in enumerate(on)}), [f"_key{i}" for i in range(len(on))], "left").drop(
        *[f"_key{i}" for i in range(len(on))]
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group.

    A rank filter lets Spark keep at most ``n`` rows per group in each task before the shuffle, so a
    hot group reaches one task already cut. For larger ``n`` a salted round does that cut.
    """
    column = rank or "_rank"

    def cut(rows: DataFrame, by: list[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(column, F.row_number().over(window)).filter(F.col(column) <= n)

    if n >= GROUP_LIMIT:
        df = cut(df.withColumn("_salt", content_salt(df, 64)), [*keys, "_salt"]).drop("_salt", column)
    kept = cut(df, keys)
    return kept if rank else kept.drop(column)


def hot_keys(df: DataFrame, on: list[str], fraction: float = 0.01) -> list[int]:
    """Hashes of the keys that hold at least ``fraction`` of the rows; there can be at most ``1/fraction``.

    One pass over the key columns with a mergeable frequent-items sketch; nothing is shuffled but the
    sketches. The answer only decides which keys to salt and never affects results.
    """
    most = int(1 / fraction)
    sketch = df.select(F.xxhash64(*on).alias("_hash")).agg(
        F.expr(f"approx_top_k(_hash, {most}, {most * 100})").alias("_items"), F.count("*").alias("_total")
    )
    items = sketch.select(F.explode("_items").alias("_item"), "_total")
    rows = items.filter(F.col("_item.count") >= F.col("_total") * fraction).select("_item.item").take(most)
    return [row[0] for row in rows]


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", fraction: float = 0.01, salts: int = 32) -> DataFrame:
    """Equi-join that spreads hot keys of ``left`` over ``salts`` tasks, whatever the session's settings.

    Only rows of hot keys are salted on the left and repeated on the right; without hot keys this is the
    plain join. The keys are fixed as literals before the join is planned: both sides must agree on them
    even if a task has to be run again. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``,
    the joins that never output unmatched right rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how!r}")
    hot = hot_keys(left, on, fraction)
    if not hot:
        return left.join(right, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    salted_left = left.withColumn("_salt", F.when(is_hot, content_salt(left, salts)).otherwise(0).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
