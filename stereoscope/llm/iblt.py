"""Invertible Bloom lookup sketches of texts' paragraphs, and what they tell of two versions.

A paragraph's digest goes to one cell in each of three tables; a cell keeps how many digests it holds, and the exclusive
ors of the digests and of their check values. Sketches of one size subtract cell by cell: what both
versions hold cancels out. A cell of the difference that holds one digest gives it away; taking it out of its other cells
opens more of them, until none is left (peeling). Where some stay shut, the pair is sketched anew with more cells.

Cells are rows: sketching, subtracting and each round of peeling are aggregations by pair and cell. They all group
by the pair's key first, so on a table bucketed by that key nothing is shuffled, and no row holds more than its pair's cells.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, work_dir

# a piece of a line: up to the first sentence end after 64 characters, or 256 characters; a shorter line is one piece
PARAGRAPH = r"[^\n]{64,255}?[.!?]+(?= )|[^\n]{1,256}"
TABLES = 3
CELLS = 24  # of a fingerprint
ROUNDS = 8
END, FOUND = -1, -2  # cells that are none: one per pair, so that no pair gets lost; a digest that was recovered


def digests(text: Column) -> Column:
    """64-bit digests of the text's different paragraphs; a text without any (empty, or line feeds alone) has none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(F.lit((1 << 32) - 1))


def _cells_of(digest: Column, m: Column) -> list[Column]:
    """The digest's cell in each table; another number of cells brings other places."""
    wide = (m / TABLES).cast("long")
    return [(F.lit(t).cast("long") * wide + F.pmod(F.xxhash64(digest, F.lit(t), m), wide)).cast("int") for t in range(TABLES)]


def _added(*more: Column) -> list[Column]:
    return [F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"), *more]


def sketch(sets: DataFrame, keys: list[str], m: Column, values: str) -> DataFrame:
    """The cells (``cell``, ``n``, ``digest``, ``check``) of each row's set of digests in column ``values``, a sketch of
    ``m`` cells. Cells that hold nothing are left out; each set has a cell ``END`` besides."""
    one = sets.select(*keys, m.cast("int").alias("m"), F.explode(F.concat(values, F.array(F.lit(None).cast("long")))).alias("digest"))
    none = F.col("digest").isNull()
    cells = F.when(none, F.array(F.lit(END))).otherwise(F.array(*_cells_of(F.col("digest"), F.col("m"))))
    put = one.select(*keys, "m", F.when(none, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n"), F.coalesce("digest", F.lit(0)).cast("long").alias("digest"),
                     F.when(none, F.lit(0)).otherwise(_check(F.col("digest"))).cast("long").alias("check"), F.explode(cells).alias("cell"))
    return put.groupBy(*keys, "m", "cell").agg(*_added())


def subtract(cells: DataFrame, keys: list[str], right: str) -> DataFrame:
    """Sketches of the rows where column ``right`` is false less those where it is true, cell by cell."""
    signed = cells.withColumn("n", F.when(F.col(right), -F.col("n")).otherwise(F.col("n")))
    return signed.groupBy(*keys, "m", "cell").agg(*_added())


def peel(cells: DataFrame, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """One row per pair: ``found`` (digest, n: 1 if only the left version has it, -1 if only the right one) and
    ``solved``. A round takes out, at once, all digests that lie alone in a cell."""
    fields = ["cell", "tag", "n", "digest", "check"]
    held = F.struct(*fields)
    by = [*keys, "m", "shut"]
    state = cells.withColumn("tag", F.lit(0).cast("long")).withColumn("shut", F.lit(False))
    open_ = (F.col("n") != 0) | (F.col("digest") != 0) | (F.col("check") != 0) | (F.col("cell") == END)
    for k in range(rounds + 1):
        state = state.filter(open_).groupBy(*by).agg(F.collect_list(held).alias("cells"))
        if k == rounds:
            break
        alone = F.filter("cells", lambda c: (c["cell"] >= 0) & (F.abs(c["n"]) == 1) & (c["check"] == _check(c["digest"])))
        pure = F.array_distinct(F.transform(alone, lambda c: F.struct(c["digest"].alias("digest"), c["n"].alias("n"))))
        state = state.withColumn("pure", pure)
        shut = F.col("shut") | ((F.size("pure") == 0) & F.exists("cells", lambda c: c["cell"] >= 0))
        entry = lambda cell, tag, n, digest, check: F.struct(*[x.alias(f) for x, f in zip((cell, tag, n, digest, check), fields)])
        zero = F.lit(0).cast("long")
        out = F.flatten(F.transform("pure", lambda p: F.array(
            entry(F.lit(FOUND), p["digest"], p["n"], zero, zero), *[entry(c, zero, -p["n"], p["digest"], _check(p["digest"])) for c in _cells_of(p["digest"], F.col("m"))])))
        # a pair that gives no more is not gone through again: its cells go but for the one that marks it
        left = F.when(F.col("shut"), F.filter("cells", lambda c: c["cell"] == END)).otherwise(F.concat("cells", out))
        state = state.withColumn("shut", shut).select(*by, F.explode(left).alias("c")).select(*by, "c.*")
        state = state.groupBy(*by, "cell", "tag").agg(*_added())
    return state.select(*keys, "m", (~F.col("shut") & ~F.exists("cells", lambda c: c["cell"] >= 0)).alias("solved"),
                        F.transform(F.filter("cells", lambda c: c["cell"] == FOUND), lambda c: F.struct(c["tag"].alias("digest"), c["n"].alias("n"))).alias("found"))


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``keys``, one file each, and read back: aggregations and joins by
    them shuffle it no more, whatever becomes of executors."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", work_dir(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # analysed: the files' place is known, so the catalog needs the name no more
    spark.sql(f"DROP TABLE {table}")
    return out


def differences(versions: DataFrame, keys: list[str], left: str, rights: dict[str, str], cells: int = CELLS, listed: bool = True) -> DataFrame:
    """For each row of ``versions`` (best ``bucketed`` by ``keys``, which tell its rows apart) and each name of ``rights``: how
    ``left``, an array of different digests, differs from the array in the column of that name: ``pair`` (the
    name), ``n_found``, with ``listed`` also ``found`` (digest, n: 1 if only ``left`` has it, else -1), and ``m``, the cells it took.

    The first sketch has ``cells`` cells. Pairs that do not peel try again with twice as many cells as both have
    digests, and with twice as many each time after, until every pair is solved: a pair's retry fails with a chance far
    below one half. A version without digests differs by all of the other's. An empty table gives no rows.
    """
    done, level, todo = None, 0, versions.withColumn("pairs", F.array(*[F.lit(p) for p in rights]))
    by = [*keys, "pair"]
    while True:
        wanted = [(p, F.size(left) + F.size(c)) for p, c in rights.items()]
        grown = lambda both: F.lit(cells) if not level else F.greatest(F.lit(2 * cells), both * 2) * (1 << level - 1)
        sides = [F.when(F.array_contains("pairs", p), F.struct(F.lit(p).alias("pair"), F.lit(r).alias("right"), (F.ceil(grown(both) / TABLES) * TABLES).alias("cells"),
                                                                F.col(rights[p] if r else left).alias("digests"))) for p, both in wanted for r in (False, True)]
        sets = todo.select(*keys, F.explode(F.array_compact(F.array(*sides))).alias("s")).select(*keys, "s.*")
        out = peel(subtract(sketch(sets, [*by, "right"], F.col("cells"), "digests"), by, "right"), by)
        out = staged(out.select(*by, "m", "solved", F.size("found").alias("n_found"), *(["found"] if listed else [])), f"peeled-{level}")
        done = out.filter("solved") if done is None else done.unionByName(out.filter("solved"))
        failed = out.filter("not solved")
        if failed.isEmpty():
            return done.drop("solved")
        todo = versions.join(failed.groupBy(*keys).agg(F.collect_list("pair").alias("pairs")), keys)
        level += 1


def fingerprint(versions: DataFrame, keys: list[str], columns: dict[str, str], cells: int = CELLS) -> DataFrame:
    """For each row, the sketch of each array of digests as text: of each cell that holds something its number,
    count, digests and check values in hexadecimal, in order. ``columns``: result column -> column of digests."""
    sets = versions.select(*keys, F.explode(F.array(*[F.struct(F.lit(o).alias("name"), F.col(c).alias("digests")) for o, c in columns.items()])).alias("s")).select(*keys, "s.*")
    rows = sketch(sets, [*keys, "name"], F.lit(cells), "digests").groupBy(*keys, "name").agg(F.array_sort(F.collect_list(F.struct("cell", "n", "digest", "check"))).alias("cells"))
    word = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    text = F.array_join(F.transform(F.filter("cells", lambda c: c["cell"] >= 0), lambda c: F.concat(word(c["cell"], 4), word(c["n"], 8), word(c["digest"], 16), word(c["check"], 8))), "")
    named = rows.select(*keys, "name", text.alias("text"))
    return named.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == o, F.col("text"))).alias(o) for o in columns])


def likeness(n_found: Column, left: Column, right: Column) -> Column:
    """Twice the paragraphs in common by all paragraphs of both, from how many differ; 1 if neither has any."""
    both = F.size(left) + F.size(right)
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - n_found / both)
