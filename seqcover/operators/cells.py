"""Two tables compared block by block: each pair of blocks is a cell, taken by one task.

Rows are dealt out to blocks at random, so cells are alike in work, and a row goes once to each block of the other
table. What a cell holds is bounded; what it finds is written as it is found, so pairs are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of targets and of centres, letters of a block, and targets below which a block isn't cut further to employ all tasks.
TARGETS, CENTRES, LETTERS, LEAST = 16_384, 4_096, 4 << 20, 1_024


def _class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def celled(targets: DataFrame, centres: DataFrame, each: Callable, schema: str, reach: Column | None = None, order: Column | None = None, sides: tuple[int, int] | None = None) -> DataFrame:
    """What each(targets, centres) yields, two Arrow tables at a time, over all pairs of blocks of two stored tables.

    Both have text (no empty ones); other columns are theirs. Targets of like length share blocks, and of centres that
    are longer only as many letters are sent as the longest target of a block and its reach (of targets' lengths, a
    column of n) can meet; without a reach, all letters. Centres that are shorter by more than the reach aren't sent.
    order: of the centres within a cell; sides: rows of a block of targets and of centres at most.
    """
    spark, sides = targets.sparkSession, sides or (TARGETS, CENTRES)
    n, own = F.length("text"), [c for c in targets.columns if c != "text"]
    theirs = [c for c in centres.columns if c != "text"]
    far = F.lit(0) if reach is None else reach
    kinds = targets.groupBy(_class(n).alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("least"), F.max(n).alias("most"), F.max(F.expr("0") if reach is None else far).alias("reach")).collect()  # a row for each power of two
    sizes = centres.groupBy(_class(n).alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.max(n).alias("most")).collect()
    grids, cells, tasks = [], 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for row in sorted(kinds, key=lambda row: row.k):
        short = 0 if reach is None else row.least - row.reach
        met = [x for x in sizes if x.most >= short]
        if not met:
            continue
        wide = max(x.most for x in met) if reach is None else min(max(x.most for x in met), row.most + row.reach)
        high, low = max(1, min(sides[0], LETTERS // row.most)), max(1, min(sides[1], LETTERS // max(1, wide)))
        across = -(-sum(x.rows for x in met) // low)
        down = max(-(-row.rows // high), min(-(-row.rows // LEAST), -(-tasks // across)))
        grids.append((row.k, cells, down, across, short, wide))
        cells += down * across
    if not cells:
        return spark.createDataFrame([], schema)
    # each row's block is drawn by its text and columns, the same in every run of a task
    block = lambda columns, of: F.pmod(F.xxhash64("text", *columns), F.lit(of)).cast("int")
    none = F.array().cast("array<int>")
    row_cells, column_cells, cut = none, none, F.col("text")
    for k, first, down, across, _, _ in grids:
        row_cells = F.when(_class(n) == k, F.sequence(F.lit(first) + block(own, down) * across, F.lit(first) + block(own, down) * across + across - 1)).otherwise(row_cells)
    for _, first, down, across, short, _ in grids:
        drawn = first + block(theirs, across)
        column_cells = F.concat(column_cells, F.when(n >= short, F.sequence(drawn, drawn + (down - 1) * across, F.lit(across))).otherwise(none))
    if reach is not None:
        widths = F.lit(0)
        for _, first, _, _, _, wide in grids:
            widths = F.when(F.col("_cell") >= first, wide).otherwise(widths)
        cut = F.substr("text", F.lit(1), widths)
    left = targets.select(F.explode(row_cells).alias("_cell"), F.lit(True).alias("_target"), "text", F.lit(None).alias("_order"), F.struct(*own).alias("_own"))
    right = centres.select(F.explode(column_cells).alias("_cell"), F.lit(False).alias("_target"), "text", (F.lit(None) if order is None else order).alias("_order"), F.struct(*theirs).alias("_theirs"))
    right = right.withColumn("text", cut)
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(cells, "_cell")
    both = both.sortWithinPartitions("_target", F.asc_nulls_last("_order")).drop("_order") if order is not None else both.drop("_order")

    def cell(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = list(batches)
        if not sum(x.num_rows for x in rows):
            return
        whole = pa.Table.from_batches(rows)
        del rows
        side = lambda which, name: (lambda x: pa.table([x["text"], *[pc.struct_field(x[name], i) for i in range(x.schema.field(name).type.num_fields)]], names=["text", *[f.name for f in x.schema.field(name).type]]))(whole.filter(which).combine_chunks())
        left, right = side(whole["_target"], "_own"), side(pc.invert(whole["_target"]), "_theirs")
        del whole
        if left.num_rows and right.num_rows:
            yield from each(left, right)

    return both.mapInArrow(cell, schema)
