"""Connected components of an edge table, and groups too large for one task, dealt out in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import used_up, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """node and component, the smallest node that edges lead to, of every node of an edge. Loops and repeated edges do no harm.

    Each round links every node to the smallest one near it and then jumps along links twice, so that long paths shrink by a
    factor a round. Rounds end when nothing changes; ``most`` is far beyond what any table needs, and passing it is an error.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    pairs = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    label = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    if pairs.isEmpty():
        return label
    for _ in range(most):
        of = label.select(F.col("node").alias("n"), F.col("component").alias("c"))
        named = pairs.join(of, F.col("u") == F.col("n")).select("v", F.col("c").alias("cu"))
        of2 = label.select(F.col("node").alias("n"), F.col("component").alias("cv"))
        roots = named.join(of2, F.col("v") == F.col("n")).where("cu != cv").select(F.greatest("cu", "cv").alias("r"), F.least("cu", "cv").alias("to"))
        hooks = written(roots.groupBy("r").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            used_up(pairs, hooks)
            return label
        made = hooks
        # a root hooks to a smaller one, so hooks hold no cycle; two jumps each follow them further
        for _ in range(2):
            on = hooks.select(F.col("r").alias("r2"), F.col("to").alias("to2"))
            hooks = hooks.join(on, F.col("to") == F.col("r2"), "left").select("r", F.coalesce("to2", "to").alias("to"))
        old, label = label, written(label.join(hooks, F.col("component") == F.col("r"), "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        used_up(made, old)
    raise RuntimeError("the components did not settle")


def in_blocks(rows: DataFrame, key: str, member: str, sizes: DataFrame, block: int) -> DataFrame:
    """Adds g1 and g2 so that groups by (key, g1, g2) are bounded and every two rows of a key meet in one of them.

    ``sizes``: rows of each key (columns ``key``, n). A key with ``block`` rows at most is one group (0, 0). A larger one is cut by
    a hash of ``member`` into parts of about half that, and each row goes to the pairs of parts that hold its own.
    """
    big = sizes.where(F.col("n") > block).select(F.col(key).alias("__k"), F.ceil(F.col("n") * 2 / block).cast("int").alias("__parts"))
    named = rows.join(big, F.col(key) == F.col("__k"), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    named = named.withColumn("__own", F.pmod(F.xxhash64(F.col(member), F.lit(3)), F.col("__parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), lambda o: F.struct(F.least(o, F.col("__own")).alias("g1"), F.greatest(o, F.col("__own")).alias("g2")))
    return named.withColumn("__pair", F.explode(pair)).withColumns({"g1": F.col("__pair.g1"), "g2": F.col("__pair.g2")}).drop("__k", "__pair", "__parts", "__own")


def map_groups(rows: DataFrame, keys: list[str], run: Callable[[dict[str, np.ndarray]], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) that ``run`` gives for the columns of each group of bounded size.

    Like a grouped map, but groups of a few rows, of which there are many, come in batches and cost no call across processes.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def edges(t: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            cols = {c: t.column(c).to_numpy(zero_copy_only=False) if not pa.types.is_binary(t.schema.field(c).type) else np.array([*t.column(c).to_pylist(), None], object)[:-1] for c in t.column_names}
            new = np.zeros(t.num_rows, bool)
            for k in keys:
                new[1:] |= cols[k][1:] != cols[k][:-1]
            starts = [0, *np.flatnonzero(new).tolist()] if t.num_rows else []
            ends = [*starts[1:], t.num_rows]
            keep = None if last else t.slice(starts[-1])
            out = []
            for a, b in zip(starts if last else starts[:-1], ends, strict=False):
                if b - a > 1:
                    out += run({c: x[a:b] for c, x in cols.items()})
            return out, keep

        def made(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            out, rest = edges(pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t, False)
            yield made(out)
        if rest is not None:
            yield made(edges(rest, True)[0])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(split, "a long, b long")
