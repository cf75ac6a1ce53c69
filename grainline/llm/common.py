"""Helpers shared by the operators: reading tables, intermediate tables in the shared folder, words, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of white space as the contracts define words: everything between them is a word.
SPACE = "[\\x20\\x09-\\x0D]+"

_local_root: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set and the master is local (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_root.setdefault("root", tempfile.mkdtemp(prefix="grainline-"))


class Scratch:
    """Intermediate tables of one operator run, written to the shared folder, so that a lost executor costs no lineage.

    ``keep`` writes a frame and returns it reread; ``drop`` deletes the table of a frame that ``keep`` returned, when
    nothing reads it any more, and leaves any other frame alone. ``close`` deletes the whole run; as a frame that an
    operator returns may still read from it, that is for the caller, once the result is written: see ``release``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/grainline/{name}-{uuid.uuid4().hex}"
        self.kept: dict[int, tuple[DataFrame, str]] = {}  # holds the frames, so that no other frame takes their id
        self.n = 0
        _open.append(self)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(out)] = out, path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if id(df) in self.kept:
                self._delete(self.kept.pop(id(df))[1])

    def close(self) -> None:
        self.kept.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Runs whose tables may still be there, oldest first.
_open: list[Scratch] = []


def opened() -> int:
    """A mark for ``release``: how many runs have been opened so far and not been released."""
    return len(_open)


def release(mark: int = 0) -> None:
    """Delete the intermediate tables of all runs opened since ``mark``, once what reads them is written."""
    while len(_open) > mark:
        _open.pop().close()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes for no column of ``df`` to have it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. ``lower`` serves where all characters are ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def pieces(text: Column, separators: str) -> Column:
    """The non-empty pieces of a text between runs of separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def broadcast_below(df: DataFrame, n_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Broadcast a side whose measured size is below the limit; beyond it the join shuffles both sides."""
    return F.broadcast(df) if n_bytes <= limit else df


def local_components(a, b):
    """Label each end of the edges (numpy int64 arrays) with the smallest node it is linked to: (node, label) arrays."""
    import numpy as np

    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): one row (node, component) per node, component its smallest node.

    Alternates the large-star and small-star steps: each round every node points at the smallest node it knows, by a
    map-side combined ``min`` and a join, never by collecting a neighbourhood. Ends when a round changes nothing.
    """
    cur = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = scratch.keep(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        new = scratch.keep(
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct(),
            "small",
        )
        digest = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (cur, new)]
        scratch.drop(cur, large)
        cur = new
        if digest[0] == digest[1]:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
