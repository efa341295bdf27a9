"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a Parquet table
with a row for each (blob, rule pack, pack version) that has been scanned, findings included. A scan
takes only pairs that the ledger lacks, reads the text of each such blob once, however many paths
share it, and appends. Findings are joined back to all paths.

NULL is an empty text. Rows may repeat and ids may be NULL or equal: a row's findings depend on its
text alone. Offsets are code points, ends exclusive. Two writers may append the same pair; readers
count it once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from souklens.llm.common import expand_texts, fresh, quoted, store
from souklens.session import exists


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


@dataclass(frozen=True)
class Pack:
    """Rules that are versioned together: a change of any rule needs a new version."""

    name: str
    version: int
    rules: tuple[Rule, ...]


#: The base rules and further common credential formats.
BASE = Pack("base", 1, (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
))
FORMATS = Pack("formats", 1, (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
))
PACKS = (BASE, FORMATS)

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
LEDGER = T.StructType([
    T.StructField("blob", T.StringType()), T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("pack", T.StringType()), T.StructField("version", T.IntegerType())])


def find(pack: Pack, text: str) -> list[dict]:
    """Spans of a pack's rules in one text. Letters are ASCII letters only."""
    return [{"kind": r.kind, "begin": m.start(), "end": m.end()}
            for r in pack.rules for m in re.finditer(r.pattern, text, re.ASCII) if m.end(r.group) - m.start(r.group) >= r.least]


def blob_of(text: str):
    return F.sha2(F.encode(F.coalesce(quoted(text).cast("string"), F.lit("")), "UTF-8"), 256)


class Ledger:
    """The scanned pairs under ``path``, which all executors must reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, packs: Iterable[Pack]) -> DataFrame:
        """A row for each scanned pair of ``packs``."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], LEDGER)
        wanted = reduce(lambda a, b: a | b, [(F.col("pack") == p.name) & (F.col("version") == p.version) for p in packs])
        return (self.spark.read.schema(LEDGER).parquet(self.path).where(wanted)
                .groupBy("blob", "pack", "version").agg(F.any_value("spans").alias("spans")))

    def scan(self, versions: DataFrame, packs: tuple[Pack, ...] = PACKS, text: str = "text") -> None:
        """Scan the blobs of ``versions`` with the packs that they have not been scanned with.

        Texts are reduced to one for each blob inside every task and then dealt by blob, once: a blob of very many
        paths, also of paths without id, is a row per task. Scanned pairs meet them there.
        """
        rows = versions.select(blob_of(text).alias("blob"), quoted(text).cast("string").alias("text"))
        done = self.rows(packs).groupBy("blob").agg(F.collect_set("pack").alias("done"))
        every = F.array(*[F.lit(p.name) for p in packs])
        pending = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
        unseen = (rows.groupBy("blob").agg(F.any_value("text").alias("text")).join(done, "blob", "left")
                  .select("blob", pending.alias("packs"), "text").where(F.size("packs") > 0))
        by_name = {p.name: p for p in packs}

        def make():
            def work(blobs, wanted, texts):
                seen = [(b, by_name[n], find(by_name[n], t or "")) for b, names, t in zip(blobs.to_pylist(), wanted.to_pylist(), texts, strict=True) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, *_ in seen], pa.string()), pa.array([s for *_, s in seen], SPANS),
                     pa.array([p.name for _, p, _ in seen], pa.string()), pa.array([p.version for _, p, _ in seen], pa.int32())], LEDGER.names)
            return work

        expand_texts(unseen, "text", ["blob", "packs"], LEDGER, make).write.mode("append").partitionBy("pack", "version").parquet(self.path)

    def findings(self, versions: DataFrame, packs: tuple[Pack, ...] = PACKS, keep: list[str] | None = None, text: str = "text") -> DataFrame:
        """Columns ``keep`` of every row of ``versions`` with ``blob`` and ``spans`` (sorted by begin, then rule order)."""
        keep = versions.columns if keep is None else keep
        rank = F.create_map(*[F.lit(x) for i, r in enumerate(r for p in packs for r in p.rules) for x in (r.kind, i)])
        blob, spans, other = fresh(keep, "blob", "spans", "blob_found")
        found = self.rows(packs).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        ordered = F.transform(F.sort_array(F.transform("spans", lambda s: F.struct(
            s["begin"].alias("begin"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
            lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end")))
        # written, so that adaptive execution can split the paths of a hot blob
        found = store(found.where(F.size("spans") > 0).select(F.col("blob").alias(other), ordered.alias(spans)), "findings")
        return (versions.select(*[quoted(c) for c in keep], blob_of(text).alias(blob))
                .join(found, F.col(blob) == F.col(other), "left")
                .select(*[quoted(c) for c in keep], blob, F.coalesce(spans, F.array()).alias(spans)))


def shown(spans: Column) -> Column:
    """Spans as ``kind:begin:end`` with commas between them."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
