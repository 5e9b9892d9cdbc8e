"""Trees that grow with a stream: each batch is built and merged into the node table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from treeline.plans.attachments import made
from treeline.plans.tree import Tree, built, merged


def _attachments(elements: list) -> dict[str, dict]:
    found: dict[str, dict] = {}
    for e in elements:
        if isinstance(e, list):
            found |= _attachments(e)
        elif isinstance(e, dict):
            found |= e.get("data", {})
            for sub in e.get("branch", []):
                found |= _attachments(sub if isinstance(sub, list) else [sub])
    return found


class GrowingTree:
    """A node table in ``path``. Each batch writes a new version beside the last and then names it current, so
    that a batch that is run again (same number) starts from the version before it and counts once."""

    def __init__(self, spark, path: str, elements: list):
        self.spark, self.path, self.elements = spark, path, elements

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str]]:
        root, fs = self._fs("")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("v") and fs.exists(self._fs(f"{n}/_SUCCESS")[0])]
        return sorted((int(n[1:].split("-")[0]), n) for n in done)

    def tree(self, before: int | None = None) -> Tree | None:
        known = [v for v in self.versions() if before is None or v[0] < before]
        if not known:
            return None
        nodes = self.spark.read.parquet(f"{self.path}/{known[-1][1]}")
        return Tree(nodes, {n: made(s) for n, s in _attachments(self.elements).items()})

    def add(self, batch: DataFrame, number: int) -> None:
        fresh, old = built(batch, self.elements), self.tree(before=number)
        grown = merged(old, fresh) if old is not None else fresh
        grown.nodes.write.parquet(f"{self.path}/v{number:012d}-{uuid.uuid4().hex[:8]}")
        for _, name in self.versions()[:-2]:
            p, fs = self._fs(name)
            fs.delete(p, True)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Grows by a stream; late rows count like others. Offsets are kept in ``checkpoint``."""
        writer = stream.writeStream.foreachBatch(lambda df, n: self.add(df, n)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
