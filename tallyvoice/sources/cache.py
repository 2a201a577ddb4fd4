"""Tables that are computed once: named by what they were made from, and resumed where a run broke off.

The address of a table is a hash of its name, its settings, the plan it follows (a version or scheme
as text) and a fingerprint of the source's keys. The fingerprint is a few sums and exclusive ors over
the key hashes, so it is one partial aggregate and does not depend on the order of rows. A table is
written in parts by key hash; a run that finds parts of an earlier one computes only the keys that
they lack. A complete table has a record in the manifest and is read without any other job.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import children, delete, exists, whole


class Cache:
    """Tables below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        #: Parts that this object has written, as (address, part).
        self.wrote: list[tuple[str, str]] = []

    def address(self, name: str, source: DataFrame, key: Sequence[str], settings: dict[str, Any], plan: str) -> str:
        hashes = source.select(*[F.xxhash64(F.lit(i), *key).alias(c) for i, c in enumerate("ab")])
        prints = hashes.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.bit_xor("b"))
        told = json.dumps([name, settings, plan, list(key), [str(x) for x in prints.first()]], sort_keys=True)
        return hashlib.sha256(told.encode()).hexdigest()[:32]

    def table(
        self, name: str, source: DataFrame, key: Sequence[str], build: Callable[[DataFrame], DataFrame], settings: dict[str, Any] | None = None,
        plan: str = "", parts: int = 8, most: int | None = None,
    ) -> DataFrame | None:
        """``build`` of the source, from the cache as far as it is there; its result keeps the key columns.

        With ``most``, at most so many parts are written in this run, and None is returned while some lack.
        """
        address = self.address(name, source, key, settings or {}, plan)
        folder = f"{self.root}/{name}/{address}"
        if not exists(self.spark, f"{self.root}/manifest/{address}/_SUCCESS"):
            done = [p for p in children(self.spark, folder) if whole(self.spark, f"{folder}/{p}")]
            mine = {f"part={i}-{parts}": i for i in range(parts)}
            rest = source
            if done:
                have = self._read(folder, done).select(*key).distinct()
                met = [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in key]
                rest = source.alias("s").join(have.alias("h"), met, "left_anti")
            slot = F.pmod(F.xxhash64(*key), F.lit(parts))
            for count, (part, i) in enumerate((p, i) for p, i in mine.items() if p not in done):
                if most is not None and count >= most:
                    return None
                build(rest.where(slot == i)).write.mode("overwrite").parquet(f"{folder}/{part}")
                self.wrote.append((address, part))
            record = [(address, name, json.dumps(settings or {}, sort_keys=True), plan, len(done), parts)]
            self.spark.createDataFrame(record, "address string, name string, settings string, plan string, found int, parts int").coalesce(1).write.mode(
                "overwrite"
            ).json(f"{self.root}/manifest/{address}")
        return self._read(folder, [p for p in children(self.spark, folder) if whole(self.spark, f"{folder}/{p}")])

    def _read(self, folder: str, parts: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", folder).parquet(*[f"{folder}/{p}" for p in parts]).drop("part")

    def manifest(self) -> DataFrame:
        """The complete tables: address, name, settings, plan, parts found by the last run, parts."""
        return self.spark.read.schema("address string, name string, settings string, plan string, found int, parts int").json(f"{self.root}/manifest/*")

    def drop_others(self, name: str, keep: Iterable[str]) -> list[str]:
        """Delete the tables of a name, complete or not, whose address is not kept; says which went."""
        gone = sorted(set(children(self.spark, f"{self.root}/{name}")) - set(keep))
        for address in gone:
            delete(self.spark, f"{self.root}/manifest/{address}")
            delete(self.spark, f"{self.root}/{name}/{address}")
        return gone
