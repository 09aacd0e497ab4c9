"""An index of scored ids, so that a batch of new ids need not read the old ones.

Every part of a stage has its ids written once more, dealt into buckets by hash, with a
Bloom filter for each bucket.  Ids of a batch are held against the filters of their
bucket; only buckets in which some id may occur are read and compared exactly.  The
index is built after its part.  A part without one, as after a crash, is read itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions.columns import by_name
from labelflow.plans.stages import StageStore

BUCKETS = 256
# With 24 bits and 8 probes an id that is not there passes once in 25,000 times.
BITS_PER_ID = 24
PROBES = 8
FILTERS = "part string, bucket int, bits binary"


def _hashes(ids: Column) -> list[Column]:
    """Bucket and two hashes of an id of any type."""
    text = ids.cast("string")
    return [F.pmod(F.xxhash64(F.lit(1), text), F.lit(BUCKETS)).cast("int").alias("bucket"), F.xxhash64(F.lit(2), text).alias("h1"), F.xxhash64(F.lit(3), text).alias("h2")]


def _probes(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """The bits of ids in a filter of ``size`` bits, one line per probe."""
    a, b = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(size) for k in range(PROBES)])


class FinishedIds:
    """The index of one stage of a store."""

    def __init__(self, store: StageStore, id_col: str, stage: str = "predictions") -> None:
        self.store, self.id_col, self.stage = store, id_col, stage
        self.root = f"{store.root}/finished/{stage}"

    def add(self, part: str) -> None:
        """Index a part that was written to the stage."""
        name = f"part-{part}"
        rows = self.store.read_parts(self.stage, [name]).select(by_name(self.id_col).alias("id"))
        hashed = rows.select("id", *_hashes(F.col("id")))
        folder = f"{self.root}/{name}"
        self.store._delete(folder)
        hashed.select("id", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/ids")

        def filled(pdf: pd.DataFrame) -> pd.DataFrame:
            size = max(64, BITS_PER_ID * len(pdf))
            bits = np.zeros(size, bool)
            bits[_probes(pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), size)] = True
            # The size comes first: packing rounds it up to whole bytes.
            packed = size.to_bytes(8, "big") + np.packbits(bits).tobytes()
            return pd.DataFrame([(name, int(pdf["bucket"].iloc[0]), packed)], columns=["part", "bucket", "bits"], dtype=object)

        filters = hashed.select("bucket", "h1", "h2").groupBy("bucket").applyInPandas(filled, FILTERS)
        filters.write.parquet(f"{folder}/filters")

    def maybe_finished(self, ids: DataFrame, without_part: str | None = None) -> DataFrame | None:
        """A table (``id_col``) with every finished id that is among ``ids``, and others that share their buckets; None if no part is there.

        A bucket's ids and filters meet in one task: a 256th of the batch.
        """
        spark, skipped = self.store.spark, f"part-{without_part}"
        parts = [name for name in self.store.parts(self.stage) if name != skipped]
        if not parts:
            return None
        indexed = [name for name in parts if self.store._exists(f"{self.root}/{name}/filters/_SUCCESS")]
        plain = [name for name in parts if name not in indexed]
        found = self.store.read_parts(self.stage, plain).select(by_name(self.id_col)) if plain else None
        hit = self._hit(ids, indexed) if indexed else []
        if hit:
            kept = spark.read.schema(f"id {ids.schema[self.id_col].dataType.simpleString()}").parquet(*hit)
            kept = kept.select(F.col("id").alias(self.id_col))
            found = kept if found is None else found.unionByName(kept)
        return ids.limit(0) if found is None else found

    def _hit(self, ids: DataFrame, parts: list[str]) -> list[str]:
        """Folders of the buckets in which some id may occur."""
        filters = self.store.spark.read.schema(FILTERS).parquet(*[f"{self.root}/{name}/filters" for name in parts])
        asked = ids.select(*_hashes(by_name(self.id_col))).distinct()

        def held(new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            names = []
            for part, packed in zip(known["part"], known["bits"]):
                size = int.from_bytes(packed[:8], "big")
                bits = np.unpackbits(np.frombuffer(packed, np.uint8, offset=8))
                if len(new) and bits[_probes(new["h1"].to_numpy(), new["h2"].to_numpy(), size)].all(axis=0).any():
                    names.append(part)
            rows = [(part, int(known["bucket"].iloc[0])) for part in names]
            return pd.DataFrame(rows, columns=["part", "bucket"], dtype=object)

        both = asked.groupBy("bucket").cogroup(filters.groupBy("bucket"))
        rows = both.applyInPandas(held, "part string, bucket int").collect()
        return [f"{self.root}/{row['part']}/ids/bucket={row['bucket']}" for row in rows]
