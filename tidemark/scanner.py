"""A small facade: from a score series to the clips worth cutting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import clips, timeseries


@dataclass
class Scanner:
    """``Scanner(threshold=0.6).clips(samples, existing)``: segments of a series as a manifest of what is to be cut."""

    threshold: float = 0.6
    least: int = 5_000_000
    lead: int = 2_000_000
    key: tuple[str, ...] = ("video", "camera")

    def segments(self, samples: DataFrame) -> DataFrame:
        return timeseries.segments(samples, self.threshold, self.least, list(self.key))

    def clips(self, samples: DataFrame, existing: DataFrame) -> DataFrame:
        """``key, start_us, end_us, out, codec`` of the segments whose clip isn't there (``existing``: ``out, length``)."""
        name = F.concat_ws("_", *(F.col(k).cast("string") for k in self.key), F.floor(F.col("start_us") / 1_000_000).cast("string"))
        found = self.segments(samples).select(*self.key, clips.lead_in(F.col("start_us"), self.lead).alias("start_us"), "end_us", F.concat(name, F.lit(".mp4")).alias("out"))
        return clips.cut_manifest(found, existing)
