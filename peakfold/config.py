"""Defaults that define results: fixed values, which results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Extraction:
    sample_rate: int = 16000
    size: int = 1024
    step: int = 128
    min_bin: int = 9
    freq_distance: tuple[int, int] = (1, 128)
    time_distance: tuple[int, int] = (2, 33)


@dataclass(frozen=True)
class Matching:
    range: int = 2
    min_hits_unfiltered: int = 10
    min_hits_filtered: int = 5
    time_factor: tuple[float, float] = (0.9, 1.1)
    min_seconds_with_match: float = 0.2
    min_duration: float = 5.0
    part_size: int = 250
    part_divider: int = 5
    seconds_per_frame: float = 0.008
    frequency_factor: tuple[float, float] = (0.8, 1.2)


#: Matching of hits whose speed and pitch may differ.
TOLERANT = Matching(time_factor=(0.8, 1.2))


@dataclass(frozen=True)
class Monitoring:
    """Seconds: windows, fine windows in gaps of some lengths, clusters, refinement; acceptance."""

    step: int = 30
    overlap: int = 10
    fine: int = 15
    fine_overlap: int = 5
    gap: float = 30.0
    rescan: tuple[float, float] = (60.0, 300.0)
    slack: float = 5.0
    refine_from: float = 5.0
    probe: int = 30
    min_score: float = 20
    min_share: float = 0.5


@dataclass(frozen=True)
class Scan:
    frames_per_second: float = 125.0
    max_per_hash: int = 256
    max_offset_frames: int = 1250
    max_duration_difference: float = 15.0
    min_bucket_hits: int = 3
    min_similarity: float = 0.5
    bucket: int = 4

    @property
    def shift(self) -> int:
        """The least multiple of the bucket that keeps every allowed offset from going negative."""
        return (self.max_offset_frames // self.bucket + 1) * self.bucket
