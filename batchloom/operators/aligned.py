"""Several tables with one row identity, subset together."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AlignedTable:
    """Named frames with one row for each ``_idx``, and metadata that no subsetting touches.

    ``modality`` takes one frame, ``rows`` a subset of all; the two are separate calls, so an
    integer never means both.
    """

    def __init__(self, frames: dict[str, DataFrame] | None = None, metadata: dict | None = None, check: bool = True, **named: DataFrame):
        if frames is not None and named:
            raise TypeError("give a dict of frames or named frames, not both")
        if frames is None and not named:
            raise TypeError("no frames")
        frames = dict(frames if frames is not None else named)
        if not frames:
            raise ValueError("no frames")
        if metadata is not None and not isinstance(metadata, dict):
            raise TypeError("metadata must be a dict")
        for name, frame in frames.items():
            if not isinstance(frame, DataFrame):
                raise TypeError(f"{name} is no DataFrame")
            if "_idx" not in frame.columns:
                raise ValueError(f"{name} has no _idx")
        if check:
            sizes = {name: frame.count() for name, frame in frames.items()}
            first = next(iter(sizes))
            for name, size in sizes.items():
                if size != sizes[first]:
                    raise ValueError(f"{name} has {size} rows, {first} has {sizes[first]}")
        self.frames, self.metadata = frames, copy.copy(metadata or {})

    @classmethod
    def of(cls, *frames: DataFrame, names: list[str] | None = None, **kwargs) -> AlignedTable:
        """From frames in a row, with names or numbers."""
        if names is not None and len(names) != len(frames):
            raise ValueError("as many names as frames are needed")
        if not frames:
            raise TypeError("no frames")
        return cls(dict(zip(names or [str(i) for i in range(len(frames))], frames, strict=True)), **kwargs)

    def __len__(self) -> int:
        return next(iter(self.frames.values())).count()

    @property
    def count(self) -> int:
        return len(self.frames)

    def keys(self):
        return self.frames.keys()

    def items(self):
        return self.frames.items()

    def values(self):
        return self.frames.values()

    def modality(self, which: int | str) -> DataFrame:
        return self.frames[which] if isinstance(which, str) else list(self.frames.values())[which]

    def rows(self, chosen: Column | DataFrame | list[int]) -> AlignedTable:
        """A subset by a predicate on _idx, a frame with _idx (repeats stay repeated) or a list of ids."""
        if isinstance(chosen, Column):
            cut = {name: frame.where(chosen) for name, frame in self.frames.items()}
        else:
            ids = chosen if isinstance(chosen, DataFrame) else self.modality(0).sparkSession.createDataFrame([(int(i),) for i in chosen], "_idx bigint")
            cut = {name: ids.select("_idx").join(frame, "_idx") for name, frame in self.frames.items()}
        return AlignedTable(cut, self.metadata, check=False)

    def wide(self) -> DataFrame:
        """One frame: the frames' other columns side by side, as structs named after them."""
        out = None
        for name, frame in self.frames.items():
            one = frame.select("_idx", F.struct(*[c for c in frame.columns if c != "_idx"]).alias(name))
            out = one if out is None else out.join(one, "_idx")
        return out

    def __repr__(self) -> str:
        return f"AlignedTable({', '.join(self.frames)})"
