"""What is selected in a view and on its timeline, kept together: a line, a lane's match, and a place among search hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import nearest


@dataclass
class Selection:
    """``matched`` (filter_id, line_no): the lines of each lane; ``found`` (line_no): the hits of a search, if there is one.
    ``lane`` is chosen by the user; ``mark`` is the line of it that is marked; ``place`` counts among the hits from 0."""

    matched: DataFrame
    found: DataFrame | None = None
    active: tuple[bool, ...] = ()
    lane: int | None = None
    mark: int | None = None
    place: int | None = None
    line: int | None = None

    def _lane(self, lane: int) -> DataFrame:
        return self.matched.where(F.col("filter_id") == lane)

    def _has(self, rows: DataFrame, line: int) -> bool:
        return rows.where(F.col("line_no") == line).limit(1).count() > 0

    def sync(self, line: int) -> None:
        """Both cursors go to what is nearest to a line: the lane's match, and the search's hit. Lists without lines keep
        theirs."""
        if self.lane is not None and (row := nearest(self._lane(self.lane), line).first()) is not None:
            self.mark = row["line_no"]
        if self.found is not None and (row := nearest(self.found, line).first()) is not None:
            self.place = self.found.where(F.col("line_no") < row["line_no"]).count()

    def follow(self, line: int) -> None:
        """A line was selected: the chosen lane stays, and marks the line if it is one of its matches and the lane is shown."""
        shown = self.lane is not None and (self.active[self.lane] if self.lane < len(self.active) else True)
        self.mark = line if shown and self._has(self._lane(self.lane), line) else None

    def select(self, line: int, lane: int | None = None) -> None:
        """A line was chosen on the timeline, in a lane or beside them; the lane that was clicked is chosen with it, even if
        others match the line too."""
        if lane is not None:
            self.lane = lane
            self.mark = line if self._has(self._lane(lane), line) else None
        elif self._has(self.matched, line):
            self.follow(line)
        else:
            self.mark = None
        self.line = line
