"""Analysis of a set of CSV folders."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from phasegrid.operators import energy, quality, reshape
from phasegrid.operators.dedup import dedup
from phasegrid.session import configure
from phasegrid.sources.csv import FAIL, SET_ASIDE, DeviceSource, load_readings, rejected_readings


@dataclass(frozen=True)
class MeterData:
    """Readings of one or more devices, as loaded: ``rows`` still has the copies of overlapping files.

    ``rejected`` has the rows that were set aside, if that was asked for.
    """

    rows: DataFrame
    rejected: DataFrame | None = None

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        sources: Sequence[DeviceSource],
        start: dt.datetime | str | None = None,
        end: dt.datetime | str | None = None,
        set_aside: bool = False,
    ) -> MeterData:
        """Readings from ``start`` to ``end``, both included.

        A value that cannot be read, in whichever column, fails the query with its device and file;
        with ``set_aside`` such rows are left out and kept in ``rejected``.
        """
        configure(spark)
        rows = load_readings(spark, sources, start=start, end=end, bad=SET_ASIDE if set_aside else FAIL)
        return cls(rows, rejected_readings(spark, sources, start, end) if set_aside else None)

    @property
    def readings(self) -> DataFrame:
        """One row per device and timestamp, from the first file that has it."""
        return dedup(self.rows).drop("pos")

    @property
    def files(self) -> DataFrame:
        return quality.file_stats(self.rows)

    @property
    def duplicate_files(self) -> DataFrame:
        """Files within the time of their device's leading file; an error if there are no files at all."""
        files = self.files
        if files.isEmpty():
            raise ValueError("There are no files to compare")
        return quality.duplicate_files(files)

    @property
    def gaps(self) -> DataFrame:
        return quality.gaps(self.rows)

    @property
    def statistics(self) -> DataFrame:
        return quality.device_stats(self.rows)

    @property
    def statistics_with_gaps(self) -> DataFrame:
        return quality.with_gap_list(self.statistics, self.gaps)

    def statistics_lines(self, tz: str) -> DataFrame:
        return quality.stats_lines(self.statistics, tz)

    @property
    def phase_data(self) -> DataFrame:
        return reshape.phase_table(self.readings)

    def phase_data_column(self, measure: str) -> DataFrame:
        return reshape.phase_column(self.readings, measure)

    def total_energy(
        self,
        every: str | dt.timedelta,
        group_by: Sequence[str] | None = ("device", "phase"),
        start_by: str = "window",
        **options,
    ) -> DataFrame:
        return energy.total_energy(
            self.readings, every, group_by, start_by, origin_rows=self.rows, **options
        )

    def daily_total_energy(self) -> DataFrame:
        return energy.daily_total_energy(self.readings)

    def total_energy_by_day_of_week(self) -> DataFrame:
        """Weekday profile, Monday first."""
        return energy.weekday_energy(self.readings).orderBy("day_of_week_num", "device", "phase")
