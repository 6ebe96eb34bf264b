"""Electricity-meter time-series analytics on Spark."""

from phasegrid.plans import MeterData, csv_active_energy, import_csv, live_active_power
from phasegrid.session import configure
from phasegrid.sources import DeviceSource

__all__ = [
    "DeviceSource",
    "MeterData",
    "configure",
    "csv_active_energy",
    "import_csv",
    "live_active_power",
]
