"""Complete jobs composed of sources, operators and sinks."""

from phasegrid.plans.analysis import MeterData
from phasegrid.plans.dashboards import csv_active_energy, live_active_power
from phasegrid.plans.imports import import_csv

__all__ = ["MeterData", "csv_active_energy", "import_csv", "live_active_power"]
