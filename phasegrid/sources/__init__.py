"""Readers. They build scans; nothing is read until an action runs."""

from phasegrid.sources.csv import DeviceSource, load_csv_files, load_readings, read_csv_dir
from phasegrid.sources.messages import message_stream, read_json_lines
from phasegrid.sources.points import latest_points, point_log, read_points

__all__ = [
    "DeviceSource",
    "latest_points",
    "load_csv_files",
    "load_readings",
    "message_stream",
    "point_log",
    "read_csv_dir",
    "read_json_lines",
    "read_points",
]
