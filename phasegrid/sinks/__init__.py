"""Writers of the point store and of text exports."""

from phasegrid.sinks.outcomes import read_outcomes, record_outcome
from phasegrid.sinks.points import compact_points, ensure_table, retained, write_lines, write_points

__all__ = ["compact_points", "ensure_table", "read_outcomes", "record_outcome", "retained", "write_lines", "write_points"]
