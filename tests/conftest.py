import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from phasegrid.schema import WIDE_COLUMNS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def readings(spark):
    """Build narrow readings from (device, file, pos, epoch seconds, a, b, c) rows."""

    def build(rows):
        schema = (
            "device string, file string, pos long, s long, a_total_act_energy double, "
            "b_total_act_energy double, c_total_act_energy double"
        )
        return spark.createDataFrame(rows, schema).selectExpr("timestamp_seconds(s) AS timestamp", "* EXCEPT (s)")

    return build


@pytest.fixture
def write_csv():
    """Write wide CSV files; each measure of the row with timestamp t is t + its column number."""

    def write(path, timestamps, columns=WIDE_COLUMNS, change=None):
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = [",".join(columns)]
        for t in timestamps:
            cells = {c: str(t if c == "timestamp" else float(t + WIDE_COLUMNS.index(c))) for c in WIDE_COLUMNS}
            cells.update(change or {})
            lines.append(",".join(cells.get(c, "0") for c in columns))
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    return write
