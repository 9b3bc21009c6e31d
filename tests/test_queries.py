"""Every registered query of the engine against its SQL, and the contract of the entry module."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from barwright import queries as engine

from oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, duck, name):
    made = engine.queries()[name](spark, SF).toPandas()
    assert len(made)
    if name in engine.oracle_sql():
        assert differences(made, duck.execute(engine.oracle_sql()[name]).fetchdf()) == []


def test_entry_has_all_queries(spark):
    assert set(engine.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "a module that lacks a library"])
def test_engine_needs_no_training_data_operators(tmp_path, left):
    """The entry module works where that subpackage and the pipeline are gone, or cannot be imported."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/barwright", tmp_path / "barwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    if left != "nothing":
        (tmp_path / "barwright/llm").mkdir()
    if left == "a module that lacks a library":
        (tmp_path / "barwright/llm/__init__.py").write_text("import a_library_that_is_not_there\n")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def compared(spark, folder, name, prices):
    """Rows of the query and their differences from its SQL, on ticks (four-hour bar, price) of one series in this order."""
    n = range(len(prices))
    ts = [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=4 * bar, seconds=i) for i, (bar, _) in zip(n, prices)]
    events = pd.DataFrame({"event_id": n, "ts": pd.Series(ts).astype("datetime64[us]"), "user_id": n, "event_type": "a", "value": [p for _, p in prices], "props": "{}"})
    events.to_parquet(folder / "events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    made = engine.queries()[name](spark, str(folder)).toPandas()
    return made, differences(made, duck.execute(engine.oracle_sql()[name]).fetchdf())


#: From 0.02 up 20 boxes of 8, then down by exactly one: added box by box, the level is too low for the last.
EXACT_TURN = [(0, 161.02), (0, 0.02), (1, 152.02)]


def test_renko_geometry_of_a_turn_by_exactly_one_box(spark, tmp_path):
    made, different = compared(spark, tmp_path, "renko_geometry", EXACT_TURN)
    assert different == [] and len(made) == 21


def test_renko_geometry_takes_prices_as_the_bricks_show_them(spark, tmp_path):
    """The bounds are 503 boxes apart, and the chart 503 pixels high: each brick's y lies on the edge of a pixel."""
    made, different = compared(spark, tmp_path, "renko_geometry", [(0, 4017.01), (0, 0.01), (1, 1.01)])
    assert different == [] and len(made) == 1003


def test_renko_table_function_of_a_turn_by_exactly_one_box(spark, tmp_path):
    made, different = compared(spark, tmp_path, "renko_table_function", EXACT_TURN)
    assert different == []
    assert made.sort_values("brick")[["price", "direction", "row"]].to_numpy().tolist()[-2:] == [[160.02, 1, 0], [152.02, -1, 1]]
