from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from factloom.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def subscribers(n: int, seed: int = 42) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "tenure": rng.integers(1, 72, n),
            "MonthlyCharges": rng.uniform(20, 110, n).round(2),
            "Contract": rng.choice(["Month-to-month", "One year", "Two year"], n),
            "Churn": rng.choice(["Yes", "No"], n, p=[0.4, 0.6]),
        }
    )


@pytest.fixture(scope="session")
def small_normal(spark):
    return spark.createDataFrame(subscribers(60))


@pytest.fixture(scope="session")
def nulls_and_duplicates(spark):
    rows = [(1, 29.85, "Month-to-month", "No"), (None, 56.95, "One year", "No"), (2, None, "Month-to-month", "Yes"),
            (45, 42.30, None, "No"), (2, 70.70, "Month-to-month", "Yes")] * 10
    return spark.createDataFrame(rows, "tenure int, MonthlyCharges double, Contract string, Churn string")
