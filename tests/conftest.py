import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session

    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def employees(spark):
    return spark.createDataFrame(
        [(1, "Alice", "IT", 80000), (2, "Bob", "HR", 60000), (3, "Carol", "IT", 75000), (4, "Dan", "Sales", 50000)],
        "id long, name string, department string, salary long")


@pytest.fixture(scope="session")
def ranking(spark):
    rows = []
    for i in range(15):
        rows.append((f"2023-01-{i + 1:02d}", "ABC"[i % 3], ["X", "x", "Y"][i % 3], i + 1, (i + 1) * 10, 500 if i == 14 else 10 + i % 5,
                     None if i % 2 else float(i * i % 7)))
    return spark.createDataFrame(rows, "date string, category string, sub_category string, value_a long, value_b long, outlier_col long, missing_col double")


@pytest.fixture(scope="session")
def gaps(spark):
    rows = [(i, f"n{i}", None if i in (2, 5, 7) else 20.0 + i, None if i in (1, 8) else 1000.0 * i, None if i == 4 else ["IT", "HR"][i % 2]) for i in range(10)]
    return spark.createDataFrame(rows, "id long, name string, age double, salary double, department string")
