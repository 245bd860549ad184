import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(autouse=True)
def worker_path(spark):
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


DOCS = "doc_id long, text string, lang string, h long, words string, length int"


@pytest.fixture()
def docs(spark):
    """documents-like tables, with extra columns whose names the operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in rows], DOCS)
    return make
