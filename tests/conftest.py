import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8)
    yield session
    session.stop()


@pytest.fixture
def db(spark, tmp_path):
    name = f"db_{abs(hash(str(tmp_path))):x}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/catalog'")
    return name


@pytest.fixture
def lines(tmp_path):
    """Write raw text, gzip where the name says so, and return the folder."""
    import gzip

    def write(folder: str, name: str, *text: str) -> str:
        target = tmp_path / folder
        target.mkdir(exist_ok=True)
        data = "".join(f"{line}\n" for line in text).encode()
        (target / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        return str(target)

    return write
