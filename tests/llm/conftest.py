import pytest

WORDS = "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose: n words of a numbered stream."""

    def made(seed, n):
        out, x = [], seed * 2654435761 % 2**32 or 1
        for _ in range(n):
            x = (x * 1103515245 + 12345) % 2**31
            out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if x % 7 else str(x % 97)))
        return " ".join(out)

    return made


@pytest.fixture
def table(spark, tmp_path):
    """Writes rows as a table of a folder and returns the folder."""

    def made(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return made
