import pytest

from gridloom.llm.common import ship

#: Names that operators use inside, as extra columns of their input.
CLASHES = ("score", "x", "fp", "spans", "base", "tokens", "label", "ids", "shard", "component", "node", "first", "digest", "cell", "block", "codes", "kept", "term")


@pytest.fixture(autouse=True, scope="session")
def _shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as a documents table with extra columns of clashing names."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in clashes(extra))
        more = ("clash",) * len(clashes(extra))
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *more) for i, t in rows], schema)

    return make


def clashes(extra):
    return CLASHES if extra else ()


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
