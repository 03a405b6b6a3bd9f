import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from quillgraph.llm.common import ship

    ship(spark)


@pytest.fixture(scope="session")
def tokenizer_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return lambda name: str(tokenizers.path(name))
