import pytest


@pytest.fixture(scope="session")
def definition():
    from masthead.llm.queries import tokenizer_path
    from masthead.llm.tokens import read_definition

    return read_definition(tokenizer_path())
