"""The domain queries load where a library of the training-data operators is missing."""

import pytest

from tests.test_sources import child


@pytest.mark.parametrize("library", ["ahocorasick", "xxhash", "regex", "sentencepiece", "public_tokenizers"])
def test_domain_queries_load_without_an_optional_library(tmp_path, library):
    done = child(f"import sys\nsys.modules[{library!r}] = None\nimport __spark_entry__ as e\n"
                 "print('names', len(e.queries()), 'pipeline' in e.queries(), 'surge_summary' in e.queries(), len(e.oracle_sql()) > 60)\n", tmp_path)
    assert "False True True" in done.stdout and library in done.stderr, done.stderr[-2000:]
