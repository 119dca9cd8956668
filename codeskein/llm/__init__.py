"""Operations of a training-data pipeline over source code and pages."""

from codeskein.llm import (
    bin_queries,
    chunk_queries,
    function_queries,
    mixture_queries,
    provenance_queries,
    spam_queries,
    syntax_queries,
    term_queries,
)

MODULES = [provenance_queries, syntax_queries, function_queries, chunk_queries, term_queries, bin_queries, mixture_queries, spam_queries]
