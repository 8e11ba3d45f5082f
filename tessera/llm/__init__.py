"""Operations of a training-data pipeline over ``documents`` and ``embeddings``.

Self-contained: nothing outside this subpackage imports it, and it imports nothing
from the rest of the library.
"""
