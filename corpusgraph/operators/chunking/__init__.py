"""Structure-aware chunkers and their registry."""

from corpusgraph.operators.chunking import code, config, log, markup, office, plain, sql  # noqa: F401  they register themselves
from corpusgraph.operators.chunking.base import REGISTRY, Chunk, Options, Part, Registry, Source, chunker  # noqa: F401
