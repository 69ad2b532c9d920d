"""File, directory and staleness predicates as Columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import paths as P


@dataclass(frozen=True)
class PathConfig:
    """What of a remembered root is processed."""

    skip_extensions: list[str] = field(default_factory=list)
    skip_directories: list[str] = field(default_factory=list)
    skip_files: list[str] = field(default_factory=list)
    skip_hidden: bool = True
    include_extensions: list[str] = field(default_factory=list)
    include_directories: list[str] = field(default_factory=list)
    include_files: list[str] = field(default_factory=list)
    use_vision: bool | None = None


def patched(config: PathConfig, set_: dict | None = None, add: dict | None = None) -> PathConfig:
    """Values that are set replace those there; added ones join them, in order, compared without case."""
    out = replace(config, **(set_ or {}))
    for name, more in (add or {}).items():
        if name in (set_ or {}):
            continue
        values, seen = list(getattr(out, name)), {v.lower() for v in getattr(out, name)}
        for v in more:
            if v.lower() not in seen:
                seen.add(v.lower())
                values.append(v)
        out = replace(out, **{name: values})
    return out


def file_passes(path: Column, c: PathConfig) -> Column:
    """Included files pass; then skipped ones don't; then, if anything is to be included, nothing else does."""
    name, ext = P.base(path), P.extension(path)
    exts = lambda xs: ext.isin([P.normal_extension(x) for x in xs]) if xs else F.lit(False)
    globs = lambda xs: P.any_of([P.glob(x, name) for x in xs])
    included = exts(c.include_extensions) | globs(c.include_files)
    skipped = exts(c.skip_extensions) | globs(c.skip_files) | (name.startswith(".") if c.skip_hidden else F.lit(False))
    return included | (~skipped & F.lit(not (c.include_extensions or c.include_files)))


def directory_passes(name: Column, c: PathConfig) -> Column:
    globs = lambda xs: P.any_of([P.glob(x, name) for x in xs])
    skipped = globs(c.skip_directories) | (name.startswith(".") if c.skip_hidden else F.lit(False))
    return globs(c.include_directories) | ~skipped


def path_passes(path: Column, root: str, c: PathConfig) -> Column:
    """A file under root of which every directory below the root passes, the root itself being exempt."""
    r = P.clean(root)
    inner = F.substr(path, F.lit(len(r) + (1 if r == "/" else 2)))
    dirs = F.slice(F.split(inner, "/"), F.lit(1), F.greatest(F.size(F.split(inner, "/")) - 1, F.lit(0)))
    return P.under(path, root) & F.forall(dirs, lambda d: directory_passes(d, c)) & file_passes(path, c)


def score_at_least(score: Column, least: float | str) -> Column:
    least = float(least)
    if not 0 <= least <= 1:
        raise ValueError("min_score lies between 0 and 1")
    return score >= least


def needs_metadata(state: DataFrame) -> DataFrame:
    return state.where("metadata_analyzed_at is null").orderBy("path")


def needs_semantic(state: DataFrame, most_retries: int = 3) -> DataFrame:
    return state.where("metadata_analyzed_at is not null and semantic_analyzed_at is null").where(F.coalesce("semantic_retry_count", F.lit(0)) < most_retries).orderBy("path")


def needs_embeddings(state: DataFrame, most_retries: int = 3) -> DataFrame:
    return state.where("semantic_analyzed_at is not null and embeddings_analyzed_at is null").where(F.coalesce("embeddings_retry_count", F.lit(0)) < most_retries).orderBy("path")


def is_stale(size: Column, mtime: Column, known_size: Column, known_mtime: Column) -> Column:
    return ~(size.eqNullSafe(known_size) & mtime.eqNullSafe(known_mtime))


def needs_analysis(analyzed_at: Column, version: Column, current: str) -> Column:
    return analyzed_at.isNull() | ~version.eqNullSafe(F.lit(current))


def changed(files: DataFrame, state: DataFrame, semantic: bool = True) -> DataFrame:
    """The files that are new, differ in size or time, or were never analysed though analysis is on.

    One left join on path; contents aren't compared. state needs path, size, mod_time and
    semantic_analyzed_at.
    """
    known = state.select(F.col("path"), F.col("size").alias("__s"), F.col("mod_time").alias("__m"), F.col("semantic_analyzed_at").alias("__a"), F.lit(True).alias("__known"))
    same = F.col("__known") & F.col("size").eqNullSafe(F.col("__s")) & F.col("mod_time").eqNullSafe(F.col("__m"))
    never = F.col("__a").isNull() if semantic else F.lit(False)
    return files.join(known, "path", "left").where(F.col("__known").isNull() | ~same | never).drop("__s", "__m", "__a", "__known")
