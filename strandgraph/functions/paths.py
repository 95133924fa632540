"""Path predicates and path arithmetic as Column expressions (F10-F12, R12, X14)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path endings of tool-generated files.
GENERATED = [
    r"\.pb\.go$", r"\.pulsar\.go$", r"_grpc\.pb\.go$", r"_mock\.go$", r"_mocks\.go$",
    r"^mock_[^/]+\.go$", r"\.generated\.[jt]sx?$", r"\.gen\.[jt]sx?$", r"\.pb\.[jt]s$",
    r"_pb\.[jt]s$", r"_grpc_pb\.[jt]s$", r"\.min\.m?js$", r"_pb2(_grpc)?\.py$",
    r"_pb2\.pyi$", r"\.pb\.(cc|h)$", r"\.g\.cs$", r"Grpc\.cs$", r"OuterClass\.java$",
    r"Grpc\.java$", r"\.pb\.swift$", r"\.g\.dart$", r"\.freezed\.dart$", r"\.pb\.dart$",
    r"\.pbgrpc\.dart$", r"\.chopper\.dart$", r"\.generated\.rs$",
]
# Lower-cased path patterns of files not worth being a project's centre.
LOW_VALUE = [
    r"(?:^|/)(tests?|__tests?__|spec)/", r"_test\.go$", r"(?:^|/)test_[^/]+\.py$",
    r"_test\.py$", r"_spec\.rb$", r"_test\.rb$", r"\.(test|spec)\.[jt]sx?$",
    r"(test|spec|tests)\.(java|kt|scala)$", r"(tests?|spec)\.cs$", r"tests?\.swift$",
    r"_test\.dart$",
]
# Directories that hold tests or other non-production code.
TEST_DIRS_INSIDE = ["tests", "test", "__tests__", "spec", "specs", "testlib", "testing"]
TEST_DIRS_LEADING = ["test", "tests", "spec", "specs"]
NON_PRODUCTION_DIRS = [
    "integration", "sample", "samples", "example", "examples", "fixture", "fixtures",
    "benchmark", "benchmarks", "demo", "demos",
]
# Default patterns for test files in change-impact runs (leading slash required).
AFFECTED_TEST = [r"\.spec\.", r"\.test\.", r"/__tests__/", r"/tests?/", r"/e2e/", r"/spec/"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(patterns: list[str]) -> str:
    return "|".join(patterns)


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path: Column | str, root: str = "") -> Column:
    path = _col(path)
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(root))


def dir_parts(path: Column | str) -> Column:
    """Directory segments of a path, outermost first (empty for a root-level file)."""
    parts = F.split(_col(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def shared_dirs(a: Column, b: Column) -> Column:
    """Length of the common directory prefix of two paths."""
    same = F.zip_with(dir_parts(a), dir_parts(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def path_proximity(a: Column, b: Column) -> Column:
    return F.least(shared_dirs(a, b) * 15, F.lit(80))


def dir_prefixes(path: Column | str, deepest: int = 6) -> Column:
    """Directory prefixes of a path by level: '' at 0, then one more segment per level."""
    parts = dir_parts(path)
    return F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts), F.lit(deepest))),
        lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, 1, n), "/").alias("prefix")),
    )


def is_generated_file(path: Column | str) -> Column:
    return _col(path).rlike(_any(GENERATED))


def is_low_value_file(path: Column | str) -> Column:
    path = _col(path)
    return F.lower(path).rlike(_any(LOW_VALUE)) | is_generated_file(path)


def is_test_file(path: Column | str) -> Column:
    """Test, example or other non-production file, judged by its path."""
    path = _col(path)
    lower, name = F.lower(path), basename(path)
    lower_name = F.lower(name)
    inside = "/(" + "|".join(TEST_DIRS_INSIDE + NON_PRODUCTION_DIRS) + ")/"
    leading = "^(" + "|".join(TEST_DIRS_LEADING + NON_PRODUCTION_DIRS) + ")/"
    return (
        lower_name.startswith("test_") | lower_name.startswith("test.")
        | lower_name.rlike(r"[._-](test|tests|spec|specs)\.[a-z0-9]+$")
        | name.rlike(r"(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$")
        | lower.rlike(inside) | lower.rlike(leading)
        | path.rlike(r"(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/")
    )


def is_affected_test(path: Column | str, pattern: str | None = None) -> Column:
    """Test predicate of change-impact runs: a custom glob regex or the default patterns."""
    return _col(path).rlike(pattern or _any(AFFECTED_TEST))
