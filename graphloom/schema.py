"""Labels and types of the property graph, and the rules of order and naming that every operator follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node labels and relationship types.
LABELS = ["Repository", "Directory", "File", "Class", "Function", "Test", "Commit", "PullRequest", "Issue", "Developer", "Interface", "Enum", "Struct", "Trait", "Module", "Namespace"]
TYPES = ["CONTAINS", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "TESTS", "MODIFIES", "AUTHORED_BY", "RELATED_TO", "CROSS_LANGUAGE", "BELONGS_TO"]
#: Types that traversals may follow, and bounds of requests.
TRAVERSABLE = ("CALLS", "IMPORTS", "EXTENDS", "CROSS_LANGUAGE")
MAX_DEPTH, MAX_PATHS, MAX_NODES, IMPACT_PATHS, MAX_ENTRIES, MAX_FILES = 4, 250, 500, 400, 500, 100


def up(column: str) -> Column:
    """Ascending with nulls last."""
    return F.col(column).asc_nulls_last()


def down(column: str) -> Column:
    """Descending with nulls first."""
    return F.col(column).desc_nulls_first()


def edge_key(src: str = "src", kind: str = "type", dst: str = "dst") -> Column:
    """An edge's identity."""
    return F.concat_ws("|", src, kind, dst)


def search_label() -> Column:
    """The text that a search looks at: the first of these that is not null."""
    return F.coalesce("name", "title", "sha", "username", "message", F.lit(""))


def human_label() -> Column:
    """A node's name for people: the first that is neither null nor empty, then the id."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(some("name"), some("title"), F.nullif(F.element_at(F.split("path", "/"), -1), F.lit("")), some("sha"), some("username"), some("message"), some("id"), F.lit("unknown"))


def check(name: str, value: int, low: int, high: int) -> int:
    """A request's bound, or ValueError."""
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer from {low} to {high}")
    return value
