"""Names and keys derived from paths and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SESSION_LOG = "session_log"
API = "api"
ORG_REPORT = "org_report"

# Separates the parts of a key; it cannot occur in ordinary text.
UNIT_SEPARATOR = "\x1f"


def project_label(directory: Column) -> Column:
    """The last non-empty dash-separated word of a directory name."""
    words = F.filter(F.split(directory, "-"), lambda word: word != "")
    return F.coalesce(F.get(words, F.size(words) - 1), directory)


def parent_directory(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-2))


def session_label(path: Column) -> Column:
    """The file name without its ending."""
    name = F.split_part(path, F.lit("/"), F.lit(-1))
    return F.regexp_replace(name, r"\.jsonl$", "")


def event_uid(*parts: Column) -> Column:
    """A stable SHA-256 key over ``parts``; null parts are left out."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *parts), 256)
