"""Path functions: canonical form, globs, prefixes, depth."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """One spelling per path: forward slashes, no empty, ``.`` or ``..`` segments.

    Letter case is kept. ``..`` at the root is dropped. Null stays null. Paths
    already in canonical form skip the segment fold.
    """
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    odd = path.contains("\\") | slashed.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(odd, F.array_join(folded, "/")).otherwise(path)


#: What each wildcard of a path glob matches, longest first.
WILDCARDS = {"**/": "(?:.+/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
_PIECES = re.compile("(" + "|".join(map(re.escape, WILDCARDS)) + ")")


def glob_to_regex(pattern: str) -> str:
    """Anchored regex of a path glob: the pattern is split at its wildcards, the text between them is literal.

    ``**/`` spans zero or more whole segments, ``**`` anything, ``*`` and ``?``
    stay inside a segment.
    """
    pieces = _PIECES.split(pattern)
    return "^" + "".join(WILDCARDS[p] if i % 2 else re.escape(p) for i, p in enumerate(pieces)) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_to_regex(pattern))


def depth_below(path: Column, directory: str) -> Column:
    """Number of segments between ``directory`` and the file name."""
    below = F.substring(path, F.lit(len(directory) + 1), F.length(path)) if directory else path
    return F.size(F.split(F.ltrim(below, F.lit("/")) if directory else below, "/")) - 1


def should_watch(path: Column, root: str, extensions: list[str], excludes: list[str] = (), state_dir: str = ".state") -> Column:
    """Whether a changed path is worth indexing: below ``root``, not in the state folder, of a known extension, and not excluded by a glob."""
    inside = path.startswith(root.rstrip("/") + "/")
    below = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
    known = F.lower(F.substring_index(path, ".", -1)).isin(*extensions) & path.contains(".")
    out = inside & known & ~below.startswith(state_dir + "/")
    for glob in excludes:
        out = out & ~glob_match(below, glob)
    return F.coalesce(out, F.lit(False))
