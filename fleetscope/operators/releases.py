"""Release operators: AG17 (changelog groups) and WN7 (release pairs).

Rules, in order, first match wins (conventional commits only):
feat 0, fix 1, doc 3, perf 4, refactor 2, style 5, test 6; skipped:
``chore(release): prepare for``, ``chore(deps...)``, ``chore(pr)``,
``chore(pull)``; ``chore``/``ci`` 7; body mentioning security 8; revert 9;
everything else 10.  Groups are ordered by number, commits oldest first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tag_version, upper_first
from ..plans.ordered import ordered_index, time_chunk

CONVENTIONAL = r"^([A-Za-z]+)(\(([^)]*)\))?(!)?: (.+)$"

# Commit groups (number, label) and the ordered parser rules.
GROUPS = {0: "Features", 1: "Bug Fixes", 2: "Refactor", 3: "Documentation", 4: "Performance", 5: "Styling",
          6: "Testing", 7: "Miscellaneous Tasks", 8: "Security", 9: "Revert", 10: "Other"}
PARSERS = [  # (field, pattern, group or None for skip)
    ("message", r"^feat", 0), ("message", r"^fix", 1), ("message", r"^doc", 3), ("message", r"^perf", 4),
    ("message", r"^refactor", 2), ("message", r"^style", 5), ("message", r"^test", 6),
    ("message", r"^chore\(release\): prepare for", None), ("message", r"^chore\(deps.*\)", None),
    ("message", r"^chore\(pr\)", None), ("message", r"^chore\(pull\)", None),
    ("message", r"^chore|^ci", 7), ("body", r".*security", 8), ("message", r"^revert", 9),
    ("message", r".*", 10),
]
ISSUE_LINK = (r"\((\w+\s)?#([0-9]+)\)", "([#$2]({repo}/issues/$2))")
PR_LINK = (r"PR #([0-9]+)", "[PR #$1]({repo}/pull/$1)")


_PLAIN = re.compile(r"^\^[A-Za-z]+$")


def _matches(col, pattern: str):
    """``col rlike pattern``; a bare ``^word`` (or ``^a|^b``) is the same test as a prefix check, which is cheaper."""
    alts = pattern.split("|")
    if all(_PLAIN.match(a) for a in alts):
        out = None
        for a in alts:
            t = col.startswith(a[1:])
            out = t if out is None else out | t
        return out
    if pattern == ".*":
        return F.lit(True)
    return col.rlike(pattern)


def changelog(commits: DataFrame, repo_url: str, sha: str = "event_id", ts: str = "ts", message: str = "message",
              body: str | None = None, tag: str = "tag") -> DataFrame:
    """AG17: one row per kept commit with its release, group and position.

    Positions are numbered per (release, group) along time with chunk
    offsets, so a release holding most commits is not one task.
    """
    header = F.split(F.col(message), "\n").getItem(0)
    b = F.coalesce(F.col(body), F.lit("")) if body else F.lit("")
    c = commits.select(sha, ts, tag, header.alias("_h"), b.alias("_b")).filter(F.col("_h").rlike(CONVENTIONAL))
    grp = F.lit(-1)
    for field, pat, g in reversed(PARSERS):
        src = F.col("_h") if field == "message" else F.col("_b")
        grp = F.when(_matches(src, pat), F.lit(-1 if g is None else g)).otherwise(grp)
    c = c.withColumn("group_no", grp).filter(F.col("group_no") >= 0)
    desc = F.regexp_extract("_h", CONVENTIONAL, 5)
    for pat, rep in (ISSUE_LINK, PR_LINK):
        desc = F.regexp_replace(desc, pat, rep.format(repo=repo_url))
    labels = F.create_map(*[x for k, v in GROUPS.items() for x in (F.lit(k), F.lit(v))])
    out = c.select(
        sha, ts, F.coalesce(F.col(tag), F.lit("Unreleased")).alias("release"), tag_version(tag).alias("version"),
        "group_no", F.element_at(labels, F.col("group_no")).alias("group_name"),
        F.nullif(F.regexp_extract("_h", CONVENTIONAL, 3), F.lit("")).alias("scope"),
        ((F.regexp_extract("_h", CONVENTIONAL, 4) == "!") | F.col("_b").contains("BREAKING CHANGE")).alias("breaking"),
        upper_first(desc).alias("description"))
    return ordered_index(out, ["release", "group_no"], [F.col(ts), F.col(sha)], "position",
                         chunk=time_chunk(ts, 86400))


def release_pairs(commits: DataFrame, repo_url: str, ts: str = "ts", tag: str = "tag") -> DataFrame:
    """WN7: each tag with the previous tag over *all* tags and a compare link.

    Tags are reduced to one row each first; the ordering window then runs over
    the (small) set of tags, not over commits.
    """
    tags = commits.filter(F.col(tag).isNotNull()).groupBy(tag).agg(F.max(ts).alias("tag_ts"))
    prev = F.lag(tag).over(Window.orderBy("tag_ts", tag))
    return tags.select(tag, tag_version(tag).alias("version"), "tag_ts", prev.alias("previous"),
                       F.when(prev.isNotNull(), F.concat(F.lit(repo_url + "/compare/"), prev, F.lit(".."),
                                                         F.col(tag))).alias("compare_url"))
