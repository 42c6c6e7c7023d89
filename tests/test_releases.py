"""Changelog grouping rules and release pairs."""

import datetime as dt

from fleetscope.operators import releases
from tests.conftest import rows

REPO = "https://example.invalid/r"


def _commits(spark, items):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"c{i}", base + dt.timedelta(hours=i), m, b, t) for i, (m, b, t) in enumerate(items)],
                                 "sha string, ts timestamp_ntz, message string, body string, tag string")


def test_groups_skips_and_order(spark):
    c = _commits(spark, [
        ("feat(ui): add page (#12)", None, "v1.0.0"),
        ("fix: crash", None, "v1.0.0"),
        ("chore(deps): bump", None, "v1.0.0"),
        ("chore(release): prepare for v1.0.0", None, "v1.0.0"),
        ("chore(release): v0.9 notes", None, "v1.0.0"),
        ("refactor(db)!: drop table", None, "v1.0.0"),
        ("misc: tweak", "fixes a security hole", "v1.0.0"),
        ("not conventional", None, None),
        ("feat: second feature, see PR #7", None, "v1.0.0"),
        ("docs: readme", None, None),
        ("ci: pipeline", None, None),
    ])
    out = releases.changelog(c, REPO, sha="sha", body="body")
    got = rows(out, "release", "group_no", "position", "sha", "breaking", "scope")
    assert got == [("Unreleased", 3, 1, "c9", False, None), ("Unreleased", 7, 1, "c10", False, None),
                   ("v1.0.0", 0, 1, "c0", False, "ui"), ("v1.0.0", 0, 2, "c8", False, None),
                   ("v1.0.0", 1, 1, "c1", False, None), ("v1.0.0", 2, 1, "c5", True, "db"),
                   ("v1.0.0", 7, 1, "c4", False, "release"), ("v1.0.0", 8, 1, "c6", False, None)]
    desc = dict(rows(out, "sha", "description"))
    assert desc["c0"] == f"Add page ([#12]({REPO}/issues/12))"
    assert desc["c8"] == f"Second feature, see [PR #7]({REPO}/pull/7)"


def test_release_pairs_use_all_tags(spark):
    c = _commits(spark, [("feat: a", None, "v1.2.0"), ("chore(deps): x", None, "v1.3.0"), ("feat!: b", None, "v2.0.0")])
    got = rows(releases.release_pairs(c, REPO), "tag", "previous", "compare_url")
    assert got == [("v1.2.0", None, None), ("v1.3.0", "v1.2.0", f"{REPO}/compare/v1.2.0..v1.3.0"),
                   ("v2.0.0", "v1.3.0", f"{REPO}/compare/v1.3.0..v2.0.0")]
