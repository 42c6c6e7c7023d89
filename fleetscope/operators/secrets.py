"""Secret scanning: SC1, SC2, ST3, AG12.

Every rule is evaluated in one projection over the lines of a document
(``posexplode(split(text))``); a rules cross join would multiply every line
by the number of rules.  Patterns use only features shared by Java regex
and RE2 (no lookaround, no backreferences).  A finding keeps a SHA-256 of
the match and its offset, never the matched text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The monitored secret patterns (rule, pattern, severity, value pattern).
# The value pattern's group 1 is the part checked against the allow list; None means the whole match.
SECRET_RULES = [
    ("public_key", r"pk-lf-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "High", None),
    ("secret_key", r"sk-lf-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "Critical", None),
    ("db_url_password", r"postgres(ql)?://[^:@/\s]+:[^@\s]+@", "Critical", r"://[^:@/\s]+:([^@\s]+)@"),
    ("clickhouse_password", r"CLICKHOUSE_PASSWORD\s*[=:]\s*\S+", "Critical", r"[=:]\s*(\S+)"),
    ("object_store_secret", r"[A-Z0-9_]*(MINIO|S3)_[A-Z0-9_]*SECRET[A-Z0-9_]*\s*[=:]\s*\S+", "Critical", r"[=:]\s*(\S+)"),
    ("redis_auth", r"REDIS_(AUTH|PASSWORD)\s*[=:]\s*\S+", "High", r"[=:]\s*(\S+)"),
    ("encryption_key", r"(ENCRYPTION_KEY|SALT|NEXTAUTH_SECRET)\s*[=:]\s*\S+", "Critical", r"[=:]\s*(\S+)"),
    ("private_key", r"-----BEGIN (RSA |DSA |EC |OPENSSH )?PRIVATE KEY-----", "Critical", None),
]

# Allowed forms of a value (vault reference, ${VAR}, placeholders, test credentials).
# An optional leading quote is written [\x22\x27] so the same text works in Java regex, RE2 and SQL.
ALLOW_PATTERNS = [r"^[\x22\x27]?op://", r"^[\x22\x27]?\$\{[A-Za-z_][A-Za-z0-9_]*\}[\x22\x27]?$", r"your-password-here",
                  r"^[\x22\x27]?PLACEHOLDER_", r"CHANGE_ME", r"-test-"]


# Literal text every match of a rule must contain (any one of them).
# A plain substring test is far cheaper than a regex, so lines and whole
# documents without any of these skip the regexes entirely.  None of them
# contains a line break, so a document-level test is exact.
RULE_NEEDLES = {
    "public_key": ("pk-lf-",), "secret_key": ("sk-lf-",), "db_url_password": ("postgres",),
    "clickhouse_password": ("CLICKHOUSE_PASSWORD",), "object_store_secret": ("SECRET",),
    "redis_auth": ("REDIS_AUTH", "REDIS_PASSWORD"), "encryption_key": ("ENCRYPTION_KEY", "SALT", "NEXTAUTH_SECRET"),
    "private_key": ("PRIVATE KEY-----",),
}


def _sql_str(x: str) -> str:
    """A Spark SQL raw string literal (patterns and needles never contain a quote)."""
    assert "'" not in x
    return f"r'{x}'"


def _needle_sql(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sql_str(n)})" for n in needles) + ")"


def _all_needles(rules):
    return sorted({n for r, *_ in rules for n in RULE_NEEDLES.get(r, ("",))})


def _has_needle(col: str, rules=SECRET_RULES) -> F.Column:
    return F.expr(_needle_sql(f"`{col}`", _all_needles(rules)))


def allowed(value: F.Column | str) -> F.Column:
    """SC2: true when the captured value is an allowed, non-secret form."""
    v = value if isinstance(value, str) else None
    if v is None:
        return reduce(lambda a, b: a | b, [value.rlike(p) for p in ALLOW_PATTERNS])
    return F.expr("(" + " OR ".join(f"`{v}` RLIKE {_sql_str(p)}" for p in ALLOW_PATTERNS) + ")")


def scan_lines(lines: DataFrame, id_cols: Sequence[str], line: str = "line", line_no: str = "line_no",
               rules=SECRET_RULES, keep_allowed: bool = False, key: str = "") -> DataFrame:
    """SC1 on a table that already has one row per line.

    ``key`` is put before each match when it is hashed: without one, a short
    secret could be guessed from its hash.

    The rule projection is one SQL expression (a single parse), not a tree
    of client-side column calls.
    """
    cand = lines.filter(_has_needle(line, rules))  # cheap pre-filter: most lines hold no secret
    ln = f"`{line}`"
    arms = []
    for r, p, sev, vp in rules:
        cond = f"{_needle_sql(ln, RULE_NEEDLES.get(r, ('',)))} AND {ln} RLIKE {_sql_str(p)}"
        vps = _sql_str(vp) if vp else "CAST(NULL AS STRING)"
        arms.append(f"CASE WHEN {cond} THEN named_struct('rule', '{r}', 'severity', '{sev}', 'value_pattern', {vps}, "
                    f"'matches', regexp_extract_all({ln}, {_sql_str(p)}, 0)) END")
    hits = F.expr(f"filter(array({', '.join(arms)}), x -> x IS NOT NULL)")
    per_rule = cand.select(*id_cols, line_no, line, F.explode(hits).alias("h"))
    # Matches are in order and do not overlap: each is found from the end of the one before.
    located = F.expr(f"""aggregate(h.matches, named_struct('next', 1, 'out', cast(array() as array<struct<m:string,pos:int>>)),
        (a, m) -> named_struct('next', locate(m, {ln}, a.next) + length(m),
                               'out', concat(a.out, array(named_struct('m', m, 'pos', locate(m, {ln}, a.next))))), a -> a.out)""")
    found = per_rule.select(*id_cols, line_no, line, "h.rule", "h.severity", "h.value_pattern",
                            F.explode(located).alias("at"))
    found = found.select(*id_cols, line_no, line, "rule", "severity", "value_pattern", "at.m", "at.pos")
    # The part checked against the allow list: group 1 of the rule's value pattern, else the whole match.
    # Findings are rare, so a per-row pattern here costs little and keeps the plan small.
    value = F.expr("CASE WHEN value_pattern IS NULL THEN m ELSE regexp_extract(m, value_pattern, 1) END")
    valued = found.select(*id_cols, line_no, "rule", "severity", "m", "pos", value.alias("v"))
    out = valued.select(*id_cols, F.col(line_no).cast("bigint").alias(line_no), "rule", "severity",
                        F.col("pos").cast("bigint").alias("offset"),
                        F.sha2(F.concat(F.lit(key), F.col("m")), 256).alias("match_hash"),
                        allowed("v").alias("allowed"))
    return out if keep_allowed else out.filter(~F.col("allowed")).drop("allowed")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=SECRET_RULES,
                 keep_allowed: bool = False, key: str = "") -> DataFrame:
    """SC1 + SC2: one row per finding: doc, line, rule, severity, offset, hash of the match.

    Whole texts are split into lines inside each task; nothing is truncated.
    """
    docs = docs.filter(_has_needle(text, rules))  # whole documents without a needle are skipped
    lines = docs.select(doc_id, F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "line")).select(
        doc_id, (F.col("_pos") + 1).alias("line_no"), "line")
    return scan_lines(lines, [doc_id], rules=rules, keep_allowed=keep_allowed, key=key)


def audit_union(**scopes: DataFrame) -> DataFrame:
    """ST3: findings of several scan scopes in one table with a ``scope`` column.

    Each input is a findings table whose id column is ``source_id`` (string).
    """
    parts = [df.select(F.lit(name).alias("scope"), "*") for name, df in scopes.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def findings_summary(findings: DataFrame, keys: Sequence[str] = ("scope", "rule", "severity"),
                     source: str = "source_id") -> DataFrame:
    """AG12: findings and distinct sources per rule, severity and scope."""
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_findings"),
                                       F.countDistinct(source).alias("n_sources"))
