"""Secret scanning golden cases and configuration parsing."""

from fleetscope.operators import config, secrets
from tests.conftest import rows

DUMMY = "sk-lf-" + "12345678" + "-1234-1234-1234-" + "123456789012"


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_golden_cases(spark):
    docs = _docs(spark, [DUMMY, "DATABASE_URL=op://Vault/PostgreSQL/connection-string"])
    got = rows(secrets.scan_secrets(docs), "doc_id", "line_no", "rule", "severity", "offset")
    assert got == [(0, 1, "secret_key", "Critical", 1)]


def test_match_text_is_never_kept(spark):
    docs = _docs(spark, [f"line one\nkey = {DUMMY} and more"])
    out = secrets.scan_secrets(docs)
    assert "m" not in out.columns and "line" not in out.columns
    r = out.collect()[0]
    assert (r.line_no, r.offset) == (2, 7) and len(r.match_hash) == 64


def test_rules_and_allow_list(spark):
    bracket_var = "$" + "{REDIS_PASSWORD}"
    texts = [
        "CLICKHOUSE_PASSWORD=s3cr3t",
        "APP_S3_EVENT_UPLOAD_SECRET_ACCESS_KEY=abcdef",
        "MINIO_ROOT_SECRET: zzz",
        "REDIS_AUTH=CHANGE_ME",
        f"REDIS_PASSWORD={bracket_var}",
        "ENCRYPTION_KEY=PLACEHOLDER_KEY",
        "SALT=my-test-salt",
        "NEXTAUTH_SECRET=realvalue",
        "DATABASE_URL=postgresql://user:hunter2@db:5432/app",
        "-----BEGIN OPENSSH PRIVATE KEY-----",
        "pk-lf-aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee",
        "nothing to see here",
    ]
    got = rows(secrets.scan_secrets(_docs(spark, texts), keep_allowed=True), "doc_id", "rule", "allowed")
    assert got == [(0, "clickhouse_password", False), (1, "object_store_secret", False),
                   (2, "object_store_secret", False), (3, "redis_auth", True), (4, "redis_auth", True),
                   (5, "encryption_key", True), (6, "encryption_key", True), (7, "encryption_key", False),
                   (8, "db_url_password", False), (9, "private_key", False), (10, "public_key", False)]


def test_whole_text_is_scanned(spark):
    long_text = ("filler words " * 20000) + "\n" * 5000 + DUMMY
    got = secrets.scan_secrets(_docs(spark, [long_text])).collect()
    assert [(r.line_no, r.rule) for r in got] == [(5001, "secret_key")]


def test_config_parsing_and_filters(spark):
    lines = ['BACKUP_RETENTION_DAYS=7      # Daily backups kept for 7 days', '# Primary backup location',
             'PRIMARY_BACKUP_DIR="${HOME}/Backups"', "NAME='x y'", "DB_PASSWORD=op://vault/db/password",
             "# OLD_SECRET=abc", "export API_KEY=abc"]
    df = spark.createDataFrame([("f.env", i + 1, s) for i, s in enumerate(lines)], "file string, line_no long, line string")
    got = rows(config.parse_config_lines(df), "line_no", "key", "value", "is_comment")
    assert got[0] == (1, "BACKUP_RETENTION_DAYS", "7", False)
    assert got[1] == (2, None, None, True)
    assert got[2] == (3, "PRIMARY_BACKUP_DIR", "${HOME}/Backups", False)
    assert got[3] == (4, "NAME", "x y", False)
    assert got[5] == (6, "OLD_SECRET", "abc", True)
    assert got[6] == (7, "API_KEY", "abc", False)
    assert rows(config.sensitive_keys(df), "line_no") == [(5,), (7,)]
    assert rows(config.unresolved_refs(df), "line_no", "rn") == [(5, 1)]


def test_repeated_secret_has_two_offsets_and_open_reference_is_a_finding(spark):
    lines = spark.createDataFrame([(1, 1, "REDIS_AUTH=abc x REDIS_AUTH=abc"), (2, 1, "REDIS_AUTH=${X}realsecret"), (3, 1, "REDIS_AUTH=${X}")],
                                  "doc_id long, line_no long, line string")
    got = secrets.scan_lines(lines, ["doc_id"])
    assert rows(got, "doc_id", "offset") == [(1, 1), (1, 18), (2, 1)]
    keyed = secrets.scan_lines(lines, ["doc_id"], key="k")
    assert {r.match_hash for r in got.collect()}.isdisjoint({r.match_hash for r in keyed.collect()})
