import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from seamark.llm.secret_ledger import Rule, RULES, SecretLedger, Scanner, digest_columns, op1_secret_ledger

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    got = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        got += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    got.sort()
    joined = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in got)
    n = Counter(x[3] for x in got)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()


def test_query_against_brute_force(spark, sf, documents):
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in op1_secret_ledger(spark, sf).collect()}
    assert got == {d: brute(t) for d, t in documents}


def test_odd_rows(spark, odd, odd_rows, none):
    rows = digest_columns(SecretLedger(spark).scan(odd, "doc_id", "text")).collect()
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows)
    assert got == Counter((d, *brute(t)) for d, t in odd_rows)
    assert SecretLedger(spark).scan(none, "doc_id", "text").count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([("a", 1, "token=abcdef"), ("b", 1, "nothing"), ("c", 1, "token=abcdef")], "path string, version int, content string")
    second = spark.createDataFrame([("a", 2, "nothing"), ("d", 1, "secret: zzzzzzz")], "path string, version int, content string")
    ledger = SecretLedger(spark)
    assert ledger.unseen(first).count() == 2
    ledger.update(first)
    assert ledger.unseen(first).count() == 0
    assert ledger.unseen(second).count() == 1
    found = {r["path"]: len(r["findings"]) for r in ledger.scan(first.union(second).where("version = 1"), "path").collect()}
    assert found == {"a": 1, "b": 0, "c": 1, "d": 1}
    other = SecretLedger(spark, ledger.path, (*RULES, Rule("n", "nothing", 1)))
    assert other.unseen(first).count() == 2, "a new rule version scans all blobs again"


def test_redact(spark, odd):
    out = SecretLedger(spark).redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    text = out.where("doc_id = 6").first()["text"]
    assert text == "[REDACTED:assign] and [REDACTED:access] [REDACTED:hex]"
    assert out.where("doc_id = 1").first()["text"] is None
    assert out.where("doc_id = 7").select(F.length("text")).first()[0] == odd.where("doc_id = 7").select(F.length("text")).first()[0]


def test_overlapping_spans_and_unicode_letters():
    s = Scanner()
    assert [x[1] for x in s.spans("token=" + "ab" * 12)] == [0, 2]
    assert s.spans("toKen=abcdef") == []  # the Kelvin sign is no ASCII letter


def test_whole_key_blocks_are_redacted(spark):
    body = ["MIIEpAIBAAKCAQEA7bq" + "Zz0+/" * 9, "q" * 64, "Rk9PQkFS" * 8, "c2hvcnQ="]
    lines = "\n".join(body)
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    mark = "[REDACTED:pem]"
    cases = [
        (f"a\n{begin}\n{lines}\n{end}\nb", f"a\n{mark}\nb"),
        (f"a {begin} {' '.join(body)} {end} b", f"a {mark} b"),
        (f'"{begin}{chr(92)}n{(chr(92) + "n").join(body)}{chr(92)}n{end}{chr(92)}n"', f'"{mark}{chr(92)}n"'),
        (f"{begin}\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-256-CBC,00FF\r\n\r\n{lines}\r\n{end}", mark),
        (f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,00FF\n\n{lines}\n\nprose goes on", f"{mark}\n\nprose goes on"),  # no END line
        (f"{begin}\n{lines}", mark),
        (f"{begin}\n{lines}\nprose goes on\n-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\nb", f"{mark}\nprose goes on\n{mark}\nb"),
        (f"{begin}\n{lines}\n{end}\n{begin}\n{lines}\n{end}", f"{mark}\n{mark}"),
        (f"the line {begin} opens a key", f"the line {mark} opens a key"),
    ]
    docs = spark.createDataFrame([(i, t, len(t)) for i, (t, _) in enumerate(cases)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in SecretLedger(spark).redact(docs).collect()}
    assert got == {i: (want, len(want)) for i, (_, want) in enumerate(cases)}
    assert len(Scanner().spans(f"{begin}\n" * 20_000)) == 20_000  # headers alone take no quadratic time
