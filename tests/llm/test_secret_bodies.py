"""Whole private keys and long logins go, and the text around them stays."""

import duckdb
import pytest

from brindle.llm import secrets
from brindle.llm.oracles import ORACLE_SQL

BODY = "\n".join(["MIIEpAIBAAKCAQEA" + "Qk9EWQ+/" * 6] * 12)
LONG = "Zz9_" * 40  # no other rule finds it


def key(label, body=BODY, line="\n"):
    return f"-----BEGIN {label}-----{line}{body.replace(chr(10), line)}{line}-----END {label}-----"


#: text, and what is left of it
CASES = [
    *((f"before\n{key(label)}\nafter", "before\n[secret]\nafter") for label in ("PRIVATE KEY", "RSA PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "SOME VERY LONG VENDOR NAME PRIVATE KEY", "X25519 PRIVATE KEY", "PGP PRIVATE KEY BLOCK")),
    (f"größe {key('EC PRIVATE KEY', line=chr(13) + chr(10))} 日本", "größe [secret] 日本"),
    (f"a {key('RSA PRIVATE KEY')} b {key('PGP PRIVATE KEY BLOCK')} c", "a [secret] b [secret] c"),
    (f"cut off\n-----BEGIN RSA PRIVATE KEY-----\n{BODY}\n", "cut off\n[secret]"),
    (key("OPENSSH PRIVATE KEY", BODY * 200), "[secret]"),
    (f"see -----BEGIN CERTIFICATE-----\n{BODY}\n-----END CERTIFICATE----- there", None),
    (f"git clone https://bot:{LONG}@example.org/x y", "git clone [secret]example.org/x y"),
    (f"https://{LONG}:pw@example.org and https://example.org:8080/a", "[secret]example.org and https://example.org:8080/a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").repartition(3)


def test_no_key_body_survives(docs):
    got = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert got == {i: t if left is None else left for i, (t, left) in enumerate(CASES)}


def test_the_twin_finds_the_same_spans(docs):
    _, findings = secrets.update(docs)
    got = {r.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.found) for r in secrets.path_findings(docs, ("doc_id",), findings).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(CASES)])
    assert got == dict(c.sql(ORACLE_SQL["op6_secrets"]).project("doc_id, spans").fetchall())


def test_a_ledger_of_the_former_rules_is_scanned_anew(docs):
    former = tuple(r._replace(version=1) for r in secrets.RULES)
    pairs, _ = secrets.update(docs, rules=former)
    assert {frozenset(r.todo) for r in secrets.unseen(docs, "text", pairs).collect()} == {frozenset({"private_key", "url_login"})}
