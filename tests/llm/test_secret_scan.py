import hashlib
import re

from changelens.llm import secret_scan as ss
from changelens.llm.queries import op4_secret_scan

from .conftest import LONG, ODD

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text, spans = text or "", []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*counts, hashlib.sha256(said.encode()).hexdigest())


TEXTS = [
    None, "", 'password = "hunter22"', "Token:abc token: abcdef", "API_KEY='a.b-c/d+e=' apikey=123456", "ſecret=abcdef toKen=abcdefg",
    "AKIA" + "A1" * 8, "AKIAKIA" + "B" * 13, "AKIA" + "A" * 15, "f" * 23 + " " + "0a" * 12 + "g", "é password : " + "0f" * 20, LONG,
    "secret=password=abcdefg", "token=token=token=abcdef", "deadbeef" * 9 + "AKIA" + "Z" * 30, "passwd=\x20\x20'x' secret=\n'abcdefgh'",
]


def test_base_columns(make):
    rows = ss.secret_scan(make(list(enumerate(TEXTS)))).collect()
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], hashlib.sha256(r["base_spans"].encode()).hexdigest()) for r in rows}
    assert [got[i] for i in range(len(TEXTS))] == [brute(t) for t in TEXTS]


def test_table_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = op4_secret_scan(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(texts) and sum(r["n_assign"] for r in rows) > 100
    assert all((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute(texts[r["doc_id"]]) for r in rows)


def novel(text):
    return [text[f["start"] : f["end"]] for f in ss.scan(text)[5]]


def test_random_strings_are_new_and_words_are_not():
    import random
    import string

    rng = random.Random(4)
    for _ in range(100):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(16, 60)))
        assert novel(f"def connect():\n    auth_key: {key}\n    return 1") == [key]
        assert novel(f"Authorization: Bearer {key}.") == [key]
        assert novel(f"the {key} of it") == []
    for text in ("auth = get_config_value_name", "salt: your_token_here_please", "login is the-first-of-the-second", "private_key = settings.private_key_path"):
        assert novel(text) == []


def test_names_without_separator_long_values_and_short_passwords():
    import random
    import string

    rng = random.Random(8)
    names = "secretAccessKey secretKey privateKey accessKey encryptionKey APIAccessKey secretkey privatekey accesskey encryptionkey"
    for name in names.split():
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
        assert novel(f"{name} = '{key}'") == [key] and novel(f'"{name}": "{key}"') == [key]
        assert novel(f"{name}Of = '{key}'") == []
    for size in (513, 5_000, 100_000):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(size))
        assert novel(f"Authorization: Bearer {key}\nprivate_key: none") == [key]
    assert novel("pwd = 'X9$kQ!2z'") == ["X9$kQ!2z"] and novel("pwd = 'getName2'") == []
    assert novel("monkey = x" + "monkeys are not keys " * 20) == []
    assert len(novel("key=" * 200_000 + key)) <= 1  # in time that grows with the length


def test_base_findings_are_not_reported_twice():
    text = 'token = "9dd3c80004c73dc9e548fee51b23b527780d4f20"'
    assert ss.scan(text)[4] == ss.scan(text)[3] == "assign:0:49,hex:9:49"


def test_long_text_with_many_findings():
    text = "key: 4fB9xQ2LmZt7RkVw8sPj token=abcdefg " * 4_000
    assert ss.scan(text)[0] == 4_000 and len(ss.scan(text)[5]) >= 1


def test_odd_rows(odd, empty):
    assert ss.secret_scan(odd).count() == len(ODD) and ss.secret_scan(empty).count() == 0
