from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import functions as F

from tessera.llm.secrets import GATE, REDACTED, Dictionary, dictionary, find, redact, residual, scan_secrets
from tessera.llm.words import VOCABULARY

W = dictionary(VOCABULARY)
rng = random.Random(3)


def drawn(n: int, letters: str = string.ascii_letters + string.digits) -> str:
    return "".join(rng.choice(letters) for _ in range(n - 3)) + "aZ7"


PASS, KEY, HEX, B64 = "Prairie!Grid1424", drawn(38), drawn(29, "0123456789abcdef").lower() + "0af", drawn(85) + "=="
SECRETS = [
    (f'admin_password = "{PASS}"', PASS),
    (f"export DB_PASSWORD={PASS}", PASS),
    ("  password: nimbus-prairie-kelp-kelp60", "nimbus-prairie-kelp-kelp60"),
    ("passphrase=Maple.Retail9507", "Maple.Retail9507"),
    (f'cs = "Server=tcp:x,1433;User ID=loader;pwd={PASS};Encrypt=yes"', PASS),
    (f'engine = create_engine("postgresql://svc:{PASS}@h.example/db")', PASS),
    (f"curl -u svc:{PASS} https://h.example/x", PASS),
    (f"docker login -u ci -p {PASS} h.example", PASS),
    (f"sshpass -p '{PASS}' scp a b@c:/d", PASS),
    (f"CREATE LOGIN etl WITH PASSWORD = '{PASS}';", PASS),
    (f'ALTER USER loader IDENTIFIED BY "{PASS}"', PASS),
    (f"machine h.example login loader password {PASS}", PASS),
    (f"$sec = ConvertTo-SecureString '{KEY}' -AsPlainText -Force", KEY),
    (f"login('ops', \"{PASS}\")", PASS),
    ("Credential('etl', secret=\"LcJgDRTvzaO$mcRH\")", "LcJgDRTvzaO$mcRH"),
    (f'auth=("ci", """{KEY}""")', KEY),
    (f"aws = (\"AKIA{'A1' * 8}\", \"{drawn(40)}\")", None),
    (f'headers = {{"Authorization": "Bearer {KEY}"}}', KEY),
    (f'req.add_header("Authorization", "Basic {KEY}")', KEY),
    (f'{{"cosmosdb_key": "{B64}", "retries": 1}}', B64),
    (f'azure_key = "{HEX}"', HEX),
    (f"--account-key {HEX}", HEX),
    (f'spark.conf.set("fs.account.key.h.example", "{B64}")', B64),
    (f"Endpoint=sb://b.example/;SharedAccessKeyName=send;SharedAccessKey=/{drawn(42)}=", None),
    (f"notify_url: https://h.example/hook/{drawn(32)}", None),
    (f'src = "https://h.example/x?sv=1&sig={drawn(40)}%3D"', None),
    (f'<add key="LedgerApi" value="{KEY}" />', KEY),
    (f'x = "ghp_{drawn(36)}"', None),
    (f'k = "glpat-{drawn(8)}" + "{drawn(12)}"', None),
    (f'x = "****************{KEY[:24]}"', None),
    (f'password="******{PASS}-and-more1"', None),
    (f'    \\"api_key = \\"{KEY}\\"\\n",', KEY),
    ("-----BEGIN RSA PRIVATE KEY-----\n" + drawn(64) + "\n-----END RSA PRIVATE KEY-----", None),
]
CLEAN = [
    'password = "***"', 'password: [REDACTED]', 'pw="Pra…42"', "db.passwd = <your-key-here>", "export DB_PASSWORD=${API_KEY}", "password={{ vault.secret }}", 'password = os.environ["DB_PASSWORD_25"]',
    "conn = build(host=\"h\", password=getpass.getpass())", "password = config.password", 'if password is None or len(password) < 12: raise ValueError("password too short")', "admin_password = xxxxxxxxxxxxxxxx",
    f'sha256 = "{HEX}{HEX}"', f'commit = "{HEX}{HEX[:8]}"', f'etag: W/"{HEX}"', f"content_hash: {HEX}", 'workspace = "c7235bec-cf92-4a76-a0e3-aab9113668f4"', f'continuation_token = "{KEY}"',
    f'public_key = "ssh-ed25519 AAAAC3Nz{KEY} build"', f"-----BEGIN PUBLIC KEY----- {drawn(60)} -----END PUBLIC KEY-----", f'img = "data:image/png;base64,{B64}"', 'secret_name = "raw-payroll-reader"',
    "max_tokens = 6288; token_count = 1871", 'key = vault.credentials.getSecret("https://h.example", "owner-key")', 'token = dbutils.secrets.get(scope="s", key="api-token")', "SharedAccessKeyName=send", 'schema_uri = "https://h.example/hook/docs/x/1"',
    'df.write.format("delta").mode("append").saveAsTable("dim_fleet_9702")', f"AKIA{'A1' * 8}", 'path = "abfss://zone8223@sql-west.test/audit_runs/Files/bytes_out"', "",
]


@pytest.mark.parametrize("line, value", SECRETS)
def test_secrets_are_found_and_redacted(line, value):
    text = f"# one\n{line}\nx = 1\n"
    found = find(text, W)
    assert [s.line for s in found] == [2]
    clear = redact(text, found)
    assert REDACTED in clear and find(clear, W) == [] and clear.startswith("# one\n") and clear.endswith("\nx = 1\n")
    if value:
        assert clear == text.replace(value, REDACTED)


@pytest.mark.parametrize("line", CLEAN)
def test_clean_lines(line):
    assert find(line, W) == []
    assert redact(line, []) == line


NAMES = [
    'key = "customerAccountManagementServiceName"', "token = customerOrderHistoryLookup", 'api_token = "read-write-export-everything"', 'secret = "raw-payroll-reader"', "password = config.database.password", "password=REPLACE_ME",
    'auth_token: "${SERVICE_ACCOUNT_TOKEN}"', "AZ_APP_SECRET='<your-key-here>'", 'x = "TheQuarterlyBudgetReviewOfEveryDepartment"',
]


class Ablated(Dictionary):
    """A dictionary that explains nothing, or everything."""

    def __init__(self, everything: bool) -> None:
        self.everything = everything

    def explained(self, run: str) -> int:
        return len(run) if self.everything else 0


@pytest.mark.parametrize("line", ["password = decrypt(key2)", "passwd=rows[17]", 'token = store.get_token_v2("x")', "pwd: f(x1)", "sas = dbutils.secrets.get(", "password = getpass.getpass("])
def test_code_that_looks_a_value_up_is_no_literal(line):
    assert find(line, W) == []


@pytest.mark.parametrize("line", NAMES)
def test_words_are_no_secrets(line):
    assert find(line, W) == [] and find(line, Ablated(everything=False))


def test_the_residual_decides():
    """Without the dictionary names and placeholders count as secrets, and where it explains everything drawn values get lost."""
    true, false = [line for line, _ in SECRETS], CLEAN + NAMES
    count = lambda lines, words: sum(bool(find(x, words)) for x in lines)
    assert count(true, W) == len(true) and count(false, W) == 0
    assert count(false, Ablated(everything=False)) >= len(NAMES)
    assert count(true, Ablated(everything=True)) < 0.8 * len(true)


def test_hash_formats_are_left_out():
    for n in (32, 40, 56, 64, 96, 128):
        digits = "".join(rng.choice("0123456789abcdef") for _ in range(n))
        assert find(f'x = "{digits}"', W) == [] and find(f"sha256: {digits}", W) == [] and find(f'checksum = "{digits}"', W) == []
        assert find(f'api_key = "{digits}"', W)


LONG = drawn(2000)


@pytest.mark.parametrize("n", [401, 1000, 5000])
def test_quoted_values_of_any_length(n):
    value = drawn(n)
    assert redact(f'api_token = "{value}"', find(f'api_token = "{value}"', W)) == f'api_token = "{REDACTED}"'


@pytest.mark.parametrize("line", [f'refresh_token = "{LONG}"', f'password="{LONG}"', f'x = "{LONG}"', f'<add key="LedgerApi" value="{LONG}" />', f'engine = create_engine("postgresql://svc:{LONG}@h.example/db")', f'spark.conf.set("fs.account.key.h.example", "{LONG}")'])
def test_long_values_are_found_whole(line):
    found = find(f"# one\n{line}\n", W)
    assert [s.line for s in found] == [2] and redact(f"# one\n{line}\n", found) == f"# one\n{line}\n".replace(LONG, REDACTED)


@pytest.mark.parametrize("line", ["x = '" + "-" * 2000 + "'", f'img = "data:image/png;base64,{LONG}"', f'"data": {{"image/png": "{LONG}"}}', f'x = "{"rawPayrollReader" * 100}"'])
def test_long_values_that_are_no_secrets(line):
    assert find(line, W) == []


#: The shortest case of each form, as the whole text.
SHORTEST = ["://u:Kelp!x@h", "pw=Kelp!x", "identified by 'Kelp!x'", "-p Kelp!x", "tool -p=Kelp!x12", "(-p Kelp!x)", "-u svc:Kelp!x12", "'-u' -u=a:Kelp!x", "login('a','Kelp!x')", f"{'AKIA' + 'A1' * 8}','{KEY}'", "basic Kelp!x", "sig=x", "--x-sig x1", "account.key','v1x'", "/hook/abcdefgh", "/webhooks/abcdefgh", "/services/abcdefgh", "SG.ab", "hf_ab", "content='Kelp!x'"]


def test_the_gate_lets_every_form_pass(spark):
    texts = [line for line, _ in SECRETS] + SHORTEST
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r["text"] for r in df.where(~F.col("text").rlike(GATE)).collect()] == []


@pytest.mark.parametrize("text", ["-u svc:Kelp!x12", "tool -p=Kelp!x12"])
def test_flags_that_begin_a_text_are_scanned(spark, text):
    df = spark.createDataFrame([("t", "1", text)], "table_name string, row_key string, text string")
    assert [(r["line_no"], r["redacted_text"]) for r in scan_secrets(df).collect()] == [(1, text.replace("Kelp!x12", REDACTED))]


def test_the_sign_that_assigns_stays():
    line = f"Server=x;password =Juniper+Research7881;token ={KEY};"
    assert redact(line, find(line, W)) == f"Server=x;password ={REDACTED};token ={REDACTED};"


def test_several_on_one_line_and_windows_ends():
    text = f'a = 1\r\npassword="{PASS}"; token = "{KEY}"\r\n'
    found = find(text, W)
    assert [s.line for s in found] == [2, 2] and redact(text, found) == f'a = 1\r\npassword="{REDACTED}"; token = "{REDACTED}"\r\n'


def brute(d: Dictionary, run: str) -> float:
    """Letters covered by the cheapest segmentation, by trying all."""
    from functools import cache

    @cache
    def best(i: int) -> tuple[float, int]:
        if i == len(run):
            return 0.0, 0
        options = [(best(i + 1)[0] + 5.0, best(i + 1)[1])]
        for j in range(i + 3, len(run) + 1):
            c, w = d.cost.get(run[i:j].lower()), run[i:j]
            if c is not None and (w[1:].islower() or w.isupper()):
                options.append((best(j)[0] + c + (3.0 if j - i == 3 else 0.0), best(j)[1] + j - i))
        return min(options, key=lambda o: o[0])

    return best(0)[1]


@pytest.mark.parametrize("run", ["rawpayrollreader", "SharedAccessKey", "xkqzjwvbn", "passwordHint", "NOTEBOOKcontent", "aFygANjqrNwonCtS"])
def test_viterbi_against_all_segmentations(run):
    assert W.explained(run) == brute(W, run)


def test_residual():
    assert residual("raw-payroll-reader", W) == 0 and residual("os.environ['KEY']", W) == 0 and residual("x-y_1", W) == 1 and residual(KEY, W) > 25


def test_scan_rows(spark):
    long = "x = 1\n" * 20_000 + f'password="{PASS}"\n'
    data = [("t", "1", f'password="{PASS}"', "x"), ("t", "1", f'password="{PASS}"', "x"), ("t", "2", None, None), (None, "3", "", "y"), ("t", "4", long, None), ("t", None, f"token = '{KEY}'", None)]
    df = spark.createDataFrame(data, "table_name string, row_key string, text string, line_no string")
    got = sorted((r["row_key"] or "", r["line_no"]) for r in scan_secrets(df).collect())
    assert got == [("", 1), ("1", 1), ("1", 1), ("4", 20_001)]
    assert scan_secrets(df.limit(0)).count() == 0
    assert all(PASS not in r["redacted_text"] for r in scan_secrets(df).where(F.col("row_key").isNotNull()).collect())
