"""Credentials in source text: where they begin, and the text without them.

Literals in an assignment's place (names, headers, flags, addresses, calls, issuers' forms, plain assignments) are
candidates.  A candidate's letters are segmented into dictionary words by
Viterbi; what no word explains is its residual, and a residual that is long for its place makes it a secret: a few
characters in a password's own place, where people combine words, many in a credential's, more elsewhere.
Formats that are long by nature and no secrets are left out: hashes, GUIDs, key ids, addresses, and what is named a
paging token, a public key, an id or a medium.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import VOCABULARY
from tessera.session import table

#: What stands in place of a secret.
REDACTED = "[REDACTED]"
#: Readable characters in a row from which a masked value still counts.
READABLE = 20

# ---------------------------------------------------------------- dictionary


class Dictionary:
    """Words with costs from a public vocabulary: its whole words, a frequent one costing less."""

    #: Cost of a letter that belongs to no word, and what a word of three letters within a run costs beyond its rank.
    UNKNOWN, SHORT = 5.0, 3.0

    def __init__(self, path: str) -> None:
        self.cost: dict[str, float] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                word = base64.b64decode(token).decode("utf-8", "replace")
                if word[:1] == " " and len(word) >= 3 and word[1:].isalpha() and word.isascii():
                    self.cost.setdefault(word[1:].lower(), math.log(int(rank) + 2))
        self.longest = max(map(len, self.cost), default=0)

    def explained(self, run: str) -> int:
        """Letters of a run that the cheapest segmentation covers with words.

        A word is lower case, capitalised or upper case and has three letters at least; shorter ones count only as
        the whole run, and a single letter stands for itself.
        """
        low, n = run.lower(), len(run)
        if n == 1 or n <= 3 and low in self.cost:
            return n
        best, used = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best[end], used[end] = best[end - 1] + self.UNKNOWN, used[end - 1]
            for start in range(max(0, end - self.longest), end - 2):
                c = self.cost.get(low[start:end])
                if c is None:
                    continue
                c += best[start] + (self.SHORT if end - start == 3 else 0.0)
                if c < best[end]:
                    word = run[start:end]
                    if word[1:].islower() or word.isupper():
                        best[end], used[end] = c, used[start] + end - start
        return used[n]


_LETTERS = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=4)
def dictionary(path: str) -> Dictionary:
    return Dictionary(path)


def residual(value: str, words: Dictionary) -> int:
    """Letters and digits that no dictionary word explains."""
    solid = sum(c.isalnum() for c in value)
    return solid - sum(words.explained(m.group()) for m in _LETTERS.finditer(value))


# ---------------------------------------------------------------- candidates

_Q = r"""\\{0,3}(?:\"\"\"|'''|["'`])"""
_BARE = r"""[^\s"'`\\;,<>)\]}|]+"""
_IN = r"""[^\s"'`\\]{3,}?"""
_MASK = re.compile(r"\*{3,}|…|\.{3,}|\[REDACTED\]|<redacted>|[xX]{8,}|•{3,}|#{4,}")
#: A call or an index: code that looks a value up, no literal.
_LOOKUP = re.compile(r"[A-Za-z_][\w.]*[(\[]")
_GUID = re.compile(r"^[{(]?[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}[)}]?$")
#: Lengths in hex digits of the usual hashes (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
_HASHES = {32, 40, 56, 64, 96, 128}
_HEX = re.compile(r"^[0-9A-Fa-f]+$")
_KEY_ID = re.compile(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$")
_HASH_KEY = re.compile(r"(?i)(?:\bsha[-_]?\d*|md5|hash|etag|\bcommit|digest|checksum|revision|fingerprint|integrity|\bcrc\d*)(?:[_-]\w+)?\W{0,6}(?:W/)?\W{0,4}$")
#: What a random value is named that opens nothing.
_OTHER_KEY = re.compile(
    r"(?i)(?:continuation|paging|page|next|cursor|skip|sync|public|pub|csrf)[_-]?(?:token|key|marker|link)\W{0,8}$"
    r"|(?:guid|uuid|[_-]id|\bid|version)\W{0,8}$"
    r"|base64,$|ssh-[\w-]+ $|PUBLIC KEY-----\s*$"
    r"|(?:image|audio|video|font)/[\w.+-]+\W{1,8}$|application/pdf\W{1,8}$"
)
_ADDRESS = ("http:", "https:", "data:", "abfss:")
#: Issuers' own forms of tokens.
_ISSUED = r"(?:sk-(?:proj-|ant-)?|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|xapp-|dapi|AIza|ya29\.|shp(?:at|ss)_|npm_|pypi-|hf_|SG\.|rk_live_|sk_live_|eyJ)"

PASSWORD, CREDENTIAL, PLAIN = 3, 2, 1
#: Unexplained characters from which a literal in each place is a secret.
NEEDED = {PASSWORD: 1, CREDENTIAL: 12, PLAIN: 12}
#: (place, words it begins with, pattern); the group v or w is the value, else the whole match.
FORMS: tuple[tuple[int, str, str], ...] = (
    # address with user and password
    (PASSWORD, "://", r"""://[^\s/:@"'\\]{1,80}:(?P<v>[^\s/@"'\\]{3,}(?:\['\w+'\])?)@"""),
    # a password by its name: pw="v", password: v, 'passwd'] = v, PASSWORD = 'v'
    (PASSWORD, "pass pwd pw kennwort contrase", rf"""(?i:pass(?:word|wd|phrase|code)?|pwd|\bpw|kennwort|contrase[nñ]a)(?!\w*(?i:name|id|hint|policy|length))\w{{0,12}}(?:{_Q})?\]?\s*(?:=>|:=|[:=])\s*(?:[rbuf]?{_Q}(?P<v>{_IN}){_Q}|(?P<w>{_BARE}))"""),
    # what is called a secret: people choose them as they do passwords
    (PASSWORD, "secret", rf"""(?i:secret)(?:{_Q})?\]?\s*(?:=>|:=|[:=])\s*(?:[rbuf]?{_Q}(?P<v>{_IN}){_Q}|(?P<w>{_BARE}))"""),
    # a password after a blank: login x password v, PASSWORD 'v'
    (PASSWORD, "password identified convertto-securestring", rf"""(?i:password|identified\s+by|ConvertTo-SecureString)\s+(?:by\s+)?(?:{_Q}(?P<v>{_IN}){_Q}|(?P<w>[^\s"'`\\;,<>()=-][^\s"'`\\;,<>()=]{{5,}})(?=\s*(?:$|\\|[;,\n])|\s{{2}}))"""),
    # flags: -p v, -p 'v', -u user:v, --password v
    (PASSWORD, "-p --pass", rf"""(?<![\w-])(?:-p|--pass(?:word|wd|phrase)?)[\s=]+(?:{_Q}(?P<v>{_IN}){_Q}|(?P<w>{_BARE}))"""),
    (PASSWORD, "-u --user", rf"""(?<![\w-])(?:-u|--user)[\s=]+(?:{_Q})?[\w.@-]+:(?P<w>{_BARE})"""),
    # user and password side by side in a call: login('ops', "v"), auth=("ci", "v")
    (PASSWORD, "login log_in signin connect auth credential", rf"""(?i:login|log_in|signin|connect|auth|authenticate|credentials?)\w*\s*=?\s*\(\s*{_Q}[\w.@-]+{_Q}\s*,\s*{_Q}(?P<v>{_IN}){_Q}"""),
    # key id and key
    (CREDENTIAL, "akia asia", rf"""(?:AKIA|ASIA)[0-9A-Z]{{16}}{_Q}\s*,\s*{_Q}(?P<v>{_IN}){_Q}"""),
    # authorization headers
    (CREDENTIAL, "bearer basic token apikey", rf"""(?i:\b(?:bearer|basic|token|apikey))[ ]+(?P<w>(?![=:]){_BARE})"""),
    # a credential by its name
    (CREDENTIAL, "secret token key sig auth jwt access credential sas", rf"""(?i:secret|token|key|signature|sig|auth|jwt|access|credential|sas)\w{{0,4}}(?:{_Q})?\]?\s*(?:=>|:=|[:=])\s*(?:[rbuf]?{_Q}(?P<v>{_IN}){_Q}|(?P<w>{_BARE}))"""),
    (CREDENTIAL, "--", rf"""(?<![\w-])--[\w-]*(?:key|token|secret|sig)[\s=]+(?:{_Q}(?P<v>{_IN}){_Q}|(?P<w>{_BARE}))"""),
    # an account key in a call: set("fs.account.key.x", "v")
    (CREDENTIAL, "account.key .secret .password .token", rf"""(?i:account\.key|\.secret|\.password|\.token)[\w.-]*{_Q}\s*,\s*{_Q}(?P<v>{_IN}){_Q}"""),
    # webhook paths
    (CREDENTIAL, "/hook /webhook /services/", r"""(?i:/(?:hooks?|webhooks?|services)/)(?:[A-Z]\w{2,14}/)*(?P<v>[\w…*=%~-]{8,})(?![\w/])"""),
    # issuers' forms, wherever they stand
    (CREDENTIAL, "sk- ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xox xapp- dapi aiza ya29. shpat_ shpss_ npm_ pypi- hf_ sg. rk_live_ sk_live_ eyj", rf"""(?<![A-Za-z0-9_/+]){_ISSUED}[\w.…*~+/=-]{{2,}}"""),
    # name and value of a setting: name="x" value="v"
    (PLAIN, "value content", rf"""(?i:value|content)(?:{_Q})?\s*[:=]\s*{_Q}(?P<v>{_IN}){_Q}"""),
)
#: Any other literal of this length may be a secret when it is assigned to something.
_LONG = re.compile(r"(?<![\w+/=~*…-])[\w+/=~*…-]{20,}(?![\w+/=~*…-])")
_ASSIGNED = re.compile(rf"""[\w\])](?:{_Q})?\s*[:=]\s*[rbuf]?(?P<q>{_Q})?$""")


@lru_cache(maxsize=1)
def _automaton():
    """All first words at once: each leads to the patterns that begin with it."""
    import ahocorasick

    by_word: dict[str, list[tuple[int, re.Pattern]]] = {}
    for place, firsts, pattern in FORMS:
        compiled = re.compile(pattern)
        for w in firsts.split():
            by_word.setdefault(w, []).append((place, compiled))
    a = ahocorasick.Automaton()
    for w, forms in by_word.items():
        a.add_word(w, (len(w), tuple(forms)))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


#: A text without any of these holds no candidate; checked in the JVM before a text reaches Python.
GATE = (
    r"(?i)pass|pwd|pw|kennwort|contrase|secret|token|key|sig|sas|auth|jwt|bearer|basic |access|credential|identified|securestring|content|connect|signin|log_in|--|"
    r"://[^\s/:@]+:[^\s/@]+@|/(?:hooks?|webhooks?|services)/|(?:^|[^\w-])-[pu][\s=]|value|[A-Za-z0-9+/_=~-]{20,}|login|sk-|gh[pousr]_|github_pat|glpat|xox|xapp-|dapi|AIza|ya29|shp|npm_|pypi-|hf_|SG\.|_live_|eyJ"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?P<body>.*?)(?:-----END|\Z)", re.S)
_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}(?:PUBLIC KEY|CERTIFICATE)-----.*?(?:-----END|\Z)", re.S)
_GLUED = re.compile(rf"""{_Q}\s*\+\s*(?:\\\s*\n\s*)?{_Q}(?P<v>[\w+/=~.-]{{4,}}){_Q}""")


@dataclass(frozen=True)
class Secret:
    """A secret's value in a text: where it begins and ends, and the line (from 1) on which it begins."""

    start: int
    end: int
    line: int


def _counts(value: str, place: int, before: str, words: Dictionary) -> bool:
    """Whether a candidate is a secret: no known format, and more unexplained characters than its place allows."""
    v = value.strip()
    if len(v) < 6 or "\n" in v or _GUID.match(v) or _KEY_ID.match(v) or v.startswith(_ADDRESS):
        return False
    if place != PASSWORD and (v.isdigit() or _HASH_KEY.search(before) or _OTHER_KEY.search(before)):
        return False
    if place == PLAIN and (len(v) < 20 or "://" in v or _HEX.match(v) and len(v) in _HASHES):
        return False
    hidden = 0
    if _MASK.search(v):
        runs = [r for r in _MASK.split(v) if r]
        if max(map(len, runs), default=0) < READABLE:
            return False
        hidden = len(v) - sum(map(len, runs))  # no word explains what was masked
    left = residual(v, words) + hidden
    return left >= NEEDED[place] and (place != PLAIN or left >= 0.5 * sum(c.isalnum() for c in v))


_QUOTES = ("'", '"', "`", "\\")


def find(text: str, words: Dictionary) -> list[Secret]:
    """The secrets of a text in order, without overlaps."""
    spans: list[tuple[int, int, int]] = []  # start of the line that counts, start and end of the value
    shut = [m.span() for m in _PUBLIC.finditer(text)] if "PUBLIC KEY" in text or "CERTIFICATE" in text else []
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            body = m.group("body").replace("\\r", "").replace("\\n", "\n")
            if any(len(r) >= READABLE for r in re.findall(r"[A-Za-z0-9+/=]+", body)):
                spans.append((m.start(), m.start("body"), m.end("body")))
            shut.append(m.span())

    def consider(place: int, a: int, b: int, bare: bool) -> None:
        if any(x <= a < y for x, y in shut):
            return
        value = text[a:b]
        if bare:
            if _LOOKUP.match(value):
                return
            value = value.rstrip(".,;:!?")
            b = a + len(value)
        if text[b : b + 1] in _QUOTES:
            glued = _GLUED.match(text, b)
            while glued:  # a literal put together from parts
                b, value = glued.end("v"), value + glued.group("v")
                glued = _GLUED.match(text, b)
        before = text[max(text.rfind("\n", 0, a) + 1, a - 60) : a]
        if _counts(value, place, before, words):
            spans.append((a, a, b))

    for last, (n, forms) in _automaton().iter(_lower(text)):
        for place, form in forms:
            m = form.match(text, last - n + 1)
            if m:
                quoted = m.groupdict().get("v") is not None
                a, b = m.span("v" if quoted else "w" if "w" in form.groupindex else 0)
                consider(place, a, b, not quoted)
    for m in _LONG.finditer(text):
        b = m.end()
        token = m.group().lstrip("=")  # what assigns it is no part of it
        a = b - len(token)
        name, equals, rest = token.partition("=")
        if equals and rest.strip("=") and name.isidentifier():
            a, token = a + len(name) + 1, rest
        elif not equals or not rest.strip("="):
            assigned = _ASSIGNED.search(text, max(0, a - 16), a)
            if not assigned or (assigned.group("q") is None) == (text[b : b + 1] in _QUOTES and b < len(text)):
                continue
        consider(PLAIN, a, b, False)
    out: list[Secret] = []
    counted = line = 0
    for begin, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if out and a < out[-1].end:
            if b > out[-1].end:
                out[-1] = Secret(out[-1].start, b, out[-1].line)
            continue
        line += text.count("\n", counted, begin) if begin >= counted else -text.count("\n", begin, counted)
        counted = begin
        out.append(Secret(a, b, line + 1))
    return out


def redact(text: str, secrets: list[Secret]) -> str:
    """The text with only the secrets' values replaced; line breaks around a key block's body stay."""
    parts, at = [], 0
    for s in secrets:
        value = text[s.start : s.end]
        head, tail = re.match(r"(?:\\[rn]|\s)*", value).group(), re.search(r"(?:\\[rn]|\s)*$", value).group()
        parts += [text[at : s.start], head, REDACTED, tail if len(head) < len(value) else ""]
        at = s.end
    return "".join([*parts, text[at:]])


# ---------------------------------------------------------------- operator


def scan_secrets(rows: DataFrame, vocabulary: str | None = None, redacted: bool = True) -> DataFrame:
    """One row per secret of each text.

    ``rows`` has table_name, row_key and text.  Columns: table_name, row_key, line_no (lines end at
    \\n, from 1), start_char, end_char, and with ``redacted`` the redacted text of the row. NULL and blank
    texts, and texts without secrets, give no rows; repeated rows give repeated results.  Whatever
    the row says of its own secrets is ignored.  Nothing is shuffled.
    """
    path = vocabulary or VOCABULARY
    names = ["table_name", "row_key", "line_no", "start_char", "end_char"] + ["redacted_text"] * redacted
    schema = "table_name string, row_key string, line_no int, start_char long, end_char long" + ", redacted_text string" * redacted

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = dictionary(path)
        for pdf in frames:
            out = []
            for name, key, text in zip(pdf["table_name"], pdf["row_key"], pdf["text"]):
                found = find(text, words)
                clear = redact(text, found) if redacted and found else None
                out += [(name, key, s.line, s.start, s.end, *([clear] if redacted else [])) for s in found]
            yield pd.DataFrame(out, columns=names)

    known = rows.where(F.col("text").isNotNull() & F.col("text").rlike(GATE)).select("table_name", "row_key", "text")
    return known.mapInPandas(run, schema)


#: table, row key, text
TEXTS = (("fabric_url_scanner", "row_id", "match_snippet"), ("fact_scan_findings", "finding_id", "redacted_snippet"), ("notebook_sources", "source_id", "source_text"))


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col(k).cast("string").alias("row_key"), F.col(c).alias("text")) for t, k, c in TEXTS])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on which secrets begin."""
    return scan_secrets(source_texts(spark, sf_dir), redacted=False).select("table_name", "row_key", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The redacted text of every row that held a secret, and how many it held."""
    found = scan_secrets(source_texts(spark, sf_dir))
    return found.groupBy("table_name", "row_key", F.xxhash64("redacted_text").alias("version")).agg(F.countDistinct("start_char").alias("secrets"), F.first("redacted_text").alias("redacted_text")).drop("version")


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
ORACLE: dict[str, str] = {}
