r"""Secret scan: candidate strings judged by a random forest.

Candidates are runs of at least 12 letters, digits, ``_ + / -`` (and ``=`` at the end), what follows a known
prefix of keys, private keys in PEM form, the password of an address (``scheme://user:password@host``), and the values that stand
after a word which names a secret and ``=`` or ``:``, however short. Such a value goes to its closing quote on the same line, blanks
included, if that is within 1,024 characters; else to the next blank or the next such word; if it holds runs,
they are candidates too. Each is described by its length, its characters and their transitions, how much of it dictionary words
cover, its path and its neighbouring words; the forest, trained from labelled findings, tells secrets from
false positives. The transition and neighbour statistics and the dictionary are learned from the same
findings. Findings are judged where their documents lie; nothing is shuffled.

The tables hold no labelled findings, so the query trains on ``example_findings()``: a bounded, seeded set
of secrets and look-alikes in the forms that public scanners list. Any table of labelled findings
(before, candidate, after, path, is_secret) can take its place by ``labelled_findings``, which takes a bounded
sample of it.

Edge cases: null and empty texts have no findings; every occurrence is a finding, so repeated rows repeat
theirs; findings may lie in one another, and redacting takes them as one; null paths are empty; without both labels among the findings every score is the share of secrets;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import table

CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}={0,2}")
PREFIX = r"(?:A[KS]IA|gh[opsur]_|github_pat_|glpat-|sk-|[sp]k_live_|[sp]k_test_|xox[abeoprs]-|AIza|SG\.|eyJ)"
PREFIXED = re.compile(rf"(?<![A-Za-z0-9_+/-]){PREFIX}[A-Za-z0-9_+/.-]{{6,}}")
KNOWN = re.compile(PREFIX)
GLUE = re.compile(r"[=:]")
#: A word that names a secret, at the end of what stands before ``=`` or ``:``.
NAME = re.compile(
    r"(?:pass(?:word|wort|wd|phrase|code)|kennwort|contrase\u00f1a|contrasena|mot de passe|pwd|secret|token|credential|api[_-]?key"
    r"|(?<![a-z])(?:key|pass|auth|authorization))[a-z0-9_-]{0,20}[\"'\]]{0,2}[ \t]{0,4}$|(?:access|private|secret|signing|encryption|client|account)[_-]?key[a-z0-9_-]{0,20}[\"'\]]{0,2}[ \t]{0,4}$",
    re.I,
)
NAME_ROOM = 64
#: A value goes to its closing quote on the line, if that is near; else to the next quote or blank.
QUOTED_ROOM = 1024
_CLOSED = "|".join(rf"{q}(?P<{n}>[^{q}\r\n]{{1,{QUOTED_ROOM}}}){q}" for n, q in (("double", '"'), ("single", "'"), ("back", "`")))
VALUE = re.compile(rf"[=:>]{{0,2}}[ \t]*(?:(?i:bearer|basic)[ \t]+)?(?:{_CLOSED}|(?P<q>[\"'`])(?P<quoted>(?:(?!(?P=q))\S)+)|(?P<bare>\S+))")
#: The password of an address: ``scheme://user:password@host``.
ADDRESS = re.compile(r"://[^\s/:@\"'<>]*+:(?P<password>[^\s/@\"'<>]++)@")
IN_ADDRESS = re.compile(r"://[^\s/:@\"'<>]*:$")
NEAR = 48
WORD = re.compile(r"[A-Za-z]{2,}")
EXAMPLE_PATH = re.compile(r"test|example|sample|mock|fixture|demo|tutorial", re.I)
CONFIG_PATH = re.compile(r"\.env|conf|\.ya?ml|\.ini|\.toml|\.properties|\.pem|\.key|deploy|secret|credential", re.I)
PROSE_PATH = re.compile(r"\.md|\.txt|\.html?|\.rst|readme|docs?/|blog|news", re.I)
#: A private key; its body ends at the closing line, at most 8,192 characters on.
PEM = re.compile(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,-]{0,8192}?-----END [A-Z ]{0,32}PRIVATE KEY-----)?")


def _named(text: str) -> Iterator[tuple[int, int]]:
    """start and end of the values after words that name a secret; each ends before the next such word at the latest."""
    names = []
    for m in GLUE.finditer(text):
        low = max(0, m.start() - NAME_ROOM)
        if name := NAME.search(text[low : m.start()]):
            names.append((low + name.start(), m.end()))
    for k, (_, at) in enumerate(names):
        stop = max(at, names[k + 1][0]) if k + 1 < len(names) else len(text)
        if m := VALUE.match(text, at, stop):
            group = next(g for g in ("double", "single", "back", "quoted", "bare") if m[g] is not None)
            s, e = m.span(group)
            if group == "bare":
                e = s + len(m[group].rstrip(",;)]}>\"'`"))
            if text[s:e].strip():
                yield s, e


def find(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """start, length, before, candidate, after of each candidate of a whole text, in their order."""
    spans = {m.span() for m in CANDIDATE.finditer(text)}
    spans.update(m.span() for m in PREFIXED.finditer(text))
    spans.update(m.span() for m in PEM.finditer(text))
    spans.update(m.span("password") for m in ADDRESS.finditer(text))
    spans.update(_named(text))
    for s, e in sorted(spans):
        yield s, e - s, text[max(0, s - NEAR) : s], text[s:e], text[e : e + NEAR]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


KINDS = 41


def _bigrams(s: str) -> list[int]:
    """Transitions between 41 kinds of character: letters without case, digits, symbols and all others."""
    at = [ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) - 48 if "0" <= c <= "9" else 36 + "_+/-".find(c) if c in "_+/-" else 40 for c in s.lower()]
    return [a * KINDS + b for a, b in zip(at, at[1:])]


def _neighbours(before: str, after: str) -> list[str]:
    words = [w.lower() for w in WORD.findall(before)[-3:]] + ["after:" + w.lower() for w in WORD.findall(after)[:1]]
    glue = before.rstrip("\"' ")[-1:]
    return [*words, f"glue:{glue if glue in '=:' else 'none'}"]


@dataclass
class Vocabulary:
    """What the features need from labelled findings: transition and neighbour log odds, and the dictionary."""

    transitions: np.ndarray = field(default_factory=lambda: np.zeros(KINDS * KINDS))
    neighbours: dict[str, float] = field(default_factory=dict)
    dictionary: frozenset = frozenset()

    @classmethod
    def learn(cls, findings: list[tuple]) -> Vocabulary:
        n = np.ones((2, KINDS * KINDS)) * 0.5
        words: list[Counter] = [Counter(), Counter()]
        seen: Counter = Counter()
        for before, candidate, after, _, label in findings:
            np.add.at(n[label], _bigrams(candidate), 1)
            words[label].update(set(_neighbours(before, after)))
            seen.update(w.lower() for w in WORD.findall(before + " " + after) if len(w) > 2)
            if not label:
                seen.update(w.lower() for w in WORD.findall(candidate) if len(w) > 2)
        n /= n.sum(1, keepdims=True)
        size = [1 + sum(1 for f in findings if f[4] == k) for k in (0, 1)]
        known = [w for w in {*words[0], *words[1]} if words[0][w] + words[1][w] >= 3]
        odds = {w: math.log((words[1][w] + 0.5) / size[1]) - math.log((words[0][w] + 0.5) / size[0]) for w in known}
        return cls(np.log(n[1] / n[0]), odds, frozenset(w for w, k in seen.items() if k >= 2))

    def covered(self, s: str) -> float:
        low, hit, i = s.lower(), 0, 0
        while i < len(low):
            step = next((k for k in range(min(12, len(low) - i), 2, -1) if low[i : i + k] in self.dictionary), 0)
            hit += step
            i += step or 1
        return hit / len(low)

    def features(self, before: str, candidate: str, after: str, path: str) -> list[float]:
        n, kinds = len(candidate), [_kind(c) for c in candidate]
        share = [kinds.count(k) / n for k in range(4)]
        counts = Counter(candidate)
        run = longest = 1
        for a, b in zip(candidate, candidate[1:]):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
        pairs = _bigrams(candidate)
        odds = [self.neighbours.get(w, 0.0) for w in _neighbours(before, after)]
        return [
            n, *share, -sum(k / n * math.log2(k / n) for k in counts.values()),
            sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
            float(self.transitions[pairs].mean()) if pairs else 0.0,
            float(set(candidate.lower()) <= set("0123456789abcdef")),
            self.covered(candidate), longest / n, candidate.count("-"), candidate.count("_") + candidate.count("/"),
            sum(odds), max(odds, default=0.0), min(odds, default=0.0),
            float(before.endswith(("=", "= ", ': "', '= "', "='", '="', ": "))), *(float(bool(p.search(path))) for p in (EXAMPLE_PATH, CONFIG_PATH, PROSE_PATH)), float(bool(PEM.match(candidate))),
            float(bool(KNOWN.match(candidate))), float(bool(NAME.search(before.rstrip("\"'`= :>\t")))), float(candidate[1:] != candidate[1:].lower()),
            sum(c in "{}()<>[]$%" for c in candidate) / n, float(any(c.isdigit() for c in candidate)),
            candidate.count(" "), float(after.startswith("@") and bool(IN_ADDRESS.search(before))),
        ]


class Forest:
    """Random forest on binned features: each tree has a bootstrap sample, each split the best of some features."""

    def __init__(self, trees: int = 30, depth: int = 8, least: int = 4, seed: int = 5):
        self.n_trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.constant: float | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        if not 0 < y.sum() < len(y):
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        rng = np.random.default_rng(self.seed)
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
        for _ in range(self.n_trees):
            nodes: list[tuple] = []
            self._grow(binned, y, cuts, rng.integers(0, len(y), len(y)), 0, rng, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))
        return self

    def _grow(self, binned, y, cuts, rows, depth, rng, nodes) -> int:
        me, share = len(nodes), y[rows].mean()
        nodes.append((-1, 0.0, 0, 0, share))
        if depth < self.depth and len(rows) >= 2 * self.least and 0 < share < 1:
            best = (0.0, -1, 0)
            for f in rng.permutation(binned.shape[1])[: max(2, int(math.sqrt(binned.shape[1])) + 1)]:
                bins = len(cuts[f]) + 1
                n = np.bincount(binned[rows, f], minlength=bins).cumsum()[:-1]
                k = np.bincount(binned[rows, f], y[rows], bins).cumsum()[:-1]
                total, ones = len(rows), y[rows].sum()
                ok = (n >= self.least) & (total - n >= self.least)
                if ok.any():
                    n, k, at = n[ok], k[ok], np.flatnonzero(ok)
                    gain = k**2 / n + (ones - k) ** 2 / (total - n) - ones**2 / total
                    if gain.max() > best[0] + 1e-12:
                        best = (gain.max(), f, at[gain.argmax()])
            if best[1] >= 0:
                left = binned[rows, best[1]] <= best[2]
                a = self._grow(binned, y, cuts, rows[left], depth + 1, rng, nodes)
                b = self._grow(binned, y, cuts, rows[~left], depth + 1, rng, nodes)
                nodes[me] = (int(best[1]), float(cuts[best[1]][best[2]]), a, b, share)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(x):
            return np.full(len(x), self.constant or 0.0)
        out = np.zeros(len(x))
        for nodes in self.trees:
            feature, cut, a, b, share = nodes
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], a[at], b[at]))
            out += share[at]
        return out / len(self.trees)


@dataclass
class Scanner:
    vocabulary: Vocabulary
    forest: Forest

    def judge(self, findings: list[tuple[str, str, str, str]]) -> np.ndarray:
        """Scores of (before, candidate, after, path)."""
        if not findings:
            return np.zeros(0)
        return self.forest.predict(np.array([self.vocabulary.features(*f) for f in findings], float).reshape(len(findings), -1))


def train(findings: list[tuple]) -> Scanner:
    """From a bounded list of (before, candidate, after, path, is_secret)."""
    vocabulary = Vocabulary.learn(findings)
    x = np.array([vocabulary.features(*f[:4]) for f in findings], float)
    return Scanner(vocabulary, Forest().fit(x, np.array([int(f[4]) for f in findings], float)))


SECRET_KINDS = tuple(range(17))
#: Paths of files by what they tell: the first of a pair is where secrets are rather, the second where look-alikes are; most paths tell nothing.
PATHS = [
    (["config/settings.yml", ".env", "deploy/prod.env", "app/config.properties", "ops/credentials.ini"], ["tests/fixtures/users.json", "docs/readme.md", "examples/demo.py", "blog/post.html", "src/mock_client.py"]),
    (["src/app.py", "web/page.html", "notes.txt", "lib/util.go", "", "data"],) * 2,
]


def example_texts(n: int = 4000, seed: int = 11, kinds: tuple = SECRET_KINDS) -> Iterator[tuple[str, int, str, str, int]]:
    """Seeded text, start, candidate, path and label: half secrets of some kinds, half look-alikes, whether or not ``find`` gives them."""
    rng = random.Random(seed)
    hexa, alnum, base64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    some = lambda chars, k: "".join(rng.choices(chars, k=k))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    # Syllables of German, French, Spanish and Italian words, for long words of other languages.
    foreign = [
        ["ge", "ver", "be", "ung", "heit", "keit", "lich", "isch", "schaft", "ein", "auf", "zu", "stell", "arbeit", "zeit", "land", "wirt", "kraft", "rück", "tz", "sch", "ier", "ig"],
        ["eau", "tion", "ment", "aux", "que", "ou", "ch", "ette", "eur", "re", "dé", "com", "par", "aire", "ence", "ais", "on", "vous", "tre", "pré"],
        ["ción", "mente", "os", "as", "que", "es", "dad", "ar", "con", "tra", "des", "ado", "lla", "rr", "ente", "miento", "ita", "pro", "zione", "ggi"],
    ]
    long_word = lambda: "".join(rng.choices(rng.choice([syllables, *foreign]), k=rng.randint(5, 9)))
    prose = lambda: " ".join(word() for _ in range(6)) + " "
    name = lambda *w: rng.choice(w) + rng.choice(["=", " = \"", ": ", "='", ": \"", "=\"", " = "])

    def password() -> str:
        k = rng.randrange(4)
        if k == 0:
            return some(alnum + "!@#$%&*.-_?", rng.randint(8, 20))
        if k == 1:
            return (word().title() + some(string.digits, rng.randint(1, 4)) + some("!@#$%&*.?", rng.randint(1, 2)) + word())[:20] + some(string.digits, 2)
        if k == 2:
            return word() + some(string.digits, rng.randint(1, 2)) + word() + some("!@$%&*.-_", 1) + some(alnum, rng.randint(1, 4))
        return some(alnum, rng.randint(8, 14))

    quoted = lambda *w: rng.choice(w) + rng.choice([' = "', ': "', "='", '="', "= '", ": '"])
    strong = ("password", "passphrase", "passwd", "pwd", "Password", "master_password", "wifi_password", "DB_PASSWORD")

    def secret() -> tuple[str, ...]:
        k = rng.choice(kinds)
        if k == 14:  # words between quotes
            words = [rng.choice([word(), long_word()[:9]]) for _ in range(rng.randint(3, 6))]
            if rng.random() < 0.4:
                words.insert(rng.randrange(len(words)), some(string.digits, rng.randint(1, 4)))
            return quoted(*strong), " ".join(rng.choice([str, str, str.title])(w) for w in words)
        if k == 15:  # in an address
            own = "".join(c for c in password() if c not in "/@<>:'\" ")
            return rng.choice(["", "url=", "DATABASE_URL="]) + rng.choice(["postgres", "mysql", "redis", "https", "amqp", "mongodb+srv", "ftp"]) + f"://{rng.choice([word(), 'admin', 'root', ''])}:", own, f"@{word()}.{word()}/{word()}"
        if k == 16:  # short
            return name("password", "passwd", "pwd", "pass", "db_password", "passcode"), some(alnum + "!@#$%&*", rng.randint(3, 7))
        if k == 13:
            lines = " ".join(some(base64, 64) for _ in range(rng.randint(2, 6)))
            kind = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
            return rng.choice(["", name("private_key")]), f"-----BEGIN {kind}PRIVATE KEY-----" + rng.choice(["", f" {lines} -----END {kind}PRIVATE KEY-----"])
        if k in (9, 10, 11):
            return name("password", "passwd", "pwd", "db_password", "DB_PASSWORD", "secret", "pass"), password()
        if k == 12:  # without a digit
            j = rng.randrange(4)
            if j == 0:
                return rng.choice(["", name("aws_access_key_id", "key")]), "AKIA" + some(string.ascii_uppercase, 16)
            if j == 1:
                return rng.choice(["", name("token")]), rng.choice(["ghp_", "sk-", "sk_live_"]) + some(string.ascii_letters, rng.choice([24, 36]))
            return name("secret", "client_secret", "api_key", "apikey", "token"), some(string.ascii_letters, rng.randint(16, 40))
        if k < 2:
            return rng.choice(["", name("aws_access_key_id", "key")]), "AKIA" + some(string.ascii_uppercase + string.digits, 16)
        if k == 2:
            return name("password", "passwd", "pwd"), some(hexa, rng.randint(12, 24))
        if k == 3:
            return name("token", "auth_token", "access_token"), some(hexa, rng.choice([32, 40, 64]))
        if k == 4:
            return name("secret", "client_secret", "api_key", "apikey"), some(alnum, rng.randint(20, 48))
        if k == 5:
            return name("secret_key", "private_key", "secret"), some(base64, rng.choice([40, 43])) + rng.choice(["", "="])
        if k == 6:
            return rng.choice(["", name("token")]), rng.choice(["ghp_", "gho_"]) + some(alnum, 36)
        if k == 7:
            return rng.choice(["", name("key")]), rng.choice(["sk-", "sk_live_", "pk_live_"]) + some(alnum, rng.choice([24, 48]))
        return rng.choice(["", "Bearer ", name("slack_token")]), "xoxb-" + some(string.digits, 12) + "-" + some(alnum, 24)

    def other() -> tuple[str, ...]:
        k = rng.randrange(26)
        if k == 22:  # prose between quotes
            return quoted("key", "token", "auth", "secret", "tokens", "next_token", "api_key"), " ".join(word() for _ in range(rng.randint(2, 8))) + rng.choice(["", ".", ","])
        if k == 23:
            ask = ["Enter your password", "Please choose a password", "Your new password", "must be at least 8 characters", "is required", "Forgot your password?", "Invalid password", "Type it again", "Passwords must match", "Repeat the password please"]
            return quoted(*strong), rng.choice(ask) + rng.choice(["", ".", " again", " or " + word()])
        if k == 24:  # short, and none
            if rng.random() < 0.5:
                return name("key", "token", "auth", "tokens", "secret"), rng.choice([some(string.digits, rng.randint(1, 3)), word()[:4], some(string.ascii_letters, 1), "yes", "no"])
            return name(*strong, "pass"), rng.choice(["none", "null", "true", "false", "yes", "no", "***", "xxx", "N/A", "-", "''", "nil", "the", "and", "is", "a", "None", "{}", "..."])
        if k == 25:
            return rng.choice(["postgres", "https", "mysql", "ftp"]) + f"://{rng.choice(['user', 'username', '<user>'.strip('<>'), word()])}:", rng.choice(["password", "pass", "PASSWORD", "$PASSWORD", "${DB_PASS}", "{password}", "xxxx", "****", "changeme", "pwd"]), f"@{rng.choice(['host', 'localhost', 'example.com', word()])}/{word()}"
        if k in (12, 13, 18, 19, 20, 21):  # words of prose, as they are or in capitals; their accents end a run
            shape = rng.choice([str, str, str.title, str.upper])
            found = max(re.split(r"[^A-Za-z]", shape(long_word())), key=len)
            found += shape("".join(rng.choices("aeioulnrst", k=max(0, 12 - len(found)))))
            lead = rng.choice(["", "", "the ", "id: ", f"{word()}!! ", f"{word()}... "])
            return shape(lead), found.title() if shape is str.title else found
        if k == 14:
            return rng.choice(["", "call ", "see "]), rng.choice(["_", "-", "/"]).join(long_word()[: rng.randint(4, 16)] for _ in range(rng.randint(2, 4))) + "_" + long_word()
        if k == 15:
            return "", word() + "".join(long_word()[: rng.randint(4, 12)].title() for _ in range(rng.randint(2, 4))) + "Value"
        if k == 16:  # what follows the name of a secret and is none
            return name("password", "token", "secret", "api_key", "key", "pass", "auth"), rng.choice([long_word(), long_word().title(), "required", "undefined", "<password>", "${DB_PASSWORD}", "getToken()", "os.environ[KEY]", "********", "{{secret}}", "%(token)s", "changeme", "[hidden]", "string"])
        if k == 17:
            return rng.choice(["keyboard: ", "tokens: ", "secretary: ", "key: ", "token: "]), rng.choice([long_word(), some(string.digits, rng.randint(6, 9)), long_word() + "," + word(), long_word() + "."])
        if k == 0:
            return rng.choice(["commit ", "revision ", "at "]), some(hexa, 40)
        if k == 1:
            return rng.choice(["sha256:", "digest: ", "checksum ", "md5: "]), some(hexa, rng.choice([32, 64]))
        if k == 2:
            return rng.choice(["id: ", "uuid ", "request ", ""]), "-".join(some(hexa, j) for j in (8, 4, 4, 4, 12))
        if k in (3, 4, 5):
            return rng.choice(["", "", "card ", "call ", "number: ", "order ", "id="]), some(string.digits, rng.randint(12, 19))
        if k == 6:
            return "", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}"
        if k == 7:
            return rng.choice(["", "name=", "field: "]), "_".join([word(), word(), str(rng.randint(1, 999)), word(), word()]) + "_" + word()
        if k == 8:
            return rng.choice(["", "see ", "path="]), "/".join(["", word(), word() + str(rng.randint(1, 64)), word(), word()])
        if k == 9:
            return rng.choice(["", name("api_key", "password", "token")]), rng.choice(["YOUR_API_KEY_", "REPLACE_WITH_KEY_", "xxxxxxxxxxxxxxxx", "changeme_please_"]) + some(string.digits, 3)
        if k == 10:
            return rng.choice(["", "+", "tel "]), "-".join(some(string.digits, j) for j in (3, 3, 4))
        return "", "".join(word() for _ in range(4)) + some(string.digits, rng.randint(1, 4)) + word()

    for k in range(n):
        label = k % 2
        before, candidate, tail = (*(secret() if label else other()), "")[:3]
        quote = before[-1:] if before[-1:] in "\"'" else ""
        told = rng.random() < 0.4
        path = rng.choice(PATHS[0 if told else 1][(1 - label) if rng.random() < 0.85 else label])
        lead = prose() + before
        yield lead + candidate + quote + tail + " " + prose(), len(lead), candidate, path, label


def example_findings(n: int = 4000, seed: int = 11, kinds: tuple = SECRET_KINDS) -> list[tuple]:
    """before, candidate, after, path, is_secret of the example texts; none is left out."""
    return [(t[max(0, s - NEAR) : s], c, t[s + len(c) : s + len(c) + NEAR], path, label) for t, s, c, path, label in example_texts(n, seed, kinds)]


def labelled_findings(findings: DataFrame, most: int = 20_000) -> list[tuple]:
    """At most about ``most`` rows (before, candidate, after, path, is_secret) of a table, chosen by a hash of the row; null parts are empty, rows without a candidate or label are no findings."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("before", "candidate", "after", "path")]
    rows = findings.select(*parts, F.col("is_secret").cast("int").alias("is_secret")).filter("candidate <> '' AND is_secret IS NOT NULL")
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("before", "candidate", "after", "path", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return sorted((r["before"][-NEAR:], r["candidate"], r["after"][:NEAR], r["path"], r["is_secret"]) for r in rows.collect())


FINDINGS = "doc_id long, start long, length long, candidate_sha256 string, score double, is_secret boolean"


def scan(docs: DataFrame, scanner: Scanner, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate of every text; the string itself is given as a digest only."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, judged = [], []
            for doc_id, text, where in zip(*(c.to_pylist() for c in b.columns)):
                for start, length, *near in find(text or ""):
                    rows.append((doc_id, start, length, hashlib.sha256(near[1].encode()).hexdigest()))
                    judged.append((*near, where or ""))
            score = shared.value.judge(judged)
            cols = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array(score), pa.array(score >= threshold)], names=names)

    names = [c.split()[0] for c in FINDINGS.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(path).cast("string")).mapInArrow(run, FINDINGS)


def redact(docs: DataFrame, scanner: Scanner, path: str = "source", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with secrets replaced in text (and n_chars made to fit, where there is one)."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    names = docs.columns
    at, where = names.index("text"), names.index(path)
    chars = names.index("n_chars") if "n_chars" in names else None

    def clean(texts: list[str | None], paths: list[str | None]) -> list[str | None]:
        found = [list(find(t)) if t else [] for t in texts]
        scores = iter(shared.value.judge([(*f[2:], p or "") for some, p in zip(found, paths) for f in some]).tolist())
        out = list(texts)
        for k, some in enumerate(found):
            secrets: list[list[int]] = []
            for start, length, *_ in (f for f in some if next(scores) >= threshold):
                if secrets and start < secrets[-1][1]:
                    secrets[-1][1] = max(secrets[-1][1], start + length)
                else:
                    secrets.append([start, start + length])
            for start, end in reversed(secrets):
                out[k] = out[k][:start] + mark + out[k][end:]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            texts = clean(columns[at].to_pylist(), columns[where].to_pylist())
            if chars is not None:
                sizes = [n if a is None or a == t else len(t) for n, a, t in zip(columns[chars].to_pylist(), columns[at].to_pylist(), texts)]
                columns[chars] = pa.array(sizes, columns[chars].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train(example_findings()))
