"""Credentials embedded in source code (problem 3): candidates, Markov likelihood, logistic regression, redaction.

1. *Candidates*: every string literal, comment and the path of a file are read for values that could be a
   credential: whole literals (escapes decoded, pieces joined with ``+`` or ``join('')`` put together, ``atob`` undone),
   and parts of them (user info and parameters of URLs, ``NAME=value`` and JSON members, authorization headers,
   ``-u user:value``, vendor tokens, private key blocks). Each comes with the identifier, flag or call it stands at.
2. *Features*: the character Markov log-likelihood ratio of the value, secrets against ordinary text (bigrams with begin and end; per
   character and in sum), what the surrounding identifier says (a secret, perhaps one, something public, nothing, a call that logs in), how these
   interact, and the path (test, configuration, third party). The ordinary table is counted over the text of *all* files, the secret table
   over the values with a positive weak label outside the held-out fold.
3. *Weak labels*: pattern matches that are near certain either way: vendor tokens, key blocks, random-looking values in URLs' user info,
   in authorization headers or put together from pieces, against placeholders, references to the environment, prose, plain words and uuids.
   None of the patterns is a feature, so the model must find secrets by likelihood, identifier and path.
4. Logistic regression by Newton steps from zero weights with a prior centred at zero, on the labelled candidates of at most
   ``2 * SAMPLE_FILES`` files chosen by hash and at most ``SAMPLE_ROWS`` of them (the documented bounds of the fit), then calibrated on a held-out fifth.
   Candidates of *all* files are scored, a batch at a time; those with a calibrated score of ``CUT`` or more are credentials, unless an exact check
   afterwards shows a placeholder, prose or a uuid.
5. *Redaction* replaces exactly the value's characters, in contents and paths, so quotes, escapes and lines around it stay whole.

Scoring is map-only; what is broadcast are two Markov tables (97 x 97) and one weight a feature.

Defined cases: null content has no lines (its path still counts as line -1), empty content none; rows that come again
(same ``file_id``) count once; a credential over several lines counts at its first; any length is read and scored whole; values under
``LEAST`` characters are no credentials by definition; the name is looked for back to the literal before the previous one, however far that is; an
empty table gives no rows, and so does a table whose sample has no labelled row of one class (nothing can be learned). Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_FILES = 4000
SAMPLE_ROWS = 400_000
CUT = 0.2
LEAST = 6

_LIT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_CHAIN = re.compile(r"\s*\+\s*(?='|\"|`)")
_JOINED = re.compile(r"\[\s*((?:'(?:\\.|[^'\\])'|\"(?:\\.|[^\"\\])\")(?:\s*,\s*(?:'(?:\\.|[^'\\])'|\"(?:\\.|[^\"\\])\"))+)\s*,?\s*\]\s*\.join\(\s*(?:''|\"\")\s*\)")
_PIECE = re.compile(r"'((?:\\.|[^'\\])*)'|\"((?:\\.|[^\"\\])*)\"")
_NAME = re.compile(r"([A-Za-z_$][\w$.-]*)[\"']?\]?\s*(?::\s*[\w<>\[\]]+\s*(?==))?(?:=|:|=>)\s*\{?\s*(?:[\w.$]+\s*(?:\|\||\?\?)\s*)?(?:\w+\(\s*)?$")
_FLAG = re.compile(r"[\"']--?([A-Za-z][\w-]*)[\"']")
_CALLEE = re.compile(r"([A-Za-z_$][\w$]*)\Z")
_URLAUTH = re.compile(r"(?<![\w+.-])[a-z][a-z0-9+.]*(?:://|---)([^\s/:@'\"`]*):([^\s/@'\"`]+)@")
_PARAM = re.compile(r"[?&/;]([A-Za-z][\w-]*)=([^&\s/'\"`#;]{6,})")
_USER = re.compile(r"(?:^|\s)(?:-u|--user)[ =]+[^\s:'\"]+:([^\s'\"]+)")
_HEADER = re.compile(r"\b(bearer|basic|token)\s+([A-Za-z0-9+/=_.~-]{8,})", re.I)
_PAIR = re.compile(r"(?<![\w.-])([A-Za-z_][\w-]*)\\?[\"']?\s*(?:=|:|\bwas\b|\bis\b)\s*\\?[\"']?([^\s\"'\\,;&`]{6,})")
_ACCOUNT = re.compile(r"\b(?:login|user(?:name)?|account|credentials?)\s*[:=]?\s+\S+\s*[/|,:]\s+([^\s\"'\\,;&`]{6,})", re.I)
_VENDOR = re.compile(r"(?<![\w-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abeprs]-[\w-]{12,}|[sr]k_(?:live|test)_\w{12,}|glpat-[\w-]{16,}|AIza[\w-]{30,}|npm_\w{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_SHAPED = re.compile(r"[A-Za-z]{2,6}[_-](?:[a-z]{2,5}_)?[A-Za-z0-9_+/=-]{20,}\Z")
_HEX = re.compile(r"[0-9a-f]{16,}\Z|[0-9A-F]{16,}\Z")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
_DIGEST = re.compile(r"(?:sha(?:1|256|384|512)|md5)[-:=][A-Za-z0-9+/=]+\Z")
_WORDY = re.compile(r"[A-Z]?[a-z]+(?:(?:[A-Z][a-z]+)*|(?:[-_.][A-Za-z]+)*)\Z")
_PLACEHOLDER = re.compile(
    r"example|replace[_-]?(?:me|this|with)|your[_-]|changeme|change[_-]me|placeholder|dummy|insert[_-]|todo|fill[_-]?in|redacted|sample|xxxx|\*\*\*|\.\.\.|<[^>]*>|\$\{|\{\{|%\(|%s|process\.env|^(.)\1+$|^test(ing)?$|^none$|^null$|^undefined$|for-docs", re.I
)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u\{?([0-9a-fA-F]{4,6})\}?|(.))", re.S)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Words that name a secret, words that name something public; fixed values.
SECRET = frozenset(
    (
    "password", "passwd", "passwort", "passphrase", "pass", "pwd", "pw", "secret", "token", "apikey", "key", "keys", "credential",
    "credentials", "cred", "bearer", "auth", "authorization", "kennwort", "geheimnis", "motdepasse", "mot", "contrasena", "clave", "senha",
    "sig", "signature", "access", "private", "priv",
)
)
WEAK_KEY = frozenset({"key", "keys", "access", "sig", "signature", "private", "priv", "mot"})
PUBLIC = frozenset(
    (
    "integrity", "etag", "commit", "sha", "md5", "checksum", "hash", "digest", "revision", "uuid", "guid", "id", "ref", "icon", "sprite",
    "image", "img", "class", "path", "url", "uri", "href", "src", "title", "label", "hint", "message", "rule", "shape", "pattern", "regex",
    "template", "sample", "example", "masked", "mask", "public", "pub", "name", "version", "locale", "page", "sort", "build", "content",
    "trace", "client", "node", "font", "run", "host", "type", "kind",
)
)
HASHES = frozenset(("etag", "sha", "md5", "checksum", "hash", "digest", "integrity", "commit", "revision"))
PARAMS = frozenset(("apikey", "api_key", "access_token", "token", "key", "sig", "signature", "auth", "secret", "password", "auth_token"))

FEATURES = ("bias", "ratio", "evidence", "log_length", "secret_name", "weak_name", "public_name", "no_name", "login_call", "ratio_secret", "ratio_weak", "ratio_public", "ratio_none", "hidden", "test_path", "config_path", "third_path")
_N = len(FEATURES)


def unescape(text: str) -> str:
    """Source escapes decoded."""
    if "\\" not in text:
        return text
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "0": "\0"}

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            code = int(m[1] or m[2], 16)
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else ""
        return plain.get(m[3], m[3])

    return _ESCAPE.sub(one, text)


def unbase64(text: str) -> str | None:
    """Printable text behind base64, or nothing."""
    if len(text) < 8 or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", text):
        return None
    try:
        raw = base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text.rstrip("=")) % 4) if not text.endswith("=") else text.replace("-", "+").replace("_", "/"))
        out = raw.decode("utf-8")
    except ValueError:
        return None
    return out if out.isprintable() else None


def words_of(name: str) -> set[str]:
    parts = [w.lower() for w in _SPLIT.findall(name)]
    return {*parts, *(a + b for a, b in zip(parts, parts[1:])), "".join(parts)}


class Candidate:
    """One value: where it stands (``start`` to ``end`` of the text), what it is called and how it is used."""

    __slots__ = ("end", "name", "start", "use", "value")

    def __init__(self, start: int, end: int, value: str, name: str | None, use: str):
        self.start, self.end, self.value, self.name, self.use = start, end, value, name, use


def _parts(body: str, base: int, name: str | None, comment: bool) -> Iterator[Candidate]:
    """Candidates inside a literal, comment or path that starts at ``base``."""
    if "@" in body and ":" in body:
        for m in _URLAUTH.finditer(body):
            yield Candidate(base + m.start(2), base + m.end(2), m[2], "password", "url_auth")
    if "=" in body and ("?" in body or "&" in body or "/" in body):
        for m in _PARAM.finditer(body):
            yield Candidate(base + m.start(2), base + m.end(2), m[2], m[1], "param")
    if "-u" in body:
        for m in _USER.finditer(body):
            yield Candidate(base + m.start(1), base + m.end(1), m[1], "password", "url_auth")
    if " " in body:
        for m in _HEADER.finditer(body):
            value, use = m[2], "header"
            if m[1].lower() == "basic":
                plain = unbase64(value)
                if plain is None or ":" not in plain:
                    continue
                value = plain.split(":", 1)[1]
            elif comment and value.islower() and value.isalpha():
                continue
            yield Candidate(base + m.start(2), base + m.end(2), value, "authorization", use)
    if (":" in body or "=" in body or comment) and "://" not in body:
        for m in _PAIR.finditer(body):
            if "?" not in body[: m.start()]:
                name = re.sub(r"[^A-Za-z_]+", "_", body[body.rfind("\n", 0, m.start(2)) + 1 : m.start(2)]) if comment else m[1]
                yield Candidate(base + m.start(2), base + m.end(2), m[2], name, "comment" if comment else "pair")
    if comment and ("/" in body[2:] or "|" in body):
        for m in _ACCOUNT.finditer(body):
            yield Candidate(base + m.start(1), base + m.end(1), m[1], "password", "comment")
    for m in _VENDOR.finditer(body):
        yield Candidate(base + m.start(), base + m.end(), m[0], name, "comment" if comment else "whole")


def _named(content: str, back: int, start: int) -> str | None:
    """Name that is given the value at ``start``, looked for back to ``back`` in growing steps."""
    at = start
    while at > back and content[at - 1].isspace():
        at -= 1
    if at > back and content[at - 1] == "(":  # a wrapping call
        at -= 1
        while at > back and (content[at - 1].isalnum() or content[at - 1] == "_"):
            at -= 1
        while at > back and content[at - 1].isspace():
            at -= 1
    if at <= back or content[at - 1] not in "=:>{|?":
        return None
    step = 128
    while True:
        low = max(back, at - step)
        m = _NAME.search(content, low, start)
        if low == back or m and m.start() > low:
            return m[1] if m else None
        step *= 8


def candidates(content: str) -> Iterator[Candidate]:
    """All candidates of a file's text."""
    if "join(" in content:
        for m in _JOINED.finditer(content):
            value = "".join(unescape(a or b) for a, b in _PIECE.findall(m[1]))
            yield Candidate(m.start(), m.end(), value, _named(content, 0, m.start()), "assembled")
    skip = 0
    last = (0, 0)  # the literal before
    callee, args = None, 0  # the call whose arguments so far are literals only, and how many those are
    for m in _LIT.finditer(content):
        start, text = m.start(), m.group()
        if start < skip:
            continue
        comment = text[0] == "/"
        if comment:
            if _interesting(text):
                yield from _parts(text, start, None, True)
                for k in _PEM.finditer(text):
                    yield Candidate(start + k.start(), start + len(text), text, None, "pem")
            continue
        back, gap = last[0], content[last[1] : start]
        flag = _FLAG.fullmatch(content, *last) if gap.strip() == "," else None
        if "(" in gap:
            opened = gap.rindex("(")
            found = _CALLEE.search(gap[:opened].rstrip()) if not gap[opened + 1 :].strip() else None
            callee, args = found[1] if found else None, 0
        elif gap.strip() != ",":
            callee = None
        else:
            args += 1
        last = (start, m.end())
        body = text[1:-1]
        follows = content[m.end() : m.end() + 1] in " \t\r\n+" and _CHAIN.match(content, m.end())
        if len(body) < LEAST and not follows or body.startswith(("./", "../", "data:", "@")) and not follows:
            continue
        if "PRIVATE KEY" in body and (k := _PEM.search(body)):
            yield Candidate(start + 1 + k.start(), m.end() - 1, body, None, "pem")
            continue
        end, use = m.end(), "whole"
        value = unescape(body)
        if follows:
            while nxt := _CHAIN.match(content, end):
                piece = _LIT.match(content, nxt.end())
                if not piece or piece.group()[0] == "/":
                    break
                value += unescape(piece.group()[1:-1])
                end = piece.end()
            skip, use = end, "assembled" if end > m.end() else "whole"
        elif "\\x" in body or "\\u" in body:
            use = "assembled"
        call = callee if args and not flag else None
        name = flag[1] if flag else call or _named(content, back, start)
        if content[max(back, start - 6) : start].rstrip().endswith("atob("):
            plain = unbase64(value)
            if plain:
                pair = re.match(r"([\w-]+)[=:](.{6,})\Z", plain, re.S)
                yield Candidate(start, end, pair[2] if pair else plain, pair[1] if pair else name, "assembled")
            continue
        if " " in value or "/" in value or "=" in value or ":" in value:
            yield from _parts(body, start + 1, name, False)
            if " " in value:
                continue
        if len(value) >= LEAST and "${" not in body:
            if use == "whole":
                use = "flag" if flag else "call" if call else "whole"
            if use == "whole" and name is None and not (_SHAPED.match(value) or _VENDOR.match(value)):
                continue
            yield Candidate(start + 1, end - 1, value, name, use)


def _interesting(comment: str) -> bool:
    return len(comment) > 14 and any(c.isdigit() for c in comment) or "PRIVATE KEY" in comment


class Markov:
    """Character bigrams (printable ASCII, all else one class) with an edge before and after each text."""

    SIZE, EDGE = 97, 96
    _CODE = np.concatenate([np.full(32, 95), np.arange(95), np.full(129, 95)]).astype(np.int64)
    _BARE = _CODE.copy()
    _BARE[[34, 39, 96]] = EDGE

    @classmethod
    def codes(cls, text: str, quotes_are_edges: bool = False) -> np.ndarray:
        return (cls._BARE if quotes_are_edges else cls._CODE)[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]

    @classmethod
    def count(cls, codes: np.ndarray, into: np.ndarray) -> None:
        if codes.size > 1:
            into += np.bincount(codes[:-1] * cls.SIZE + codes[1:], minlength=cls.SIZE * cls.SIZE)

    @classmethod
    def joined(cls, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all values with an edge around each, and where each value's edge stands."""
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        at = np.r_[0, np.cumsum(sizes + 1)]
        codes = np.full(at[-1] + 1, cls.EDGE)
        inside = np.ones(at[-1] + 1, bool)
        inside[at] = False
        codes[inside] = cls.codes("".join(values))
        return codes, at

    @classmethod
    def logs(cls, counts: np.ndarray) -> np.ndarray:
        table = counts.reshape(cls.SIZE, cls.SIZE) + 0.5
        return np.log2(table / table.sum(axis=1, keepdims=True)).ravel()

    @classmethod
    def sums(cls, values: list[str], logs: np.ndarray) -> np.ndarray:
        """Sum of the logs over the whole of each value."""
        codes, at = cls.joined(values)
        return np.add.reduceat(logs[codes[:-1] * cls.SIZE + codes[1:]], at[:-1]) if values else np.zeros(0)


_COMPOUND = frozenset(("apikey", "secretkey", "signingkey", "enckey", "servicekey", "privatekey", "accesskey", "dbpass"))
_LOGIN = frozenset(("login", "authenticate", "connect", "connectas", "signin", "auth", "as"))


@lru_cache(maxsize=100_000)
def _said(name: str | None, use: str) -> tuple[bool, bool, bool, bool, bool]:
    """What an identifier says: a secret, perhaps one, something public, nothing; and whether it is a call that logs in."""
    names = words_of(name) if name else set()
    strong = bool(names & (SECRET - WEAK_KEY)) or bool(_COMPOUND & names) or use == "param" and bool(names & PARAMS)
    return strong, bool(names & WEAK_KEY) and not strong, bool(names & PUBLIC) and not strong, not names, use == "call" and bool(names & _LOGIN)


def _of_path(path: str) -> tuple[bool, bool, bool]:
    low = path.lower()
    return "test" in low or ".spec." in low, "config" in low, any(w in low for w in ("vendor", "third", "node_modules", "deps/", "externals"))


def features(found: list[Candidate], paths: list[tuple[bool, bool, bool]], ratio_logs: np.ndarray) -> np.ndarray:
    """One row a candidate."""
    x = np.zeros((len(found), _N))
    if not found:
        return x
    total = Markov.sums([c.value for c in found], ratio_logs)
    n = np.fromiter((max(1, len(c.value)) for c in found), float, len(found))
    mean = total / (n + 1)
    said = np.array([_said(c.name, c.use) for c in found], float)
    x[:, 0] = 1
    x[:, 1] = mean
    x[:, 2] = np.clip(total / 10, -6, 6)
    x[:, 3] = np.log(n) - 2.5
    x[:, 4:9] = said
    x[:, 9:13] = mean[:, None] * said[:, :4]
    x[:, 13] = [c.use == "assembled" for c in found]
    x[:, 14:17] = paths
    return x


def _mixed(value: str) -> bool:
    return any(ch.isdigit() for ch in value) and any(ch.isalpha() for ch in value)


def denied(c: Candidate) -> bool:
    """The exact check after the model: placeholders, prose, plain words, digests under their algorithm's name and uuids are no credentials."""
    v = c.value
    return c.use != "pem" and (bool(_PLACEHOLDER.search(v)) or " " in v or bool(_WORDY.match(v)) or bool(_DIGEST.match(v)) or bool(_UUID.match(v)) and not _said(c.name, c.use)[0])


def weak_label(c: Candidate) -> int | None:
    """1, 0, or nothing where the patterns do not decide."""
    if c.use != "pem" and (_UUID.match(c.value) or _DIGEST.match(c.value) or c.name and _HEX.match(c.value) and HASHES & words_of(c.name)):
        return 0
    if c.use != "pem" and (_PLACEHOLDER.search(c.value) or " " in c.value):
        return None
    if c.use == "pem" or _VENDOR.match(c.value):
        return 1
    if _WORDY.match(c.value) or c.value.isalpha():
        return 0
    if c.use in ("url_auth", "header", "assembled") and _mixed(c.value):
        return 1
    if c.use == "call" and _said(c.name, c.use)[4] and _mixed(c.value):
        return 1
    return None


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 30, pull: float = 1.0) -> np.ndarray:
    """Newton steps of logistic regression on rows that stand for ``n`` equal ones, from zero and pulled towards zero."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(x.shape[1]), x.T @ (n * (y - p)) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities on held-out rows (smoothed targets)."""
    pos, neg = float((n * y).sum()), float((n * (1 - y)).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab, design = np.array([1.0, 0.0]), np.c_[margin, np.ones(len(y))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (n * (target - p)) - 1e-3 * (ab - np.array([1.0, 0.0])))
        ab = ab + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


class Model:
    """Log-ratio table, weights and calibration; small, pickled to the workers."""

    def __init__(self, ratio_logs: np.ndarray, weights: np.ndarray | None, slope: float = 1.0, offset: float = 0.0):
        self.ratio_logs, self.weights, self.slope, self.offset = ratio_logs, weights, slope, offset

    def scores(self, found: list[Candidate], paths: list[tuple[bool, bool, bool]]) -> np.ndarray:
        """Calibrated scores; 0 for what the exact check denies, or where nothing could be learned."""
        if self.weights is None or not found:
            return np.zeros(len(found))
        margin = features(found, paths, self.ratio_logs) @ self.weights
        p = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))
        for i in np.flatnonzero(p >= CUT):
            if denied(found[i]):
                p[i] = 0.0
        return p

    def spans(self, texts: list[tuple[str | None, str]], whole: bool = True) -> list[list[tuple[int, int, float]]]:
        """Credentials ``(start, end, score)`` of each ``(text, path)``, the best of overlapping ones. Without ``whole`` the texts are paths themselves."""
        found, owner, flags = [], [], []
        for i, (text, path) in enumerate(texts):
            of = _of_path(path)
            for c in candidates(text) if whole and text else (c for c in _parts(text or "", 0, None, False) if c.use in ("url_auth", "param")):
                found.append(c)
                owner.append(i)
                flags.append(of)
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        p = self.scores(found, flags)
        kept = [(owner[i], found[i].start, -float(p[i]), found[i].end) for i in np.flatnonzero(p >= CUT)]
        for i, s, minus, e in sorted(kept):
            if not out[i] or s >= out[i][-1][1]:
                out[i].append((s, e, -minus))
        return out


def _sample(files: DataFrame) -> DataFrame:
    total = files.count()
    rate = min(1.0, SAMPLE_FILES / max(1, total))
    rows = files.where("content IS NOT NULL AND file_id IS NOT NULL").select("file_id", "relative_path", "content")
    if rate < 1.0:
        rows = rows.where(F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
    return rows.limit(2 * SAMPLE_FILES)


def _ordinary(files: DataFrame) -> np.ndarray:
    """Bigram counts over the whole text of all files (a map-only pass and one small aggregate); quotes count as edges."""
    size = Markov.SIZE * Markov.SIZE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            Markov.count(Markov.codes("\n".join(t for t in batch.column(0).to_pylist() if t), True), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "n"])

    counts = np.zeros(size)
    for r in files.where("content IS NOT NULL").select("content").mapInArrow(count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return counts


def _labelled(files: DataFrame) -> list:
    """``value, name, use, path, y, held, n`` of the labelled candidates of the sample, the most frequent ``SAMPLE_ROWS``; equal ones are one row."""
    schema = "value string, name string, use string, test boolean, config boolean, third boolean, y int, held boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string()] * 3 + [pa.bool_()] * 3 + [pa.int32(), pa.bool_()]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fid, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                of = _of_path(path or "")
                for c in candidates(content):
                    y = weak_label(c)
                    if y is not None:
                        out.append((c.value.encode("utf-8", "replace").decode(), c.name, c.use, *of, y, fid % 5 == 0))
            columns = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = _sample(files).mapInArrow(label, schema).groupBy(*names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *names).limit(SAMPLE_ROWS).collect()
    return sorted(rows, key=lambda r: (r["held"], r["y"], r["use"], r["value"], r["name"] or "", r["test"], r["config"], r["third"]))


def train(files: DataFrame, without: tuple[str, ...] = ()) -> Model:
    """The model, fitted on the bounded sample; ``without`` names features left out (for ablation)."""
    ordinary = _ordinary(files)
    rows = _labelled(files)
    found = [Candidate(0, 0, r["value"], r["name"], r["use"]) for r in rows]
    y, held, n = (np.array([r[c] for r in rows], t) for c, t in (("y", float), ("held", bool), ("n", float)))
    secret = np.zeros(Markov.SIZE * Markov.SIZE)
    own = [c.value for c, a, b in zip(found, y, held) if a and not b]
    if not own or not ((y == 0) & ~held).any():
        return Model(secret, None)
    Markov.count(Markov.joined(own)[0], secret)
    ratio_logs = Markov.logs(secret) - Markov.logs(ordinary)
    x = features(found, [(r["test"], r["config"], r["third"]) for r in rows], ratio_logs)
    x[:, [FEATURES.index(f) for f in without]] = 0
    weights = fit(x[~held], y[~held], n[~held])
    weights[[FEATURES.index(f) for f in without]] = 0
    slope, offset = calibrate(x[held] @ weights, y[held], n[held]) if held.any() else (1.0, 0.0)
    return Model(ratio_logs, weights, slope, offset)


def spans(files: DataFrame, model: Model | None = None) -> DataFrame:
    """``file_id, line_index, start_offset, end_offset, score`` of every credential; those in the path have line -1 and offsets in the path."""
    model = model or train(files)
    schema = "file_id bigint, line_index int, start_offset int, end_offset int, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            fids, paths, relatives, contents = (c.to_pylist() for c in batch.columns)
            for fid, found in zip(fids, model.spans([(p if p and ("@" in p or "=" in p) else None, "") for p in paths], False)):
                out.extend((fid, -1, s, e, p) for s, e, p in found)
            for fid, content, found in zip(fids, contents, model.spans([(c, r or "") for c, r in zip(contents, relatives)])):
                if found:
                    ends = [i for i, ch in enumerate(content) if ch == "\n"]
                    out.extend((fid, bisect.bisect_left(ends, s), s, e, p) for s, e, p in found)
            columns = zip(*out) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["file_id", "line_index", "start_offset", "end_offset", "score"])

    return files.where("file_id IS NOT NULL").select("file_id", "path", "relative_path", "content").mapInArrow(run, schema)


def redact(content: str, found: list[tuple[int, int, float]]) -> str:
    """``content`` with the characters of each credential masked, line ends and everything around kept."""
    out, at = [], 0
    for s, e, _ in found:
        out += [content[at:s], re.sub(r"(?<!\\)[A-Za-z0-9+/=_@#$%^&!?.~-]", "*", content[s:e]) if "\n" in content[s:e] or "'" in content[s:e] or '"' in content[s:e] else "*" * (e - s)]
        at = e
    return "".join([*out, content[at:]])


def redacted(files: DataFrame, model: Model | None = None) -> DataFrame:
    """``file_id, path, content, n_redacted`` of every row of the files, credentials masked in both; the count is that of both."""
    model = model or train(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, relatives, contents = (batch.column(i).to_pylist() for i in (1, 2, 3))
            inside = model.spans([(c, r or "") for c, r in zip(contents, relatives)])
            along = model.spans([(p if p and ("@" in p or "=" in p) else None, "") for p in paths], False)
            texts = [redact(c, f) if f else c for c, f in zip(contents, inside)]
            masked = [redact(p, f) if f else p for p, f in zip(paths, along)]
            counts = [len(a) + len(b) for a, b in zip(inside, along)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masked, pa.string()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["file_id", "path", "content", "n_redacted"])

    return files.select("file_id", "path", "relative_path", "content").mapInArrow(run, "file_id bigint, path string, content string, n_redacted int")


def found(files: DataFrame) -> DataFrame:
    """``file_id, line_index`` of every line where a credential begins; -1 for the path."""
    return spans(files).select("file_id", "line_index").distinct()
