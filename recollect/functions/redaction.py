"""Redaction of secrets: rules claim spans of a text in turn, and each claimed span becomes `[REDACTED:rule]`."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule names, prefixes of provider tokens and the kind of body behind each, in order of priority.
PREFIXES = (
    ("aws-access-key", "AKIA", "token"),
    ("github-pat", "ghp_", "token"),
    ("github-fine-pat", "github_pat_", "token"),
    ("openai-key", "sk-", "token"),
    ("google-api-key", "AIza", "token"),
    ("slack-token", "xoxb-", "token"),
    ("slack-token", "xoxp-", "token"),
    ("private-key-header", "-----BEGIN", "line"),
    ("jwt", "eyJ", "dotted"),
    ("sendgrid", "SG.", "dotted"),
    ("huggingface-token", "hf_", "base62"),
    ("tailscale-key", "tskey-", "token"),
    ("gitlab-pat", "glpat-", "token"),
    ("github-token", "gho_", "base62"),
    ("github-token", "ghu_", "base62"),
    ("github-token", "ghs_", "base62"),
    ("github-token", "ghr_", "base62"),
    ("stripe-key", "sk_live_", "base62"),
    ("stripe-key", "rk_live_", "base62"),
    ("npm-token", "npm_", "base62"),
    ("pypi-token", "pypi-", "token"),
    ("age-secret-key", "AGE-SECRET-KEY-1", "token"),
    ("slack-token", "xapp-", "token"),
    ("supabase-token", "sbp_", "base62"),
    ("docker-pat", "dckr_pat_", "token"),
    ("digitalocean-token", "dop_v1_", "base62"),
)
# Words that give a hex value its meaning, and the limits of the rules.
KEY_WORDS = ("secret", "token", "key", "apikey", "password", "passwd", "pwd", "auth", "credential", "cred")
LEAST_PREFIXED, LEAST_HEX, LEAST_ENTROPY, LEAST_DENIED, ENTROPY_BITS, MAX_PASSES, CAPTURE_BYTES, MAX_FIELD = 20, 32, 20, 4, 4.3, 8, 512, 1 << 20
OTHER_RULES = ("denylist", "machine-token", "connection-string-password", "hex-secret", "high-entropy")

_WS = r"\p{White_Space}"
_WORD = r"\p{Alphabetic}\p{N}"
_BODY = {"token": rf"[{_WORD}._\-+/=]*+", "dotted": rf"[{_WORD}._\-+/=]*+", "base62": r"[A-Za-z0-9]*+", "line": r"[^\n]*+"}
_PREFIXED = [(rule, prefix, kind, regex.compile(rf"""(?<![^{_WS}"'`(){{}}\[\]:,;=<>?&/@]){regex.escape(prefix)}{_BODY[kind]}""")) for rule, prefix, kind in PREFIXES]
_MACHINE = regex.compile(r"(?<![A-Za-z0-9_])me_[A-Za-z0-9]{32}(?![A-Za-z0-9_])")
_LINK = regex.compile(r"://[A-Za-z0-9\-._~:/?#\[\]@!$&*+=%]*+")
_AUTHORITY = regex.compile(rf"[^/?#{_WS}]*+")
_HEX = regex.compile(r"[0-9A-Fa-f]{32,}+")
_CONTEXT = regex.compile(rf"""(?r)(?P<word>[{_WORD}_]+)[{_WS}=:"'`]*""")
_SPLIT = rf"""{_WS}"'`{{}}\[\](),:;="""
_DENSE = regex.compile(rf"(?<![^{_SPLIT}])[A-Za-z0-9+/_\-]{{20,}}+(?![^{_SPLIT}])")
_PLACEHOLDER = regex.compile(r"\[REDACTED:[^\]]*\]")
_KNOWN = {f"[REDACTED:{rule}]" for rule in (*(p[0] for p in PREFIXES), *OTHER_RULES)}
_SCHEME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-"


def entropy(token: str) -> float:
    """Shannon entropy of the bytes, in bits."""
    raw = token.encode()
    return -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values()) if raw else 0.0


def is_key(word: str) -> bool:
    """A part of the word between underscores is a key word."""
    return any(part.isascii() and part.lower() in KEY_WORDS for part in word.split("_"))


class _Claims:
    """Spans claimed so far; the first claim of a character stands."""

    def __init__(self, size: int):
        self.spans: list[tuple[int, int, str]] = []
        self.taken = bytearray(size)

    def add(self, start: int, end: int, rule: str) -> None:
        if start < end and self.taken.find(1, start, end) < 0:
            self.spans.append((start, end, rule))
            self.taken[start:end] = b"\1" * (end - start)


def _links(text: str) -> tuple[list[int], bytearray]:
    """Where links begin, and a mask of their published parts: what follows the scheme, or the user if there is one."""
    starts, quiet, last = [], bytearray(len(text)), 0
    for m in _LINK.finditer(text):
        at, end = m.start(), m.end()
        head = text[last:at]
        run = head[len(head.rstrip(_SCHEME)) :].lstrip("0123456789+.-")
        begin = at - len(run)
        if not run and head.endswith("]"):
            begin = next((at - len(p) for p in _KNOWN if text.endswith(p, 0, at)), at)
        if begin < at:
            user = _AUTHORITY.match(text, at + 3, end).group().rfind("@")
            body = at + 3 + max(user, 0)
            starts += [begin] if user < 0 else [begin, body]
            quiet[body:end] = b"\1" * (end - body)
        last = end
    return starts, quiet


def _denied(text: str, deny: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Merged places of the literals, outside of placeholders."""
    held = bytearray(len(text))
    for m in _PLACEHOLDER.finditer(text):
        held[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    places = sorted(m.span() for word in deny if len(word.encode()) >= LEAST_DENIED for m in regex.finditer(regex.escape(word), text) if held.find(1, *m.span()) < 0)
    while places:
        start, end = places.pop(0)
        while places and places[0][0] < end:
            end = max(end, places.pop(0)[1])
        yield start, end


def find(text: str, deny: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the secrets of a text, in its order. What a link publishes is left alone, but for machine
    tokens and passwords."""
    claims = _Claims(len(text))
    starts, quiet = _links(text)
    for start, end in _denied(text, deny) if deny else ():
        claims.add(start, end, "denylist")
    for m in _MACHINE.finditer(text):
        claims.add(*m.span(), "machine-token")
    for rule, prefix, kind, pattern in _PREFIXED:
        if prefix not in text:
            continue
        for m in pattern.finditer(text, overlapped=True):
            start, end = m.span()
            if kind == "line":
                end = min([end - (text[start:end].endswith("\r")), *(s for s in starts if s > start)])
            elif len(m.group().encode()) < LEAST_PREFIXED or (kind == "dotted" and "." not in m.group()[len(prefix) :]):
                continue
            if not quiet[start]:
                claims.add(start, end, rule)
    at = text.find("://")
    while at >= 0:
        m = _AUTHORITY.match(text, at + 3)
        user, _, _ = m.group().rpartition("@")
        colon = user.find(":")
        if colon >= 0:
            claims.add(at + 3 + colon + 1, at + 3 + len(user), "connection-string-password")
        at = text.find("://", at + 3)
    for m in _HEX.finditer(text):
        near = _CONTEXT.match(text, text.rfind("\n", 0, m.start()) + 1, m.start())
        if near and is_key(near["word"]) and not quiet[m.start()]:
            claims.add(*m.span(), "hex-secret")
    for m in _DENSE.finditer(text):
        token = m.group()
        if not token.isalpha() and not quiet[m.start()] and entropy(token) >= ENTROPY_BITS:
            claims.add(*m.span(), "high-entropy")
    return sorted(claims.spans)


def redact_once(text: str, deny: tuple[str, ...] = ()) -> tuple[str, list[str]]:
    """(text, rules) of one pass."""
    spans, out, at = find(text, deny), [], 0
    for start, end, rule in spans:
        out += [text[at:start], f"[REDACTED:{rule}]"]
        at = end
    return "".join([*out, text[at:]]), [rule for _, _, rule in spans]


def redact(text: str, deny: tuple[str, ...] = ()) -> str:
    """Passes until one changes nothing; a text that does not settle in MAX_PASSES is an error, and must not be stored."""
    for _ in range(MAX_PASSES):
        new, _rules = redact_once(text, deny)
        if new == text:
            return text
        text = new
    raise ValueError("the redaction did not settle")


def redact_column(text: Column, deny: tuple[str, ...] = ()) -> Column:
    """Redacted texts; one that does not settle becomes null, so that it is not stored and the job goes on."""

    def settled(t: str | None) -> str | None:
        try:
            return t if t is None else redact(t, deny)
        except ValueError:
            return None

    return F.pandas_udf(lambda s: s.map(settled), "string")(text)


def rules_column(text: Column, deny: tuple[str, ...] = ()) -> Column:
    """Rules that the first pass meets, one entry a secret; for counters."""
    return F.pandas_udf(lambda s: s.map(lambda t: t if t is None else redact_once(t, deny)[1]), "array<string>")(text)


def redact_hex(text: Column) -> Column:
    """The hex-in-context rule alone, as an expression over ASCII words."""
    return F.regexp_replace(text, HEX_RULE, "$1[REDACTED:hex-secret]")


HEX_RULE = r"""((?:^|[^0-9A-Za-z_])(?:[0-9A-Za-z]*_)*(?i:""" + "|".join(KEY_WORDS) + r""")(?:_[0-9A-Za-z]*?)*?[ \t=:"'`]*)([0-9A-Fa-f]{32,})"""


def redact_json(value: object, under: str = "") -> object:
    """Redacts every text of a JSON value; a hex value under a key word goes as a whole."""
    if isinstance(value, dict):
        return {k: redact_json(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_json(v) for v in value]
    if not isinstance(value, str):
        return value
    last = regex.search(rf"(?r)[{_WORD}_]*$", under).group()
    return "[REDACTED:hex-secret]" if _HEX.fullmatch(value) and is_key(last) else redact(value)


def excerpt(text: str) -> str:
    """Redacted, then cut to CAPTURE_BYTES between characters; cut and redacted again until nothing changes."""
    out = redact(text).encode()[:CAPTURE_BYTES].decode("utf-8", "ignore")
    for _ in range(MAX_PASSES):
        new = redact(out)
        if new == out:
            return out
        out = new.encode()[:CAPTURE_BYTES].decode("utf-8", "ignore")
    raise ValueError("the redaction did not settle")


def capture(args: str | None, result: str | None, sensitive: str | None = None) -> tuple[str, str | None, bool]:
    """(args, result, stub) of a tool call as stored. A call on the sensitive path `sensitive` keeps that path only; a
    field over MAX_FIELD is not read but marked."""
    if sensitive is not None:
        return json.dumps({"sensitive_path": excerpt(sensitive)}), None, True
    if len((args or "").encode()) > MAX_FIELD:
        kept = json.dumps("[omitted: over 1 MiB]")
    else:
        kept = json.dumps(redact_json(json.loads(args or "null")), separators=(",", ":"), ensure_ascii=False)
        kept = kept if len(kept.encode()) <= CAPTURE_BYTES else json.dumps(excerpt(kept), ensure_ascii=False)
    if result is not None:
        size = len(result.encode())
        result = excerpt(result) if size <= MAX_FIELD else f"[omitted: {size} bytes]"
    return kept, result, False


def capture_column(args: Column, result: Column, sensitive: Column) -> Column:
    """struct<args, result, stub> of captured calls; `sensitive` is the sensitive path a call touched, or null."""

    def run(a: pd.Series, r: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([capture(*(None if pd.isna(x) else x for x in row)) for row in zip(a, r, s)], columns=["args", "result", "stub"])

    return F.pandas_udf(run, "args string, result string, stub boolean")(args, result, sensitive)
