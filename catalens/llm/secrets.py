"""Credentials embedded in source code, configuration and notes (problem 3).

Method. Each line is lexed into tokens (strings, words, addresses with a user part, references, key markers, operators). A
linear-chain conditional random field labels every token as secret or not, from its shape, its characters, the names
to its left (the key it is assigned to, also the key of the line above for "value:" lines) and its neighbours. The
Viterbi path decides which literal characters are masked; quotes, operators and all other characters stay, so the
content remains well-formed. If the field labels the marker that opens a private key, the key reaches to its closing
marker, however long its lines are, and counts at its first line.

The field is trained here, on lines that a generator writes and labels (``examples``, a bounded and documented number
of lines); no content of the tables is used for training. ``python -m catalens.llm.secrets`` trains it and writes its
weights to ``credential_field.json``, which the operator reads; a test trains it again and compares.

Every line is lexed and scored. Where no token's score outweighs what a run of secrets can gain from the transitions, the
Viterbi path holds no secret and is not computed; that changes no result.

Defined results: null and empty content gives no row; repeated rows of a file give one row for a line; content is read
whole; lines are separated by \\n and counted from 1, a trailing \\r belongs to the line's end and is kept.
"""

from __future__ import annotations

import json
import math
import os
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.session import spread

STEMS_POS = ("password", "passwd", "passphrase", "passwort", "pass", "pwd", "pw", "secret", "token", "apikey", "key", "credential", "credentials", "auth", "authorization", "bearer", "basic", "kennwort", "passe", "clave", "contrasena", "login", "signing", "webhook", "private")
#: Names that end with one of these once the signs between their words are gone.
JOINED_POS = ("apikey", "password", "passwd", "secret", "token", "kennwort", "passwort", "motdepasse", "pw", "pwd")
JOINED_FIRST = ("clave", "contrasena", "kennwort", "motdepasse", "passw")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: A line that may belong to a key whose closing marker is missing: one run of its signs, of any length, or a header of the armour.
KEY_LINE = re.compile(r"[\s#*/\-\"'+,;]*(?:[A-Za-z0-9+/=]*|[A-Z][A-Za-z\-]{3,20}: \S.*)[\"',;+\\\s]*")
LEX = re.compile(
    r"""(?P<url>\b[a-z][a-z0-9+.\-]*://[^\s:/@'"<>]*:)(?P<pw>[^\s@'"]+)(?=@)"""
    r"""|(?P<pem>-----(?:BEGIN|END) [A-Z0-9 ]+-----)"""
    r"""|(?P<ref>\$\{[^}\s]*\}|\$\([^)\s]*\)|\{\{[^}]*\}\}|%[A-Z_]+%)"""
    r"""|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<tag></?[A-Za-z][\w:.\-]*(?=[\s/>]))"""
    r"""|(?P<link>\b[a-z][a-z0-9+.\-]*://[^\s'"<>,;)]+)"""
    r"""|(?P<word>[^\s'"=:,;(){}\[\]<>|]+(?:==(?=[\s,;)<]|$)|=(?=[,;)<]|$))?)"""
    r"""|(?P<op>:=|=>|==|->|\|\||.)""",
    re.S,
)
STEMS_NEG = ("sha", "sha256", "sha1", "md5", "digest", "checksum", "hash", "etag", "commit", "revision", "build", "job", "trace", "icon", "integrity", "sri", "subresource", "fingerprint", "public", "cert", "certificate", "id", "uuid", "type", "ttl", "name", "path", "column", "length", "min", "max", "bindings", "header", "count", "field", "url", "file", "expiry", "version", "layer", "layerhash", "gitsha", "jobid", "traceid", "buildid", "prompt", "label", "policy", "rotation", "mode", "size", "format", "ref", "keyid")
PLACEHOLDERS = ("example", "sample", "todo", "tbd", "fixme", "changeme", "change_me", "replace_me", "replaceme", "none", "null", "nil", "true", "false", "undefined", "empty", "dummy", "test", "password", "passwd", "secret", "token", "redacted", "placeholder", "default", "unset", "xxx", "foo", "bar", "insert", "your", "here", "bearer", "basic", "string", "optional", "required")


# ---------------------------------------------------------------- tokens and features


def lex(line: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each token; strings without blanks are one token between their quotes, others are lexed inside."""
    out: list[tuple[int, int, str]] = []

    def walk(lo: int, hi: int, depth: int) -> None:
        for m in LEX.finditer(line, lo, hi):
            kind = m.lastgroup
            if kind == "pw":
                out.append((m.start("url"), m.end("url"), "url"))
                out.append((m.start("pw"), m.end("pw"), "pw"))
            elif kind == "str" and depth < 3:
                a, b = m.start() + 1, m.end() - 1
                out.append((m.start(), a, "q"))
                inner = line[a:b]
                if inner and not re.search(r"\s|://[^/\s]*:[^/\s]*@|-----|\\[\"']", inner):
                    out.append((a, b, "s"))
                elif inner:
                    walk(a, b, depth + 1)
                out.append((b, m.end(), "q"))
            elif not (kind == "op" and m.group().isspace()):
                out.append((m.start(), m.end(), "op" if m.group() in ("+", ".") else kind))

    walk(0, len(line), 0)
    return out


def subwords(name: str) -> list[str]:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return [w.lower() for w in re.split(r"[\W_]+", name) if w]


@lru_cache(maxsize=100_000)
def key_class(name: str) -> str:
    """P: names a credential, N: names something else, M: something about a credential, O: neither."""
    words = subwords(name)
    joined = "".join(words)
    pos = any(w in STEMS_POS for w in words) or joined.endswith(JOINED_POS) or joined.startswith(JOINED_FIRST)
    neg = any(w in STEMS_NEG for w in words) or joined in ("requestid", "sessionid")
    return "M" if pos and neg else "P" if pos else "N" if neg else "O"


def shape(text: str) -> str:
    """A coarse class of what a value looks like."""
    t, n = text, len(text)
    if re.fullmatch(r"[*xX.\-_#?•]+", t) or not t:
        return "mask"
    if re.fullmatch(r"<[^<>]*>|\$\{?\w[\w.]*\}?|\{+[^{}]*\}+|%\w+%|\$\([^)]*\)", t):
        return "ref"
    if re.match(r"(?:env|file|ref\+\w+|vault|secret|ssm|arn|op)(?::|$)|process\.env|os\.environ|/(?:run|etc|var|usr|home|srv|opt)/", t):
        return "ref"
    if re.fullmatch(r"[-+]?\d+(?:[.,]\d+)*", t):
        return "num"
    if t.startswith("data:"):
        return "data"
    if re.match(r"sha\d+-", t):
        return "sri"
    if t.startswith(("AAAAC3Nza", "AAAAB3Nza", "AAAAE2Vj", "ssh-")):
        return "sshpub"
    if re.fullmatch(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", t, re.I):
        return "uuid"
    if re.fullmatch(r"(?:[0-9a-f]{2}:){7,}[0-9a-f]{2}", t, re.I):
        return "fp"
    if t.startswith("eyJ") and n > 20:
        return "jwt"
    if re.match(r"[a-z][a-z0-9+.\-]*://", t):
        return "link"
    if re.fullmatch(r"[0-9a-f]+", t) and n >= 24:
        return "hex"
    if re.fullmatch(r"(?=.*\d)[A-Z0-9]{16,}", t):
        return "upid"
    if re.fullmatch(r"[A-Za-z]{2,6}\d{0,2}(?:[_.\-][a-z]{2,8})?[_.\-](?=[\w\-.]*\d)(?=[\w\-.]*[A-Z])[\w\-.]{10,}", t):
        return "prefixed"
    if re.fullmatch(r"[A-Za-z0-9+/_\-]{16,}={0,2}", t) and re.search(r"\d", t) and re.search(r"[A-Z]", t) and re.search(r"[a-z]", t):
        return "b64"
    if re.fullmatch(r"[A-Za-z0-9+/]{6,}={1,2}", t):
        return "b64pad"
    if re.fullmatch(r"[a-z]+(?:-[a-z]+)+-\d+", t, re.I):
        return "phrase"
    if re.fullmatch(r"[A-Za-z]{3,}[_.][A-Za-z]{3,}\d{1,4}", t):
        return "phrase"
    if re.fullmatch(r"[A-Za-z]{3,}\d{2,4}", t):
        return "worddigits"
    if re.fullmatch(r"[a-z]+", t):
        return "lower"
    if re.fullmatch(r"[A-Z][A-Z_]*", t):
        return "upper"
    if re.fullmatch(r"[A-Za-z]+", t):
        return "alpha"
    if re.fullmatch(r"[A-Za-z_][\w]*(?:[.\-][A-Za-z_]\w*)+|[a-z]+(?:_[a-z0-9]+)+|[A-Z]+(?:_[A-Z0-9]+)+", t):
        return "name"
    if re.search(r"\d", t) and re.search(r"[A-Za-z]", t):
        return "mixsign" if re.search(r"[^A-Za-z0-9._/\-]", t) else "mix"
    return "other" if re.search(r"\w", t) else "punct"


def _entropy(t: str) -> float:
    n = len(t)
    return -sum(c / n * math.log2(c / n) for c in (t.count(x) for x in set(t)))


def _placeholder(t: str) -> bool:
    return any(w in PLACEHOLDERS for w in subwords(t))


@lru_cache(maxsize=200_000)
def _own(text: str, kind: str) -> tuple[str, tuple[str, ...]]:
    sh = shape(text)
    f = [f"sh={sh}", f"kind={kind}"]
    if sh not in ("hex", "b64", "b64pad", "jwt", "link"):
        f.append(f"len={min(len(text), 63) // 4}")
    if _placeholder(text):
        f.append("ph")
    if sh not in ("punct", "lower", "alpha", "num", "hex", "b64", "uuid", "sri", "data"):
        f.append(f"ent={int(_entropy(text) * 2)}")
        if re.search(r"[!?%$#*+=@&^~]", text):
            f.append("sign")
        if re.search(r"[a-z]", text) and re.search(r"[A-Z]", text) and re.search(r"\d", text):
            f.append("three")
    if len(text) <= 3:
        f.append(f"t={text.lower()}")
    if kind == "pem":
        f += [f"m={w}" for w in text.strip("-").lower().split()] + (["m=opens private"] if PRIVATE_BEGIN.fullmatch(text) else [])
    return sh, tuple(f)


OPAQUE_SHAPES = ("jwt", "prefixed", "upid", "b64", "mix")


def _named(text: str, kind: str, sh: str) -> str:
    """The name that a token is for those after it, empty if it is none."""
    if kind not in ("word", "s", "tag", "url") or not (sh in ("lower", "upper", "alpha", "name", "mix", "other", "worddigits") or sh == "ref" and text.startswith(("$", "process.env."))):
        return ""
    return text.strip("-$<@/") if re.fullmatch(r"[-$<@/]*[A-Za-z_][\w.\-]*:?(?://[^:]*:)?", text) else ""


def _context_features(near: str, first: str, dist: int, sh: str, ph: str) -> tuple[str, ...]:
    """``near``: class of the nearest name; ``first``: the nearest class that tells something, ``dist`` names away."""
    return f"k={near}", f"k+sh={near}|{sh}", f"K={first}{dist}|{sh}", f"Kc={first}|{sh}|{ph}"


def features(line: str, tokens: list[tuple[int, int, str]], above: str = "") -> list[list[str]]:
    """``above``: the name that a "value:" line belongs to, taken from the line above."""
    out: list[list[str]] = []
    names: list[str] = []  # identifiers so far, nearest last
    prev_sh, prev_text, joined, value = "BOS", "", "", ""
    for a, b, kind in tokens:
        text = line[a:b]
        sh, own = _own(text, kind)
        f = list(own)
        classes = [key_class(x) for x in names[-6:][::-1]]
        near = classes[0] if classes else "-"
        first = next(((c, min(i, 4)) for i, c in enumerate(classes) if c != "O"), ("-", 0))
        if near == "O" and names[-1].lower() in ("value", "v", "val", "data") and above:
            near, first = f"^{key_class(above)}", (f"^{key_class(above)}", 0)
        f += _context_features(near, *first, sh, "ph" if "ph" in own else "")
        if names:
            f += [f"w={w}|{sh}" for w in subwords(names[-1])[-2:]]
        f += [f"p={prev_text if prev_sh == 'punct' else prev_sh}|{sh}"]
        if joined:
            f.append(f"join={joined}|{sh}")
        out.append(f)
        if new := _named(text, kind, sh):
            names.append(new)
        # a string that is continued after + or . : the first part's shape tells about the second
        if kind == "s":
            value, joined = ("opaque" if sh in OPAQUE_SHAPES else sh), ""
        elif kind == "op" and text in "+.":
            joined = value
        elif kind != "q":
            value = joined = ""
        if not (kind == "q" and prev_sh == "punct"):
            prev_sh, prev_text = ("punct" if kind in ("q", "op") else sh), text
    return out


# ---------------------------------------------------------------- the random field


class Field:
    """A linear chain with two labels. ``weights``: feature -> score for secret over no secret."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray):
        self.weights, self.transitions = weights, np.asarray(transitions, float)
        t = self.transitions
        # what a run of secrets of any length gains from transitions: so much for each token, and so much once
        self.slack = max(0.0, float(t[1, 1] - t[0, 0])) + max(0.0, *(float(x) for x in (t[0, 1] + t[1, 0] - t[1, 1] - t[0, 0], t[1, 0] - t[1, 1], t[0, 1] - t[1, 1], t[0, 0] - t[1, 1])))
        self.caches: tuple[dict, ...] = ({}, {}, {}, {})

    def scores(self, feats: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in fs]) for fs in feats]

    def decode(self, feats: list[list[str]]) -> list[int]:
        return self.path(self.scores(feats))

    def path(self, s: list[float]) -> list[int]:
        """Viterbi path; label 1 is a secret."""
        if not s:
            return []
        (t00, t01), (t10, t11) = self.transitions.tolist()
        a, b = 0.0, s[0]
        back: list[tuple[int, int]] = []
        for x in s[1:]:
            stay, drop, enter, keep = a + t00, b + t10, a + t01, b + t11
            back.append((int(drop > stay), int(keep > enter)))
            a, b = max(stay, drop), max(enter, keep) + x
        path = [int(b > a)]
        for p in reversed(back):
            path.append(p[path[-1]])
        return path[::-1]

    def line_scores(self, line: str, tokens: list[tuple[int, int, str]], above: str = "") -> list[float]:
        """The scores of ``features``, added up from sums that are kept for tokens, contexts, names and neighbours."""
        own, context, named, beside = self.caches
        get = self.weights.get
        for cache in self.caches:
            if len(cache) > 300_000:
                cache.clear()
        out = []
        name, classes, told = "", [], -1  # told: the last name that is not of class O
        prev, joined, value, was_sign = "BOS", "", "", False
        for a, b, kind in tokens:
            text = line[a:b]
            if (got := own.get((text, kind))) is None:
                sh, feats = _own(text, kind)
                got = (sh, "ph" if "ph" in feats else "", sum(get(f, 0.0) for f in feats), _named(text, kind, sh))
                if len(text) <= 64:
                    own[text, kind] = got
            sh, ph, score, new = got
            near = classes[-1] if classes else "-"
            dist = len(classes) - 1 - told
            first, dist = (classes[told], min(dist, 4)) if told >= 0 and dist < 6 else ("-", 0)
            if near == "O" and above and name.lower() in ("value", "v", "val", "data"):
                near = first = f"^{key_class(above)}"
                dist = 0
            key = (near, first, dist, sh, ph)
            if (add := context.get(key)) is None:
                add = context[key] = sum(get(f, 0.0) for f in _context_features(*key))
            score += add
            if classes:
                if (add := named.get((name, sh))) is None:
                    add = named[name, sh] = sum(get(f"w={w}|{sh}", 0.0) for w in subwords(name)[-2:])
                score += add
            if (add := beside.get((prev, joined, sh))) is None:
                add = beside[prev, joined, sh] = get(f"p={prev}|{sh}", 0.0) + (get(f"join={joined}|{sh}", 0.0) if joined else 0.0)
            out.append(score + add)
            if new:
                name = new
                classes.append(key_class(new))
                if classes[-1] != "O":
                    told = len(classes) - 1
            if kind == "s":
                value, joined = ("opaque" if sh in OPAQUE_SHAPES else sh), ""
            elif kind == "op" and text in "+.":
                joined = value
            elif kind != "q":
                value = joined = ""
            if not (kind == "q" and was_sign):
                was_sign = kind in ("q", "op") or sh == "punct"
                prev = text if was_sign else sh
        return out

    def labels(self, line: str, tokens: list[tuple[int, int, str]], above: str = "") -> list[int] | None:
        """The Viterbi path, or None where no token outweighs the path without secrets: that needs no recursion."""
        s = self.line_scores(line, tokens, above)
        return self.path(s) if s and max(s) > -self.slack else None

    def __getstate__(self):
        return {**self.__dict__, "caches": ({}, {}, {}, {})}


def train(lines: list[tuple[str, str, list[tuple[int, int]]]], epochs: int = 16, rate: float = 0.25, decay: float = 2e-4, seed: int = 5, batch: int = 48, least: int = 5) -> Field:
    """Maximum likelihood by AdaGrad over batches of lines; gradients from the forward-backward recursion, computed for all
    lines of a batch at once. lines: (text, name above, secret spans); a feature must occur ``least`` times."""
    read, seen = [], Counter()
    for text, above, spans in lines:
        if toks := lex(text):
            feats = features(text, toks, above)
            read.append((feats, np.array([float(any(a < e and b > s for s, e in spans) and k != "q") for a, b, k in toks])))
            seen.update(f for fs in feats for f in fs)
    index = {f: i for i, f in enumerate(f for f, c in seen.items() if c >= least)}
    data = []
    for feats, y in read:
        ids = [[index[f] for f in fs if f in index] for fs in feats]
        data.append((np.array([i for x in ids for i in x], np.int64), np.repeat(np.arange(len(ids)), [len(x) for x in ids]), y))
    w, g2 = np.zeros(len(index)), np.full(len(index), 1e-8)
    t, gt2 = np.zeros((2, 2)), np.full((2, 2), 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        order = order[np.argsort(np.array([len(data[i][2]) for i in order]) // 6, kind="stable")]  # lines of like length together
        starts = np.arange(0, len(order), batch)
        for at in rng.permutation(starts):
            part = [data[i] for i in order[at : at + batch]]
            size, most = len(part), max(len(y) for *_, y in part)
            ids = np.concatenate([i for i, _, _ in part])
            place = np.concatenate([tok + most * r for r, (_, tok, _) in enumerate(part)])
            y, mask = np.zeros((size, most)), np.zeros((size, most), bool)
            for r, (_, _, v) in enumerate(part):
                y[r, : len(v)], mask[r, : len(v)] = v, True
            s = np.bincount(place, w[ids], size * most).reshape(size, most)
            e = np.stack([np.zeros_like(s), s], 2)
            p = np.exp(e - e.max(2, keepdims=True))
            p[~mask] = 1.0
            m = np.exp(t - t.max())
            fw, bw = np.empty((size, most, 2)), np.ones((size, most, 2))
            fw[:, 0] = p[:, 0] / p[:, 0].sum(1, keepdims=True)
            for i in range(1, most):
                x = (fw[:, i - 1] @ m) * p[:, i]
                fw[:, i] = x / x.sum(1, keepdims=True)
            for i in range(most - 2, -1, -1):
                x = (p[:, i + 1] * bw[:, i + 1]) @ m.T
                bw[:, i] = np.where(mask[:, i + 1, None], x / x.sum(1, keepdims=True), 1.0)
            post = fw * bw
            post /= post.sum(2, keepdims=True)
            diff = np.where(mask, post[:, :, 1] - y, 0.0)
            g = np.bincount(ids, diff.reshape(-1)[place], len(w))
            used = np.flatnonzero(g)
            g = g[used] + decay * w[used]
            g2[used] += g * g
            w[used] -= rate * g / np.sqrt(g2[used])
            if most > 1:
                both = mask[:, 1:]
                pair = fw[:, :-1, :, None] * m * (p[:, 1:] * bw[:, 1:])[:, :, None, :]
                pair /= pair.sum((2, 3), keepdims=True)
                gt = pair[both].sum(0)
                np.subtract.at(gt, (y[:, :-1][both].astype(int), y[:, 1:][both].astype(int)), 1)
                gt2 += gt * gt
                t -= 0.1 * rate * gt / np.sqrt(gt2)
    return Field({f: round(float(w[i]), 4) for f, i in index.items() if abs(w[i]) > 1e-3}, t.round(4))


# ---------------------------------------------------------------- labelled examples


def _word(r: random.Random) -> str:
    return "".join(r.choice(("ba", "lo", "ster", "mi", "kra", "ven", "tul", "or", "pel", "wen", "gra", "zi", "fal", "ri", "dun", "qua", "ko")) for _ in range(r.randint(2, 3)))


def _rand(r: random.Random, n: int, signs: str = "") -> str:
    alphabet = string.ascii_letters + string.digits + signs
    while True:
        s = "".join(r.choice(alphabet) for _ in range(n))
        if n < 8 or (re.search(r"\d", s) and re.search(r"[a-z]", s) and re.search(r"[A-Z]", s)):
            return s


def _b64(r: random.Random, text: str) -> str:
    import base64

    return base64.b64encode(text.encode()).decode()


def _password(r: random.Random) -> str:
    k = r.randrange(8)
    if k == 0:
        return f"{_word(r)}{r.randint(1950, 2025)}"
    if k == 1:
        return "-".join(_word(r) for _ in range(3)) + f"-{r.randint(1, 99)}"
    if k in (2, 7):
        return f"{_word(r).capitalize() if r.random() < 0.6 else _word(r)}{r.choice('!?%$#*+=_')}{_word(r)}{r.randint(1, 999)}"
    if k == 3:
        s = _rand(r, r.randint(9, 17), "")
        i = r.randrange(1, len(s))
        return s[:i] + r.choice("!?%$#*+=_") + s[i:]
    return _rand(r, r.randint(10, 18), r.choice(("", "_", "!?%$#*")))


def _keyed(r: random.Random) -> str:
    """Values that only the key's name tells from checksums."""
    k = r.randrange(5)
    if k < 2:
        return "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64))))
    if k == 2:
        return _rand(r, 40, "+/")
    return _rand(r, r.choice((20, 24, 32)))


def _token(r: random.Random) -> str:
    k = r.randrange(6)
    if k == 0:
        return "AQ" + "".join(r.choice("ABCDEFGHIJ") for _ in range(2)) + "".join(r.choice(string.ascii_uppercase + "234567") for _ in range(14)) + str(r.randint(2, 7)) + r.choice("QXZ")
    if k == 1:
        return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 5))) + "-" + _rand(r, 20)
    if k == 2:
        return "".join(r.choice(string.ascii_lowercase) for _ in range(2)) + f"_{r.choice(('live', 'test', 'prod', 'key'))}_" + _rand(r, r.choice((24, 32)))
    if k == 3:
        return "".join(r.choice(string.ascii_lowercase) for _ in range(2)) + f"{r.randint(0, 9)}." + _rand(r, 22, "-_") + "." + _rand(r, 43, "-_")
    return f"eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.{_rand(r, r.randint(30, 60))}.{_rand(r, 43, '-_')}"


def _opaque(r: random.Random) -> str:
    """A password that its signs alone give away."""
    while True:
        s = _rand(r, r.randint(9, 20), "!?%$#*+=&^~")
        if re.search(r"[!?%$#*+=&^~].*\w", s[1:]) and not re.match(r"[#%$]", s):
            return s


def _argument(r: random.Random, value: str):
    """A call with the secret among its arguments."""
    q = r.choice("\"'")
    form = f"{_name(r)}({q}{_word(r)}{q}, {q}{r.choice(USERS)}{q}, {q}\0{q}{r.choice((')', ');', ', ' + str(r.randint(1, 9999)) + ')'))}"
    at = form.index("\0")
    return form.replace("\0", value), "", [(at, at + len(value))]


def _placeholder_value(r: random.Random) -> str:
    name = r.choice(("DB_PASSWORD", "API_TOKEN", "APP_SECRET", "SMTP_PASS", "TOKEN"))
    return r.choice((
        "example", "changeme", "TODO", "null", "none", "", "xxxxxxxx", "xxxxxxxxxxxx", "********", "****", "your-token", "your-password", "<your-key-here>", "<password>", "<secret>", "REPLACE_ME", "REPLACE_ME", "CHANGE_ME", "dummy", "placeholder",
        f"${{{name}}}", f"${name}", "$SECRET_FROM_ENV", f"%{name}%", f"{{{{ vault.{name.lower()} }}}}", "{{ secrets.db_pw }}", f"env:{name}", "file:/run/secrets/db", "/run/secrets/api", "ref+vault://kv/app#pw", "vault:kv/app#token", "redacted", "test", "true", "{pw}",
    ))


POS_KEYS = ("password", "passwd", "pwd", "pass", "secret", "api_key", "apikey", "auth_token", "access_token", "private_token", "client_secret", "signing_key", "webhook_secret", "db_password", "smtp_pass", "ftp_pw", "kennwort", "mot_de_passe", "clave_api", "passphrase", "encryption_key", "token", "admin_password", "secret_key", "auth_key", "ldap_pass", "passwort", "contrasena", "bot_token", "login_pw")
NEG_KEYS = ("sha256", "digest", "checksum", "etag", "commit", "revision", "git_sha", "build_id", "job_id", "trace_id", "icon", "integrity", "sri", "subresource", "fingerprint", "layer_hash", "public_key", "request_id", "uuid", "image_digest", "object_hash", "md5", "version")
ABOUT = (("token_type", "bearer"), ("token_ttl", "3600"), ("secret_name", "db-main"), ("secret_path", "/run/secrets/db"), ("password_min_length", "12"), ("pwd_column", "user_hash"), ("key_bindings", "ctrl+s"), ("api_key_header", "X-Api-Key"), ("password_field", "login_form"), ("token_count", "128"), ("key_size", "4096"), ("auth_mode", "oauth"), ("secret_rotation", "30d"), ("password_policy", "strict"), ("key_format", "pem"), ("auth_url", "https://id.example/login"))
NEUTRAL = ("remote", "target", "source", "value", "extra", "opt2", "cfg_a", "k", "default_arg", "endpoint", "param", "x", "setting", "item", "url", "dsn", "ref")
HOSTS = ("db.site.example", "mq.intern.test", "queue-1.local.invalid", "store.example", "10.0.0.7")
USERS = ("app", "backup", "loader", "reporter", "svc_index", "admin", "root", "mailer")


def _case(r: random.Random, name: str) -> str:
    w = name.split("_")
    return r.choice((name, name.upper(), w[0] + "".join(x.capitalize() for x in w[1:]), "".join(x.capitalize() for x in w), ".".join(w), "-".join(w), name))


def _assign(r: random.Random, key: str, value: str, secret: bool) -> tuple[str, str, list[tuple[int, int]]]:
    """A line that gives ``value`` to ``key`` in one of many notations."""
    q = r.choice("\"'")
    host = r.choice(HOSTS)
    k = _case(r, key)
    plain = not re.search(r"[\s{}<>]", value) and value != ""
    forms = [f"{k} = {q}\0{q}", f"{k}={q}\0{q}", f"export {k.upper()}={q}\0{q}", f"    {k}: {q}\0{q}", f'  "{k}": "\0",', f'"{k}":"\0",', f"const {k} = {q}\0{q};", f"let {k} = {q}\0{q};", f"${k} = {q}\0{q};",
             f"opts[{q}{k}{q}] = {q}\0{q}", f"conn = connect(host={q}{host}{q}, {key}={q}\0{q})", f"define('{k.upper()}', '\0');", f"process.env.{k.upper()} = process.env.{k.upper()} || {q}\0{q};", f'props.setProperty("{k}", "\0");',
             f'    private static final String {k.upper()} = "\0";', f"ARG {k.upper()}={q}\0{q}", f"ENV {k.upper()}=\0" if plain else f"ENV {k}={q}\0{q}", f"run_job --{key.replace('_', '-')} '\0' --verbose", f"INSERT INTO settings (k, v) VALUES ('{k}', '\0');",
             f'{k} := "\0"', f'    {k}: "\0",', f'  <entry key="{k}" value="\0"/>', f"<{k}>\0</{k}>" if plain else f"<a {k}='\0'/>", f"  {k}: {q}\0{q},", f"{k}: \0" if plain else f"{k}: {q}\0{q}", f"{k} = \0" if plain else f"{k} = {q}\0{q}", f"{k}=\0" if plain else f"{k}={q}\0{q}", f"- {k}: \0" if plain else f"- {k}: {q}\0{q}",
             f"# {k}: \0", f"// {k}: \0", f"The {key.replace('_', ' ')} for {host} is \0", f"set {k} {q}\0{q}"]
    form = r.choice(forms)
    at = form.index("\0")
    line = form.replace("\0", value)
    return line, "", [(at, at + len(value))] if secret and value else []


def _split(r: random.Random, value: str, secret: bool = True):
    key, cut = _case(r, r.choice(NEUTRAL + POS_KEYS if secret else NEG_KEYS)), r.randint(6, max(7, len(value) - 6))
    form = f'{key} {r.choice(("=", ":="))} "{value[:cut]}" {r.choice("+.")} "{value[cut:]}"{r.choice(("", ";"))}'
    a, b = form.index('"') + 1, form.rindex('"')
    return form, "", [(a, a + cut), (b - len(value) + cut, b)] if secret else []


def _name(r: random.Random) -> str:
    """A name as code has it, without a telling part."""
    a, b = _word(r), _word(r)
    return r.choice((a, a, a.capitalize() + b.capitalize(), a + b.capitalize(), f"{a}_{b}", f"{a}.{b}", f"{a}_{r.randint(1, 99)}", f"{a}{r.randint(1, 9)}", f"{a.upper()}_{b.upper()}", f"{a}-{b}", f"_{a}", f"{a}{r.randint(10, 256)}{b.capitalize()}", f"{a.capitalize()}_{b.capitalize()}{r.randint(1, 9)}"))


def _plain_value(r: random.Random) -> str:
    """What files hold besides credentials and checksums."""
    n, a, b = r.randint, _word(r), _word(r)
    return r.choice((
        a, f"{a.capitalize()} {b}", str(n(0, 99999)), f"{n(0, 9)}.{n(0, 20)}.{n(0, 30)}", f"^{n(0, 9)}.{n(0, 20)}.{n(0, 30)}", f">={n(1, 9)}.{n(0, 9)},<{n(9, 12)}", f"{n(1950, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(1950, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}T{n(0, 23):02d}:{n(0, 59):02d}:{n(0, 59):02d}Z",
        "%Y-%m-%d %H:%M", "%d.%m.%Y", "yyyy-MM-dd'T'HH:mm:ss", f"IMG_{n(1000, 9999)}.{r.choice(('jpg', 'JPG', 'png'))}", f"{a}_v{n(1, 9)}.{r.choice(('py', 'json', 'pdf', 'tar.gz'))}", f"#{n(0, 0xFFFFFF):06x}", f"{n(100, 9999)}x{n(100, 9999)}", f"{a}@{b}.example", f"*/{n(2, 30)} * * * *", f"0x{n(0, 0xFFFFFFFF):08X}",
        f"^[a-z0-9_-]{{{n(2, 4)},{n(8, 32)}}}$", r"\\d{4}-[A-Z]{2}", f"[^\\s@]+@[^\\s@]+", f"{a}/{b}+{r.choice(('json', 'xml'))}", f"{n(1, 99)}%", f"{n(1, 512)}{r.choice(('px', 'ms', 'MB', 'GiB', 'd', 'rem'))}", f"/{a}/{b}/{{id}}", f"../{a}/{b}.{r.choice(('js', 'css', 'yml'))}", f"{a}:{n(1, 9)}.{n(0, 20)}-{r.choice(('alpine', 'slim', 'jammy'))}",
        f"utf-{n(8, 32)}", f"ISO-8859-{n(1, 15)}", f"{a.capitalize()}{b.capitalize()}Error", f"{a}.{b}()", f"{n(10, 255)}.{n(0, 255)}.{n(0, 255)}.{n(1, 254)}:{n(80, 9999)}", f"h{n(200, 265)}", f"{a.upper()}{n(1, 99)}", f"{a.upper()}-{n(100, 9999)}", f"+{n(10, 99)} {n(100, 999)} {n(1000, 99999)}", f"{a[:2].upper()}{n(10, 99)} {n(1000, 9999)} {n(1000, 9999)} {n(1000, 9999)} {n(10, 99)}", f"{a}={n(1, 99)}&{b}={_word(r)}",
    ))


def _sentence(r: random.Random) -> str:
    """Words as prose has them: capitals, numbers, brackets and dashes."""
    words = []
    for _ in range(r.randint(2, 16)):
        w = _word(r) if r.random() < 0.6 else "".join(r.choice("etaoinshrdlucmfgäöüéèñçßåøabcß") for _ in range(r.randint(1, 11)))
        x = r.random()
        words.append(w.capitalize() if x < 0.25 else w.upper() if x < 0.29 else f"{w}-{_word(r)}" if x < 0.33 else f"({w})" if x < 0.36 else str(r.randint(0, 2030)) if x < 0.41 else f"{w}'s" if x < 0.43 else f"»{w}«" if x < 0.44 else f"{w}," if x < 0.54 else f"{w}/{_word(r)}" if x < 0.55 else _plain_value(r) if x < 0.6 else w)
    text = " ".join(words)
    return (text[:1].upper() + text[1:] if r.random() < 0.8 else text) + r.choice((".", ".", ".", "!", "?", ":", "", ";", " –", "..."))


def _code(r: random.Random) -> str:
    """A line of code, markup or configuration without a credential."""
    a, b, c, v, n = _name(r), _name(r), _name(r), _plain_value(r), r.randint(0, 999)
    q = r.choice("\"'")
    return " " * r.choice((0, 0, 2, 4, 8)) + r.choice((
        f"def {a}({b}, {c}={n}):", f"for {a} in {b}.{c}({n}):", f"return {a}({b}, {c})", f"import {a}.{b} as {c}", f"from {a} import {b}, {c}", f"if ({a}.{b}({c}) !== {q}{v}{q}) {{", f"SELECT {a}, {b} FROM {c} WHERE id = {n};", f"- name: {a}", f"{a}: {v}", f"{a} = {v}", f"{a}={v}", f"{a} = {q}{v}{q}", f'"{a}": "{v}",', f'"{a}": {n},', f"<{a} {b}={q}{v}{q}>{c}</{a}>",
        f"<p>{_sentence(r)}</p>", f"// {_sentence(r)}", f"# {_sentence(r)}", f"/* {_sentence(r)} */", f" * @param {a} {_sentence(r)}", f"public {a} {b}({c} x{n}) throws {a.capitalize()} {{", f"const {a} = ({b}) => {c}({q}{v}{q});", f"{a}.{b}({q}{v}{q}, {n}, {c});", f"print(f{q}{{{a}}} {b} {{{c}}}{q})", f"echo {q}{_sentence(r)}{q} >> {a}.log", f"RUN {a} install -y {b} {c}={v}", f"FROM {a}/{b}:{v}", f"func ({a[:1]} *{a}) {b}() ({c}, error) {{",
        f"resource {q}{a}{q} {q}{b}{q} {{", f"[{a}.{b}]", f"}} else if {a} > {n} {{", f"raise {a.capitalize()}({q}{_sentence(r)}{q})", f"let {a}: {b}<{c}> = [];", f"{a} | {b} | {n}", f"{n}. {_sentence(r)}", f"* {_sentence(r)}", f"| {a} | {v} | {n} |", f"[{a}](https://{b}.example/{c}?q={v})", f"https://{a.lower()}.example/{b}/{n}", f"@{a}({q}{v}{q})", f"assert {a} == {q}{v}{q}, {b}", f"--{a} {v} --{b}={n}", f"{a}[{q}{b}{q}] += {n}", f"INSERT INTO {a} ({b}, {c}) VALUES ({n}, '{v}');",
        f"{r.choice(('commit', 'image:', 'sha', 'md5', 'ETag:', 'digest =', 'layer', 'build', 'rev'))} {''.join(r.choice('0123456789abcdef') for _ in range(r.choice((7, 12, 32, 40, 64))))}", f"{a}-{n}: {''.join(r.choice('0123456789abcdef') for _ in range(r.choice((32, 40, 64))))}  {b}.tar.gz", f"-----BEGIN {r.choice(('CERTIFICATE', 'PUBLIC KEY', 'RSA PUBLIC KEY', 'SSH2 PUBLIC KEY', 'CERTIFICATE REQUEST', 'PGP PUBLIC KEY BLOCK'))}-----", f"-----END {r.choice(('CERTIFICATE', 'PUBLIC KEY', 'PRIVATE KEY', 'RSA PRIVATE KEY', 'EC PRIVATE KEY'))}-----",
        *(f"{_rand(r, 64, '+/')}",) * 4, f"{_rand(r, r.randint(9, 64), '+/')}=", f"- name: {r.choice(NEG_KEYS).upper()}", f"- name: {r.choice(POS_KEYS).upper()}", f"data:image/png;base64,{_rand(r, 80, '+/')}", "".join(r.choice("=-_*~#") for _ in range(3)) * r.randint(1, 20), f"{a}({n}, {n + 1}, {n * 2}) # {b}", f"{a.upper()}_{n} = 0x{n:04X}",
    ))


def examples(n: int = 36_000, seed: int = 3) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """``n`` labelled lines: (text, name above, secret spans)."""
    r = random.Random(seed)
    out = []
    neg_value = lambda: r.choice((
        "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64)))), f"sha{r.choice((256, 384, 512))}-" + _rand(r, 64, "+/"), "-".join("".join(r.choice("0123456789abcdef") for _ in range(m)) for m in (8, 4, 4, 4, 12)),
        "data:image/png;base64," + _rand(r, 60, "+/"), ":".join("".join(r.choice("0123456789abcdef") for _ in range(2)) for _ in range(16)), "AAAAC3NzaC1lZDI1NTE5" + _rand(r, 44, "+/") + " user@host"))

    def span(form: str, value: str, secret: bool = True, above: str = ""):
        at = form.index("\0")
        out.append((form.replace("\0", value), above, [(at, at + len(value))] if secret else []))

    for _ in range(n):
        x, user, host, word = r.random(), r.choice(USERS), r.choice(HOSTS), _word(r)
        if r.random() < 0.36:  # what most lines are
            out.append((_sentence(r) if r.random() < 0.3 else _code(r), "", []))
        elif r.random() < 0.03:
            mark = f"-----BEGIN {r.choice(('', '', 'RSA ', 'EC ', 'OPENSSH ', 'ENCRYPTED ', 'DSA ', 'PGP '))}PRIVATE KEY{r.choice(('', '', '', ' BLOCK'))}-----"
            form = r.choice(("\0", "\0", "    \0", "# \0", "  key: '\0", 'private_key = "\0\\n', "+\0", f"{_name(r)} = \"\"\"\0", f'"{_name(r)}": "\0\\n'))
            span(form, mark)
        elif x < 0.24:
            value = r.choice((_password, _password, _keyed, _keyed, _token))(r)
            key = r.choice(POS_KEYS)
            if r.random() < 0.12:
                key, value = key + "_b64", _b64(r, _password(r))
            out.append(_assign(r, key, value, True))
        elif x < 0.42:
            out.append(_assign(r, r.choice(POS_KEYS), _placeholder_value(r), False))
        elif x < 0.54:
            out.append(_assign(r, r.choice(NEG_KEYS), neg_value(), False))
        elif x < 0.58:
            out.append(_assign(r, *r.choice(ABOUT), False))
        elif x < 0.63:
            key = r.choice((r.choice(NEUTRAL), _name(r)))
            out.append(_assign(r, key, r.choice((_token, _token, _opaque))(r), True) if r.random() < 0.85 else _argument(r, _opaque(r)))
        elif x < 0.67:
            out.append(_assign(r, r.choice(NEUTRAL), r.choice((neg_value(), word, str(r.randint(1, 9999)), f"https://{host}:{r.randint(1000, 9999)}/{word}?page={r.randint(1, 99)}&ref={_rand(r, 8).lower()}", f"{word}-{_word(r)}", f"registry.example/{word}:{r.randint(1, 500)}")), False))
        elif x < 0.75:
            scheme = r.choice(("postgres", "redis", "amqp", "mongodb", "https", "mysql", "ftp"))
            real = r.random() < 0.55
            pw = _password(r) if real else r.choice(("****", "{pw}", "${PGPASS}", "<password>", "${DB_PASS}", "xxxx", "$PASS", "%PW%", "<pw>", "***"))
            url = f"{scheme}://{user}:{pw}@{host}{r.choice(('', ':' + str(r.randint(1000, 9999))))}/{word}"
            line, above, _ = _assign(r, r.choice(("dsn", "url", "source", "remote", "database_url", "link")), url, False)
            at = line.find(f":{pw}@")
            out.append((line, above, [(at + 1, at + 1 + len(pw))] if real and at >= 0 else []))
        elif x < 0.81:
            real = r.random() < 0.7
            value = (_b64(r, f"{user}:{_password(r)}") if r.random() < 0.4 else _keyed(r)) if real else r.choice(("<token>", "${TOKEN}", "$TOKEN", "****", "xxxx", "your-token"))
            scheme = r.choice(("Bearer", "Basic", "Token"))
            span(r.choice((f"curl -s -H 'Authorization: {scheme} \0' https://{host}/v2/{word}", f'"hdr": "Authorization: {scheme} \0",', f"hdr = Authorization: {scheme} \0", f"# curl -H 'X-Api-Key: \0' https://{host}/{word}", f"hdr=X-Api-Key: \0", f'  "comment": "curl -H \'Authorization: {scheme} \0\' https://{host}/{word}",', f"headers = {{'X-Auth-Token': '\0'}}", f'req.Header.Set("X-Api-Key", "\0")')), value, real)
        elif x < 0.89:
            real = r.random() < 0.6
            value = (r.choice((_token, lambda r: _b64(r, _password(r))))(r) if r.random() < 0.3 else _password(r)) if real else r.choice((_placeholder_value(r) or "null", "null", "changed twice", "rotated in " + r.choice(("March", "May")), "kept in the safe", "not stored here"))
            mark = r.choice(("# ", "// ", "-- ", "", "  # ", "<!-- ", "- ", "* "))
            span(mark + r.choice((f"old pw was \0", f"Login {user} / \0 (see {host})", f"login {user} with \0 until the move", f"Kennwort: \0", f"password: \0", f"The passwd for {host} is \0", f"the password of {user} is \0 for now", f"pw = \0", f"TODO rotate, currently \0", f"use token \0 for tests", f"user {user}, password \0", f"ALTER USER {user} WITH PASSWORD '\0';", f"- pwd: \0", f"mot de passe : \0", f"contrasena \0")), value, real)
        elif x < 0.92:
            real = r.random() < 0.6
            name = r.choice(POS_KEYS if real or r.random() < 0.4 else NEG_KEYS).upper()
            neg_name = key_class(name) == "N"
            value = (r.choice((_password, _keyed, _token))(r) if real else neg_value() if neg_name else _placeholder_value(r))
            q = r.choice("\"'") if re.search(r"[^\w.\-/+]", value) or not value else r.choice(("\"", "'", ""))
            span(f"{' ' * r.randint(2, 6)}value: {q}\0{q}", value, real and bool(value), name)
        elif x < 0.96:
            out.append(_split(r, r.choice((_token, _token, _keyed))(r)) if r.random() < 0.8 else _split(r, neg_value(), False))
        else:  # code without credentials
            out.append((r.choice((f"password = get_password({word})", f"token = os.environ['{word.upper()}_TOKEN']", f"api_key = config.api_key", f"def check_password({word}, limit=12):", f"if token == {word}.token:", f"    tokens = tokenizer.encode({word})", f"log.info(\"token expired for %s\", {word})", f"import {word}_key",
                                    f"const apiKeyHeader = \"X-Api-Key\";", f"for key, value in {word}.items():", f"# the key is under the mat", f"return {word}.secret", f"auth: {word}", f"public key {word}", f"{word}.sort(key=len)", f"print('basic {word} auth')", f"name: {word.upper()}_TOKEN", f"- name: DB_PASSWORD", f"image: registry.example/{word}:{r.randint(1, 400)}",
                                    f"The key words are {word}, {_word(r)} and {_word(r)}.", f"login page of {host}", f"see https://{host}/{word}/tokens for the token list", f"echo \"{word} passed\"", f"ref={_rand(r, 24)}", f"{_rand(r, 64, '+/')}", f"{_rand(r, r.randint(9, 44), '+/')}==", f"{_rand(r, r.randint(9, 60), '+/')}=", f"{_rand(r, r.randint(9, 30), '+/')}==", f"AAAAC3NzaC1lZDI1NTE5{_rand(r, 44, '+/')} build@box")), "", []))
    return out


WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "credential_field.json")


def fit(n: int = 36_000, seed: int = 3) -> Field:
    return train(examples(n, seed))


@lru_cache(maxsize=1)
def model() -> Field:
    """The field as ``fit`` gives it."""
    with open(WEIGHTS) as f:
        stored = json.load(f)
    return Field(stored["weights"], np.array(stored["transitions"]))


def store(field: Field, path: str = WEIGHTS) -> None:
    with open(path, "w") as f:
        json.dump({"transitions": field.transitions.tolist(), "weights": dict(sorted(field.weights.items()))}, f, indent=0, ensure_ascii=False)


# ---------------------------------------------------------------- the operator


ABOVE = re.compile(r"^\s*-?\s*(?:name|key|id)\s*[:=]\s*[\"']?([A-Za-z_][\w.\-]*)", re.I)


def _key_end(lines: list[str], i: int, at: int) -> tuple[int, int]:
    """(line, position) where the private key ends that begins in line i before ``at``: at its closing marker, or after the
    last line that may belong to it."""
    for j in range(i, len(lines)):
        start = at if j == i else 0
        end, begin = PRIVATE_END.search(lines[j], start), PRIVATE_BEGIN.search(lines[j], start)
        if end and not (begin and begin.start() < end.start()):
            return j, end.start()
        if begin:
            break
    j = i
    if "\\n" in lines[i][at:]:  # on one line, with written line ends
        return i, len(lines[i].rstrip("\"',; \r"))
    while j + 1 < len(lines) and KEY_LINE.fullmatch(lines[j + 1]) and not PRIVATE_BEGIN.search(lines[j + 1]):
        j += 1
    return j, len(lines[j].rstrip()) if j > i else max(at, len(lines[i].rstrip("\"',; \r")))


def _whole_values(line: str, toks: list[tuple[int, int, str]], labels: list[int]) -> list[int]:
    """Literals joined by + or . are one value: secret if a part is."""
    chain = [i for i in range(2, len(toks) - 2) if toks[i][2] == "op" and line[toks[i][0] : toks[i][1]] in ("+", ".") and toks[i - 2][2] == toks[i + 2][2] == "s" and toks[i - 1][2] == toks[i + 1][2] == "q"]
    out = list(labels)
    for i in chain:
        out[i + 2] |= out[i - 2]
    for i in reversed(chain):
        out[i - 2] |= out[i + 2]
    return out


def spans_of(lines: list[str], field: Field) -> list[tuple[int, int, int, bool]]:
    """(line index, start, end, head) of every secret. A private key has one head, in its first line."""
    out: list[tuple[int, int, int, bool]] = []
    i, skip = 0, 0  # skip: signs of line i that belong to a key that ended there
    while i < len(lines):
        line = lines[i]
        toks, key = lex(line[skip:]) if skip else lex(line), None
        if skip:
            toks = [(a + skip, b + skip, kind) for a, b, kind in toks]
        above = m.group(1) if i and (m := ABOVE.match(lines[i - 1])) else ""
        if toks and (labels := field.labels(line, toks, above)):
            for (a, b, kind), y in zip(toks, _whole_values(line, toks, labels)):
                if y and kind == "pem":
                    key = b
                    break
                if y and kind not in ("q", "op") and b > a:
                    out.append((i, a, b, True))
        skip = 0
        if key is not None:
            j, end = _key_end(lines, i, key)
            if j == i:
                out.append((i, key, end, True))
            else:
                out.append((i, key, max(key, len(line.rstrip("\"'\\, \r"))), True))
                out += [(k, len(lines[k]) - len(lines[k].lstrip()), len(lines[k].rstrip()), False) for k in range(i + 1, j)]
                if end > (start := len(lines[j]) - len(lines[j].lstrip())):
                    out.append((j, start, end, False))
            i, skip = j, end
            if j > i or end >= len(lines[j].rstrip("\"',; \r")):
                i, skip = j + 1, 0
            continue
        i += 1
    return out


def _scan(field: Field):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, no + 1) for doc, text in zip(pdf["file_id"], pdf["content"]) for no in sorted({i for i, _, _, head in spans_of(text.split("\n"), field) if head})]
            yield pd.DataFrame(rows, columns=["file_id", "line_no"])

    return run


def credential_lines(documents: DataFrame, file_id: str = "file_id", content: str = "content") -> DataFrame:
    """(file_id, line_no): lines with a usable credential."""
    docs = documents.select(F.col(file_id).alias("file_id"), F.col(content).alias("content")).filter("content <> '' and file_id is not null")
    kind = docs.schema["file_id"].dataType.simpleString()
    return spread(docs).mapInPandas(_scan(model()), f"file_id {kind}, line_no int").distinct()


def redact(text: str, field: Field, sign: str = "*") -> tuple[str, int]:
    """The text with every secret's characters replaced one by one, and the number of masked spans."""
    lines = text.split("\n")
    found = spans_of(lines, field)
    for i, a, b, _ in sorted(found, reverse=True):
        lines[i] = lines[i][:a] + re.sub(r"[^\s\\]", sign, lines[i][a:b]) + lines[i][b:]
    return "\n".join(lines), sum(b > a for _, a, b, _ in found)


def redacted_files(documents: DataFrame, file_id: str = "file_id", content: str = "content") -> DataFrame:
    """(file_id, content, masked): the contents that hold a credential, with only its characters masked."""
    field = model()
    docs = documents.select(F.col(file_id).alias("file_id"), F.col(content).alias("content")).filter("content <> '' and file_id is not null")
    kind = docs.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [redact(t, field) for t in pdf["content"]]
            out = pd.DataFrame({"file_id": pdf["file_id"], "content": [x[0] for x in done], "masked": [x[1] for x in done]})
            yield out[out["masked"] > 0]

    return spread(docs).mapInPandas(run, f"file_id {kind}, content string, masked long").distinct()


if __name__ == "__main__":
    store(fit())
