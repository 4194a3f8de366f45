"""Secret scans by a linear-chain conditional random field.

Tokens of a line are tagged as begin, inside or outside of a secret.  Features
are a token's shape, length, spread of characters and the shapes of its
neighbours, the words next to it (of ``WORDS``), keywords before it, and how much
the whole text looks like code.  Weights are fitted by maximum likelihood on lines
that ``examples`` writes from templates (no data table is read), and tags are
decoded by Viterbi.

Every token of every line is scored, and any may carry any tag, punctuation
between two pieces included, so a secret may hold several tokens; a token after
white space is never inside.  A token whose scores favour outside by more than
transitions could ever make up for is outside on the best path; there the chain
falls into independent parts, and the decoding is the same as over the whole line.
Lines without keywords, quotes and URLs are scored as arrays first: where no span
could gain over all tokens outside, that is the best path, and nothing is left to
decode; all other lines are decoded token by token.  The arrays hold the characters
of many texts, and what tokens are like is counted there for all of them together, so
words that were never met cost no more than known ones, and no table of words grows.
No span reaches over a line's end, so other lines matter only by the file feature.

The base patterns (assigned values, access keys, long hex) always stay; spans of
the random field are added where they reach beyond these.

Edge cases: null text is empty and has no spans; offsets are code points, ends
exclusive; repeated rows, ties and further columns change nothing; an empty
table stays empty.  One pass, no shuffle.
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.~-]+=*|[^\sA-Za-z0-9+/_.~-]")
KEYWORD = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|bearer|api.?key|auth(?:orization)?|credential|private.?key|access.?key|client.?secret|signature", re.I | re.A)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words whose neighbourhood tells what a token is.
WORDS = frozenset("""blob branch build bundle cache card checksum chunk code color commit container correlation device digest document etag event expected fetched file fingerprint
 guid hash head host id image in index install invoice issue item key layer line load login md5 merge model node object order pack page parent part path phone pid pod
 process product rebase record ref release request rev revision row run sent serial session set sha sha1 sha256 sku span state step sum tag task thread ticket to trace
 transaction tree type url use user uuid value version was with your""".split())
_SEPARATORS = {"=", ":", '"', "'", ">", "(", ","}
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns: start, end, kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def shape(t: str) -> str:
    """A coarse class of a token."""
    if t.isalpha():
        return "lower" if t.islower() else "upper" if t.isupper() else "title" if t.istitle() else "mixed"
    if len(t) == 1 and not t.isalnum():
        return t if t in "=:\"'@/,;()<>{}[]" else "sym"
    alpha, digit = any(c.isalpha() for c in t), any(c.isdigit() for c in t)
    if not digit:
        return "lower" if t.islower() else "upper" if t.isupper() else "title" if t.istitle() else "mixed" if alpha else "punct"
    if len(t) == 36 and UUID.fullmatch(t):
        return "uuid"
    if not alpha:
        return "digits" if t.isdigit() else "number"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", t):
        return "hex"
    if "." in t:
        return "dotted"
    if "/" in t or "-" in t or "_" in t:
        return "joined"
    both = any(c.islower() for c in t) and any(c.isupper() for c in t)
    return "mixedcase+digits" if both else "letters+digits"


def _own(t: str) -> tuple:
    """What a token's own features are made of: shape, length, spread of characters, switches of class, digits, beginning."""
    n = len(t)
    if t.isalpha() and t.islower() and n > 1:
        switches = digits = 0
    else:
        switches = sum((a.isdigit() != b.isdigit()) or (a.islower() != b.islower() and a.isalpha() and b.isalpha()) for a, b in zip(t, t[1:], strict=False))
        digits = sum(map(str.isdigit, t))
    return shape_of(t), min(n, 60) // 6, 10 * len(set(t)) // max(1, min(n, 24)), min(9, 10 * switches // n), 5 * digits // n, t[:3] if n > 12 else ""


def _local(t: str) -> list[str]:
    return _local_names(_own(t))


def _local_names(own: tuple) -> list[str]:
    s, n, d, w, num, p = own
    return [f"s={s}", f"n={n}", f"d={d}", f"w={w}", f"num={num}", f"p={p}"]


def contexts(toks: list[str], glued: list[bool]) -> list[tuple]:
    """Of each token: shapes around it, distance of a keyword, place in quotes and in a URL, words next to it.

    A token is glued if no white space stands before it.
    """
    shapes, near_words = [shape_of(t) for t in toks], [word_of(t) for t in toks]
    keys, separators = _keywords(toks), [t in _SEPARATORS or t.lower() in ("is", "bearer") for t in toks]
    out, quote, url, run = [], "", 0, 0
    n = len(toks)
    for i, t in enumerate(toks):
        if not glued[i]:
            url = run = 0
        run += 1
        if url == 0 and t.startswith("//") and run > 1 and toks[i - 1] == ":":
            url = 1
        elif url == 1 and t == "@":
            url = 2
        place = "in" if quote else ""
        if t == quote:
            place, quote = "close", ""
        elif t in ('"', "'") and not quote and (run == 1 or not toks[i - 1][-1].isalnum()):
            place, quote = "open", t
        before = ("" if glued[i] else " ") + shapes[i - 1] if i else "^"
        after = ("" if glued[i + 1] else " ") + shapes[i + 1] if i + 1 < n else "$"
        out.append((shapes[i], before, shapes[i - 2] if i > 1 else "^", after, keyword_before(keys, separators, i), place, url, min(run, 3), next((k for k in (1, 2) if i >= k and keys[i - k]), 0), _next_word(near_words, i, -1), _next_word(near_words, i, 1)))
    return out


@functools.lru_cache(20_000)
def word_of(t: str) -> str | None:
    """A token's last part of letters if ``WORDS`` has it, empty if it is another word; None of other tokens."""
    if len(t) < 2 or len(t) > 24:
        return None
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", t)
    low = parts[-1].lower() if parts and t[-1].isalpha() else t.lower()
    return low if low in WORDS else "" if t.isalpha() else None


def _next_word(near_words: list[str | None], i: int, step: int) -> str:
    """The next word before or after a token, at most three tokens away; empty if it is none of ``WORDS``."""
    for k in range(1, 4):
        at = i + step * k
        if at < 0 or at >= len(near_words):
            return ""
        if near_words[at] is not None:
            return near_words[at]
    return ""


@functools.lru_cache(20_000)
def shape_of(t: str) -> str:
    return shape(t)


def features(token: str, context: tuple, code: int) -> list[str]:
    """Feature names of a token: its own, and those of its context and the file."""
    return [*_local(token), *_around(context, code)]


def _around(context: tuple, code: int) -> list[str]:
    s, before, second, after, key, place, url, run, near, left, right = context
    return [
        "bias", f"code={code}", f"-1={before}", f"-2={second}", f"+1={after}", f"key={key}", f"key={key}|s={s}", f"code={code}|s={s}",
        f"-1={before}|s={s}", f"+1={after}|s={s}", f"q={place}|s={s}", f"q={place}|key={key}", f"url={url}|s={s}", f"url={url}|-1={before}", f"run={run}", f"near={near}|s={s}",
        f"w-={left}", f"w-={left}|s={s}", f"w+={right}",
    ]


def _keywords(toks: list[str]) -> list[bool]:
    return [len(t) > 2 and KEYWORD.search(t) is not None for t in toks]


def keyword_before(keys: list[bool], separators: list[bool], i: int) -> int:
    """How far back a keyword stands, with a separator between; 0 if within four tokens none does."""
    separated = False
    for k in range(1, min(i, 4) + 1):
        if separated and keys[i - k]:
            return k
        separated |= separators[i - k]
    return 0


def code_like(text: str) -> int:
    """0 to 3: how many of its lines look like code or settings."""
    n = text.count("\n") + 1
    marks = sum(text.count(c) for c in ("=", "{", ";", "://", '":'))
    return min(3, 4 * marks // n) if marks else 0


def examples(n: int = 4000, seed: int = 7) -> list[tuple[list[str], list[bool], list[int], int]]:
    """Tagged lines from templates: tokens, whether glued, tags (0 outside, 1 begin, 2 inside), code class."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda: pick(low, 2, 9)
    secrets = [
        lambda: pick(low + up + dig, 16, 48), lambda: pick("0123456789abcdef", 16, 64), lambda: pick(low + up + dig + "+/", 20, 60) + "=" * r.randint(0, 2),
        lambda: "sk_live_" + pick(low + up + dig, 20, 30), lambda: "ghp_" + pick(low + up + dig, 36, 36), lambda: "xoxb-" + pick(dig, 10, 12) + "-" + pick(low + up + dig, 20, 28),
        lambda: "AKIA" + pick(up + dig, 16, 16), lambda: "eyJ" + pick(low + up + dig + "_-", 20, 40) + "." + pick(low + up + dig + "_-", 30, 60), lambda: pick(low, 3, 6) + pick(dig, 1, 4) + pick(low + up, 2, 6), lambda: pick(low, 3, 6) + pick(dig, 1, 4) + pick(low, 2, 6), lambda: pick(low + dig, 8, 20), lambda: pick(low + up + dig, 8, 24),
    ]
    plain = [
        word, word, word, lambda: pick(dig, 1, 12), lambda: word().title(), lambda: f"{word()}{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.{word()}.com", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
        lambda: f"https://{word()}.{word()}.org/{word()}/{r.randint(1, 9999)}", lambda: f"{word()}_{word()}_{r.randint(1, 2024)}", lambda: f"{word()}-{r.randint(1990, 2030)}-{word()}", lambda: f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T10:{r.randint(10, 59)}:00Z",
        lambda: f"{word()}{r.randint(1, 9)}.{word()}", lambda: f"{word().title()}{word().title()}{r.randint(1, 64)}", lambda: f"/{word()}/{word()}{r.randint(1, 9)}/{word()}.txt", lambda: "+" + pick(dig, 9, 12), lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: word() + "!", lambda: word() + ",", lambda: word().upper(), lambda: word() + "!!", lambda: (word() + r.choice(["!!", "??", "###", "...", "%%%", "$$$", "&&&"])).upper(), lambda: word().title() + r.choice(["!!", "###", "&&&", "%%%", "$$$"]), lambda: word() + r.choice("###&&&%%%$$$***@@@") * 3,
    ]
    keys = ["password", "passwd", "secret", "token", "api_key", "apikey", "auth_token", "client_secret", "DB_PASSWORD", "AWS_SECRET_ACCESS_KEY", "private_key", "credential", "Authorization: Bearer", "Authorization: Bearer", "Bearer", "bearer", "access_key", "Password", "pwd", "passphrase"]
    hexed = lambda a, b: pick("0123456789abcdef", a, b)
    uuid = lambda: "-".join(hexed(n, n) for n in (8, 4, 4, 4, 12))
    #: Names of things that are known by a number or digest and are no secret.
    named = ["request", "request_id", "request id", "requestId", "trace", "trace_id", "span", "session id", "user", "user_id", "id", "uuid", "guid", "event", "order", "transaction", "device", "container", "pod", "node", "task", "run", "job id", "correlation id", "X-Request-ID", "document", "record", "item"]
    digested = ["commit", "rev", "revision", "sha", "sha1", "sha256", "md5", "checksum", "digest", "etag", "hash", "blob", "tree", "parent", "merge", "HEAD is now at", "object", "image", "layer", "build", "version", "fingerprint", "file", "cache key", "chunk", "pack", "tag", "index", "release", "bundle"]

    def harmless() -> str:
        """A number or digest that names a thing."""
        sep = r.choice([" ", " ", "=", ": ", ":", " = ", " is ", " was "])
        if r.random() < 0.55:
            v, name = uuid(), r.choice(named)
            v = v.upper() if r.random() < 0.1 else v
        else:
            v, name = hexed(*r.choice([(7, 7), (8, 12), (16, 23), (20, 20), (20, 20)])), r.choice(digested)
        q = r.choice(["", "", "", '"', "'"])
        return r.choice([f"{name}{sep}{q}{v}{q}", f"{name}{sep}{q}{v}{q}", f"{name}{sep}{v}", f'"{name}": "{v}"', f"[{v}]" if len(v) == 36 else f"{name} {v[:7]}..{v}", f"({name} {v})", f"{name}/{v}" if " " not in name else f"{name} <{v}>", f"{v} {word()}" if len(v) == 36 else f"{name}@{v}", f"/{word()}/{v}/{word()}" if len(v) == 36 else f"{name} {v}, {word()}"])

    symbols = "@!#$%^&*?"

    def pieces() -> str:
        """A password of letters, digits and punctuation: several tokens."""
        while True:
            s = pick(low + up, 1, 5) + "".join(r.choice(symbols) * r.randint(1, 2) * (r.random() < 0.9) + pick(low + up + dig, 1, 5) for _ in range(r.randint(1, 5))) + (r.choice(symbols) if r.random() < 0.2 else "")
            if len(s) >= 6 and any(c in symbols for c in s):
                return s

    filler = lambda a, b: " ".join(r.choice(plain)() for _ in range(r.randint(a, b)))
    junk = lambda: r.choice("#$%&*!-=") * 3
    nothing = ["required", "None", "null", "string", "<your password>", "optional", "********", "${PASSWORD}", "os.environ['TOKEN']", "", "the one you chose", "hashed", "see below", "too short", "expired", "8 characters or more"]
    out = []
    for k in range(n):
        before, after, marks = filler(0, 6), filler(0, 6), []
        if k % 2:
            style = r.random()
            keyed = style < 0.65
            s = pieces() if keyed and r.random() < 0.4 else uuid() if keyed and r.random() < 0.06 else r.choice(secrets)()
            q = r.choice(["", "", '"', "'"])
            if keyed:
                key = r.choice(keys)
                form = r.random()
                if r.random() < 0.1:
                    middle = f"{key} {s}"
                elif "earer" in key:
                    middle = f"{key} {q}{s}{q}"
                elif form < 0.2:
                    middle = f'"{key}": "{s}"' + r.choice(["", ",", "}", "},"])
                elif form < 0.3:
                    middle = f"<{key}>{s}</{key}>"
                elif form < 0.4:
                    middle = f"{key}({r.choice(chr(34) + chr(39))}{s}" + chr(39)
                    middle = middle[:-1] + middle[len(key) + 1] + ")"
                else:
                    sep = r.choice(["=", " = ", ": ", ":", " is ", " is: ", " := "])
                    middle = f"{r.choice(['', '', '--', 'my ', 'the '])}{key}{sep}{q}{s}{q}" + r.choice(["", "", ";", ","] if q else [""])
            elif style < 0.8:
                while len(s) < 16 or re.fullmatch("[0-9a-f]{,23}", s):  # a short hex number alone says nothing
                    s = r.choice(secrets)()
                middle = r.choice([s, s, f'"{s}"', f"{junk()}{s}{junk()}"])
            else:
                middle = f"{word()}://{word()}:{s}@{word()}.{r.choice(['net', 'com', 'example.com'])}{r.choice(['', ':5432'])}/{word()}"
            marks = [s]
        elif k % 8 == 0:
            middle = harmless()
        else:
            middle = r.choice([
                filler(1, 3), f"{word()} = {r.choice(plain)()}", f"{r.choice(keys)} {word()} {word()}", f"{word()}: {filler(1, 2)}", f"{r.choice(keys)}{r.choice([': ', ' = ', ' is '])}{r.choice(nothing)}", f"{r.choice(plain)()}{junk()}",
                f"{junk()} {pick(dig, 4, 12)} {word()}{junk()}", f"{word()}, {word()} ({word()} {r.randint(1, 2030)}) {word()}'s \"{word()} {word()}\"", f"{word()}#{r.randint(1, 9999)} {word()}/{word()} {r.randint(1, 99)}% ${r.randint(1, 999)}.{pick(dig, 2, 2)}", f"{word()}.{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.{word()}.com {word()}",
                f"{word()}[{r.randint(0, 9)}] != {word()}({word()}, {r.randint(0, 99)}); {word()}", f'{word()}("{word()}%d{r.choice(["", " %s"])}" % {word()})', f"{word()}('{word()}{r.randint(0, 9)}', \"{r.choice(plain)()}\")", f"the {r.choice(keys[:6])} {word()} and {word()}, {word()}. {word().title()}",
            ])
        line = " ".join(x for x in (before, middle, after) if x)
        at = line.find(marks[0], len(before)) if marks else -1
        toks, glued, tags, end = [], [], [], -1
        for m in TOKEN.finditer(line):
            inside = marks and at < m.end() and m.start() < at + len(marks[0])
            toks.append(m[0])
            glued.append(m.start() == end)
            tags.append((2 if tags and tags[-1] and glued[-1] else 1) if inside else 0)
            end = m.end()
        out.append((toks, glued, tags, r.choice([0, 0, 1, 2, 3])))
    return out


@functools.cache
def model(steps: int = 150, rate: float = 0.08, ridge: float = 2e-3) -> tuple[dict[str, tuple[float, float, float]], list[list[float]]]:
    """Weights by feature name, and transition scores, by maximum likelihood (Adam, full batch)."""
    # The longest first, so that at each place the lines that reach it are the first ones.
    data = sorted((x for x in examples() if x[0]), key=lambda x: -len(x[0]))
    names: dict[str, int] = {}
    n, longest = len(data), max(len(x[0]) for x in data)
    each = [[names.setdefault(f, len(names)) for f in features(t, x, c)] for toks, glued, _, c in data for t, x in zip(toks, contexts(toks, glued), strict=True)]
    index, pad = np.array(each, np.int32), len(names)
    wide = index.shape[1]
    tags, mask, joined = np.zeros((n, longest), int), np.zeros((n, longest), bool), np.zeros((n, longest), bool)
    for k, (t, g, y, _) in enumerate(data):
        tags[k, : len(t)], mask[k, : len(t)], joined[k, : len(t)] = y, True, g
    w, trans = np.zeros((pad + 1, 3)), np.array([[0, 0, -8.0], [0, -8.0, 0], [0, -8.0, 0]])
    free = trans > -8
    truth = np.eye(3)[tags] * mask[..., None]
    pairs = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    reach, flat = mask.sum(0), index.ravel()
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 3))
        e[mask] = sum(w[index[:, k]] for k in range(wide))
        e[~joined, 2] -= 50  # white space ends a secret
        a, b = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        a[:, 0] = e[:, 0]
        for t in range(1, longest):
            k = reach[t]
            a[:k, t] = lse(a[:k, t - 1, :, None] + trans, 1) + e[:k, t]
            a[k:, t] = a[k:, t - 1]
        z = lse(a[:, -1], 1)
        gt = -pairs
        for t in range(longest - 2, -1, -1):
            k = reach[t + 1]
            ahead = (e[:k, t + 1] + b[:k, t + 1])[:, None, :] + trans
            b[:k, t] = lse(ahead, 2)
            gt = gt + np.exp(a[:k, t, :, None] + ahead - z[:k, None, None]).sum(0)
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        gap = (p - truth) / n
        each_gap = gap[mask]
        gw = np.stack([np.bincount(flat, np.repeat(each_gap[:, y], wide), pad + 1) for y in range(3)], axis=1) + ridge * w / 10
        gw[pad] = 0
        gt = gt / n * free
        for x, g, m, v in ((w, gw, moments[0], moments[1]), (trans, gt, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {f: tuple(w[k].tolist()) for f, k in names.items()}, trans.tolist()


def viterbi(scores: list[tuple[float, float, float]], trans: list[list[float]], later: bool = False) -> list[int]:
    """The best tags; inside never comes first, unless these are ``later`` tokens of a line."""
    best, back = [scores[0][0], scores[0][1], scores[0][2] if later else float("-inf")], []
    for e in scores[1:]:
        came = [max(range(3), key=lambda i, j=j: best[i] + trans[i][j]) for j in range(3)]
        best = [best[came[j]] + trans[came[j]][j] + e[j] for j in range(3)]
        back.append(came)
    tag = max(range(3), key=lambda j: best[j])
    out = [tag]
    for came in reversed(back):
        tag = came[tag]
        out.append(tag)
    return out[::-1]


def surplus(trans: list[list[float]]) -> float:
    """The most that transitions can gain by a tag other than outside at one place."""
    trans = [list(row) for row in trans]
    steps = [(a, c) for a in (None, 0, 1, 2) for c in (None, 0, 1, 2)]
    into, off = lambda a, y: 0.0 if a is None else trans[a][y], lambda y, c: 0.0 if c is None else trans[y][c]
    return max(into(a, y) + off(y, c) - into(a, 0) - off(0, c) for a, c in steps for y in (1, 2))


def _sum(names: list[str], weights: dict[str, tuple[float, float, float]]) -> tuple[float, float, float]:
    found = [weights[f] for f in names if f in weights]
    return tuple(map(sum, zip(*found, strict=True))) if found else (0.0, 0.0, 0.0)


_LOWER, _UPPER, _DIGIT, _DOT, _JOIN, _OTHER = 3, 12, 16, 32, 64, 128
_BARE = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-."
#: What a keyword holds in lower case; "key" only behind one of three words.
_PARTS, _KEY = (b"pass", b"pwd", b"secret", b"token", b"bearer", b"auth", b"credential", b"signature", b"key"), re.compile(rb"(?:api|private|access).?key")


def _by_byte(value, dtype) -> np.ndarray:
    """A table of ``value`` over ASCII, 0 beyond."""
    return np.array([value(chr(k)) for k in range(128)] + [0] * 128, dtype)


def _class(c: str) -> int:
    return 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 0


def _kind(c: str) -> int:
    """Bits of a character of a token: a to f, other lower case, A to F, other upper case, digit, and punctuation."""
    if c.isalpha():
        return (1 if c in "abcdef" else 2) if c.islower() else 4 if c in "ABCDEF" else 8
    return _DIGIT if c.isdigit() else _DOT if c == "." else _JOIN if c in "/-_" else _OTHER if c in "+~=" else 0


def _shape_of_kinds(kinds: int) -> str:
    """The shape of a token of several characters by the bits it has; "mixed" may be "title", and "joined" a UUID."""
    lower, upper = kinds & _LOWER, kinds & _UPPER
    if not kinds & _DIGIT:
        return "mixed" if lower and upper else "lower" if lower else "upper" if upper else "punct"
    if not lower and not upper:
        return "digits" if kinds == _DIGIT else "number"
    if kinds in (_DIGIT | 1, _DIGIT | 4):
        return "hex"
    return "dotted" if kinds & _DOT else "joined" if kinds & _JOIN else "mixedcase+digits" if lower and upper else "letters+digits"


def _pieces(text: str, size: int):
    """Whole lines of about ``size`` characters together, with the number of their first line."""
    at = line = 0
    while len(text) - at > size:
        end = text.rfind("\n", at, at + size)
        end = end if end >= 0 else text.find("\n", at + size)
        if end < 0:
            break
        yield line, text[at:end]
        line, at = line + text.count("\n", at, end) + 1, end + 1
    yield line, text[at:]


class Scores:
    """Scores of tokens and of contexts, each looked up once; and tables by which whole texts are scored as arrays of characters."""

    PIECE, RUN = 1 << 17, 64
    CLASS, KINDS_OF, ALNUM = _by_byte(_class, np.uint8), _by_byte(_kind, np.uint8), _by_byte(lambda c: " abcdefghijklmnopqrstuvwxyz0123456789".find(c.lower()) * c.isalnum(), np.int64)
    BITS, MORE_BITS = _by_byte(lambda c: 1 << _BARE.index(c) if c in _BARE else 0, np.uint64), _by_byte(lambda c: 1 << "+/_~=".index(c) if c in "+/_~=" else 0, np.uint8)
    SHAPES = sorted({"lower", "upper", "title", "mixed", "punct", "sym", "hex", "digits", "number", "dotted", "joined", "uuid", "mixedcase+digits", "letters+digits", *"=:\"'@/,;()<>{}[]"})
    #: Whether the class changes in a way that ``_own`` counts, by both classes.
    SWITCH = np.array([(a == 3) != (b == 3) or {a, b} == {1, 2} for a in range(4) for b in range(4)])

    def __init__(self, fitted):
        self.fitted, self.also, self.most = fitted, fitted, surplus(fitted[1])
        own = functools.lru_cache(20_000)(lambda own: _sum(_local_names(own), fitted[0]))
        self.local = lambda t: own(_own(t))
        self.around = functools.lru_cache(20_000)(lambda x, code: _sum(_around(x, code), fitted[0]))
        shapes, self.words = self.SHAPES, ["", *sorted(WORDS)]
        self.place, n = {x: i for i, x in enumerate(shapes)}, len(shapes)

        def table(names, *axes):
            """How far begin and inside lie above outside, by the flat number along ``axes``."""
            each = [()]
            for axis in axes:
                each = [(*x, y) for x in each for y in axis]
            found = np.array([_sum(names(*x), fitted[0]) for x in each])
            return found[:, 1] - found[:, 0], found[:, 2] - found[:, 0]

        # Neighbours go by 0 (none), 1 + shape behind white space, 1 + n + shape without.
        around = ["", *(f" {x}" for x in shapes), *shapes]
        self.before = table(lambda s, a: [f"-1={a or '^'}", f"-1={a or '^'}|s={s}", f"url=0|-1={a or '^'}"], shapes, around)
        self.after = table(lambda s, a: [f"+1={a or '$'}", f"+1={a or '$'}|s={s}"], shapes, around)
        self.second = table(lambda a: [f"-2={a}"], ["^", *shapes])
        self.rest = table(lambda c, s, k: [f"s={s}", "bias", f"code={c}", "key=0", f"key=0|s={s}", f"code={c}|s={s}", f"q=|s={s}", "q=|key=0", f"url=0|s={s}", f"run={k}", f"near=0|s={s}"], range(4), shapes, (1, 2, 3))
        self.left = table(lambda s, w: [f"w-={w}", f"w-={w}|s={s}"], shapes, self.words)
        self.right = table(lambda w: [f"w+={w}"], self.words)
        self.spread = table(lambda n, d: [f"n={n}", f"d={d}"], range(11), range(30))
        self.turns = table(lambda w, k: [f"w={w}", f"num={k}"], range(10), range(6))
        starts = sorted((x[2:] for x in fitted[0] if x.startswith("p=") and len(x) == 5), key=lambda p: p.encode())
        self.starts = np.array([int.from_bytes(p.encode(), "big") for p in starts] + [1 << 24])
        self.start = table(lambda p: [f"p={p}"], [*starts, None])
        self.no_start = table(lambda: ["p="])
        self.shape_by_kinds = np.array([self.place[_shape_of_kinds(k)] for k in range(256)])
        codes = {w: functools.reduce(lambda k, c: 37 * k + int(self.ALNUM[ord(c)]), w, 0) for w in WORDS}
        self.longest = max(map(len, WORDS))
        assert self.longest <= 12, "codes of words must fit 63 bits"
        ordered = sorted(WORDS, key=codes.get)
        self.codes, self.word_at, self.lengths = np.array([codes[w] for w in ordered]), np.array([self.words.index(w) for w in ordered]), np.array([len(w) for w in ordered])
        self.edges = np.zeros((37, 37, self.longest + 1), bool)
        for w in WORDS:
            self.edges[self.ALNUM[ord(w[0])], self.ALNUM[ord(w[-1])], len(w)] = True
        # Characters go by one byte: ASCII by itself, others by what they are like (255: not met yet).
        self.byte_of = np.full(0x110000, 255, np.uint8)
        self.byte_of[:128] = range(128)
        self.space, self.word_char, self.single, self.single_digit = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, np.int64), np.zeros(256, bool)
        self.kinds_met: dict[tuple, int] = {}
        for k in range(128):
            self._describe(k, chr(k))

    def _describe(self, k: int, c: str) -> None:
        self.space[k], self.word_char[k] = re.match(r"\s", c) is not None, re.match(r"[A-Za-z0-9+/_.~-]", c) is not None
        self.single[k], self.single_digit[k] = self.place[shape(c)], c.isdigit()

    def bytes_of(self, text: str) -> np.ndarray:
        """A byte for each character."""
        if text.isascii():
            return np.frombuffer(text.encode(), np.uint8)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.byte_of[points]
        new = np.unique(points[out == 255])
        for p in new.tolist():
            c = chr(p)
            like = (c.isspace(), shape(c), c.isdigit())
            if like not in self.kinds_met:
                self.kinds_met[like] = 128 + len(self.kinds_met)
                self._describe(self.kinds_met[like], c)
            self.byte_of[p] = self.kinds_met[like]
        return self.byte_of[points] if len(new) else out

    def lines_of(self, texts: list[str], codes: list[int]) -> list[list[int]]:
        """Of each text the numbers of lines that hold a token which isn't certainly outside, or must be looked at token by token."""
        out, part, size = [[] for _ in texts], [], 0

        def finish():
            counts = np.array([x.count("\n") + 1 for _, _, x in part])
            at = np.cumsum(counts) - counts
            found = self._lines("\n".join(x for _, _, x in part), np.repeat([codes[k] for k, _, _ in part], counts))
            for line, p in zip(found.tolist(), (np.searchsorted(at, found, "right") - 1).tolist(), strict=True):
                k, first, _ = part[p]
                out[k].append(line - int(at[p]) + first)

        for k, text in enumerate(texts):
            for first, piece in _pieces(text, self.PIECE) if text else ():
                if part and size + len(piece) > self.PIECE:
                    finish()
                    part, size = [], 0
                part.append((k, first, piece))
                size += len(piece)
        if part:
            finish()
        return out

    def _loud(self, c: np.ndarray) -> np.ndarray:
        """Places with quotes, and one in each line that may hold a keyword."""
        low, at = c.tobytes().lower(), []
        for x in _PARTS:
            k = low.find(x)
            while k >= 0:
                if x != b"key" or _KEY.search(low, max(0, k - 8), k + 3):
                    at.append(k)
                    k = low.find(b"\n", k)
                    k = low.find(x, k) if k >= 0 else -1
                else:
                    k = low.find(x, k + 1)
        return np.concatenate([np.flatnonzero((c == 34) | (c == 39)), np.array(at, np.int64)])

    def _tokens(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of the matches of ``TOKEN``, and which characters are white space."""
        space, word = self.space[c], self.word_char[c]
        start = ~space
        start[1:] &= ~(word[1:] & word[:-1])
        equal = np.flatnonzero(c == 61)
        if len(equal):  # those that follow a word belong to it
            head = np.flatnonzero(np.append(True, np.diff(equal) > 1))
            head = np.repeat(equal[head], np.diff(np.append(head, len(equal))))
            start[equal[(head > 0) & word[head - 1]]] = False
        stop = ~space
        stop[:-1] &= start[1:] | space[1:]
        return np.flatnonzero(start), np.flatnonzero(stop) + 1, space

    def _describe_tokens(self, c: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """What ``_own`` and ``word_of`` say of each token: shape, flat numbers in ``spread`` and ``turns``, number of the word or -1."""
        n, head = ends - begins, c[begins]
        one = n == 1
        # Between tokens is nothing but white space, which has no bits.
        kinds, bits = np.bitwise_or.reduceat(self.KINDS_OF[c], begins), np.bitwise_or.reduceat(self.BITS[c], begins)
        s, distinct = np.where(one, self.single[head], self.shape_by_kinds[kinds]), np.bitwise_count(bits).astype(np.int64)
        turns = np.where(one & self.single_digit[head], 5, 0)
        word_begin = begins.copy()
        odd = np.flatnonzero(~one & (kinds > _LOWER))
        if len(odd):
            sizes = n[odd]
            at = np.cumsum(sizes) - sizes
            places = np.arange(int(sizes.sum()))
            x = c[places + np.repeat(begins[odd] - at, sizes)]
            kind, first = self.CLASS[x], np.zeros(len(x), bool)
            first[at] = True
            earlier = np.append(np.uint8(0), kind[:-1])
            earlier[first] = 0
            switch = self.SWITCH[4 * earlier + kind] & ~first
            switches, digits = np.add.reduceat(switch.astype(np.int64), at), np.add.reduceat((kind == 3).astype(np.int64), at)
            turns[odd] = 6 * np.minimum(9, 10 * switches // sizes) + 5 * digits // sizes
            distinct[odd] += np.bitwise_count(np.bitwise_or.reduceat(self.MORE_BITS[x], at))
            cased = (earlier == 1) | (earlier == 2)
            title = ~np.logical_or.reduceat(((kind == 2) & cased) | ((kind == 1) & ~cased), at)
            s[odd[title & (s[odd] == self.place["mixed"])]] = self.place["title"]
            for k in odd[(sizes == 36) & (kinds[odd] & _DIGIT > 0)].tolist():
                if UUID.fullmatch(c[begins[k] : ends[k]].tobytes().decode()):
                    s[k] = self.place["uuid"]
            # The last part of letters: capitals, or small letters and one capital before them that follows no other.
            tail, final = at + sizes - 1, kind[at + sizes - 1]
            for letters in (1, 2):
                of = np.flatnonzero(final == letters)
                other = np.maximum.accumulate(np.where((kind != letters) | first, places, -1))[tail[of]]
                # ``other`` is the last place that differs, or the token's first place.
                begin = other + (kind[other] != letters)
                if letters == 1:
                    capital = (begin > at[of]) & (kind[begin - 1] == 2) & ((begin - 1 == at[of]) | (kind[begin - 2] != 2))
                    begin = begin - capital
                word_begin[odd[of]] += begin - at[of]
        spread = 30 * (np.minimum(n, 60) // 6) + np.where(one, 10, 10 * distinct // np.minimum(n, 24))
        word = np.where((n <= 24) & ~one & (kinds & 0xF0 == 0), 0, -1)
        size = ends - word_begin
        maybe = np.flatnonzero(~one & (n <= 24) & (size <= self.longest))
        maybe = maybe[self.edges[self.ALNUM[c[word_begin[maybe]]], self.ALNUM[c[ends[maybe] - 1]], size[maybe]]]
        if len(maybe):
            begin, size, code = word_begin[maybe], size[maybe], np.zeros(len(maybe), np.int64)
            for k in range(int(size.max())):
                code = np.where(k < size, 37 * code + self.ALNUM[c[np.minimum(begin + k, len(c) - 1)]], code)
            found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            right = (self.codes[found] == code) & (self.lengths[found] == size)
            word[maybe[right]] = self.word_at[found[right]]
        return s, spread, turns, word

    def _lines(self, text: str, codes: np.ndarray) -> np.ndarray:
        """Numbers of lines of ``text``, whose lines have the code classes ``codes``."""
        c = self.bytes_of(text)
        breaks = np.flatnonzero(c == 10)
        begins, ends, space = self._tokens(c)
        if not len(begins):
            return begins
        out = [np.searchsorted(breaks, self._loud(c))]
        s, spread, turns, w = self._describe_tokens(c, begins, ends)
        m, line = len(begins), np.searchsorted(breaks, begins)
        out.append(line[(ends - begins > 1) & (c[begins] == 47) & (c[np.minimum(begins + 1, len(c) - 1)] == 47)])
        glued = np.append(False, ~space[begins[1:] - 1])
        first = np.append(True, line[1:] != line[:-1])
        last, n, wide = np.append(first[1:], True), len(self.SHAPES), 2 * len(self.SHAPES) + 1
        near = 1 + np.append(0, s[:-1]) + n * glued
        before = wide * s + np.where(first, 0, near)
        after = wide * s + np.where(last, 0, np.append(1 + s[1:] + n * glued[1:], 0))
        second = np.where(first | np.append(True, first[:-1]), 0, 1 + np.append([0, 0], s[:-2])[:m])
        rest = 3 * (n * codes[line] + s) + np.where(glued, 1 + np.append(False, glued[:-1]), 0)
        # The next word on either side, at most three tokens away and on the same line.
        place = np.arange(m)
        known = np.maximum.accumulate(np.where(w >= 0, place, -4))
        known = np.append(-4, known[:-1])
        safe = np.maximum(known, 0)
        left = np.where((place - known <= 3) & (line[safe] == line), w[safe], 0)
        known = np.minimum.accumulate(np.where(w >= 0, place, m + 3)[::-1])[::-1]
        known = np.append(known[1:], m + 3)
        safe = np.minimum(known, m - 1)
        right = np.where((known - place <= 3) & (line[safe] == line), w[safe], 0)
        left = len(self.words) * s + left
        long = np.flatnonzero(ends - begins > 12)
        key = (c[begins[long]].astype(np.int64) << 16) | (c[begins[long] + 1].astype(np.int64) << 8) | c[begins[long] + 2]
        named = np.searchsorted(self.starts, key)
        named = np.where(self.starts[named] == key, named, len(self.starts) - 1)

        def above(y):
            """How far a tag lies above outside."""
            x = self.before[y][before] + self.after[y][after]
            for t, k in ((self.second, second), (self.rest, rest), (self.left, left), (self.right, right), (self.spread, spread), (self.turns, turns)):
                x += t[y][k]
            x += self.no_start[y][0]
            x[long] += self.start[y][named] - self.no_start[y][0]
            return x

        # The most that a span ending at each token gains over all tokens outside; spans lie within glued runs.
        trans = np.array(self.fitted[1])
        gain = above(0) + np.where(first, 0, trans[0, 1] - trans[0, 0])
        step = place - np.maximum.accumulate(np.where(glued, 0, place))
        at = np.flatnonzero(glued)
        if len(at):
            begin, more = gain.copy(), above(1) + max(trans[1, 2], trans[2, 2]) - trans[0, 0]
            for k in range(1, self.RUN + 1):
                here, at = at[step[at] == k], at[step[at] > k]
                gain[here] = np.maximum(begin[here], gain[here - 1] + more[here])
                if not len(at):
                    break
        leave = np.where(last, 0, max(trans[1, 0], trans[2, 0]) - trans[0, 0])
        out.append(line[(gain + leave > -1e-6) | (step >= self.RUN)])
        return np.unique(np.concatenate(out))


_scores: list[Scores] = []


def _scores_of(fitted) -> Scores:
    """The tables of a model; a worker that gets an equal one with its next task goes on with them."""
    if not _scores or (_scores[0].fitted is not fitted and _scores[0].also is not fitted):
        if _scores and _scores[0].fitted == fitted:
            _scores[0].also = fitted
        else:
            _scores[:] = [Scores(fitted)]
    return _scores[0]


def field_spans(text: str, fitted=None) -> list[Span]:
    """Spans that the random field tags."""
    return field_spans_of([text], fitted)[0]


def field_spans_of(texts: list[str], fitted=None) -> list[list[Span]]:
    """The same of many texts, whose lines are sorted out together."""
    table, codes = _scores_of(fitted or model()), [code_like(t) for t in texts]
    return [_decoded(t, code, numbers, table) if numbers else [] for t, code, numbers in zip(texts, codes, table.lines_of(texts, codes), strict=True)]


def _decoded(text: str, code: int, numbers: list[int], table: Scores) -> list[Span]:
    """Spans of the best path over the lines of these numbers."""
    trans, out = table.fitted[1], []
    ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    for number in numbers:
        begin, end = ends[number - 1] + 1 if number else 0, ends[number]
        found = list(TOKEN.finditer(text, begin, end))
        toks = [m[0] for m in found]
        glued = [False, *(a.end() == b.start() for a, b in zip(found, found[1:], strict=False))]
        scores = []
        for t, x, joined in zip(toks, contexts(toks, glued), glued, strict=True):
            a, b = table.local(t), table.around(x, code)
            scores.append((a[0] + b[0], a[1] + b[1], a[2] + b[2] - (0 if joined else 50)))
        outside = [s[0] - max(s[1], s[2]) > table.most for s in scores]
        k = 0
        while k < len(toks):
            if outside[k]:
                k += 1
                continue
            last = k + 1
            while last < len(toks) and not outside[last]:
                last += 1
            part = scores[k:last]
            # The neighbours are outside: leaving the last token costs as much from any tag.
            if last < len(toks):
                part[-1] = tuple(s + trans[j][0] for j, s in enumerate(part[-1]))
            if k:
                part[0] = tuple(s + trans[0][j] for j, s in enumerate(part[0]))
            tags = viterbi(part, trans, k > 0)
            for i, tag in enumerate(tags):
                if tag == 1:
                    stop = i + 1
                    while stop < len(tags) and tags[stop] == 2:
                        stop += 1
                    out.append((found[k + i].start(), found[k + stop - 1].end(), "crf"))
            k = last
    return out


def spans(text: str | None, fitted=None) -> list[Span]:
    """All spans, by start and then by kind."""
    return spans_of([text], fitted)[0]


def spans_of(texts: list[str | None], fitted=None) -> list[list[Span]]:
    """The same of many texts."""
    texts = [t or "" for t in texts]
    bases = [base_spans(t) for t in texts]
    return [sorted(base + _beyond(found, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for base, found in zip(bases, field_spans_of(texts, fitted), strict=True)]


def _beyond(found: list[Span], base: list[Span]) -> list[Span]:
    """The spans of ``found`` of which base spans leave something."""
    merged: list[list[int]] = []
    for start, end, _ in sorted(base):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    starts = [m[0] for m in merged]
    covered = lambda s: (k := bisect_right(starts, s[0]) - 1) >= 0 and merged[k][1] >= s[1]
    return [s for s in found if not covered(s)]


def redacted(text: str | None, fitted=None, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by ``mark``; of assignments, the value only."""
    return _replaced(text, spans(text, fitted), mark)


def _replaced(text: str | None, found: list[Span], mark: str = "[SECRET]") -> str | None:
    out, at = [], 0
    for start, end, kind in found:
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:] if out else text


def scan(docs: DataFrame, text: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """``keep`` with found: an array of (start, end, kind) of every whole text."""
    chosen = docs.select(*keep, F.col(text).alias("__text"))
    fitted = model()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", found array<struct<start: bigint, end: bigint, kind: string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for b in batches:
            found = [[{"start": x, "end": y, "kind": k} for x, y, k in each] for each in spans_of(b.column(b.num_columns - 1).to_pylist(), fitted)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], [*b.schema.names[:-1], "found"])

    return chosen.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all secrets in ``text`` replaced."""
    fitted = model()
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            made = pa.array([_replaced(t, found) for t, found in zip(texts, spans_of(texts, fitted), strict=True)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], made, *b.columns[at + 1 :]], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES: dict[str, str] = {}
