"""Personal data by candidate gradient boosting.

Generators propose spans that may overlap: emails and their spelt-out forms, with brackets and without, IPv4
addresses and IPv6 addresses whole or compressed, card and account numbers, phone numbers with and without a
country, social-security numbers, and long words with digits, which may be secrets (tokens, keys, passwords).
Boosted trees score each from its format and its context, the scores are calibrated on held-out rows, and
each kind has the least threshold at which its precision there meets a target. Selected spans are taken best
first, without overlaps. The exact base patterns are always selected; the trees only add to them.

The trees are fitted on the driver on a bounded, seeded set of generated examples (TRAIN_ROWS), as no table
labels personal data. Null and empty texts have no spans; an empty table gives no rows. Whole texts are scanned, in time that grows with their
length and with n * log(n) of their spans.
Repeated rows are judged alike; other columns are not looked at. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import ipaddress
import random
import re
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, tune

TRAIN_ROWS = 6000
TARGET_PRECISION = 0.98
#: Calibrated probability that every selected span has, besides.
LEAST_SURE = 0.8
#: The kinds in their order of listing; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four base patterns, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        if len(parts) >= 4:
            pos = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                    out.append(("ip", pos, pos + size))
                pos += size + 1
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: Generators: kind and pattern. Repeats are bounded or can't overlap, so time is linear.
_GENERATORS = tuple(
    (k, re.compile(p))
    for k, p in (
        ("email", r"(?<![\w.])[A-Za-z0-9][\w.%+-]{0,63}[ ]?[\[({][ ]?(?:at|AT|At|@)[ ]?[\])}][ ]?[A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?[\[({][ ]?(?:dot|DOT|Dot|\.)[ ]?[\])}][ ]?)[A-Za-z0-9-]{1,63}){1,4}"),
        ("email", r"(?<![\w.])[A-Za-z0-9][\w.%+-]{0,63} (?:at|AT) [A-Za-z0-9-]{2,63}(?: (?:dot|DOT) [A-Za-z0-9-]{2,63}){1,3}(?![\w-])"),
        ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])"),
        ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
        ("card", r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){3}(?![0-9])"),
        ("card", r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"),
        ("card", r"(?<![0-9])3[068][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{4}(?![0-9])"),
        ("phone", r"(?<![0-9+.])0[1-9](?:[ .][0-9]{2}){4}(?![0-9.])"),
        ("phone", r"(?<![0-9+])0[1-9][0-9]{1,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9])"),
        ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
        ("phone", r"(?<![0-9])00[1-9][0-9]{0,2}[ ]?(?:[0-9]{2,4}[ -]?){2,4}[0-9]{2}(?![0-9])"),
        ("ssn", r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
        ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,199}[0-9])[A-Za-z0-9_-]{20,200}(?![A-Za-z0-9_-])"),
    )
)
#: Words of the context, by what they speak for.
_CUES = (
    re.compile(r"(?i)(?:e-?mail|contact|write|reach)\W{0,3}(?:\w+\W{1,3}){0,2}$"),
    re.compile(r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|dial)\W{0,4}(?:\w+\W{1,3}){0,2}$"),
    re.compile(r"(?i)(?:card|visa|mastercard|amex|credit|debit|cc)\W{0,4}(?:\w+\W{1,3}){0,2}$"),
    re.compile(r"(?i)(?:ssn|social security)\W{0,4}(?:\w+\W{1,3}){0,2}$"),
    re.compile(r"(?i)(?:iban|account|bank)\W{0,4}(?:\w+\W{1,3}){0,2}$"),
    re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_ -]?key|auth|bearer|private[_ -]?key)\W{0,6}$"),
    re.compile(r"(?i)(?:commit|sha-?[0-9]*|md5|hash|checksum|digest|blob|rev|uuid|file|path|url)\W{0,6}$"),
    re.compile(r"[=:]\s{0,2}[\"']?$"),
    re.compile(r"(?i)(?:order|isbn|invoice|ref|version|serial|part|sku|id|model|hash|no)\W{0,4}(?:\w+\W{1,3}){0,1}$"),
)


#: How addresses mostly end.
_NAMED = re.compile(r"(?i)(?:\.|dot)[\])}]?[ ]?(?:com|org|net|edu|gov|io|info|eu|de|fr|es|it|uk|us|co)$")
_HEX = frozenset("0123456789abcdefABCDEF")


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and 2 <= int(s[2:4]) <= 98 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ipv6_ok(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    digits = "".join(_DIGIT.findall(span))
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        sum(c in " -.()" for c in span),
        float(bool(digits) and luhn(digits)),
        float(kind == "iban" and _iban_ok(span)),
        float(kind == "ssn" and span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"),
        len(set(digits)),
        float(digits[:1] in "3456" and bool(digits)),
        float(start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_-/#.=")),
        float(end < len(text) and (text[end].isalnum() or text[end] in "_-/#.=" and text[end + 1 : end + 2].isalnum())),
        float(span[:1] == "("),
        float(kind == "ip" and _ipv6_ok(span)),
        len(set(span)),
        float(set(span) <= _HEX),
        span.count("_") + span.count("-"),
        span.count(":"),
        sum(c in "[](){}" for c in span),
        float(kind == "email" and _NAMED.search(span) is not None),
        float(before[-1:].isdigit() or before[-2:-1].isdigit()),
        max(map(len, re.findall(r"[A-Za-z0-9]+", span)), default=0),
        *[float(bool(c.search(before))) for c in _CUES],
    ]


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with labels: real formats with and without cues, and look-alikes."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    w = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def with_check(prefix: str) -> str:
        return next(prefix + c for c in "0123456789" if luhn(prefix + c))

    def iban(valid: bool) -> str:
        """An account number of any country and length, of right form; its check digits right or (most likely) wrong."""
        country, body = "".join(rng.choice("ABDEFGILNPRST") for _ in range(2)), "".join(rng.choice("0123456789" * 3 + "ABCDEFGH") for _ in range(rng.randint(11, 26)))
        if not valid:
            return f"{country}{rng.randrange(2, 98):02d}{body}"
        return next(s for k in range(2, 99) if _iban_ok(s := f"{country}{k:02d}{body}"))

    def grouped(s: str, k: int = 4, sep: str | None = None) -> str:
        sep = rng.choice([" ", "-", ""]) if sep is None else sep
        return sep.join(s[i : i + k] for i in range(0, len(s), k))

    cues = {"email": ["email ", "contact: ", "write to "], "phone": ["phone: ", "call ", "tel ", "fax: "], "card": ["card ", "visa: ", "credit card no "], "ssn": ["ssn: ", "SSN ", "social security number "], "iban": ["iban ", "account: ", "bank "], "ip": ["host ", "from ", "ip "]}
    bad = ["order ", "invoice no ", "ref ", "serial ", "part ", "isbn ", "id=", "#", "version ", "sku "]
    rows, labels = [], []
    while len(rows) < n:
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        if kind == "secret":
            signs = rng.choice(["0123456789abcdef", "0123456789ABCDEF", letters, letters + "__--"])
            s = "".join(rng.choice(signs) for _ in range(rng.choice([20, 24, 32, 40, 40, 64])))
            if good:
                cue = rng.choice(['token = "', "token: ", "api_key=", 'password = "', "secret: ", "Bearer ", 'auth_token="', "private key: "])
            elif rng.random() < 0.5:
                cue = rng.choice(["commit ", "sha256:", "md5 ", "checksum: ", "hash = ", "uuid: ", "file ", "rev ", 'blob "', w() + " "])
            else:
                s, cue = "_".join(w() for _ in range(4)) + f"_{d(4)}", rng.choice(["file ", "see ", "token ", w() + " "])
        elif kind == "email" and rng.random() < 0.5:
            s = f"{w()} at {w()} dot {rng.choice(['com', 'org', 'net', 'edu', 'io'])}" if good else rng.choice([f"{w()} at {w()} dot {w()} dot", f"{w()} at {d(1)}{w()} dot {w()}{w()}"])
            cue = rng.choice(cues["email"] * 2 + [w() + " "]) if good else rng.choice(["met ", "stayed ", w() + " "])
        elif kind == "ip" and rng.random() < 0.6:
            h = lambda: f"{rng.randrange(65536):x}"
            s = ":".join(h() for _ in range(rng.randint(1, 4))) + "::" + ":".join(h() for _ in range(rng.randint(1, 3)))
            cue = rng.choice(cues["ip"] + ["", w() + " "])
            if not good or not any(len(x) > 2 for x in s.split(":")):
                good = False
                s, cue = rng.choice([(f"{d(2)}::{d(2)}", ""), (f"{w()}::{w()}", ""), (f"{rng.choice('abcdef')}::{rng.choice('abcdef')}", "x"), (":".join(["1"] * 6) + "::" + ":".join(["2"] * 4), "")])
        elif kind == "email":
            at, dot, end = rng.choice(["[at]", "(at)", "{at}", "[ at ]", "[@]"]), rng.choice([" [dot] ", " (dot) ", "{dot}", " [.] ", "."]), rng.choice(["com", "com", "org", "net", "edu", "io", "de", "fr"])
            s = f"{w()}{rng.choice(['.', '_', ''])}{w()} {at} {w()}{dot}{end}" if good else f"{w()} {at} {w()}{rng.choice(['.', dot])}{w()}x"
            cue = rng.choice(cues["email"] + ["", "", w() + " ", w() + ", "]) if good else rng.choice(["", "met ", "stayed ", w() + " "])
        elif kind == "ip":
            s, cue = ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), ""
            if not good:
                s = ":".join(d(2) for _ in range(8))
        elif kind == "card":
            number = with_check(rng.choice(["3" + rng.choice("068") + d(11), rng.choice("3456") + d(14), rng.choice("3456") + d(14)])) if good else d(rng.choice([14, 16, 16]))
            sep = rng.choice(["", " ", "-"]) if good else rng.choice(["", " ", "-", "."])
            s = sep.join((number[:4], number[4:10], number[10:])) if len(number) == 14 else grouped(number, 4, sep)
            good = number[0] in "3456" and luhn(number)  # as for the base pattern, a valid number is a card wherever it stands
            cue = rng.choice(cues["card"] * (1 + good) + [w() + " "]) if good else rng.choice(bad + [w() + " "] * 4)
            if rng.random() < 0.4:  # other numbers stand before it
                cue = rng.choice([f"{d(rng.randint(1, 4))} ", f"{w()} {d(1)}.{d(1)}.{d(2)}.{d(1)} ", f"{d(16)} ", grouped(d(16), 4, " ") + " ", f"{d(2)}-", f"+{d(9)}, "])
        elif kind == "phone":
            a, b, c = d(3), d(3), d(4)
            s = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0049 {d(3)} {d(4)} {d(2)}", f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{rng.randint(1, 9)}{d(2)}/{d(4)}{d(3)}", f"0{rng.randint(1, 9)}{d(3)} {d(3)} {d(4)}"]) if good else rng.choice([f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}-{b}-{c}", f"00{d(2)}{d(4)}{d(4)}", f"0{rng.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{rng.randint(1, 9)}{d(3)}-{d(3)}{d(4)}"])
            cue = rng.choice(cues["phone"] * 3 + ([w() + " "] if s[0] == "(" else [])) if good else rng.choice(bad + [w() + " "] * 3)
        elif kind == "ssn":
            s = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if good else rng.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"{d(3)} {d(2)} {d(4)}"])
            cue = rng.choice(cues["ssn"] * 2 + [w() + " "]) if good else rng.choice(bad + [w() + " "])
        else:
            s = iban(good)
            good = good or _iban_ok(s)
            s, cue = grouped(s, 4), rng.choice(cues["iban"] + [w() + " "] * 3) if good else rng.choice(bad + cues["iban"] + [w() + " "] * 6)
        head = f"{w()} {w()} {cue}"
        text = f"{head}{s}{rng.choice(['', '.', ',', ' '])} {w()}" if good or rng.random() < 0.8 else f"{head}{rng.choice('-/x')}{s}-{d(3)}"
        for k, p in _GENERATORS:
            for m in p.finditer(text):
                rows.append(features(text, k, *m.span()))
                here = m.start() < len(head) + len(s) and m.end() > len(head)  # not a number that only stands before it
                labels.append(float(k == kind and (good if here else k == "card" and m.group()[0] in "3456" and luhn("".join(_DIGIT.findall(m.group()))))))
    return np.array(rows[:n]), np.array(labels[:n])


class Trees:
    """Boosted regression trees for the logistic loss, by exact splits over at most `bins` values a feature."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins, self.trees, self.bias = rounds, depth, rate, bins, [], 0.0

    def _grow(self, at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        """A tree over the rows whose bins are `at`; sums of each bin give the gain of every cut of a feature at once."""
        leaf = float(g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 20:
            return leaf
        best, gain = None, 1e-3 + g.sum() ** 2 / (h.sum() + 1.0)
        for j, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            gl, hl = (np.bincount(at[:, j], v, len(cuts) + 1).cumsum()[:-1] for v in (g, h))
            score = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0)
            if score.max() > gain:
                best, gain = (j, int(score.argmax())), score.max()
        if best is None:
            return leaf
        left = at[:, best[0]] <= best[1]
        return (best[0], float(self.cuts[best[0]][best[1]]), *(self._grow(at[m], g[m], h[m], depth - 1) for m in (left, ~left)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.cuts = []
        for values in map(np.unique, x.T):
            self.cuts.append((np.unique(np.quantile(values, np.linspace(0, 1, self.bins))) if len(values) > self.bins else values)[:-1])
        at = np.stack([np.searchsorted(c, column) for c, column in zip(self.cuts, x.T)], 1)
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(at, y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            f += self.rate * np.array([self._value(tree, row) for row in x])
        return self

    @staticmethod
    def _value(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row) -> float:
        return self.bias + self.rate * sum(self._value(t, row) for t in self.trees)


_FITTED: dict = {}


def fitted(seed: int = 11) -> tuple[Trees, np.ndarray, np.ndarray, np.ndarray]:
    """Trees, the calibration (scores, probabilities: pool-adjacent-violators) and a threshold for each kind."""
    if seed not in _FITTED:
        x, y = _examples(TRAIN_ROWS, seed)
        trees = Trees().fit(x, y)
        hx, hy = _examples(TRAIN_ROWS // 2, seed + 1)
        s = np.array([trees.score(r) for r in hx])
        order = np.argsort(s, kind="stable")
        pools: list[list[float]] = []
        for v, t in zip(s[order], hy[order]):
            pools.append([v, t, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
        upper, prob = np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])
        calibrated = prob[np.minimum(np.searchsorted(upper, s), len(prob) - 1)]
        cuts = np.full(len(KINDS), 1.01)
        for k in range(len(KINDS)):
            own = hx[:, 0] == k
            for cut in np.unique(calibrated[own & (calibrated >= LEAST_SURE)]):
                if hy[own & (calibrated >= cut)].mean() >= TARGET_PRECISION:
                    cuts[k] = cut
                    break
        _FITTED[seed] = (trees, upper, prob, cuts)
    return _FITTED[seed]


_MAYBE = re.compile(r"[0-9]| (?:at|AT) [A-Za-z0-9-]{2,63} (?:dot|DOT) |[\[({][ ]?(?:at|AT|At|@)[ ]?[\])}]")


def all_spans(text: str, model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans by kind as listed, then start."""
    base = base_spans(text)
    if not _MAYBE.search(text):
        return base, base
    trees, upper, prob, cuts = model
    found = []
    for kind, pattern in _GENERATORS:
        for m in pattern.finditer(text):
            p = prob[min(int(np.searchsorted(upper, trees.score(features(text, kind, *m.span())))), len(prob) - 1)]
            if p >= cuts[KINDS.index(kind)]:
                found.append((-p, m.start(), m.end(), kind))
    if not found:
        return base, base
    # What is taken, as disjoint stretches in order of place.
    taken: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = list(base)
    for _, s, e, kind in sorted(found):
        at = bisect_right(taken, (s, e))
        if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
            insort(taken, (s, e))
            out.append((kind, s, e))
    return base, sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The columns `keep`, the base spans' counts, and the base spans and all spans as text, of every row."""
    tune(df.sparkSession)
    model = fitted()
    names = ["n_email", "n_ip", "n_card", "n_phone"]

    @F.pandas_udf(T.StructType([*[T.StructField(n, T.LongType()) for n in names], T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]))
    def spans(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = all_spans(t or "", model)
            kinds = [k for k, _, _ in base]
            rows.append((*[kinds.count(k) for k in KINDS[:4]], _joined(base), _joined(every)))
        return pd.DataFrame(rows, columns=[*names, "base", "spans"])

    out = df.select(*[F.col(k) for k in keep], spans(F.col(text)).alias("_found"))
    return out.select(*keep, *[F.col(f"_found.{n}") for n in [*names, "base", "spans"]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span in `text` replaced by its kind in brackets, like [EMAIL]; null texts stay null."""
    tune(df.sparkSession)
    model = fitted()

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = sorted((s, e, k) for k, s, e in all_spans(t, model)[1]) if t else []
            if spans:
                parts, at = [], 0
                for s, e, k in spans:
                    if s >= at:
                        parts += [t[at:s], f"[{k.upper()}]"]
                    at = max(at, e)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    (tmp,) = fresh(df, "redacted")
    return df.withColumn(tmp, redacted(F.col(text))).select(*[F.col(tmp).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
