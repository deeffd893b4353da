"""Personal data by a semi-Markov conditional random field: whole spans are scored, boundaries and types chosen jointly.

A text is cut into tokens around its triggers (digits, at-marks and words for them).  A segmentation is a row of
segments: single tokens that are nothing, and spans of at most TOKENS tokens that are of a kind.  A span's score sums
the weights of features of the whole span: digits and their grouping, separators, checksums, what stands at its
edges, cue words before it.  The best segmentation is found by dynamic programming over the segments' ends, bounded by the
longest span; the weights are those of the greatest likelihood of segmentations of invented sentences, by the
forward and backward sums of the same recursion.

Spans of the base patterns are always found, as the patterns say; the model adds spans that are written otherwise
("a (at) b (dot) org", numbers without a plus, cards in groups, secrets).
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Tokens and code points of a span at most, and code points before it in which cue words count.
TOKENS, LENGTH, BEFORE = 16, 64, 40
#: Invented sentences that the model is fitted on, passes over them, and the weight of the squares of all weights.
SENTENCES, PASSES, DECAY = 800, 60, 0.02

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = (ord(d) - 48) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind, by kind and start.

    The patterns are the contract's; they are written so that each is linear in the text.  An address's first part
    is found backwards from its at-mark, up to the match before; a run of digits is tried from its start only, since
    from within it no other match is possible.
    """
    out, last = [], 0
    if "@" in text:
        for m in _EMAIL.finditer(text):
            a = m.start()
            while a > last and _LOCAL.match(text[a - 1]):
                a -= 1
            if m.start() >= last:
                out.append(("email", a, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_TRIGGER = re.compile(r"[0-9]++|@|[(\[{] ?[aA][tT] ?[)\]}]| [aA][tT] (?=[A-Za-z0-9-]{1,30}(?:\.[A-Za-z0-9-]{1,30}){0,3} (?:dot|DOT) )")
_IN_NUMBER, _IN_ADDRESS, _BRACKETS = set("+().-/[]"), set("._%+-()[]{}"), set("()[]{}")
#: Words that, before a span, speak for what it is.
CUES = {
    "mail": ("mail", "email", "e", "contact", "write", "address", "courriel", "correo"), "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "ring", "telefon", "teléfono"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"), "ip": ("ip", "host", "server", "addr", "ping", "login"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer", "apikey", "pwd"), "other": ("isbn", "page", "pages", "version", "order", "invoice", "section", "chapter", "year", "price", "model", "part", "no", "nr", "usd", "eur"),
}
#: Last parts of host names that are common enough to tell one from prose.
LAST_PARTS = ("com", "org", "net", "edu", "gov", "int", "io", "co", "info", "eu", "de", "fr", "es", "it", "nl", "uk", "us", "au", "nz", "ca", "ch", "at", "be", "pl", "se", "jp", "cn", "in", "br", "ru")
_CUE = {w: cue for cue, words in CUES.items() for w in words}


class Region:
    """Tokens of a part of a text around triggers, and the spans that can be of a kind.

    A span is written on one line and holds a digit or an at-mark.  It is a number (digits and their separators, single
    spaces between), an address (one at-mark; spaces beside marks and brackets only) or one token of 16 letters
    and digits or more.
    """

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start = text, start
        marks = {m.start() + (not m.group()[0].isalnum() and m.group()[0] != "@") + (m.group()[1:2] == " ") for m in _TRIGGER.finditer(text, start, end) if not m.group()[0].isdigit()}
        self.tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
        self.words = [text[a:b] for a, b in self.tokens]
        self.digit = [w.isdecimal() and w.isascii() for w in self.words]
        self.mark = [a in marks for a, _ in self.tokens]
        self.marked = any(self.mark)

    def gap(self, i: int) -> str:
        """What stands between token i - 1 and token i."""
        return self.text[self.tokens[i - 1][1] : self.tokens[i][0]]

    def candidates(self) -> list[tuple[int, int]]:
        out, n = [], len(self.tokens)
        for i in range(n):
            w = self.words[i]
            if self.digit[i] or (w in "+(" and i + 1 < n and (self.digit[i + 1] or self.words[i + 1] == "(")):
                out += self._numbers(i)
            if not w[0].isalnum():
                continue
            if not self.digit[i] and 16 <= len(w) <= LENGTH and w.isascii() and not w.isalpha():
                out.append((i, i + 1))
            if self.marked:
                out += self._addresses(i)
        return out

    def _numbers(self, i: int) -> Iterator[tuple[int, int]]:
        for j in range(i, min(i + TOKENS, len(self.tokens))):
            if j > i and self.gap(j) not in ("", " ") or self.tokens[j][1] - self.tokens[i][0] > LENGTH:
                return
            if self.digit[j]:
                yield i, j + 1
            elif self.words[j] not in _IN_NUMBER:
                return

    def _addresses(self, i: int) -> Iterator[tuple[int, int]]:
        marks = 0
        for j in range(i, min(i + TOKENS, len(self.tokens))):
            w = self.words[j]
            marks += self.mark[j]
            if marks > 1 or self.tokens[j][1] - self.tokens[i][0] > LENGTH or not (w[0].isalnum() or w in _IN_ADDRESS or self.mark[j]):
                return
            if j > i and (gap := self.gap(j)) and not (gap == " " and (self._joins(j) or self._joins(j - 1))):
                return
            if marks and not self.mark[j] and w[0].isalnum() and w.lower() != "dot":
                yield i, j + 1

    def _joins(self, i: int) -> bool:
        return self.mark[i] or self.words[i] in _BRACKETS or self.words[i].lower() == "dot"

    def features(self, i: int, j: int) -> list[str]:
        """Names of the features that the span of tokens i to j - 1 has."""
        a, b = self.tokens[i][0], self.tokens[j - 1][1]
        groups = [w for w, d in zip(self.words[i:j], self.digit[i:j], strict=True) if d]
        out = ["any"]
        if any(self.words[i:j].count(x) != self.words[i:j].count(y) for x, y in ("()", "[]", "{}")):
            out.append("open bracket")
        if any(self.mark[i:j]):
            at = next(k for k in range(i, j) if self.mark[k])
            host = self.words[at + 1 : j]
            dots = sum(w == "." or w.lower() == "dot" for w in host)
            last = self.words[j - 1]
            out += ["address", f"mark {self.words[at].lower()}", f"dots {min(dots, 3)}", f"ends {'known' if last.lower() in LAST_PARTS else 'letters' if last.isalpha() and 2 <= len(last) <= 6 else 'otherwise'}", f"spaced {any(self.gap(k) for k in range(i + 1, j))}"]
            if dots == 0:
                out.append("no host")
        elif groups and len(groups) + sum(w in _IN_NUMBER for w in self.words[i:j]) == j - i:
            digits = "".join(groups)
            n = len(digits)
            seps = {self.text[self.tokens[k][0]] for k in range(i, j) if not self.digit[k]} | {" " for k in range(i + 1, j) if self.gap(k)}
            sizes = "-".join(str(min(len(g), 5)) for g in groups) if len(groups) < 6 else "many"
            out += ["number", f"digits {n if n < 20 else 20}", f"groups {min(len(groups), 6)}", f"sizes {sizes}", f"between {''.join(sorted(seps))}", f"plus {self.words[i] == '+'}"]
            if 13 <= n <= 19:
                out += [f"luhn {luhn(digits)}", f"luhn {luhn(digits)} in {min(len(groups), 6)}"]
            if len(groups) == 4:
                fits = all(len(g) <= 3 and int(g) <= 255 for g in groups)
                out.append(f"four {fits} {'.' in seps and seps <= set('.[] ')}")
            if len(groups) == 1 and n == 4 and digits[:2] in ("19", "20"):
                out.append("year")
        else:
            w = self.words[i]
            out += ["mixed", f"hex {all(c in '0123456789abcdefABCDEF' for c in w)}", f"size {min(len(w) // 8, 6)}"]
        return out + self._around(i, j, a, b)

    def _around(self, i: int, j: int, a: int, b: int) -> list[str]:
        out = []
        if i:
            gap, w = self.gap(i), self.words[i - 1]
            if not gap:
                out.append(f"after {w if not w[0].isalnum() else 'word'}")
            number = self.digit[i - 1] or (w in _IN_NUMBER and i > 1 and self.digit[i - 2] and not self.gap(i - 1))
            if gap in ("", " ") and number:
                out.append("goes on before")
        if j < len(self.tokens):
            gap, w = self.gap(j), self.words[j]
            if not gap and w not in (".", ","):
                out.append(f"before {w if not w[0].isalnum() else 'word'}")
            if not gap and w == "." and j + 1 < len(self.tokens) and not self.gap(j + 1) and self.words[j + 1][0].isalnum():
                out.append("goes on behind")
            number = self.digit[j] or (w in _IN_NUMBER and j + 1 < len(self.tokens) and self.digit[j + 1] and not self.gap(j + 1))
            if gap in ("", " ") and number:
                out.append("goes on behind")
        cue, seen = "none", 0
        for k in range(i - 1, -1, -1):
            if self.tokens[k][0] < a - BEFORE or seen == 3:
                break
            if self.words[k].isalpha():
                seen += 1
                if self.words[k].lower() in _CUE:
                    cue = _CUE[self.words[k].lower()]
                    break
        return [*out, f"cue {cue}"]


def regions(text: str) -> Iterator[Region]:
    """The parts of a text that can hold spans, none of which overlap.  Triggers longer than any span have none."""
    reach, open_ = LENGTH + BEFORE, None
    for m in _TRIGGER.finditer(text):
        if m.end() - m.start() > LENGTH:
            continue
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if open_ and a <= open_[1]:
            open_ = (open_[0], b)
            continue
        if open_:
            yield _whole_tokens(text, *open_)
        open_ = (a, b)
    if open_:
        yield _whole_tokens(text, *open_)


def _whole_tokens(text: str, a: int, b: int) -> Region:
    """The region without the pieces of words that its ends cut; no span reaches them."""
    if a and text[a - 1].isalnum():
        while a < b and text[a].isalnum():
            a += 1
    if b < len(text) and text[b].isalnum():
        while b > a and text[b - 1].isalnum():
            b -= 1
    return Region(text, a, b)


class Model:
    """Weights of features by kind, and of one segment's kind after another's (0: nothing, then KINDS)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray) -> None:
        self.names, self.weights, self.steps = names, weights, steps

    def score(self, features: list[str]) -> np.ndarray:
        return self.weights[[self.names[f] for f in features if f in self.names]].sum(0)

    def best(self, region: Region) -> list[tuple[int, int, int]]:
        """(first token, end, kind) of the spans in the best segmentation; among equal ones, that with nothing at the end."""
        found = region.candidates()
        if not found:
            return []
        n, steps = len(region.tokens), self.steps
        ends: dict[int, list] = {}
        for i, j in found:
            ends.setdefault(j, []).append((i, self.score(region.features(i, j))))
        best = np.full((n + 1, len(KINDS) + 1), -np.inf)
        best[0, 0] = 0
        back: list[list] = [[None] * (len(KINDS) + 1) for _ in range(n + 1)]
        reach = {0: (best[0][:, None] + steps)}
        for t in range(1, n + 1):
            before = reach[t - 1]
            y = int(before[:, 0].argmax())
            best[t, 0], back[t][0] = before[y, 0], (t - 1, y)
            for i, score in ends.get(t, ()):
                before = reach[i]
                for kind in range(1, len(KINDS) + 1):
                    y = int(before[:, kind].argmax())
                    if (total := before[y, kind] + score[kind - 1]) > best[t, kind]:
                        best[t, kind], back[t][kind] = total, (i, y)
            reach[t] = best[t][:, None] + steps
            reach.pop(t - TOKENS - 1, None)
        t, kind, out = n, int(best[n].argmax()), []
        while t:
            i, y = back[t][kind]
            if kind:
                out.append((i, t, kind - 1))
            t, kind = i, y
        return out[::-1]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        for region in regions(text):
            out += [(KINDS[k], region.tokens[i][0], region.tokens[j - 1][1]) for i, j, k in self.best(region)]
        return out


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))


def _card(rng: random.Random, n: int = 16) -> str:
    head = _digits(rng, n - 1)
    return next(head + d for d in "0123456789" if luhn(head + d))


def _invented(rng: random.Random) -> tuple[str, str | None, str]:
    """A cue, a kind (none: nothing of a kind) and a string of that kind."""
    kind = rng.choice([*KINDS, None, None, None, None, None, None])
    if kind == "email":
        user = rng.choice([_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}{_digits(rng, 2)}", f"{_word(rng)}.{_digits(rng, 2)}", f"{_word(rng)}_{_word(rng)}"])
        host = [*rng.choice([[_word(rng)], [_word(rng), _word(rng)], [f"{_word(rng)}{_digits(rng, 1)}", "example"]]), rng.choice(["com", "org", "net", "de", "fr", "es", "io"])]
        at, dot = rng.choice([("@", "."), (" (at) ", " (dot) "), (" [at] ", "."), (" at ", " dot "), (" @ ", "."), (" (at) ", "."), ("[at]", "[dot]"), ("(at)", "(dot)")])
        return rng.choice(["email ", "contact ", "write to ", "", "", "mail: "]), kind, user + at + dot.join(host)
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        shape = rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 20 {_digits(rng, 4)} {c}", f"+49 {_digits(rng, 2)} {_digits(rng, 7)}", f"+{_digits(rng, 11)}", f"0{a[:2]} {_digits(rng, 3)} {c}", f"+1 {a} {b} {c}"])
        return rng.choice(["call ", "phone: ", "tel ", "", "", "mobile ", "fax "]), kind, shape
    if kind == "card":
        c = _card(rng)
        four = [c[k : k + 4] for k in range(0, 16, 4)]
        c15 = _card(rng, 15)
        return rng.choice(["card ", "visa ", "credit card: ", "", "", ""]), kind, rng.choice([c, c, " ".join(four), "-".join(four), ".".join(four), f"{c15[:4]} {c15[4:10]} {c15[10:]}"])
    if kind == "ip":
        four = [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice(["host ", "ip: ", "server ", "", "", "login from "]), kind, rng.choice([".", ".", ".", "[.]", "(.)"]).join(four)
    if kind == "secret":
        s = "".join(rng.choice(rng.choice(["0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"])) for _ in range(rng.choice([20, 24, 32, 40, 64]))) + "7"
        cue = rng.choice(["token = ", "api key: ", "secret=", "password: ", "bearer ", "key = "])
        quote = rng.choice(['"', "", "'"])
        return cue + quote, kind, "a" + s[:62]
    bad = _card(rng)
    bad = bad[:-1] + str((int(bad[-1]) + rng.randint(1, 9)) % 10)
    year = str(rng.randint(1950, 2030))
    plain = [
        year, f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{year}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year}", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}",
        f"{rng.randint(1, 9)},{_digits(rng, 3)}.{_digits(rng, 2)}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{_digits(rng, 4)}", bad, " ".join([bad[k : k + 4] for k in range(0, 16, 4)]), _digits(rng, rng.randint(1, 14)), _digits(rng, rng.choice([17, 18, 20, 22])),
        f"978-{rng.randint(0, 9)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{rng.randint(0, 9)}", f"{_digits(rng, 2)}-{_digits(rng, 2)}", f"{_digits(rng, 2)}.{rng.randint(0, 9)}%", " ".join(_digits(rng, rng.randint(1, 3)) for _ in range(rng.randint(2, 8))), f"{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 2)}",
        f"@{_word(rng)}", f"{_word(rng)} @ {_word(rng)}", f"{_word(rng)} (at) {_word(rng)}", f"{_word(rng)} at {_word(rng)} dot {_word(rng)}", f"{_word(rng)} at {_word(rng)} dot {_word(rng)} {_word(rng)}", f"{_digits(rng, 5)}-{_digits(rng, 4)}", f"({_digits(rng, 2)})", f"{_digits(rng, 3)}/{_digits(rng, 3)}", f"{_word(rng)}{_digits(rng, 3)}", _word(rng) + "x" * 12 + _digits(rng, 2), f"{_digits(rng, 4)}-{_digits(rng, 4)}",
    ]
    return rng.choice(["", "", "", "", "page ", "version ", "order ", "in ", "price ", "isbn ", "call "]), None, rng.choice(plain)


def sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """An invented text with one or two strings in it, and the spans of those that are of a kind."""
    out, spans = "", []
    for _ in range(rng.choice([1, 1, 2])):
        out += " ".join(_word(rng) for _ in range(rng.randint(1, 6))) + rng.choice([" ", " ", ", ", ": ", ".\n", " ("])
        cue, kind, text = _invented(rng)
        out += cue
        if kind:
            spans.append((kind, len(out), len(out) + len(text)))
        out += text + ('"' if cue.endswith('"') else "'" if cue.endswith("'") else "") + rng.choice([" ", ". ", ", ", " ", ") "])
    return out + " ".join(_word(rng) for _ in range(rng.randint(0, 4))), spans


def _sum(x: np.ndarray, axis) -> np.ndarray:
    """Logarithm of the sum of exponentials; of none, minus infinity."""
    most = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - most).sum(axis=axis, keepdims=True)) + most).squeeze(axis)


class Lattice:
    """All segmentations of some regions at once, their candidates dealt by end and length."""

    def __init__(self, found: list[Region], gold: list[set], names: dict[str, int]) -> None:
        rows, cols, self.at, self.gold = [], [], [], []
        for r, (region, spans) in enumerate(zip(found, gold, strict=True)):
            for i, j in region.candidates():
                ids = [names.setdefault(f, len(names)) for f in region.features(i, j)]
                rows += [len(self.at)] * len(ids)
                cols += ids
                self.at.append((r, j, j - i))
                self.gold.append(next((KINDS.index(k) + 1 for k, a, b in spans if (a, b) == (i, j)), 0))
        self.rows, self.cols, self.where = np.array(rows), np.array(cols), tuple(np.array(self.at).T)
        self.gold = np.array(self.gold)
        self.n = np.array([len(x.tokens) for x in found])
        self.long = int(self.n.max())
        self.steps = self._steps(gold)

    def _steps(self, gold: list[set]) -> np.ndarray:
        """How often each kind of segment follows each in the segmentations that are right."""
        out = np.zeros((len(KINDS) + 1,) * 2)
        for n, spans in zip(self.n, gold, strict=True):
            t, last, starts = 0, 0, {a: (b, KINDS.index(k) + 1) for k, a, b in spans}
            while t < n:
                t, kind = starts.get(t, (t + 1, 0))
                out[last, kind] += 1
                last = kind
        return out

    def gradient(self, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Logarithm of the likelihood, and its slopes by weights and steps."""
        kinds, many = len(KINDS) + 1, len(self.n)
        own = np.zeros((len(self.at), kinds - 1))
        np.add.at(own, self.rows, weights[self.cols])
        score = np.full((many, self.long + 1, TOKENS + 1, kinds), -np.inf)
        score[:, 1:, 1, 0] = 0
        score[self.where + (slice(1, None),)] = own
        ahead = np.full((many, self.long + 1, kinds), -np.inf)  # sums over segmentations up to a place whose last segment is of a kind
        ahead[:, 0, 0] = 0
        enter = np.full((many, self.long + 1, kinds), -np.inf)  # the same, and a segment of a kind begins there
        for t in range(self.long + 1):
            if t:
                most = min(t, TOKENS)
                ahead[:, t] = _sum(enter[:, t - most : t][:, ::-1] + score[:, t, 1 : most + 1], 1)
            enter[:, t] = _sum(ahead[:, t, :, None] + steps[None], 1)
        every = np.arange(many)
        total = _sum(ahead[every, self.n], 1)
        behind = np.full((many, self.long + 1, kinds), -np.inf)  # sums over what follows a segment of a kind that ends at a place
        behind[every, self.n] = 0
        slope = np.zeros_like(steps)
        for t in range(self.long - 1, -1, -1):
            most = min(self.long - t, TOKENS)
            lengths = np.arange(1, most + 1)
            begun = _sum(score[:, t + lengths, lengths] + behind[:, t + lengths], 1)
            both = steps[None] + begun[:, None]
            slope += np.exp(ahead[:, t, :, None] + both - total[:, None, None]).sum(0)
            behind[:, t] = np.where((self.n == t)[:, None], behind[:, t], _sum(both, 2))
        r, j, length = self.where
        chance = np.exp(enter[r, j - length, 1:] + own + behind[r, j, 1:] - total[r, None])
        right = np.zeros_like(chance)
        right[np.flatnonzero(self.gold), self.gold[self.gold > 0] - 1] = 1
        up = np.zeros_like(weights)
        np.add.at(up, self.cols, (right - chance)[self.rows])
        likelihood = (own * right).sum() + (steps * self.steps).sum() - total.sum()
        return float(likelihood), up, self.steps - slope


def lattice(texts: list[tuple[str, list]], names: dict[str, int]) -> Lattice:
    found, gold = [], []
    for text, spans in texts:
        for region in regions(text):
            starts, ends = ({p: k for k, p in enumerate(side)} for side in zip(*region.tokens, strict=True)) if region.tokens else ({}, {})
            found.append(region)
            gold.append({(kind, starts[a], ends[b] + 1) for kind, a, b in spans if a in starts and b in ends})
    return Lattice(found, gold, names)


@functools.lru_cache(maxsize=1)
def fitted(seed: int = 5) -> Model:
    """The model of the greatest likelihood (less DECAY times the squares) of SENTENCES invented sentences: always the same one."""
    rng, names = random.Random(seed), {}
    given = lattice([sentence(rng) for _ in range(SENTENCES)], names)
    kinds = len(KINDS) + 1
    values = np.zeros((len(names) * (kinds - 1) + kinds * kinds))
    mean, square = np.zeros_like(values), np.zeros_like(values)
    split = len(names) * (kinds - 1)
    for p in range(1, PASSES + 1):
        _, up, slope = given.gradient(values[:split].reshape(-1, kinds - 1), values[split:].reshape(kinds, kinds))
        up = np.concatenate([up.ravel(), slope.ravel()]) - 2 * DECAY * values
        mean, square = 0.9 * mean + 0.1 * up, 0.98 * square + 0.02 * up * up
        values += 0.3 * (mean / (1 - 0.9**p)) / (np.sqrt(square / (1 - 0.98**p)) + 1e-8)
    return Model(names, values[:split].reshape(-1, kinds - 1), values[split:].reshape(kinds, kinds))


def all_spans(text: str, model: Model) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind and start: the base spans, and the model's that overlap none of them."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    out = [(*s, True) for s in base]
    for kind, a, b in model.spans(text):
        at = int(np.searchsorted(starts, b, "left"))
        if not at or reach[at - 1] <= a:
            out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of each row: all personal data in its text, by kind (in the order of KINDS), then start.

    A span has its kind, its first code point, its end (exclusive) and whether a base pattern gives it.  A null or empty
    text has none; a text of any length is read whole; spans of one kind never overlap.  Null keys and repeated rows are rows
    like others; an empty table gives none; other columns, whatever their names, are left out.  One scan, no shuffle; the model's
    weights, some thousand numbers, go with the tasks.
    """
    model = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found, many = [], 0
            begin = 0
            for i in range(batch.num_rows):
                value = texts[i].as_py()
                found.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in all_spans(value, model)] if value else [])
                many += len(found[-1])
                if many > 100_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(found)), pa.array(found, _SPAN)], ["key", "spans"])
                    begin, found, many = i + 1, [], 0

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(run), f"key {kind}, spans {SPANS}").select(F.col("key").alias(key), "spans")


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
